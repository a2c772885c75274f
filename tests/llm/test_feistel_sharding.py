import zlib

import pytest
from pyspark.sql import functions as F

from engrama.llm.feistel_sharding import Permutation, shard

from .helpers import documents, hostile_texts


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4099])
def test_permutation_and_its_inverse(spark, n):
    p = Permutation(n, 5)
    to = [p.of(i) for i in range(n)]
    assert sorted(to) == list(range(n))
    assert [p.inverse(y) for y in to] == list(range(n))
    assert [r[0] for r in spark.range(n).coalesce(1).select(p.column(F.col("id"))).collect()] == to
    assert all(p.number_at(*p.place(i, 8), 8) == i for i in range(n))


def test_shards(spark):
    texts = hostile_texts()
    docs = documents(spark, texts)
    got = shard(docs).collect()
    assert len(got) == docs.count()
    by_shard = {}
    for r in got:
        body = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(body) + 1, zlib.crc32(body), "rows", None)
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert set(by_shard) == set(range(8)) and max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    again = shard(docs.repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_small_and_empty(spark):
    assert shard(documents(spark, [])).count() == 0
    got = shard(documents(spark, ["a", None], repeat=False)).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (1, 0)]
