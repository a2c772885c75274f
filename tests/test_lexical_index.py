import random

import pytest
from pyspark.sql import functions as F

from engrama.operators import lexical, lexical_index
from engrama.operators.lexical_index import Index, Search, build, refresh


def notes_of(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id string, text string")


def some_texts(n, seed=1, first=0):
    rng = random.Random(seed)
    words = [a + b for a in "bcdfglmnprst" for b in ("alo", "ero", "ino", "otu", "uma")]
    weights = [1 / (i + 1) for i in range(len(words))]
    return {f"n{first + i}": " ".join(rng.choices(words, weights, k=rng.choice([0, 3, 20, 60, 200]))) for i in range(n)}


def queries_of(spark):
    return spark.createDataFrame([(1, "balo cero"), (2, "tuma sotu tuma"), (3, "unknown"), (4, ""), (5, "balo bero bino botu buma calo")], "query_id long, q string")


def full(spark, texts, k):
    scores = lexical.bm25(notes_of(spark, texts), queries_of(spark), F.col("text"), F.col("q")).collect()
    out = {}
    for r in sorted(scores, key=lambda r: (r.query_id, -round(r.bm25, 9), r.id)):
        out.setdefault(r.query_id, []).append((r.id, round(r.bm25, 9), r.matched))
    return {q: rows[:k] for q, rows in out.items()}


def found(spark, index, k):
    out = {}
    for r in sorted(Search(index, queries_of(spark), F.col("q"), k).top().collect(), key=lambda r: (r.query_id, -round(r.bm25, 9), r.id)):
        out.setdefault(r.query_id, []).append((r.id, round(r.bm25, 9), r.matched))
    return out


@pytest.mark.parametrize("pushed", [True, False])
def test_equals_full_scoring(spark, tmp_path, monkeypatch, pushed):
    monkeypatch.setattr(lexical_index, "BLOCK", 8)
    if not pushed:
        monkeypatch.setattr(lexical_index, "MOST_TERMS", 0)
        monkeypatch.setattr(lexical_index, "MOST_BLOCKS", 0)
    texts = some_texts(500)
    index = build(notes_of(spark, texts), F.col("text"), f"file://{tmp_path}/i")
    for k in (1, 10):
        assert found(spark, index, k) == full(spark, texts, k)


def test_reads_only_blocks_that_can_win(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_index, "BLOCK", 8)
    texts = some_texts(3000) | {f"best{i}": "tuma sotu " * (5 + i) for i in range(12)}
    index = build(notes_of(spark, texts), F.col("text"), f"file://{tmp_path}/i")
    asked = queries_of(spark).filter("query_id = 2")
    search = Search(index, asked, F.col("q"), 5)
    there = search.bounds.agg(F.sum("rows")).first()[0]
    read = search.wanted_blocks().agg(F.sum("rows")).first()[0]
    assert read < there / 4
    assert [r.id for r in search.top().orderBy(F.desc("bm25")).collect()] == [i for i, _, _ in full(spark, texts, 5)[2]]


def test_update_equals_new_build(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_index, "BLOCK", 8)
    old = some_texts(300)
    index = build(notes_of(spark, old), F.col("text"), f"file://{tmp_path}/i")
    assert refresh(index, notes_of(spark, old), F.col("text")).segments == [0]
    texts = dict(list(old.items())[30:]) | some_texts(100, seed=2, first=100) | some_texts(40, seed=3, first=1000)
    index = refresh(index, notes_of(spark, texts), F.col("text"))
    again = dict(list(texts.items())[:-5]) | some_texts(30, seed=4, first=120)
    assert found(spark, index, 10) == full(spark, texts, 10)
    index = Index(spark, refresh(index, notes_of(spark, again), F.col("text")).folder)
    assert index.segments == [0, 1, 2] and (index.notes, index.words) == (len(again), sum(len(t.split()) for t in again.values()))
    assert found(spark, index, 10) == full(spark, again, 10)


def test_no_notes(spark, tmp_path):
    index = build(notes_of(spark, {"a": ""}).limit(0), F.col("text"), f"file://{tmp_path}/i")
    assert found(spark, index, 3) == {}


def test_terms_are_counted_and_packed_where_their_note_is():
    from collections import Counter

    import pyarrow as pa

    from engrama.operators.lexical_index import _counted, _packed

    words = [["b", "a", "b"], [], None, ["c"], ["a", "a", "ü"]]
    batch = pa.RecordBatch.from_pydict({"id": [9, 2, 3, 4, 1], "content_hash": list("vwxyz"), "w": pa.array(words, pa.list_(pa.string()))})
    rows = pa.Table.from_batches(list(_counted(iter([batch, batch.slice(0, 0)]))))
    assert rows["dl"].to_pylist() == [3, 0, None, 1, 3]
    assert [dict(zip(t, n, strict=True)) for t, n in zip(rows["terms"].to_pylist(), rows["tfs"].to_pylist(), strict=True)] == [Counter(w or []) for w in words]
    found = {r["term"]: r for r in _packed(rows.append_column("block", pa.array([7] * 5, pa.int64()))).to_pylist()}
    assert set(found) == {"a", "b", "c", "ü"} and found["b"] == {"term": "b", "block": 7, "n": 1, "max_tf": 2, "min_dl": 3, "ids": [9], "tfs": [2], "dls": [3]}
    assert found["a"] == {"term": "a", "block": 7, "n": 2, "max_tf": 2, "min_dl": 3, "ids": [1, 9], "tfs": [2, 1], "dls": [3, 3]}
    assert _packed(rows.slice(1, 2).append_column("block", pa.array([7, 7], pa.int64()))).num_rows == 0
