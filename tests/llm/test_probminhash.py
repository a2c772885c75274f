import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

import engrama.llm.probminhash as p
from engrama.llm.hashing import mixed

from .helpers import documents, hostile_texts, words


def similarity(a, b):
    """Probability Jaccard by its definition."""
    if not a or not b:
        return 0.0
    return sum(1 / sum(max(a[x] / a[d], b[x] / b[d]) for x in a.keys() | b.keys()) for d in a.keys() & b.keys())


def shingles(text):
    w = words(text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def brute(texts):
    sets = {t: shingles(t) for t in dict.fromkeys(texts)}
    root = {t: t for t in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations([t for t in sets if sets[t]], 2):
        if find(a) != find(b) and similarity(sets[a], sets[b]) >= 0.8:
            root[find(a)] = find(b)
    out = {}
    for i, t in enumerate(texts):
        out.setdefault(find(t) if sets[t] else ("blank", i), set()).add(i)
    return {i: (min(c), c) for c in out.values() for i in c}


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**62, 400).astype(np.uint64))
    a, b = (base[:360], np.ones(360, int)), (base[40:], rng.integers(1, 4, len(base) - 40))
    shares = []
    for i in range(30):
        x, y = p.signatures([(mixed(a[0] + np.uint64(i)), a[1]), (mixed(b[0] + np.uint64(i)), b[1])])
        shares.append((x == y).mean())
    exact = similarity(*[collections.Counter(dict(zip(s.tolist(), w.tolist()))) for s, w in (a, b)])
    assert p.probability_jaccard(a, b) == pytest.approx(exact)
    assert np.mean(shares) == pytest.approx(exact, abs=0.03)


@pytest.mark.parametrize(("block", "per_member", "pairs"), [(1000, 4, 20_000), (2, 4, 3), (5, 0, 20_000)])
def test_classes_equal_brute_force(spark, monkeypatch, block, per_member, pairs):
    monkeypatch.setattr(p, "BLOCK", block)
    monkeypatch.setattr(p, "PER_MEMBER", per_member)  # at 0 all likely pairs are left to the tasks that have the shingles
    monkeypatch.setattr(p, "PAIRS", pairs)
    rng = random.Random(9)
    texts = hostile_texts(n=25)
    base = [f"w{rng.randint(0, 999)}" for _ in range(150)]
    for _ in range(30):  # a chain that drifts away from where it began
        base = list(base)
        base[rng.randrange(150)] = f"x{rng.randint(0, 999)}"
        texts.append(" ".join(base))
    truth = brute(texts)
    docs = documents(spark, texts, repeat=False)
    got = {r.doc_id: (r.class_id, r.class_size) for r in p.classes(docs).collect()}
    assert got == {i: (least, len(c)) for i, (least, c) in truth.items()}
    kept = p.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({least for least, _ in truth.values()})


def test_likely_pairs_equal_all_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(p, "AGREE", 70)
    base = rng.integers(0, 2**16, p.SLOTS).astype(np.uint16)
    members = []
    for _ in range(40):
        signature = base.copy()
        changed = rng.random(p.SLOTS) < rng.choice([0.1, 0.3, 0.6])
        signature[changed] = rng.integers(0, 2**16, changed.sum())
        members.append((signature, p.bands(signature[None].astype(np.uint64))[0].view(np.int64), int(rng.integers(0, 12))))
    rows, truth = [], set()
    for bucket in {int(b) for _, bands, _ in members for b in bands}:
        for m, (signature, bands, root) in enumerate(members):
            if bucket in bands:
                rows.append((bucket, 0, 0, 0, m.to_bytes(2, "big"), bytes([root]), signature.tobytes(), bands.tolist()))
    for m in range(40):
        for n in range(m + 1, 40):
            if members[m][2] != members[n][2] and (members[m][1] == members[n][1]).any() and (members[m][0] == members[n][0]).sum() >= 70:
                truth.add((m.to_bytes(2, "big"), n.to_bytes(2, "big")))
    names = ["bucket", "i", "j", "side", "node", "root", "signature", "bands"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    table = pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
    monkeypatch.setattr(p, "PER_MEMBER", 1000)
    out = p._likely(table).to_pylist()
    assert len(out) == len(truth) > 20 and {tuple(sorted((r["u"], r["v"]))) for r in out} == truth
    monkeypatch.setattr(p, "PER_MEMBER", 0)
    assert all(r["u"] is None and r["bucket"] is not None for r in p._likely(table).to_pylist())
    assert p._likely(table.slice(0, 0)).num_rows == 0


def test_a_table_by_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    texts, ids = ([r[c] for r in rows.collect()] for c in ("text", "doc_id"))
    truth = {ids[i]: (ids[least], len(c)) for i, (least, c) in brute(texts).items()}
    assert {r.doc_id: (r.class_id, r.class_size) for r in p.classes(rows).collect()} == truth


def test_repeated_rows_are_one_class(spark):
    docs = documents(spark, ["a b c d e f", None, "a b c d e f"])
    assert sorted(map(tuple, p.classes(docs).collect())) == sorted([(0, 0, 5), (0, 0, 5), (2, 0, 5), (2, 0, 5), (2, 0, 5), (1, 1, 1)])
    assert sorted(r.doc_id for r in p.representatives(docs).collect()) == [0, 1]


def test_empty(spark):
    docs = documents(spark, [])
    assert p.classes(docs).count() == 0 and p.representatives(docs).count() == 0


def test_any_other_columns(spark):
    text = "a b c d e f g h i j"
    rows = spark.createDataFrame([(2, text, 1, 2, 3, 4.0, 5), (1, text, 9, 8, 7, 6.0, 5), (3, "other words", 0, 0, 0, 0.0, 0)], "doc_id long, text string, __id long, __node long, `row` long, `a.b` double, of long")
    got = p.representatives(rows)
    assert got.columns == rows.columns
    assert sorted(tuple(r) for r in got.collect()) == [(1, text, 9, 8, 7, 6.0, 5), (3, "other words", 0, 0, 0, 0.0, 0)]
