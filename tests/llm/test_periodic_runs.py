import random
import zlib

import numpy as np
import pytest

from engrama.llm.periodic_runs import collapse, looped, runs
from engrama.llm.queries import runs_digest

from .helpers import documents, hostile_texts, sha, words


def naive(w):
    """All runs: every period, every stretch of equal words, longest stretches of the smallest period."""
    best = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                best.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in best.items())


def dropped(w, found):
    return {i for s, n, q in found for i in range(s + q, s + n)}


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def found(texts):
    values = np.array([zlib.crc32(x.encode()) for t in texts for x in t], np.uint64)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    out = [[] for _ in texts]
    for t, s, n, q in runs(values, first).tolist():
        out[t].append((s, n, q))
    return out


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "abcdefgh"])
def test_equals_all_periods(letters, monkeypatch):
    from engrama.llm import periodic_runs

    rng = random.Random(len(letters))
    texts = [[]]
    for _ in range(300):
        t = []
        while len(t) < rng.randint(0, 120):
            word = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
            t += (word * rng.randint(1, 9))[: rng.randint(1, 60)]
        texts.append(t)
    expected = [naive(t) for t in texts]
    assert sum(map(len, expected)) > 50
    assert found(texts) == expected
    monkeypatch.setattr(periodic_runs, "LOAD", 7)
    monkeypatch.setattr(periodic_runs, "FIRST_CHUNK", 1)
    assert found(texts) == expected


def test_nested_runs():
    inner = list("ab" * 4 + "c")
    for t in (inner * 5, list("aaaaaab") * 6, list("x") + inner * 4 + list("ab") * 9, list("a") * 5000, (list("ab") * 50 + list("q")) * 40):
        assert found([t]) == [naive(t)]


def test_rows(spark):
    texts = hostile_texts() + ["la " * 5 + "lo", "a b " * 5000, "x y z " * 3 + "x y"]
    docs = documents(spark, texts)
    got = collapse(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        w = words(texts[r.doc_id])
        expected = naive(w) if len(w) < 2000 else found([w])[0]
        assert [tuple(x) for x in r.runs] == expected and r.n_words == len(w)
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in dropped(w, expected))
    assert collapse(docs.limit(0)).count() == 0
    assert collapse(docs.selectExpr("cast(null as long) as doc_id", "text")).count() == len(got)


def test_digest(spark):
    texts = [f"w{i % 7} " * (i % 40) + " ".join(f"v{(i * k) % 11}" for k in range(i % 90)) for i in range(200)] + [None, ""]
    docs = documents(spark, texts, repeat=False)
    rows = {r.doc_id: r for r in runs_digest(docs).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        w = planted(i, words(t))
        expected, r = naive(w), rows[i]
        best = min(expected, key=lambda x: (-x[1], x[0], x[2]), default=None)
        told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(expected), *told)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in expected))
        assert r.collapsed_sha256 == sha(" ".join(x for k, x in enumerate(w) if k not in dropped(w, expected)))


def test_loops_stay_out_of_null_rows(spark):
    rows = spark.createDataFrame([(None, "a b"), (3, None), (4, "  ")], "doc_id long, text string")
    assert {(r.doc_id, r.t) for r in rows.select("doc_id", looped(rows.doc_id, rows.text).alias("t")).collect()} <= {(None, "a b"), (3, None), (3, ""), (4, "  "), (4, "")}
