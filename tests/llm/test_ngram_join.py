import random

import numpy as np
import pytest

from engrama.llm import ngram_join
from engrama.llm.ngram_join import extra, join_classes, links_between, prefix, slack

from .helpers import ASCII_LOWER, documents, hostile_texts, words


def shingles(text):
    w = [x.translate(ASCII_LOWER) for x in words(text)]
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def similar(a, b):
    return 100 * len(a & b) >= 85 * len(a | b)


def naive(rows):
    """(id, text) to (id, size, component): all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and similar(a, sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[find(i)] = min(name, least.get(find(i), name))
    return sorted(((name, len(sets[i]), name if not sets[i] else least.get(find(i))) for i, (name, _) in enumerate(rows)), key=str)


def rows_of(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in join_classes(frame).collect()), key=str)


def near_copies(seed, n):
    """Families of texts that differ in some words, with chains, common passages and short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    prose = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage = prose(40)
    out = []
    while len(out) < n:
        base = prose(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 20, 60, 150]))
        if rng.random() < 0.4:
            at = rng.randint(0, len(base))
            base[at:at] = passage
        for _ in range(rng.choice([1, 1, 3, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                base = copy
            out.append(" ".join(x.upper() if rng.random() < 0.2 else x for x in copy))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_all_pairs(spark, seed, monkeypatch):
    texts = near_copies(seed, 300) + hostile_texts(seed)
    if seed == 2:  # blocks of few members, no broadcast
        monkeypatch.setattr(ngram_join, "BLOCK", 400)
        monkeypatch.setattr(ngram_join, "TASK", 5000)
        monkeypatch.setattr(ngram_join, "BROADCAST_NODES", 0)
    docs = documents(spark, texts)
    expected = naive([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert len({c for _, _, c in expected}) < len(texts) - 50
    assert rows_of(docs) == expected


def test_prefixes_under_every_order_meet():
    """What linked sets have in common is in their prefixes, as much as the filters ask for."""
    rng = np.random.default_rng(3)
    checked = 0
    for _ in range(4000):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        lost = int(rng.integers(0, slack(len(a)) + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[lost:], rng.integers(0, 2**63, int(rng.integers(0, n // 5 + 1))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common < 85 * (len(a) + len(b) - common):
            continue
        checked += 1
        for order in range(3):
            shared = np.intersect1d(prefix(a, order), prefix(b, order))
            assert len(shared) > min(extra(len(a)), extra(len(b)))
            assert len(shared) >= max(1, extra(len(a)), extra(len(b)))
    assert checked > 500


def test_links_join_components_once():
    base = np.arange(100, dtype=np.uint64)
    sets = [np.sort(np.append(base, np.uint64(1000 + i))) for i in range(50)]
    shared = [np.array([7, 8 + i % 2], np.uint64) for i in range(50)]
    block = {"node": np.arange(50), "root": np.arange(50), "sets": sets, "met": shared}
    assert len(links_between(block, None)) == 49
    assert links_between(block | {"root": np.zeros(50, np.int64)}, None) == []
    assert links_between(block | {"met": [np.array([i], np.uint64) for i in range(50)]}, None) == []
    assert len(links_between(block | {"met": [x[1:] for x in shared]}, None)) == 48  # two components without a bucket in common


def test_large_family_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3000)
    rng = random.Random(9)
    base = [f"v{i}" for i in range(120)]
    texts = []
    for _ in range(400):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 6])):
            copy[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    docs = documents(spark, texts, repeat=False)
    assert rows_of(docs) == naive(list(enumerate(texts)))


def test_defined_cases(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id int, text string, node long, token long, digest string, n int")
    assert rows_of(frame([])) == []
    rows = [(None, "a b c d e"), (5, "A b C d e"), (5, "a b c d e"), (None, "q"), (None, None), (7, "  "), (8, None), (9, "É b c d e"), (4, "é b c d e"), (4, "é b c d e")]
    got = rows_of(frame([(i, t, 1, 2, "x", 3) for i, t in rows]))
    assert got == naive(rows)
