import collections
import random

import numpy as np
import pyarrow as pa
import pytest

import engrama.llm.repeats as repeats
import engrama.llm.bwt_merge as bwt
from engrama.llm.automata import SuffixAutomaton, drop_repeated_words, match
from engrama.llm.bwt_merge import drop_repeated_bytes

from .helpers import documents, hostile_texts, repeated_windows, sha, words


def expected(sequences, length, join):
    out = []
    for s, starts in zip(sequences, repeated_windows(sequences, length)):
        gone = sorted({i + k for i in starts for k in range(length)})
        spans = sum(1 for a, b in zip([-2, *gone], gone) if b != a + 1)
        left = set(gone)
        out.append((len(s), len(gone), spans, sha(join([x for i, x in enumerate(s) if i not in left]))))
    return out


@pytest.mark.parametrize(("length", "split"), [(35, None), (6, 3)])
def test_words(spark, monkeypatch, length, split):
    if split:
        monkeypatch.setattr(repeats, "CLASS", split)
    texts = hostile_texts()
    docs = documents(spark, texts)
    rows = [texts[r.doc_id] for r in docs.select("doc_id").collect()]
    truth = dict(zip([r.doc_id for r in docs.select("doc_id").collect()], expected([words(t) for t in rows], length, " ".join)))
    for broadcast_words in (0, 10**6):  # shards stay where they were built, or are sent to every task
        got = drop_repeated_words(docs, length, broadcast_words=broadcast_words).collect()
        assert len(got) == len(rows)
        for r in got:
            assert tuple(r)[1:] == truth[r.doc_id], r.doc_id


@pytest.mark.parametrize(("length", "split"), [(400, None), (60, 3), (25, None)])
def test_bytes(spark, monkeypatch, length, split):
    if split:
        monkeypatch.setattr(repeats, "CLASS", split)
    texts = hostile_texts()
    docs = documents(spark, texts)
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    truth = dict(zip(ids, expected([(texts[i] or "").encode() for i in ids], length, bytes)))
    got = drop_repeated_bytes(docs, length).collect()
    assert len(got) == len(ids)
    for r in got:
        assert tuple(r)[1:] == truth[r.doc_id], r.doc_id


def test_a_window_repeated_in_one_task_and_alone_in_another(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CLASS", 2)
    # three different segments each: two tasks, most often 2 + 1
    texts = [" ".join([f"a{g}x{i}", *(f"w{g}x{k}" for k in range(8)), f"z{g}x{i}"]) for g in range(12) for i in range(3)]
    docs = documents(spark, texts, repeat=False)
    for drop, length, cut, join in ((drop_repeated_words, 8, words, " ".join), (drop_repeated_bytes, 40, str.encode, bytes)):
        truth = expected([cut(t) for t in texts], length, join)
        limit = {"broadcast_words": 0} if drop is drop_repeated_words else {}
        assert [tuple(r)[1:] for r in drop(docs, length, **limit).orderBy("doc_id").collect()] == truth


def classes_of_segments(rng, n, length, symbols, join):
    """Segments of three classes around anchors of three symbols, many alike, and their repeated starts by brute force."""
    rows = []
    for i in range(n):
        anchor = i % 3
        before, after = ([rng.choice(symbols[:2]) for _ in range(rng.randint(0, 4))] for _ in range(2))
        rows.append((anchor, [*before, *[symbols[anchor]] * 3, *after], len(before), rng.choice([1, 1, 1, 2])))
    rows = [r for r in rows if len(r[1]) >= length]
    rows = [(*r, 1 + (i % 5 == 0)) for i, r in enumerate({(r[0], tuple(r[1]), r[2]): r for r in rows}.values())]
    rows = [(x, body, lead, copies) for x, body, lead, _, copies in rows]
    # windows of one class are at equal distances from its anchor
    count = collections.Counter()
    for x, body, lead, copies in rows:
        for p in range(len(body) - length + 1):
            count[x, p - lead, tuple(body[p : p + length])] += copies
    truth = {(i, p) for i, (x, body, lead, _) in enumerate(rows) for p in range(len(body) - length + 1) if count[x, p - lead, tuple(body[p : p + length])] > 1}
    column = lambda f: np.array([f(r) for r in rows], int)
    segments = repeats.Segments(column(lambda r: r[0]), pa.array([join(r[1]) for r in rows], pa.binary()), column(lambda r: r[2]), column(lambda r: len(r[1]) - length + 1), column(lambda r: r[3]))
    return segments, truth


def test_transforms_of_shards_are_merged(monkeypatch):
    rng = random.Random(8)
    for shard in (1, 3, 7, 1000):
        monkeypatch.setattr(bwt, "SHARD", shard)
        for _ in range(30):
            segments, truth = classes_of_segments(rng, rng.randint(1, 60), 5, [97, 98, 99], bytes)
            assert {(int(i), p) for i, a, b in zip(*bwt.repeated(segments, 5)) for p in range(a, b + 1)} == truth


def test_the_merged_order_is_that_of_all_segments_together(monkeypatch):
    rng = random.Random(9)
    segments, _ = classes_of_segments(rng, 80, 5, [97, 98, 99], bytes)
    owner = np.unique(segments.anchor, return_inverse=True)[1]
    before, members = int(segments.lead.max()), np.argsort(owner, kind="stable")
    width = int((before - segments.lead + segments.starts).max()) + 4
    shards = [bwt.transform(segments, members[i : i + 9], owner, before, width) for i in range(0, len(members), 9)]
    text = [bytes(before - lead) + body.as_py() + bytes(width) for body, lead in zip(segments.body, segments.lead.tolist())]
    for k, (segment, run) in enumerate(bwt.merge(shards)):
        read = [(owner[i], text[i][: k + 1][::-1]) for i in segment]
        assert all(a[0] <= b[0] for a, b in zip(read, read[1:]))
        for (x, a), (y, b), r in zip(read, read[1:], run[1:].tolist()):
            common = next((n for n, (p, q) in enumerate(zip(a, b)) if p != q or not p), k + 1) if x == y else 0
            assert k + 1 - r == common


def test_equal_segments_pass_through_the_engines():
    for engine in (bwt.repeated, match):
        segments = repeats.Segments(np.array([5, 5, 6]), pa.array([b"a b c d", b"x b c d", b"q r s t"], pa.binary()), np.array([2, 2, 2]), np.array([1, 1, 1]), np.array([3, 1, 2]))
        runs = engine(segments, 7 if engine is bwt.repeated else 4)
        assert [x.tolist() for x in runs] == [[0, 2], [0, 0], [0, 0]]


def test_automaton_counts():
    shard = SuffixAutomaton()
    for s in ("abab", "bab", "abab"):
        shard.add(list(s))
    shard.finish()
    assert shard.repeated_ends(list("xababab"), 4) == [4, 6]


def test_empty(spark):
    assert drop_repeated_words(documents(spark, [])).count() == 0
    assert drop_repeated_bytes(documents(spark, [])).count() == 0
