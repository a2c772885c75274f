"""Word sequences that occur elsewhere, by suffix automata of reference shards.

The reference is every segment that may hold a repeat (see ``repeats``), each
different one once with its copies. A shard holds the segments of some classes.
Its suffix automaton counts, for every state, how often the strings of the state
occur; documents are streamed through it, and where the matching statistics
reach ``length`` words in a state of two occurrences or more, the window that
ends there is repeated.

A reference of up to BROADCAST_WORDS words is a few automata of a few MB; they
are sent to every task and whole documents are streamed through them, without a
shuffle of texts. A larger one stays where it was built, a shard a task, and of
the documents only the segments that share an anchor with a shard come to it:
the work grows with the corpus and not with corpus times shards. Both ways give
the same windows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.llm.hashing import thrifty
from engrama.llm.repeats import WORD, Runs, Segments, Unit, bodies_of, keyed, repeated_starts, shared_segments, spans_of, without
from engrama.llm.shared import drop, stash

LENGTH = 35
GRAM = 6
#: Words of a shard that is sent to every task, about, and of all that are: some 100 bytes a word.
SHARD_WORDS, BROADCAST_WORDS = 100_000, 500_000


class SuffixAutomaton:
    """Of several strings; ``times`` counts their occurrences by state."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.times = [-1], [0], [0]

    def _state(self, length: int, link: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(link)
        self.len.append(length)
        self.times.append(0)
        return len(self.len) - 1

    def _split(self, p: int, c, q: int) -> int:
        """A clone of q for the strings that p and c give."""
        clone = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.len[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return new

    def add(self, symbols: list, copies: int = 1) -> None:
        last = 0
        for c in symbols:
            last = self._extend(last, c)
            self.times[last] += copies

    def finish(self) -> None:
        """Each state's occurrences are also those of the state it links to."""
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.times[self.link[v]] += self.times[v]

    def repeated_ends(self, symbols: list, length: int) -> list[int]:
        """Where windows of ``length`` symbols end that occur twice or more."""
        out, v, matched = [], 0, 0
        for i, c in enumerate(symbols):
            while v and c not in self.next[v]:
                v = self.link[v]
                matched = self.len[v]
            if c in self.next[v]:
                v, matched = self.next[v][c], matched + 1
            while self.len[self.link[v]] >= length:
                v = self.link[v]
            matched = min(matched, self.len[v])
            if matched >= length and self.times[v] > 1:
                out.append(i)
        return out


def runs_of(ends: list[int], length: int) -> list[tuple[int, int]]:
    """First and last starts of windows that end at ``ends``, ascending."""
    out: list[tuple[int, int]] = []
    for end in ends:
        at = end - length + 1
        if out and out[-1][1] == at - 1:
            out[-1] = (out[-1][0], at)
        else:
            out.append((at, at))
    return out


def shard_of(bodies: list[bytes], copies: list[int]) -> SuffixAutomaton:
    """The automaton of these segments, occurrences counted."""
    shard = SuffixAutomaton()
    for body, n in zip(bodies, copies, strict=True):
        shard.add(WORD.findall(body.decode()), n)
    shard.finish()
    return shard


def match(segments: Segments, length: int) -> Runs:
    """Repeated starts of the segments, streamed through the automaton of the shard that they make up."""
    bodies = segments.body.to_pylist()
    shard = shard_of(bodies, segments.copies.tolist())
    out = [(i, a, b) for i, body in enumerate(bodies) for a, b in runs_of(shard.repeated_ends(WORD.findall(body.decode()), length), length)]
    segment, first, last = np.array(out, int).reshape(-1, 3).T
    return segment, first, last


def _built(rows: pa.Table) -> pa.Table:
    """A shard's segments to its automaton."""
    return pa.table({"shard": pa.array([pickle.dumps(shard_of(rows.column("body").to_pylist(), rows.column("n").to_pylist()))], pa.binary())})


def _streamed(shards, length: int) -> Callable:
    """Documents (key, text) through all shards to the runs of their repeated starts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [pickle.loads(x) for x in shards.value]
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = WORD.findall(text)
                if len(words) >= length:
                    ends = sorted({e for shard in automata for e in shard.repeated_ends(words, length)})
                    out += [(key, a, b) for a, b in runs_of(ends, length)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32())], names=["key", "a", "b"])

    return rows


def drop_repeated_words(docs: DataFrame, length: int = LENGTH, row_id: str = "doc_id", text: str = "text", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Per row: ``row_id``, ``n_words``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    A word goes if a window of ``length`` words that covers it also starts
    anywhere else in the corpus. A null text has no words; windows don't cross
    documents; repeated rows are copies of each other. Very long texts are
    streamed whole. An empty table gives no rows.
    """
    unit = Unit(length, min(GRAM, max(1, length // 4)), words=True)
    rows = keyed(docs, row_id, text)
    texts = rows.select("key", "text")
    places, kinds = shared_segments(texts, unit)
    reference = kinds.agg(F.sum(F.col("one.b") - F.col("one.a") + length)).first()[0] or 0
    if reference > broadcast_words:
        return without(rows, repeated_starts(texts, unit, match, places, kinds), unit, row_id, "n_words")
    count = max(1, -(-reference // SHARD_WORDS))
    built = bodies_of(kinds, texts, unit).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(count))).groupBy("shard").applyInArrow(_built, "shard binary")
    shards = docs.sparkSession.sparkContext.broadcast([bytes(r["shard"]) for r in built.collect()])
    drop(places, kinds)
    return without(rows, spans_of(stash(texts.mapInArrow(thrifty(_streamed(shards, length)), "key binary, a int, b int"))), unit, row_id, "n_words")
