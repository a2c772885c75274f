"""Byte strings that occur elsewhere, by merging Burrows-Wheeler transforms.

The segments of a class (see ``repeats``) have its anchor at a known place, so
they are transformed in step, column by column from the left: the positional
form of the transform. Column k of a shard's transform has the k-th byte of each
segment of the shard, in the order of what precedes it, read backwards. A shard
holds SHARD segments.

Shards are merged by refining an interleave, the sequence that says for each
place of the merged order from which shard it comes. At first it tells classes
apart only; a round reads column k of all shards through it and partitions it
stably by the bytes read. Texts are not looked at and nothing is sorted again:
the order within a shard is the shard's own. For neighbours that a round leaves
together it is known where their common run began. The places of neighbours
whose run has reached ``length`` bytes are a repeated interval: their windows
that end at this column are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from engrama.llm.repeats import Runs, Segments, Unit, remove_repeats

LENGTH = 400
GRAM = 48
#: Segments of a shard.
SHARD = 512
ABSENT = 256


@dataclass(frozen=True)
class Transform:
    """Of a shard: by place the class, at first the segment, and by column the bytes in the order of that column."""

    owner: np.ndarray
    segment: np.ndarray
    columns: np.ndarray


def _aligned(segments: Segments, members: np.ndarray, before: int, width: int) -> np.ndarray:
    """Bytes by column and member, with the classes' anchors in column ``before``; ABSENT where a segment has none."""
    body = segments.body.take(pa.array(members)).cast(pa.large_binary())
    offsets = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
    data = np.frombuffer(body.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(members)), lengths)
    column = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], lengths) + np.repeat(before - segments.lead[members], lengths)
    out = np.full((width, len(members)), ABSENT, np.int16)
    out[column, row] = data
    return out


def _partition(owner: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """A stable order by class and symbol."""
    return np.argsort(owner * (ABSENT + 1) + symbols, kind="stable")


def transform(segments: Segments, members: np.ndarray, owner: np.ndarray, before: int, width: int) -> Transform:
    """The transform of the shard that holds these segments."""
    members = members[np.argsort(owner[members], kind="stable")]
    columns = _aligned(segments, members, before, width)
    own, order = owner[members], np.arange(len(members))
    for k in range(width):
        columns[k] = columns[k, order]
        order = order[_partition(own, columns[k])]
    return Transform(own, members, columns)


def merge(shards: list[Transform]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rounds of the merge: by place the segment, and the column where its common run with the place above begins."""
    source = np.repeat(np.arange(len(shards), dtype=np.int16), [len(s.owner) for s in shards])
    first = np.argsort(np.concatenate([s.owner for s in shards]), kind="stable")
    interleave, segment = source[first], np.concatenate([s.segment for s in shards])[first]
    owner = np.sort(np.concatenate([s.owner for s in shards]))
    run = np.zeros(len(segment), np.int64)
    for k in range(len(shards[0].columns)):
        symbols = np.empty(len(segment), np.int16)
        symbols[np.argsort(interleave, kind="stable")] = np.concatenate([s.columns[k] for s in shards])
        move = _partition(owner, symbols)
        interleave, segment, symbols = interleave[move], segment[move], symbols[move]
        fresh = np.full(len(move), k + 1, np.int64)
        same = np.flatnonzero((owner[1:] == owner[:-1]) & (symbols[1:] == symbols[:-1]) & (symbols[1:] != ABSENT)) + 1
        above, here = move[same - 1], move[same]
        near = here == above + 1
        fresh[same[near]] = run[here[near]]
        if not near.all():  # the run of two places is the shortest between them
            far = ~near
            bounds = np.stack([above[far] + 1, here[far] + 1], axis=1).reshape(-1)
            fresh[same[far]] = np.maximum.reduceat(np.append(run, 0), bounds)[::2]
        run = fresh
        yield segment, run


def repeated(segments: Segments, length: int) -> Runs:
    """Repeated starts of the segments: the repeated intervals of their shards' merged transforms.

    An interval is repeated if it has two places, or one whose segment has copies.
    """
    n = len(segments.anchor)
    if not n:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    owner = np.unique(segments.anchor, return_inverse=True)[1]
    before = int(segments.lead.max())
    width = int((before - segments.lead + segments.starts).max()) + length - 1
    first = before - segments.lead
    by_class = np.argsort(owner, kind="stable")
    shards = [transform(segments, by_class[i : i + SHARD], owner, before, width) for i in range(0, n, SHARD)]
    twice = np.zeros((n, int(segments.starts.max()) + 1), bool)  # the last column ends every run
    for k, (segment, run) in enumerate(merge(shards)):
        start = k - length + 1
        if start < 0:
            continue
        shared = run <= start
        shared[:-1] |= shared[1:]
        shared |= segments.copies[segment] > 1
        hit = segment[shared]
        at = start - first[hit]
        inside = (at >= 0) & (at < segments.starts[hit])
        twice[hit[inside], at[inside]] = True
    edges = np.diff(twice.astype(np.int8), axis=1, prepend=0)
    begin, end = np.nonzero(edges == 1), np.nonzero(edges == -1)
    return begin[0], begin[1], end[1] - 1


def drop_repeated_bytes(docs: DataFrame, length: int = LENGTH, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``row_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    A byte goes if a string of ``length`` bytes that covers it also starts
    anywhere else in the corpus. A null text is empty; matches don't cross
    documents; repeated rows are copies of each other. Very long texts are
    worked on whole, a text at a time. An empty table gives no rows.
    """
    gram = min(GRAM, max(1, length // 4))
    return remove_repeats(docs, Unit(length, gram, words=False), repeated, row_id, text, "n_bytes")
