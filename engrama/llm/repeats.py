"""Windows of a fixed length that the corpus has more than once, exactly.

A window of ``length`` symbols (bytes or words) belongs to its anchor: the
least of its ``gram``-symbol runs by hash, the leftmost of equals. Equal windows
have equal anchors at equal offsets, so only windows of one anchor value, its
class, need be compared. Consecutive windows with one anchor form a segment;
each window of the corpus lies in exactly one.

That is a filter, and a way to deal the work: an anchor that the corpus has
once holds no repeat. All other segments go to an engine, each different one
once with the number of its copies, and the engine finds the windows that the
class has twice. A class of more segments than CLASS is dealt over several
tasks, and its windows are counted across them by digest: those that are alone
in their task one by one, the others as repeated already.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.llm.hashing import RunHashes, chunks, thrifty, word_bounds, word_values
from engrama.llm.shared import drop, stash

#: Segments of one class that one task compares.
CLASS = 4000
#: Segments of small classes that share a task, about.
TASK = 3000
#: Windows of a large class that a task has listed at once, about.
LISTED = 50_000
_U = np.uint64
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Segments:
    """What an engine compares: by segment its class, content, anchor's place minus first start, number of starts, and copies."""

    anchor: np.ndarray
    body: pa.Array
    lead: np.ndarray
    starts: np.ndarray
    copies: np.ndarray


#: The repeated starts as runs: segment, first and last start counted from the segment's first.
Runs = tuple[np.ndarray, np.ndarray, np.ndarray]
Engine = Callable[[Segments, int], Runs]


@dataclass(frozen=True)
class Unit:
    """What a text is a sequence of."""

    length: int
    gram: int
    words: bool

    def values(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit value per symbol, and where each text's symbols begin."""
        if self.words:
            values, _, _, first = word_values(data, offsets)
            return values, first
        return data.astype(_U) + _U(1), offsets

    def symbols(self, text: str) -> list | bytes:
        return WORD.findall(text) if self.words else text.encode()

    def bounds(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each symbol begins and ends, and which is each text's first."""
        if self.words:
            return word_bounds(data, offsets)
        at = np.arange(len(data) + 1)
        return at[:-1], at[1:], offsets

    def pack(self, symbols: list | bytes) -> bytes:
        return " ".join(symbols).encode() if self.words else symbols

    def unpack(self, body: bytes) -> list | bytes:
        return WORD.findall(body.decode()) if self.words else body

    def join(self, parts: list) -> bytes:
        """Kept parts as bytes."""
        return " ".join([w for p in parts for w in p]).encode() if self.words else b"".join(parts)


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each ``width`` consecutive hashes stands, leftmost among equals in the upper bits."""
    n = len(hashes)
    low = _U((1 << max(1, (n - 1).bit_length())) - 1)
    best = (hashes & ~low) | np.arange(n, dtype=_U)
    span = 1
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < width:
        rest = width - span
        best = np.minimum(best[:-rest], best[rest:])
    return (best & low).astype(np.int64)


def segments(unit: Unit, data: np.ndarray, offsets: np.ndarray, digests: bool = True) -> tuple:
    """Of the texts of a chunk: text number, anchor value, first and last window start, anchor minus first start; and a digest each, if asked for."""
    values, first = unit.values(data, offsets)
    empty = np.zeros(0, np.int64)
    if len(values) < unit.length:
        return empty, empty, empty, empty, empty, []
    runs = RunHashes(values)
    at = np.arange(len(values) - unit.gram + 1)
    grams = runs.of(at, at + unit.gram)
    anchors = minimizers(grams, unit.length - unit.gram + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.flatnonzero(text[: len(anchors)] == text[unit.length - 1 :])
    if not len(starts):
        return empty, empty, empty, empty, empty, []
    anchor = anchors[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (text[starts[1:]] != text[starts[:-1]])
    head = np.flatnonzero(fresh)
    a, b = starts[head], starts[np.concatenate([head[1:], [len(starts)]]) - 1]
    own = first[text[a]]
    if not digests:
        return text[a], grams[anchor[head]].view(np.int64), a - own, b - own, anchor[head] - a, []
    raw = memoryview(np.ascontiguousarray(values if unit.words else data).view(np.uint8))
    wide = 8 if unit.words else 1
    digest = [hashlib.blake2b(raw[i * wide : (j + unit.length) * wide], digest_size=16).digest() for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    return text[a], grams[anchor[head]].view(np.int64), a - own, b - own, anchor[head] - a, digest


def _anchors(unit: Unit) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(segments(unit, data, offsets, digests=False)[1], pa.int64())], names=["anchor"])

    return rows


def _anchored(unit: Unit) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch.column(1)):
                text, value, a, b, lead, digest = segments(unit, data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text + row)), pa.array(value, pa.int64()), pa.array(digest, pa.binary()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(lead, pa.int32())], names=["key", "anchor", "digest", "a", "b", "lead"])

    return rows


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Pieces of ``data`` as a binary array."""
    lengths = ends - starts
    before = np.concatenate([[0], np.cumsum(lengths)])
    picked = data[np.repeat(starts - before[:-1], lengths) + np.arange(before[-1])] if len(starts) else data[:0]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(before.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(picked))]).cast(pa.binary())


_PLACE = ("anchor", "digest", "a", "b", "lead", "n")


def _fetched(unit: Unit) -> Callable:
    """(key, text, places) to the content of each place."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch.column("text")):
                own = batch.column("places").slice(row, len(offsets) - 1)
                places, of = own.flatten(), np.repeat(np.arange(len(own)), own.value_lengths().to_numpy())
                begin, end, first = unit.bounds(data, offsets)
                a, b = (places.field(c).to_numpy() for c in ("a", "b"))
                body = _cut(data, begin[first[of] + a], end[first[of] + b + unit.length - 1]) if len(of) else pa.array([], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(of + row)), *[places.field(c) for c in _PLACE], body], names=["key", *_PLACE, "body"])

    return rows


_FOUND = "key binary, anchor long, digest binary, n long, start int, first int, last int"
_COUNTED = "anchor long, window binary, times int, key binary, at int"


def _compared(unit: Unit, engine: Engine) -> Callable:
    """Segments of some classes to their repeated starts."""

    def table(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        column = lambda c: rows.column(c).to_numpy()
        body = rows.column("body").chunk(0) if rows.num_rows else pa.array([], pa.binary())
        segment, first, last = engine(Segments(column("anchor"), body, column("lead"), column("b") - column("a") + 1, column("n")), unit.length)
        own = rows.select(["key", "anchor", "digest", "n", "a"]).rename_columns(["key", "anchor", "digest", "n", "start"]).take(pa.array(segment))
        return own.append_column("first", pa.array(first, pa.int32())).append_column("last", pa.array(last, pa.int32()))

    return table


def _windows(unit: Unit) -> Callable:
    """Segments of split classes, with what is known to be repeated, to digests of their windows.

    A window known to be repeated has no place, counts twice and comes once a batch: it only tells the other tasks.
    """

    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int32())
    listed = lambda out: pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["anchor", "window", "times", "key", "at"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            told: set[tuple[int, bytes]] = set()
            for x, body, a, b, n, key, known in zip(*[batch.column(c).to_pylist() for c in ("anchor", "body", "a", "b", "n", "key", "known")], strict=True):
                symbols = unit.unpack(body)
                done = range(a, b + 1) if n > 1 else {p for k in known or () for p in range(k["a"], k["b"] + 1)}
                for p in range(a, b + 1):
                    window = hashlib.blake2b(unit.pack(symbols[p - a : p - a + unit.length]), digest_size=16).digest()
                    if p not in done:
                        out.append((x, window, 1, key, p))
                    elif (x, window) not in told:
                        told.add((x, window))
                        out.append((x, window, 2, None, None))
                if len(out) >= LISTED:
                    yield listed(out)
                    out = []
            if out:
                yield listed(out)

    return rows


def shared_segments(texts: DataFrame, unit: Unit) -> tuple[DataFrame, DataFrame]:
    """Places and kinds of the segments whose anchor the corpus has twice.

    Places: ``key``, ``anchor``, ``digest``, ``a``, ``b``, ``lead``. Kinds: ``anchor``, ``digest``, ``n`` places, ``one`` of them.
    """
    # most anchors are there once: a first pass over the texts finds the others, 8 bytes each
    shared = stash(texts.select("text").mapInArrow(thrifty(_anchors(unit)), "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"))
    places = stash(texts.mapInArrow(thrifty(_anchored(unit)), "key binary, anchor long, digest binary, a int, b int, lead int").join(shared, "anchor", "left_semi"))
    drop(shared)
    return places, stash(places.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "a", "b", "lead")).alias("one")))


def bodies_of(kinds: DataFrame, texts: DataFrame, unit: Unit) -> DataFrame:
    """``kinds`` with the content of one place each: ``key``, ``anchor``, ``digest``, ``a``, ``b``, ``lead``, ``n``, ``body``."""
    wanted = kinds.select("one.key", F.struct("anchor", "digest", "one.a", "one.b", "one.lead", "n").alias("place")).groupBy("key").agg(F.collect_list("place").alias("places"))
    once = texts.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])
    return once.join(wanted, "key").select("key", "text", "places").mapInArrow(thrifty(_fetched(unit)), "key binary, anchor long, digest binary, a int, b int, lead int, n long, body binary")


def compared(kinds: DataFrame, texts: DataFrame, unit: Unit, engine: Engine) -> tuple[DataFrame, DataFrame]:
    """Repeated starts of the kinds, class by class, and (key, a, b) of those that only a count across tasks finds."""
    classes = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).select("anchor", F.ceil(F.col("kinds") / CLASS).cast("int").alias("salts"))
    salted = bodies_of(kinds, texts, unit).join(classes, "anchor")
    segments = stash(salted.withColumn("salt", F.pmod(F.xxhash64("digest"), F.col("salts"))))
    tasks = max(1, -(-segments.count() // TASK))
    dealt = F.when(F.col("salts") == 1, F.pmod(F.xxhash64("anchor"), F.lit(tasks)).cast("string")).otherwise(F.concat_ws("/", F.col("anchor").cast("string"), "salt"))
    found = stash(segments.withColumn("task", dealt).groupBy("task").applyInArrow(_compared(unit, engine), _FOUND))
    large = segments.filter("salts > 1")
    if large.isEmpty():
        across = found.filter("false").select("key", F.col("first").alias("a"), F.col("last").alias("b"))
    else:
        known = found.filter("n = 1").groupBy("key").agg(F.collect_list(F.struct((F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last")).alias("b"))).alias("known"))
        counted = stash(large.join(known, "key", "left").mapInArrow(thrifty(_windows(unit)), _COUNTED))
        twice = counted.groupBy("anchor", "window").agg(F.sum("times").alias("times")).filter("times > 1").select("anchor", "window")
        across = stash(counted.filter("key is not null").join(twice, ["anchor", "window"]).select("key", F.col("at").alias("a"), F.col("at").alias("b")))
        drop(counted)
    drop(segments)
    return found, across


def repeated_starts(texts: DataFrame, unit: Unit, engine: Engine, places: DataFrame, kinds: DataFrame) -> DataFrame:
    """``key``, ``spans`` (array of a, b): starts of repeated windows, for texts (key, text) that have any.

    Equal keys mean equal texts; every row counts as a text of its own.
    ``places`` and ``kinds`` are those of ``shared_segments``, dropped when done.
    """
    found, across = compared(kinds, texts, unit, engine)
    once = found.filter("n = 1").select("key", (F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last")).alias("b"))
    copies = places.join(found.filter("n > 1").select("anchor", "digest", "first", "last"), ["anchor", "digest"]).select("key", (F.col("a") + F.col("first")).alias("a"), (F.col("a") + F.col("last")).alias("b")).distinct()
    hits = stash(once.union(copies).union(across))
    drop(places, kinds, found, across)
    return spans_of(hits)


def spans_of(hits: DataFrame) -> DataFrame:
    """(key, a, b) to ``key``, ``spans``."""
    return hits.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))


def _removed(unit: Unit, total: str) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"total": [], "removed": [], "spans": [], "kept": []}
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                symbols = unit.symbols(text)
                kept, at, gone, count = [], 0, 0, 0
                for s in spans or ():
                    a, b = s["a"], s["b"] + unit.length
                    if a > at or not count:  # a gap before it: another run
                        kept.append(symbols[at:a])
                        count += 1
                        gone += b - a
                        at = b
                    elif b > at:
                        gone += b - at
                        at = b
                kept.append(symbols[at:])
                out["total"].append(len(symbols))
                out["removed"].append(gone)
                out["spans"].append(count)
                out["kept"].append(hashlib.sha256(unit.join(kept)).hexdigest())
            arrays = [pa.array(v, pa.string() if c == "kept" else pa.int64()) for c, v in out.items()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names=["id", total, "n_removed", "n_spans", "kept_sha256"])

    return rows


def key_of(text):
    """A digest that stands for the text."""
    return F.unhex(F.md5(text))


def keyed(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    """``id``, ``text`` (empty for null) and ``key``, a digest that stands for it."""
    slim = docs.select(docs[row_id].alias("id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    return slim.withColumn("key", F.unhex(F.md5("text")))


def without(rows: DataFrame, spans: DataFrame, unit: Unit, row_id: str, total: str) -> DataFrame:
    """Per row of ``keyed``: ``row_id``, ``total`` symbols, ``n_removed``, ``n_spans``, ``kept_sha256``."""
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.join(spans, "key", "left").select("id", "text", "spans").mapInArrow(thrifty(_removed(unit, total)), f"id {kind}, {total} long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("id", row_id)


def remove_repeats(docs: DataFrame, unit: Unit, engine: Engine, row_id: str, text: str, total: str) -> DataFrame:
    """Per row: ``row_id``, ``total`` symbols, ``n_removed``, ``n_spans``, ``kept_sha256``."""
    rows = keyed(docs, row_id, text)
    texts = rows.select("key", "text")
    return without(rows, repeated_starts(texts, unit, engine, *shared_segments(texts, unit)), unit, row_id, total)
