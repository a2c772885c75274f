"""Short codes of vectors: per part of a vector the nearest entry of a codebook, found with a vector-approximation file.

Vectors become integers and are cut into equal parts; every part position has a
codebook, refined by rounds of assignment and means. All arithmetic is on integers, so
the result hangs neither on the order of rows nor on the machine.

The search for the nearest entry is a VA-file: the entries' coordinates are quantised
to a few bits, a cell, each. A query makes two tables, the least and the greatest
squared distance to every cell of every dimension; summing what an entry's cells
have there (a product with the cells' indicator matrix, exact in doubles) bounds the
distance to the entry from below, and the upper bound of the likeliest entry rules
out all entries that begin beyond it. Only the others get integer distances.

What the driver sees, and each task is sent, are codebooks: at most ENTRIES times
the length of a vector. Sums are made in tasks and combined by a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.llm.hashing import thrifty
from engrama.llm.shared import broadcast_if, drop, stash

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Integer steps of a unit.
SCALE = 1024
#: Bits of a cell; queries that are worked on at once; components beyond are taken as this, so that sums of squares are exact.
BITS, LOAD, FURTHEST = 4, 2048, 1 << 22
#: Labels that are sent to every task; beyond, they are joined.
BROADCAST_LABELS = 200_000


class Entries:
    """A codebook of one part with its cells."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        n, width = entries.shape
        cells = 1 << bits
        rank = np.empty((n, width), np.int64)
        np.put_along_axis(rank, entries.argsort(axis=0, kind="stable"), np.arange(n)[:, None], axis=0)
        self.cell = rank * cells // n
        at = (np.arange(width)[None], self.cell)
        self.low, self.high = np.full((width, cells), FURTHEST * 2), np.full((width, cells), -FURTHEST * 2)
        np.minimum.at(self.low, at, entries)
        np.maximum.at(self.high, at, entries)
        self.holds = np.zeros((width, cells, n))
        self.holds[np.arange(width)[:, None], self.cell.T, np.arange(n)[None]] = 1
        self.holds = self.holds.reshape(width * cells, n)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of each row's nearest entry (of equals the least), its squared distance, and how many distances were taken."""
        n, width = x.shape
        wide = x[:, :, None]
        short = np.maximum(np.maximum(self.low - wide, wide - self.high), 0).astype(float)
        lower = (short * short).reshape(n, -1) @ self.holds
        cell = self.cell[lower.argmin(axis=1)]
        column = np.arange(width)
        far = np.maximum(np.abs(x - self.low[column, cell]), np.abs(x - self.high[column, cell]))
        query, entry = np.nonzero(lower <= (far * far).sum(axis=1)[:, None])
        apart = x[query] - self.entries[entry]
        distance = (apart * apart).sum(axis=1)
        begins = np.searchsorted(query, np.arange(n))
        least = np.minimum.reduceat(distance, begins)
        # entries ascend within a query: the first that reaches the minimum
        hit = np.flatnonzero(distance == least[query])
        return entry[hit[np.searchsorted(query[hit], np.arange(n))]], least, len(query)


def _parts(batch: pa.RecordBatch, width: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Rows and their components, some at a time."""
    flat = np.asarray(batch.column("components").flatten()).astype(np.int64).reshape(batch.num_rows, PARTS * width)
    for a in range(0, batch.num_rows, LOAD):
        yield slice(a, a + LOAD), flat[a : a + LOAD]


def _sums(books: np.ndarray):
    """Per task, what every entry's parts add up to: part, entry, position, n, total."""
    _, entries, width = books.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Entries(b) for b in books]
        count, total = np.zeros((PARTS, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for _, x in _parts(batch, width):
                for p in range(PARTS):
                    at = own[p].nearest(x[:, p * width : (p + 1) * width])[0]
                    count[p] += np.bincount(at, minlength=entries)
                    np.add.at(total[p], at, x[:, p * width : (p + 1) * width])
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(a, width).astype(np.int32)) for a in (part, entry)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(part))), pa.array(np.repeat(count[part, entry], width)), pa.array(total[part, entry].reshape(-1))], names=["part", "entry", "position", "n", "total"])

    return summed


def _codes(books: np.ndarray):
    """Rows with their code and its squared distance."""
    width = books.shape[2]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Entries(b) for b in books]
        for batch in batches:
            code, error = np.zeros((batch.num_rows, PARTS), np.uint8), np.zeros(batch.num_rows, np.int64)
            for rows, x in _parts(batch, width):
                for p in range(PARTS):
                    code[rows, p], near, _ = own[p].nearest(x[:, p * width : (p + 1) * width])
                    error[rows] += near
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return coded


def integers(vectors: DataFrame, row_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``id``, ``label``, ``components`` of the rows whose vector has neither null nor infinite nor undefined components."""
    v = vectors[vector]
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    step = lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(-float(FURTHEST))), F.lit(float(FURTHEST)))).cast("int")
    filled = F.concat(F.transform(v, step), F.array_repeat(F.lit(0), F.pmod(-F.size(v), F.lit(PARTS))))
    return vectors.filter(sound).select(vectors[row_id].alias("id"), vectors[label].alias("label"), filled.alias("components"))


def train(rows: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, position) of ``integers``' rows: they start as the parts of the least ids and move to the means of what is nearest to them."""
    first = [r.components for r in rows.select("id", "components").orderBy(F.col("id").asc_nulls_last(), "components").limit(ENTRIES).collect()]
    wide = len(first[0]) // PARTS if first else 0
    alike = [c for c in first if len(c) == PARTS * wide]
    books = np.array(alike, np.int64).reshape(len(alike), PARTS, wide).swapaxes(0, 1)
    for _ in range(rounds if books.size else 0):
        parts = rows.filter(F.size("components") == PARTS * wide).select("components").mapInArrow(thrifty(_sums(books)), "part int, entry int, position int, n long, total long")
        for r in parts.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            books[r.part, r.entry, r.position] = r.total // r.n
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``id``, ``label``, ``code`` (two hex digits per part) and ``error`` of ``integers``' rows."""
    fitting = rows.filter(F.size("components") == PARTS * books.shape[2])
    kinds = rows.schema
    out = f"id {kinds['id'].dataType.simpleString()}, label {kinds['label'].dataType.simpleString()}, code string, error long"
    if not books.size:
        return fitting.select("id", "label", F.lit("00" * PARTS).alias("code"), F.lit(0).cast("long").alias("error"))
    return fitting.mapInArrow(thrifty(_codes(books)), out)


def compress(vectors: DataFrame, row_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per row: ``row_id``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256``.

    Each component x becomes floor(1024 x); the four parts of a vector are coded by
    codebooks of 256 entries, trained in four rounds on all rows. ``error`` is the
    squared distance to the entries, ``label_error`` its sum over equal labels (nulls
    are one label; null if it is no long). Ties go to the lower entry.

    Rows whose vector is null or has null, infinite or undefined components are dropped, and so
    are those of another length than that of the least id. Components beyond +-4096 are
    taken as that; a length that four doesn't divide is filled up with zeros; vectors without
    components get code 00000000 and error 0. Null ids count as the greatest; repeated rows
    are coded each. An empty table gives no rows. Other columns have no effect.
    """
    rows = stash(integers(vectors, row_id, vector, label))
    books = train(rows)
    coded = stash(encode(rows, books))
    drop(rows)
    sums = stash(coded.groupBy(F.col("label").alias("of")).agg(F.expr("try_cast(sum(cast(error as decimal(38, 0))) as bigint)").alias("label_error")))
    joined = coded.join(broadcast_if(sums, sums.count(), BROADCAST_LABELS), F.col("label").eqNullSafe(F.col("of")))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return joined.select(F.col("id").alias(row_id), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
