"""Reproducible shuffle into shards by a keyed permutation of row numbers.

Rows get global numbers 0..N-1 in an order that depends on the rows alone. A
Feistel network over a x b >= N permutes the numbers; a value outside 0..N-1
walks on along its cycle until it is inside. Shard and slot follow from the
permuted number by division, so either can be computed, and inverted, for any
row number without looking at the data.

Law: ``rows`` - shard sizes differ by one row at most.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engrama.llm.columns import let, whole
from engrama.llm.shared import stash

#: A prime below 2**31: products of two residues stay inside a long.
PRIME = 2_147_483_629
ROUNDS = 6


def _div(x: Column, by: int) -> Column:
    """Whole-number division of longs."""
    return F.call_function("div", x, F.lit(by).cast("long"))


@dataclass(frozen=True)
class Permutation:
    """A keyed permutation of 0..n-1. Python ints and Columns give the same values."""

    n: int
    key: int = 0

    @property
    def sides(self) -> tuple[int, int]:
        """a and b with a * b >= n, and less than a values to walk over."""
        a = max(1, math.isqrt(max(self.n - 1, 0)) + 1)
        return a, max(1, -(-self.n // a))

    def constants(self, r: int) -> tuple[int, int, int]:
        """Multipliers and an offset of round r, from the key."""
        x, out = (self.key * 2_862_933_555_777_941_757 + r * 3_037_000_493 + 1) % 2**64, []
        for _ in range(3):
            x = (x * 6_364_136_223_846_793_005 + 1_442_695_040_888_963_407) % 2**64
            out.append((x >> 33) % (PRIME - 1) + 1)
        return tuple(out)

    def mix(self, x, r: int):
        """The round function: a quadratic polynomial modulo PRIME."""
        p, q, c = self.constants(r)
        return ((x * p + c) % PRIME * ((x * q + p) % PRIME)) % PRIME

    def step(self, left, right):
        """One pass of the network over the two halves."""
        a, b = self.sides
        for r in range(ROUNDS):
            if r % 2 == 0:
                left = (left + self.mix(right, r)) % a
            else:
                right = (right + self.mix(left, r)) % b
        return left, right

    def back(self, left: int, right: int) -> tuple[int, int]:
        a, b = self.sides
        for r in reversed(range(ROUNDS)):
            if r % 2 == 0:
                left = (left - self.mix(right, r)) % a
            else:
                right = (right - self.mix(left, r)) % b
        return left, right

    def of(self, x: int) -> int:
        """Where number x goes."""
        _, b = self.sides
        while True:
            left, right = self.step(*divmod(x, b))
            if (x := left * b + right) < self.n:
                return x

    def inverse(self, y: int) -> int:
        """The number that goes to y."""
        _, b = self.sides
        while True:
            left, right = self.back(*divmod(y, b))
            if (y := left * b + right) < self.n:
                return y

    def column(self, number: Column) -> Column:
        """``of`` over a column of longs.

        A walk meets each value outside 0..n-1 once at most, so as many further
        steps as there are such values always suffice. Only the rows that land
        outside (one in sqrt(n)) evaluate them.
        """
        a, b = self.sides
        outside = a * b - self.n

        def once(x: Column) -> Column:
            halves = F.struct(_div(x, b).alias("l"), (x % b).alias("r"))
            for r in range(ROUNDS):
                halves = let(halves, turned(r))
            return let(halves, lambda h: h["l"] * b + h["r"])

        def turned(r: int):
            if r % 2 == 0:
                return lambda h: F.struct(((h["l"] + self.mix(h["r"], r)) % a).alias("l"), h["r"].alias("r"))
            return lambda h: F.struct(h["l"].alias("l"), ((h["r"] + self.mix(h["l"], r)) % b).alias("r"))

        first = once(number)
        if not outside:
            return first
        walk = lambda y: F.aggregate(F.sequence(F.lit(1), F.lit(outside)), y, lambda z, _: F.when(z < self.n, z).otherwise(once(z)))
        return let(first, lambda y: F.when(y < self.n, y).otherwise(walk(y)))

    def place(self, number: int, shards: int) -> tuple[int, int]:
        """Shard and slot of a row number."""
        y = self.of(number)
        return y % shards, y // shards

    def number_at(self, shard: int, slot: int, shards: int) -> int:
        """The row number in a slot of a shard."""
        return self.inverse(slot * shards + shard)


def numbered(rows: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with a long ``number``, 0..N-1 in the given order.

    Rows that tie in ``order`` should be alike: they get neighbouring numbers
    in any order. A hot key is dealt over several ranges, because the position
    in the input breaks ties. The sorted rows are written once, so that the
    counts and the numbers see the same ranges; what meets in one task is one
    count per range.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    keys = [F.col(c) for c in (*order, "__tie")]
    ranged = tied.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("__tie")
    held = stash(ranged.withColumn("__at", F.monotonically_increasing_id()))
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = held.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__start"))  # a row per range: as many as shuffle partitions
    return held.withColumn("__part", part).join(F.broadcast(starts), "__part").select(*rows.columns, (F.col("__start") + within).alias("number"))


def shard(docs: DataFrame, shards: int = 8, key: int = 0, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` per row.

    ``size`` is the UTF-8 length of the text plus 1, null counting as empty.
    Row numbers follow (row_id, text hash), nulls first; repeated rows are
    alike and take neighbouring numbers. An empty table gives no rows. Under
    the law ``rows``, ``grown_shard`` is null. Texts stay in the scan: 40 bytes
    per row are sorted.
    """
    body = whole(docs[text])
    slim = docs.select(docs[row_id].alias(row_id), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("__hash"))
    rows = numbered(slim, [row_id, "__hash"])
    n = rows.count()
    to = Permutation(n, key).column(F.col("number"))
    placed = rows.withColumn("__to", to)
    return placed.select(
        row_id,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("__to") % shards).cast("int").alias("shard"),
        _div(F.col("__to"), shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
