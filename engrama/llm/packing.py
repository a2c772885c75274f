"""Best-fit packing of documents into bins, under conflicts.

A bin holds up to ``capacity`` units. It must not hold two documents of one
duplicate cluster, nor more than ``per_source`` of one source. Open bins are
ordered by what is left in them; each carries a bitmap of its clusters and one
of its sources per allowed repetition. A document goes to the tightest bin that
can take it: the search starts at the smallest residual that suffices and goes
on to the next larger one as long as bins conflict; if none is left, a new bin
opens.

A document longer than a bin is cut: full bins of its own, and a tail that is
packed. Best fit is sequential, so the corpus is dealt by a hash of the row
into groups of some GROUP_ROWS rows, packed side by side; their number grows
with the corpus, and a hot source or cluster is spread over all of them. Where
a row goes depends on the rows only, not on how they are partitioned.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrama.llm.columns import plain_words
from engrama.llm.shared import stash

CAPACITY = 2048
PER_SOURCE = 2
GROUP_ROWS = 2048


class Bins:
    """Open bins of one group, ordered by residual."""

    def __init__(self, capacity: int, per_source: int = PER_SOURCE):
        self.capacity, self.per_source = capacity, per_source
        self.residuals: list[int] = []  # those that open bins have, ascending
        self.by_residual: dict[int, list[int]] = {}  # bins of a residual, ascending
        self.clusters: list[int] = []  # a bitmap per bin
        self.sources: list[list[int]] = []  # bitmaps per bin: sources held at least once, twice, ...

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset for a document; source and cluster are single bits."""
        at = bisect.bisect_left(self.residuals, size)
        while at < len(self.residuals):
            left = self.residuals[at]
            for place, b in enumerate(self.by_residual[left]):
                if not (self.clusters[b] & cluster or self.sources[b][-1] & source):
                    self._take_out(at, left, place)
                    return self._fill(b, left, size, source, cluster)
            at += 1
        self.clusters.append(0)
        self.sources.append([0] * self.per_source)
        return self._fill(len(self.clusters) - 1, self.capacity, size, source, cluster)

    def _take_out(self, at: int, left: int, place: int) -> None:
        bins = self.by_residual[left]
        bins.pop(place)
        if not bins:
            del self.by_residual[left]
            self.residuals.pop(at)

    def _fill(self, b: int, left: int, size: int, source: int, cluster: int) -> tuple[int, int]:
        self.clusters[b] |= cluster
        planes = self.sources[b]
        for i, plane in enumerate(planes):
            if not plane & source:
                planes[i] |= source
                break
        rest = left - size
        if rest not in self.by_residual:
            self.by_residual[rest] = []
            bisect.insort(self.residuals, rest)
        bisect.insort(self.by_residual[rest], b)
        return b, self.capacity - left


def pack_group(sizes: list[int], sources: list, clusters: list, capacity: int, per_source: int = PER_SOURCE) -> list[tuple[int, int]]:
    """Bin and offset of each document, taken in the given order."""
    bins = Bins(capacity, per_source)
    source_bit: dict = {}
    cluster_bit: dict = {}
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s = 0 if source is None else 1 << source_bit.setdefault(source, len(source_bit))
        c = 0 if cluster is None else 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        out.append(bins.put(size, s, c))
    return out


def word_count(text: Column) -> Column:
    return F.size(plain_words(text))


def pack(docs: DataFrame, size: Column | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE, row_id: str = "doc_id", source: str = "source", text: str = "text", cluster: str | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per piece: ``row_id``, ``piece``, ``start``, ``length``, ``bin``, ``offset``.

    ``size`` defaults to the number of words. ``start`` is where the piece
    begins in its document, ``offset`` where it stands in its bin; bins are
    named ``group-number``, and ``whole-row-piece`` where one piece fills a
    bin. Clusters are those of the column ``cluster``, such as the classes of
    near-duplicates, or else equal texts; a null source, cluster or text
    conflicts with nothing. A document without a unit gives one piece of length
    0 that is placed like any other; a very long one fills bins of its own.
    Repeated rows are equal texts: they land in different bins. An empty table
    gives no rows.
    """
    amount = (size if size is not None else word_count(docs[text])).cast("long")
    body = docs[text]
    held = docs[cluster].cast("string") if cluster else F.when(F.length(body) > 0, F.hex(F.xxhash64(body)))
    slim = docs.select(docs[row_id].alias("id"), docs[source].cast("string").alias("source"), held.alias("cluster"), F.coalesce(amount, F.lit(0).cast("long")).alias("amount"))
    # repeated rows are told apart by a number
    counted = slim.groupBy("id", "source", "cluster", "amount").agg(F.count(F.lit(1)).alias("n"))
    rows = stash(counted.select("id", "source", "cluster", "amount", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")))
    groups = max(1, -(-rows.count() // group_rows))
    full, tail = F.expr(f"amount div {capacity}"), F.col("amount") % capacity
    whole = rows.filter(full > 0).select("id", F.concat(F.lit("whole-"), F.md5(F.to_json(F.struct("id", "source", "cluster", "amount", "copy")))).alias("name"), F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("piece"))
    wholes = whole.select("id", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), F.concat_ws("-", "name", F.col("piece").cast("string")).alias("bin"), F.lit(0).cast("long").alias("offset"))
    group = F.pmod(F.xxhash64("id", "source", "cluster", "amount", "copy"), F.lit(groups)).cast("int")
    tails = rows.filter((tail > 0) | (F.col("amount") == 0)).select("id", "source", "cluster", full.alias("piece"), tail.alias("length"), group.alias("group"))

    kind = slim.schema["id"].dataType.simpleString()

    def packed(rows: pa.Table) -> pa.Table:
        r = rows.to_pydict()
        order = sorted(range(rows.num_rows), key=lambda i: (-r["length"][i], str(r["id"][i]), r["cluster"][i] or "", r["source"][i] or ""))
        placed = pack_group(*[[r[c][i] for i in order] for c in ("length", "source", "cluster")], capacity, per_source)
        out = rows.select(["id", "piece", "length"]).take(order)
        return out.append_column("bin", pa.array([f"{r['group'][0]}-{b}" for b, _ in placed], pa.string())).append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    done = tails.groupBy("group").applyInArrow(packed, f"id {kind}, piece long, length long, bin string, offset long")
    ends = done.select("id", "piece", (F.col("piece") * capacity).alias("start"), "length", "bin", "offset")
    return wholes.unionByName(ends).withColumnRenamed("id", row_id)
