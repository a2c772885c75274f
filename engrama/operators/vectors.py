"""Exact nearest neighbours.

``nearest`` doesn't multiply all with all. Vectors lie in cells around pivots, and
angles obey the triangle inequality: a cell whose pivot is further from a vector
than the cell's radius and the vector's n-th best angle together holds nothing for
it. A first pass looks into each vector's own cell, a second into those
that the bound can't rule out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engrama.functions import vectors as v
from engrama.functions.text import content_hash
from engrama.operators.graph import refresh_plan
from engrama.sources.shared import drop, stash

#: Vectors of one side that are in a task at once; of a cell, about; pivots at most, and vectors (of the least hashes) that they are fitted to.
BLOCK, CELL, PIVOTS, FITTED = 8192, 128, 256, 4096
#: Queries that are broadcast at once; more are worked off in blocks of about this many.
QUERIES = 10_000
#: Queries, and vectors, of a block where two sets meet; queries that are multiplied at a time.
MET, PART = 32_768, 512
#: Angles are known to so many radians.
SLACK = 1e-6


def top_by_vector(collection: DataFrame, query: DataFrame, n: int) -> DataFrame:
    """query_id, id, vector_score, rank: the n notes nearest each query (query_id, qv), ties by id.

    Some query vectors at a time go to every task; each task keeps n rows per
    query before anything is shuffled.
    """
    asked = query.select("query_id", "qv").filter(F.size("qv") > 0)
    blocks = max(1, -(-asked.count() // QUERIES))
    out = None
    for k in range(blocks):
        own = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        scored = collection.select("id", "embedding").join(F.broadcast(own))
        scored = scored.select("query_id", "id", v.similarity(F.col("embedding"), F.col("qv")).alias("vector_score"))
        order = W.partitionBy("query_id").orderBy(F.desc("vector_score"), "id")
        best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
        out = best if out is None else out.unionByName(best)
    return out


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each vector to each pivot; 0 for a vector without direction, so that nothing is ruled out."""
    out = np.arccos(np.clip(units @ pivots.T, -1, 1))
    out[~units.any(axis=1)] = 0
    return out


def fit_pivots(own: DataFrame, total: int) -> np.ndarray:
    """Unit vectors in the midst of the vectors: spherical k-means over at most FITTED of them."""
    few = own.orderBy(F.xxhash64("id")).limit(FITTED).select("x").collect()
    units = np.array([r.x for r in few], float).reshape(len(few), -1)
    units = units[units.any(axis=1)]
    if not len(units):
        return np.zeros((1, units.shape[1] if units.ndim > 1 else 1))
    pivots = units[: max(1, min(PIVOTS, total // CELL))]
    for _ in range(8):
        cell = (units @ pivots.T).argmax(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, cell, units)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(norms > 0, sums / np.maximum(norms, 1e-300), pivots)
    return pivots


def _placed(pivots: np.ndarray):
    """Unit vectors to their cell and angle; a vector without direction makes its cell as wide as can be."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units = _matrix(batch.column("x"))
                angles = _angles(units, pivots)
                cell = angles.argmin(axis=1)
                angle = np.where(units.any(axis=1), angles[np.arange(len(cell)), cell], np.pi)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(cell.astype(np.int32)), pa.array(angle)], names=["id", "x", "cell", "angle"])

    return rows


def _best(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n best (vector, other, cosine) of each vector, ties by the other."""
    a, b, cos = (np.concatenate([r[k] for r in rows]) for k in range(3))
    order = np.lexsort((b, -cos, a))
    a, b, cos = a[order], b[order], cos[order]
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    return a[rank < n], b[rank < n], cos[rank < n]


def _product(ids: np.ndarray, units: np.ndarray, others: np.ndarray, with_: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For parts of the vectors, those of the others that can be among their n best: vector, other, cosine."""
    for at in range(0, len(ids), 512):
        cos = np.round(units[at : at + 512] @ with_.T, 12)
        cos[ids[at : at + 512][:, None] == others[None, :]] = -np.inf
        if cos.shape[1] > n:  # all that reach the n-th best, ties included
            least = -np.partition(-cos, n - 1, axis=1)[:, n - 1 : n]
            row, k = np.nonzero((cos >= least) & np.isfinite(cos))
        else:
            row, k = np.nonzero(np.isfinite(cos))
        yield ids[at : at + 512][row], others[k], cos[row, k]


def _table(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, names: np.ndarray, kind: pa.DataType) -> pa.Table:
    if not found:
        return pa.table({"a": pa.array([], kind), "b": pa.array([], kind), "cos": pa.array([], pa.float64())})
    a, b, cos = _best(found, n)
    return pa.table({"a": pa.array(names[a], kind), "b": pa.array(names[b], kind), "cos": pa.array(cos)})


def _own_cells(n: int):
    """Members of a block to their n best in their own cell."""

    def found(rows: pa.Table) -> pa.Table:
        names, ids = np.unique(rows.column("id").to_numpy(), return_inverse=True)  # ranks, in the order of ids
        units, cell = _matrix(rows.column("x")), rows.column("cell").to_numpy()
        out: list = []
        for c in np.unique(cell):
            own = np.flatnonzero(cell == c)
            out += _product(ids[own], units[own], ids[own], units[own], n)
        return _table(out, n, names, rows.schema.field("id").type)

    return found


def _visits(pivots: np.ndarray, radius: np.ndarray, blocks: np.ndarray, parts: np.ndarray):
    """Vectors with their n-th best cosine to the blocks in which something better may lie, with the cells to look into."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, home = batch.column("cell").to_numpy(), batch.column("home").to_numpy()
            reach = np.arccos(np.clip(batch.column("least").to_numpy(), -1, 1))[:, None] + SLACK
            near = _angles(_matrix(batch.column("x")), pivots) - radius <= reach
            near[np.arange(len(cell)), cell] = parts[cell] > 1  # its own cell has been looked into, or the part of it at home
            row, of = np.nonzero(near & (blocks >= 0))
            # a cell of several parts is that many blocks
            part = np.arange(parts[of].sum()) - np.repeat(np.cumsum(parts[of]) - parts[of], parts[of])
            row, of = np.repeat(row, parts[of]), np.repeat(of, parts[of])
            block = blocks[of] + part
            away = (of != cell[row]) | (block != home[row])
            row, of, block = row[away], of[away], block[away]
            order = np.lexsort((of, block, row))
            row, of, block = row[order], of[order], block[order]
            begins = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (block[1:] != block[:-1]))) if len(row) else np.zeros(0, np.int64)
            cells = pa.ListArray.from_arrays(pa.array(np.append(begins, len(row)), pa.int32()), pa.array(of.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row[begins])) for c in ("id", "x", "home", "least")), pa.array(block[begins].astype(np.int32)), cells], names=["id", "x", "home", "least", "block", "cells"])

    return rows


def _visited(n: int):
    """Visitors of a block (those with cells to look into) and its members to what the visitors find there."""

    def found(rows: pa.Table) -> pa.Table:
        names, ids = np.unique(rows.column("id").to_numpy(), return_inverse=True)
        units, cell = _matrix(rows.column("x")), rows.column("cell").to_numpy()
        floor = np.full(len(names), -1.0)
        floor[ids[cell < 0]] = rows.column("least").to_numpy()[cell < 0]
        wanted = rows.column("cells").combine_chunks()
        visitor = np.repeat(np.arange(len(ids)), np.diff(wanted.offsets.to_numpy()))
        cells = wanted.flatten().to_numpy()
        out: list = []
        for c in np.unique(cells):
            own, guests = np.flatnonzero(cell == c), visitor[cells == c]
            for a, b, cos in _product(ids[guests], units[guests], ids[own], units[own], n):
                good = cos >= floor[a]
                out.append((a[good], b[good], cos[good]))
        return _table(out, n, names, rows.schema.field("id").type)

    return found


def cells_of(collection: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vectors in their cells (id, x, cell, angle, home), and the cells: pivots, radii, first blocks (-1: empty), parts."""
    length = F.sqrt(F.aggregate(v.doubles(F.col("embedding")), F.lit(0.0), lambda s, x: s + x * x))
    own = collection.select("id", v.doubles(F.col("embedding")).alias("v"), length.alias("l")).filter(F.size("v") > 0)
    own = own.select("id", F.transform("v", lambda x: F.when(F.col("l") > 0, x / F.col("l")).otherwise(F.lit(0.0))).alias("x"))
    kind = own.schema["id"].dataType.simpleString()
    total = collection.count()
    if total <= BLOCK:  # one cell, which one task looks through
        return own.select("id", "x", F.lit(0).alias("cell"), F.lit(0.0).alias("angle"), F.lit(0).alias("home")), np.zeros((1, 1)), np.zeros(1), np.zeros(1, np.int64), np.ones(1, np.int64)
    own = stash(own)
    pivots = fit_pivots(own, total)
    placed = stash(own.mapInArrow(_placed(pivots), f"id {kind}, x array<double>, cell int, angle double"))
    drop(own)
    radius, blocks, parts = np.zeros(len(pivots)), np.full(len(pivots), -1), np.ones(len(pivots), np.int64)
    at, room = 0, BLOCK
    # small cells share a block, large ones are several
    for r in sorted(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect(), key=lambda r: r.cell):
        parts[r.cell] = -(-r.n // BLOCK)
        if r.n > room:
            at, room = at + 1, BLOCK
        blocks[r.cell], radius[r.cell] = at, r.radius
        at, room = (at + int(parts[r.cell]), BLOCK) if parts[r.cell] > 1 else (at, room - r.n)
    first, many = (F.element_at(F.array(*map(F.lit, map(int, x))), F.col("cell") + 1) for x in (blocks, parts))
    return placed.withColumn("home", (first + F.pmod(F.xxhash64("id"), many)).cast("int")), pivots, radius, blocks, parts


def nearest(collection: DataFrame, n: int, mode: str = "cosine") -> DataFrame:
    """a, b, similarity, rank: for each vector its n nearest others, ties by id.

    Exact. What is multiplied is a vector's own cell and the cells that the bound
    leaves; a pair of blocks of which no vector needs the other never meets.
    ``mode`` "distance" gives 1 - d*d/2 of the cosine distance.
    """
    members, pivots, radius, blocks, parts = cells_of(collection)
    kind = members.schema["id"].dataType.simpleString()
    out = f"a {kind}, b {kind}, cos double"
    own = members.select("id", "x", "cell", "home").groupBy("home").applyInArrow(_own_cells(n), out)
    if len(pivots) == 1 and parts[0] == 1:
        return _ranked(own, n, mode)
    own = stash(own)
    least = own.groupBy("a").agg(F.min("cos").alias("least"), F.count(F.lit(1)).alias("found"))
    asking = members.join(least, members["id"] == least["a"], "left").select("id", "x", "cell", "home", F.when(F.col("found") >= n, F.col("least")).otherwise(F.lit(-1.0)).alias("least"))
    visits = stash(asking.mapInArrow(_visits(pivots, radius, blocks, parts), f"id {kind}, x array<double>, home int, least double, block int, cells array<int>"))
    met = visits.select("block", F.col("home").alias("from")).distinct()
    none = F.array().cast("array<int>")
    hosts = members.withColumnRenamed("home", "block").join(met, "block").select("block", "from", "id", "x", "cell", F.lit(-1.0).alias("least"), none.alias("cells"))
    guests = visits.select("block", F.col("home").alias("from"), "id", "x", F.lit(-1).alias("cell"), "least", "cells")
    found = own.unionByName(hosts.unionByName(guests).groupBy("block", "from").applyInArrow(_visited(n), out))
    return _ranked(found, n, mode)


def _ranked(found: DataFrame, n: int, mode: str) -> DataFrame:
    similar = v.distance_similarity(F.col("cos")) if mode == "distance" else F.greatest(F.lit(0.0), F.col("cos"))
    order = W.partitionBy("a").orderBy(F.desc("cos"), "b")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("a", "b", similar.alias("similarity"), "rank")


def vector_stats(collection: DataFrame) -> DataFrame:
    """One row: number of vectors, mean pairwise cosine (of unit vectors, from the sum vector, without pairs)."""
    unit = collection.select(F.posexplode(F.transform(v.doubles(F.col("embedding")), lambda x: x / v.norm(F.col("embedding")))).alias("i", "x"))
    sums = unit.groupBy("i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    n = F.max("n")
    return sums.agg(n.alias("n"), ((F.sum(F.col("s") * F.col("s")) - n) / (n * (n - 1))).alias("mean_cosine"))


def _closest(least: float):
    """Queries (side 0) and vectors (side 1) of a block each to every query's best vector among these that is similar enough."""

    def found(rows: pa.Table) -> pa.Table:
        side, ids = rows.column("side").to_numpy(), rows.column("id").combine_chunks()
        mine, others = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        kind, out = ids.type, []
        if len(mine) and len(others):
            names = ids.take(pa.array(others))
            order = pc.array_sort_indices(names).to_numpy()  # of equal cosines the first is that of the least id
            others = others[order]
            every = _matrix(rows.column("x"))
            units = every / np.sqrt((every * every).sum(axis=1, keepdims=True))
            for at in range(0, len(mine), PART):
                own, high, best = mine[at : at + PART], np.full(len(mine[at : at + PART]), -np.inf), np.zeros(len(mine[at : at + PART]), np.int64)
                for to in range(0, len(others), BLOCK):
                    cos = np.round(units[own] @ units[others[to : to + BLOCK]].T, 12)
                    cos[np.isnan(cos)] = np.inf  # stands before all numbers, as in an ordering by SQL
                    k = cos.argmax(axis=1)
                    top = cos[np.arange(len(own)), k]
                    better = top > high
                    high[better], best[better] = top[better], others[to + k[better]]
                near = high >= least
                out.append((own[near], best[near], high[near]))
        a, b, cos = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, float if k == 2 else np.int64) for k in range(3))
        return pa.table({"query_id": rows.column("query_id").combine_chunks().take(pa.array(a)), "id": ids.take(pa.array(b)).cast(kind), "cos": pa.array(np.where(np.isinf(cos), np.nan, cos))})

    return found


def best_match(rows: DataFrame, collection: DataFrame, least: float, n: int = 3) -> DataFrame:
    """query_id, match, similarity: the nearest of n candidates if it is similar enough.

    Queries and vectors of one length are dealt into blocks, and each two blocks
    meet in one task, which multiplies them; a query's best vector of a block is
    all that leaves it. Every query meets every vector.
    """
    if least <= 0:  # then vectors of other lengths and without direction are candidates too
        top = top_by_vector(collection, rows, n).filter("rank = 1")
        return top.filter(F.col("vector_score") >= least).select("query_id", F.col("id").alias("match"), F.col("vector_score").alias("similarity"))
    directed = lambda df, c: df.withColumn("x", v.doubles(F.col(c))).filter(v.norm(F.col("x")) > 0)
    asked = directed(rows.select("query_id", "qv"), "qv").select("query_id", "x")
    known = directed(collection.select("id", "embedding"), "embedding").select("id", "x")
    parts, blocks = (max(1, -(-df.count() // MET)) for df in (rows, collection))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    kinds = asked.schema["query_id"].dataType, known.schema["id"].dataType
    mine = asked.select("query_id", F.lit(None).cast(kinds[1]).alias("id"), "x", F.lit(0).alias("side"), dealt("query_id", parts).alias("i"), every(blocks).alias("j"))
    others = known.select(F.lit(None).cast(kinds[0]).alias("query_id"), "id", "x", F.lit(1).alias("side"), every(parts).alias("i"), dealt("id", blocks).alias("j"))
    met = mine.unionByName(others).groupBy(F.size("x").alias("d"), "i", "j").applyInArrow(_closest(least), f"query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, cos double")
    best = met.groupBy("query_id").agg(F.min_by(F.struct("id", "cos"), F.struct(~F.isnan("cos"), -F.col("cos"), "id")).alias("b"))
    return best.select("query_id", F.col("b.id").alias("match"), F.col("b.cos").alias("similarity"))


def embed_changed(plan: DataFrame, notes: DataFrame, embed, most: int = 2000, size: int = 64, tries: int = 3) -> DataFrame:
    """id, embedding for the notes that the plan wants embedded.

    ``embed`` takes a list of ``size`` texts at most and returns a list of
    vectors; a call that fails is tried again, a wrong number of vectors is an
    error, an empty vector drops the note.
    """

    def made(texts: list[str]) -> list[list[float]]:
        for left in reversed(range(tries)):
            try:
                got = embed(texts)
            except Exception:  # whatever the caller's service raises; the last one is the task's
                if not left:
                    raise
                continue
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
            return got
        return []

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                yield pa.RecordBatch.from_pydict({"id": part.column(0), "embedding": pa.array(made(part.column(1).to_pylist()), pa.list_(pa.float32()))})

    todo = notes.join(plan.filter("action = 'embed'").select("id"), "id", "left_semi").select("id", F.substring("text", 1, most).alias("text"))
    kind = todo.schema["id"].dataType.simpleString()
    return todo.mapInArrow(rows, f"id {kind}, embedding array<float>").filter(F.size("embedding") > 0)


def refreshed(stored: DataFrame, notes: DataFrame, embed, force: bool = False, **options) -> DataFrame:
    """id, content_hash, embedding of all ``notes`` (id, text): kept where the hash is that of the ``stored`` row, else made anew; what is no note any more goes."""
    current = notes.select("id", content_hash(F.col("text")).alias("content_hash"))
    plan = stash(refresh_plan(stored, current, force))
    kept = stored.join(plan.filter("action = 'keep'").select("id"), "id", "left_semi").select("id", "content_hash", "embedding")
    return kept.unionByName(embed_changed(plan, notes, embed, **options).join(current, "id").select("id", "content_hash", "embedding"))
