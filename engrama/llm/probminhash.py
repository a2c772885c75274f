"""Near-duplicates by ProbMinHash, banding and exact verification.

A document is the weighted set of its five-word shingles, weighted by how often
it has them (a shorter text is one shingle). Every shingle sends arrivals of a
Poisson process with its weight as rate, each to a random slot; a slot keeps the
shingle of its earliest arrival. Two documents agree in a slot with the
probability Jaccard similarity. A document's processes stop at the time by
which all slots are filled: later arrivals can't win.

Equal texts are one node from the start. Nodes that agree in a band are
candidates: each is verified against its bucket's most central node, the one
that shares most buckets, which settles most copies with one comparison.
Buckets that still hold different components compare signatures between those
components in bounded blocks. The likeliest pairs, some per member, are
verified; a block that has more of them is compared once more inside a task with
the shingles at hand, so that only links leave it. Verification is exact, on the
shingles. The class of a document is its connected component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.llm.components import components
from engrama.llm.hashing import RunHashes, chunks, mixed, thrifty, word_values
from engrama.llm.shared import broadcast_if, drop, quoted, stash

WIDTH = 5
SIMILAR = 0.8
ROWS, BANDS = 5, 26
SLOTS = ROWS * BANDS
#: Slots in which a pair of similarity SIMILAR agrees but for a chance of 3e-7: five deviations below the mean.
AGREE = math.floor(SLOTS * SIMILAR - 5 * math.sqrt(SLOTS * SIMILAR * (1 - SIMILAR)))
#: Shingles (and slots) that are worked on at once.
LOAD = 100_000
#: Members of a bucket that are compared in one block.
BLOCK = 1000
#: Members of all buckets that share a task, about; likely pairs per member that leave it; pairs that are looked at at once.
TASK, PER_MEMBER, PAIRS = 4000, 4, 20_000
#: Nodes (names of 16 bytes, so some 20 MB) that are sent to every task; beyond, they are joined.
BROADCAST_NODES = 200_000
_U = np.uint64


def weighted_shingles(column: pa.Array, width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct shingles, ascending, and their counts."""
    for _, data, offsets in chunks(column):
        values, _, _, first = word_values(data, offsets)
        runs = RunHashes(values)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b == a:
                yield np.zeros(0, _U), np.zeros(0, np.int64)
                continue
            starts = np.arange(a, max(a + 1, b - width + 1))
            yield np.unique(runs.of(starts, np.minimum(starts + width, b)), return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """The shingle that wins each slot, a row per set; sets must not be empty."""
    out = np.zeros((len(sets), slots), _U)
    todo, patience = np.arange(len(sets)), math.log(slots) + 3
    while len(todo):
        own = [sets[i] for i in todo]
        sizes = np.array([len(s) for s, _ in own])
        of = np.repeat(np.arange(len(own)), sizes)
        shingle = np.concatenate([s for s, _ in own])
        weight = np.concatenate([c for _, c in own]).astype(float)
        stop = patience * slots / np.add.reduceat(weight, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        best, won = np.full(len(own) * slots, np.inf), np.zeros(len(own) * slots, _U)
        time, k = np.zeros(len(of)), 0
        while len(of):
            with np.errstate(over="ignore"):
                draw = mixed(shingle + _U((0xD1342543DE82EF95 * (k + 1)) % 2**64))
            time = time - np.log(((draw >> _U(11)).astype(float) + 1) / 2.0**53) / weight
            live = time <= stop[of]
            of, shingle, weight, time, draw = of[live], shingle[live], weight[live], time[live], draw[live]
            slot = of * slots + (mixed(draw) % _U(slots)).astype(np.int64)
            np.minimum.at(best, slot, time)
            first = time == best[slot]
            won[slot[first]] = shingle[first]
            k += 1
            if k in (1, 2, 4, 8, 16, 64):  # no arrival after the last slot's earliest one can win
                stop = np.minimum(stop, best.reshape(-1, slots).max(axis=1))
        filled = np.isfinite(best.reshape(-1, slots)).all(axis=1)
        out[todo[filled]] = won.reshape(-1, slots)[filled]
        todo, patience = todo[~filled], patience * 2
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash per band of consecutive slots, distinct between bands."""
    count = signature.shape[1] // rows
    out = np.tile(np.arange(1, count + 1, dtype=_U), (len(signature), 1))
    with np.errstate(over="ignore"):
        for r in range(rows):
            out = mixed(out * _U(0x9E3779B97F4A7C15) + signature[:, r : count * rows : rows])
    return out


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two weighted sets (ascending elements, weights): the chance that one draw agrees."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    combos: dict[tuple[int, int], int] = {}
    for w, v in zip(a[1][i].tolist(), b[1][j].tolist(), strict=True):
        combos[w, v] = combos.get((w, v), 0) + 1
    alone_a, alone_b = a[1].sum() - a[1][i].sum(), b[1].sum() - b[1][j].sum()
    return sum(n / (alone_a / w + alone_b / v + sum(m * max(x / w, y / v) for (x, y), m in combos.items())) for (w, v), n in combos.items())


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to key, bands and a shortened signature; none for a text without words."""

    def signed(keys: pa.Array, held: list[tuple[int, tuple[np.ndarray, np.ndarray]]]) -> pa.RecordBatch:
        found = signatures([s for _, s in held])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * BANDS, pa.int32()), pa.array(bands(found).view(np.int64).reshape(-1)))
        short = pa.array([row.astype(np.uint16).tobytes() for row in found], pa.binary())
        return pa.RecordBatch.from_arrays([keys.take(pa.array([i for i, _ in held])), lists, short], names=["key", "bands", "signature"])

    for batch in batches:
        held, load = [], 0
        for i, one in enumerate(weighted_shingles(batch.column(1))):
            if not len(one[0]):
                continue
            held.append((i, one))
            load += len(one[0]) + SLOTS
            if load >= LOAD:
                yield signed(batch.column(0), held)
                held, load = [], 0
        if held:
            yield signed(batch.column(0), held)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to key, shingles and counts."""

    def listed(keys: pa.Array, first: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ends = pa.array(np.concatenate([[0], np.cumsum([len(s) for s, _ in held])]), pa.int32())
        column = lambda i, t: pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[i].view(np.int64) for x in held]).astype(t)))
        return pa.RecordBatch.from_arrays([keys.slice(first, len(held)), column(0, np.int64), column(1, np.int32)], names=["key", "s", "c"])

    for batch in batches:
        first, held, load = 0, [], 0
        for one in weighted_shingles(batch.column(1)):
            held.append(one)
            load += len(one[0])
            if load >= LOAD:
                yield listed(batch.column(0), first, held)
                first, held, load = first + len(held), [], 0
        if held:
            yield listed(batch.column(0), first, held)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their sets to the pairs that are similar."""

    def sets(batch: pa.RecordBatch, s: str, c: str) -> list:
        return [(np.asarray(x.values).view(_U), np.asarray(y.values)) for x, y in zip(batch.column(s), batch.column(c), strict=True)]

    for batch in batches:
        near = [probability_jaccard(a, b) >= SIMILAR - 1e-12 for a, b in zip(sets(batch, "s", "c"), sets(batch, "s2", "c2"), strict=True)]
        yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))


def _key(text):
    return F.unhex(F.md5(text))


def _sets_of(keys: DataFrame, docs: DataFrame) -> DataFrame:
    """key, s, c: the shingles of the texts with these keys."""
    wanted = broadcast_if(keys, keys.count(), BROADCAST_NODES)
    texts = docs.select(_key("text").alias("key"), "text").join(wanted, "key", "left_semi")
    return stash(texts.mapInArrow(thrifty(_sets), "key binary, s array<long>, c array<int>").dropDuplicates(["key"]))


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v: keys of texts) whose texts are similar."""
    pairs = stash(pairs)
    sets = _sets_of(stash(pairs.select(F.col("u").alias("key")).union(pairs.select("v")).distinct()), docs)
    left = pairs.join(sets.withColumnRenamed("key", "u"), "u")
    both = left.join(sets.select(F.col("key").alias("v"), F.col("s").alias("s2"), F.col("c").alias("c2")), "v")
    links = stash(both.select("u", "v", "s", "c", "s2", "c2").mapInArrow(thrifty(_verified), "u binary, v binary"))
    drop(pairs, sets)
    return links


def _across(rows: pa.Table) -> pa.Table:
    """Members of two blocks of a bucket to links between their components.

    A pair is looked at in the first bucket that both share, the likeliest
    pairs first, and not once other links have joined their components.
    """
    bucket = rows.column("bucket")[0].as_py()
    parent = {r: r for r in rows.column("root").to_pylist()}

    def find(r: bytes) -> bytes:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    class Side:
        def __init__(self, side: int):
            part = rows.filter(pc.equal(rows.column("side"), side)).combine_chunks()
            self.names, self.roots = part.column("node").to_pylist(), part.column("root").to_pylist()
            n = len(self.names)
            self.signatures = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(n, SLOTS)
            self.bands = np.array(part.column("bands").to_pylist(), np.int64).reshape(n, BANDS)
            self.s, self.c = part.column("s"), part.column("c")

        def set(self, i: int) -> tuple[np.ndarray, np.ndarray]:
            return np.asarray(self.s[i].values).view(_U), np.asarray(self.c[i].values)

    one, two = Side(0), Side(1)
    same = not two.names
    two = one if same else two
    links: list[tuple[bytes, bytes]] = []
    for i, name in enumerate(one.names):
        agree = (two.signatures == one.signatures[i]).sum(axis=1)
        common = two.bands == one.bands[i]
        here = one.bands[i][common.argmax(axis=1)] == bucket
        likely = np.flatnonzero((agree >= AGREE) & here)
        likely = likely[likely > i] if same else likely
        for j in likely[np.argsort(-agree[likely], kind="stable")]:
            a, b = find(one.roots[i]), find(two.roots[j])
            if a != b and name != two.names[j] and probability_jaccard(one.set(i), two.set(j)) >= SIMILAR - 1e-12:
                parent[a] = b
                links.append((name, two.names[j]))
    return pa.table({"u": pa.array([x for x, _ in links], pa.binary()), "v": pa.array([x for _, x in links], pa.binary())})


def _fresh(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Where another block begins."""
    out = np.ones(len(rows["bucket"]), bool)
    out[1:] = np.logical_or.reduce([rows[c][1:] != rows[c][:-1] for c in ("bucket", "i", "j")])
    return out


def _pairs_of(rows: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per block of a bucket its first row and the pairs of rows to look at, in parts; rows are sorted by block."""
    begins = np.flatnonzero(_fresh(rows))
    for a, b in zip(begins, begins + np.diff(begins, append=len(rows["bucket"])), strict=True):
        members = np.arange(a, b)
        one = members[rows["side"][a:b] == 0]
        two = one if rows["i"][a] == rows["j"][a] else members[rows["side"][a:b] == 1]
        step = max(1, PAIRS // max(1, len(two)))
        for at in range(0, len(one), step):
            u, v = (x.ravel() for x in np.meshgrid(one[at : at + step], two, indexing="ij"))
            wanted = (rows["root"][u] != rows["root"][v]) & ((u < v) | (rows["i"][a] != rows["j"][a]))
            yield int(a), u[wanted], v[wanted]


_LIKELY = "u binary, v binary, bucket long, i int, j int"


def _likely(table: pa.Table) -> pa.Table:
    """Members of many blocks to their likeliest pairs of different components, and the blocks (without u, v) that have more.

    A pair is looked at in the first bucket that both share.
    """
    table = table.sort_by([("bucket", "ascending"), ("i", "ascending"), ("j", "ascending"), ("side", "ascending"), ("node", "ascending")]).combine_chunks()
    rows = {c: table.column(c).to_numpy() for c in ("bucket", "i", "j", "side")}
    rows["root"] = np.asarray(table.column("root").combine_chunks().dictionary_encode().indices)
    signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(-1, SLOTS)
    bands = np.array(table.column("bands").to_pylist(), np.int64).reshape(-1, BANDS)
    best: dict[int, list[tuple[np.ndarray, ...]]] = {}
    held: list[tuple[int, np.ndarray, np.ndarray]] = []

    def looked_at() -> None:
        u, v = (np.concatenate([h[k] for h in held]) for k in (1, 2))
        block = np.repeat([h[0] for h in held], [len(h[1]) for h in held])
        agree = (signatures[u] == signatures[v]).sum(axis=1)
        near = agree >= AGREE
        u, v, block, agree = u[near], v[near], block[near], agree[near]
        first = (bands[u] == bands[v]).argmax(axis=1)
        here = bands[u, first] == rows["bucket"][u]
        for x in np.unique(block[here]):
            of = here & (block == x)
            best.setdefault(int(x), []).append((agree[of], u[of], v[of]))

    load = 0
    for part in _pairs_of(rows):
        held.append(part)
        load += len(part[1])
        if load >= PAIRS:
            looked_at()
            held, load = [], 0
    if load:
        looked_at()
    nodes = table.column("node")
    left, right, more = [], [], []
    begins = np.flatnonzero(_fresh(rows))
    sizes = dict(zip(begins.tolist(), np.diff(begins, append=len(table)).tolist(), strict=True))
    for x, parts in best.items():
        agree, u, v = (np.concatenate([p[k] for p in parts]) for k in range(3))
        order = np.argsort(-agree, kind="stable")[: PER_MEMBER * sizes[x]]
        left += u[order].tolist()
        right += v[order].tolist()
        if len(order) < len(agree):
            more.append(x)
    pick = lambda at, c, t: pa.concat_arrays([pa.nulls(len(left), t), table.column(c).take(pa.array(at, pa.int64())).combine_chunks().cast(t)])
    ends = [pa.concat_arrays([nodes.take(pa.array(x, pa.int64())).combine_chunks().cast(pa.binary()), pa.nulls(len(more), pa.binary())]) for x in (left, right)]
    return pa.table([*ends, pick(more, "bucket", pa.int64()), pick(more, "i", pa.int32()), pick(more, "j", pa.int32())], names=["u", "v", "bucket", "i", "j"])


def _dealt(buckets: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the buckets that hold different components, once per pair of blocks: bucket, i, j, side, node, root, signature, bands."""
    member = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed_up = member.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("n")).filter("a != b").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = member.join(mixed_up, "bucket").join(nodes.select("node", "signature", "bands"), "node")
    block = F.pmod(F.hash("node"), F.col("blocks"))
    sides = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("block"), o).alias("i"), F.greatest(F.col("block"), o).alias("j"), F.when(F.col("block") <= o, 0).otherwise(1).alias("side")))
    return own.withColumn("block", block).select("bucket", "node", "root", "signature", "bands", F.inline(sides))


def remaining(buckets: DataFrame, nodes: DataFrame, links: DataFrame, docs: DataFrame) -> DataFrame:
    """``links`` and those (u, v) within a bucket between components that they leave apart."""
    dealt = stash(_dealt(buckets, nodes, components(links)))
    tasks = max(1, -(-dealt.count() // TASK))
    found = stash(dealt.withColumn("task", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(tasks)).cast("int")).groupBy("task").applyInArrow(_likely, _LIKELY))
    near = verified(found.filter("u is not null").select("u", "v").distinct(), docs)
    links = stash(links.union(near))
    more = stash(found.filter("u is null").select("bucket", "i", "j"))
    drop(dealt, found, near)
    if more.isEmpty():
        return links
    # these blocks have more likely pairs than were verified: compared again, under what is joined by now, with the shingles at hand
    again = stash(_dealt(buckets.join(more.select("bucket").distinct(), "bucket", "left_semi"), nodes, components(links)).join(more, ["bucket", "i", "j"], "left_semi"))
    sets = _sets_of(stash(again.select(F.col("node").alias("key")).distinct()), docs)
    rest = stash(again.join(sets.withColumnRenamed("key", "node"), "node").groupBy("bucket", "i", "j").applyInArrow(_across, "u binary, v binary"))
    both = stash(links.union(rest))
    drop(again, sets, rest, more, links)
    return both


def _rooted(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    """Per row: ``id``, ``node`` (key of its text), ``root`` (name of its class)."""
    slim = docs.select(docs[row_id].alias("id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    signed = slim.select(_key("text").alias("key"), "text").mapInArrow(thrifty(_signed), "key binary, bands array<long>, signature binary")
    nodes = stash(signed.groupBy(F.col("key").alias("node")).agg(F.first("bands").alias("bands"), F.first("signature").alias("signature")))
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = stash(buckets.join(shared, "bucket"))
    # what copies were made of shares more buckets than the copies do: it is compared first
    mass = met.groupBy("node").agg(F.sum("n").alias("mass"))
    central = met.join(mass, "node").groupBy("bucket").agg(F.max(F.struct("mass", "node"))["node"].alias("centre"))
    pairs = met.join(central, "bucket").filter("node != centre").select(F.col("centre").alias("u"), F.col("node").alias("v")).distinct()
    links = remaining(met.select("bucket", "node"), nodes, verified(pairs, slim), slim)
    roots = components(links)
    blank = F.length(F.translate("text", " \t\n\x0b\x0c\r", "")) == 0
    rows = slim.select("id", _key("text").alias("node"), blank.alias("blank"), F.monotonically_increasing_id().cast("string").alias("place"))
    placed = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    out = stash(placed.select("id", "node", F.when(F.col("blank"), F.concat(F.lit("blank-"), "place")).otherwise(F.hex("root")).alias("root")))
    drop(nodes, met, links)
    return out


def classes(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``row_id``, ``class_id`` (the least row id of its class), ``class_size`` in rows.

    A null text counts as an empty one. Texts without words are like nothing,
    not even each other: each such row is a class of its own. Repeated rows are
    equal texts. An empty table gives no rows.
    """
    held = _rooted(docs, row_id, text)
    sizes = held.groupBy("root").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return held.join(sizes, "root").select(F.col("id").alias(row_id), "class_id", "class_size")


def representatives(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` per class, all columns: that of the least row id, then of the least text key.

    Of repeated rows any one stays: they are alike but for other columns.
    """
    held = _rooted(docs, row_id, text)
    own = F.struct(F.col("id").isNull().alias("last"), "id", "node")
    kept = held.groupBy("root").agg(F.min(own).alias("one")).select(F.col("one.id").alias("id"), F.col("one.node").alias("node"))
    copies = held.groupBy(F.col("id").alias("of"), F.col("node").alias("by")).agg(F.count(F.lit(1)).alias("copies"))
    chosen = kept.groupBy("id", "node").agg(F.count(F.lit(1)).alias("take")).join(copies, F.col("id").eqNullSafe(F.col("of")) & (F.col("node") == F.col("by"))).select("of", "by", "take", "copies")
    chosen = stash(chosen)
    # the rows are one column meanwhile, so their names can't meet others
    rows = docs.select(F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), docs[row_id].alias("id"), _key(F.coalesce(docs[text], F.lit(""))).alias("node"))
    joined = rows.join(chosen, F.col("id").eqNullSafe(F.col("of")) & (F.col("node") == F.col("by")))
    unpacked = lambda df: df.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
    all_of_them = unpacked(joined.filter("take = copies"))
    if chosen.filter("take < copies").isEmpty():
        return all_of_them
    return all_of_them.union(unpacked(joined.filter("take < copies").dropDuplicates(["of", "by"])))
