"""Documents whose word shingles overlap, found by filters under several token orders.

A document is the set of its four-word shingles; equal sets are one node. Two nodes
link when their Jaccard similarity reaches SHARE percent, so a set of n tokens has
at most ``slack`` = n - ceil(SHARE % of n) that the other lacks. Under any order of
all tokens two linked sets therefore have more than E tokens in common among the first
slack + 1 + E of each. Three orders are used:

* The first, by hash, gives each node a prefix. How many nodes have a token in their
  prefixes is counted, and the second order, by that count, takes the commonest E - 1
  tokens off each prefix. What linked nodes share is more than E, so they keep the rarest
  token in common; most nodes keep tokens only that nobody else has. Each
  token that several nodes keep is a bucket.
* Two further orders by other hashes are applied inside the tasks that compare a
  bucket's nodes: a pair must have enough tokens in common in its prefixes under both, or
  it is not verified. Verification counts the common tokens of the whole sets.

The result are connected components, so pairs that are connected need no comparison.
Each bucket's most central node is compared with its members first. Nodes that are
joined by buckets that still hold several components are a neighbourhood: each
goes there once, with its set and its buckets, however many it shares with others. A large
neighbourhood is cut by size of set, since linked sets are of like size, and
into blocks. Only links leave a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.llm.columns import LOWER, UPPER
from engrama.llm.components import components
from engrama.llm.hashing import RunHashes, chunks, mixed, thrifty, word_values
from engrama.llm.shared import broadcast_if, drop, stash

WIDTH = 4
#: Percent of the union that two sets have in common at least.
SHARE = 85
#: E, in percent of a set's size.
EXTRA = 10
#: Odd factors, one per hash order.
ORDERS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Shingles of the members that are compared as one block; of all blocks that share a task, about; rows of a batch of shingles.
BLOCK, TASK, LOAD = 1 << 18, 1 << 21, 1 << 20
#: Nodes (48 bytes, so some 25 MB) that are sent to every task; beyond, they are joined.
BROADCAST_NODES = 500_000
_U = np.uint64


def slack(n):
    """How many of n tokens a linked set may lack; of a number, an array or a column."""
    return n - (SHARE * n + 99) // 100


def extra(n):
    """E for a set of n tokens."""
    return EXTRA * n // 100


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Per text its distinct shingles, ascending; a shorter text is one, a text without words none."""
    for _, data, offsets in chunks(column):
        values, _, _, first = word_values(data, offsets)
        grams = RunHashes(values)
        for a, b in zip(first[:-1], first[1:], strict=True):
            starts = np.arange(a, max(a + 1, b - width + 1)) if b > a else np.zeros(0, np.int64)
            yield np.unique(grams.of(starts, np.minimum(starts + width, b)))


def prefix(tokens: np.ndarray, order: int) -> np.ndarray:
    """The first slack + 1 + E tokens under an order, ascending by value."""
    n = len(tokens)
    size = min(n, slack(n) + 1 + extra(n))
    if size == n:
        return tokens
    with np.errstate(over="ignore"):
        rank = mixed(tokens * _U(ORDERS[order]))
    return np.sort(tokens[np.argpartition(rank, size - 1)[:size]])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, text) to id, key, name of the set (null for an empty one) and its size."""
    for batch in batches:
        names, sizes = [], []
        for tokens in shingle_sets(batch.column(2)):
            names.append(hashlib.md5(tokens.tobytes()).digest() if len(tokens) else None)
            sizes.append(len(tokens))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(sizes, pa.int64())], names=["id", "key", "digest", "n"])


def _tokens(part: Callable[[np.ndarray], np.ndarray]):
    """(node, text) to node and token, a row per token of ``part``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, held, load = batch.column(0).to_numpy(), [], 0
            at = 0
            for i, tokens in enumerate(shingle_sets(batch.column(1))):
                held.append(part(tokens))
                load += len(held[-1])
                if load >= LOAD or i + 1 == len(nodes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes[at : i + 1], [len(x) for x in held])), pa.array(np.concatenate(held).view(np.int64))], names=["node", "token"])
                    held, load, at = [], 0, i + 1

    return rows


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) to node and its tokens."""
    for batch in batches:
        held, load, at = [], 0, 0
        for i, tokens in enumerate(shingle_sets(batch.column(1))):
            held.append(tokens)
            load += len(tokens)
            if load >= LOAD or i + 1 == batch.num_rows:
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in held])]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(held).view(np.int64)))], names=["node", "tokens"])
                held, load, at = [], 0, i + 1


class Holders:
    """Which of some sets hold a token."""

    def __init__(self, sets: list[np.ndarray]):
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.n = len(sets)
        self.own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]
        self.tokens, self.begins, self.counts = np.unique(tokens[order], return_index=True, return_counts=True)

    def shared(self, wanted: np.ndarray) -> np.ndarray:
        """How many of the wanted tokens each set holds."""
        if not len(self.tokens) or not len(wanted):
            return np.zeros(self.n, np.int64)
        at = np.minimum(np.searchsorted(self.tokens, wanted), len(self.tokens) - 1)
        at = at[self.tokens[at] == wanted]
        counts = self.counts[at]
        ends = np.cumsum(counts)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begins[at] - (ends - counts), counts)
        return np.bincount(self.own[places], minlength=self.n)


def links_between(one: dict, two: dict | None) -> list[tuple[int, int]]:
    """Links that join the components of members of one block and of another (None: the same block).

    A block has ``node``, ``root``, ``sets`` and ``met``, the buckets of each member: those of a pair must meet.
    """
    same, two = two is None, two or one
    sizes = np.array([len(s) for s in two["sets"]])
    roots, labels = np.unique(np.concatenate([one["root"], two["root"]]), return_inverse=True)
    mine, yours = labels[: len(one["root"])].copy(), labels[len(one["root"]) :].copy()
    if len(roots) == 1:
        return []
    orders = [(o, Holders([prefix(s, o) for s in two["sets"]])) for o in (1, 2)]
    whole, buckets = Holders(two["sets"]), Holders(two["met"])
    out = []
    for i, tokens in enumerate(one["sets"]):
        n = len(tokens)
        open_ = (yours != mine[i]) & (100 * np.minimum(sizes, n) >= SHARE * np.maximum(sizes, n)) & (buckets.shared(one["met"][i]) > 0)
        if same:
            open_[: i + 1] = False
        for o, holders in orders:
            if open_.any():
                open_ &= holders.shared(prefix(tokens, o)) > np.minimum(extra(n), extra(sizes))
        if not open_.any():
            continue
        common = whole.shared(tokens)
        for j in np.flatnonzero(open_ & (100 * common >= SHARE * (sizes + n - common))).tolist():
            if yours[j] != mine[i]:
                out.append((int(one["node"][i]), int(two["node"][j])))
                kept, gone = mine[i], yours[j]
                mine[mine == gone] = kept
                yours[yours == gone] = kept
    return out


def _compared(table: pa.Table) -> pa.Table:
    """Members of many pairs of blocks to links."""
    table = table.sort_by([(c, "ascending") for c in ("bucket", "i", "j", "side", "node")]).combine_chunks()
    keys = {c: table.column(c).to_numpy() for c in ("bucket", "i", "j", "side", "node", "root")}
    listed = {c: table.column(c).combine_chunks() for c in ("tokens", "met")}

    def lists(c: str, a: int, b: int) -> list[np.ndarray]:
        ends = listed[c].offsets.to_numpy()[a : b + 1]
        return np.split(listed[c].values.to_numpy().view(_U)[ends[0] : ends[-1]], ends[1:-1] - ends[0])

    def begins(*by: str) -> np.ndarray:
        fresh = np.ones(len(table), bool)
        fresh[1:] = np.logical_or.reduce([keys[c][1:] != keys[c][:-1] for c in by])
        return np.flatnonzero(fresh)

    def block(a: int, b: int) -> dict:
        return {"node": keys["node"][a:b], "root": keys["root"][a:b], "sets": lists("tokens", a, b), "met": lists("met", a, b)}

    links: list[tuple[int, int]] = []
    groups = begins("bucket", "i", "j")
    for a, b in zip(groups.tolist(), [*groups[1:].tolist(), len(table)], strict=True):
        cut = a + int(np.searchsorted(keys["side"][a:b], 1))
        if cut > a and (cut < b or keys["i"][a] == keys["j"][a]):
            links += links_between(block(a, cut), block(cut, b) if cut < b else None)
    return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([x for _, x in links], pa.int64())})


def _links(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v: links between the sides of ``dealt`` (bucket, i, j, side, node, n, root, met)."""
    dealt = stash(dealt)
    words = dealt.agg(F.sum("n")).first()[0] or 0
    rows = dealt.join(sets, "node").withColumn("task", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(1 + words // TASK)).cast("int"))
    found = stash(rows.select("task", "bucket", "i", "j", "side", "node", "root", "tokens", "met").groupBy("task").applyInArrow(_compared, "u long, v long"))
    drop(dealt)
    return found


def _kept(postings: DataFrame, nodes: DataFrame) -> DataFrame:
    """token, node, n: the tokens of the prefixes that stay under the order by count, where several nodes keep them."""
    common = postings.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    held = postings.join(common, "token").groupBy("node").agg(F.sort_array(F.collect_set(F.struct("c", "token"))).alias("held"))
    # tokens that no other node has come first in this order, so what is taken off are the last of ``held``
    room = F.greatest(F.lit(0), F.size("held") - F.greatest(F.lit(0), F.floor(EXTRA * F.col("n") / 100) - 1))
    own = held.join(nodes.select("node", "n"), "node").select("node", "n", F.explode(F.slice("held", F.lit(1), room.cast("int"))["token"]).alias("token"))
    own = stash(own)
    several = own.groupBy("token").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("words")).filter("members > 1")
    return own.join(several, "token")


def _stars(met: DataFrame) -> DataFrame:
    """Each bucket's most central node, the one whose buckets hold most, with the members that are long enough."""
    mass = met.groupBy("node").agg(F.sum("members").alias("mass"))
    central = met.join(mass, "node").groupBy("token").agg(F.max(F.struct("mass", "node", "n")).alias("centre")).select("token", F.col("centre.node").alias("u"), F.col("centre.n").alias("m"))
    pairs = met.join(central, "token").filter(f"node != u and 100 * least(n, m) >= {SHARE} * greatest(n, m)").select("u", "m", "node", "n").distinct()
    # few enough members at a time for one task; the centre is on the other side of each
    sizes = pairs.groupBy("u", "m").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    here = F.array(F.lit(0).cast("long"))  # they share a bucket by construction
    ends = sizes.select(F.col("u").alias("bucket"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("blocks"))).alias("j"), F.col("u").alias("node"), F.col("m").alias("n")).withColumn("side", F.lit(0))
    others = pairs.join(sizes.select("u", "blocks"), "u").select(F.col("u").alias("bucket"), (1 + F.pmod(F.hash("node"), F.col("blocks"))).alias("j"), "node", "n", F.lit(1).alias("side"))
    both = ends.unionByName(others)
    return both.select("bucket", F.lit(0).cast("long").alias("i"), F.col("j").cast("long").alias("j"), "side", "node", "n", F.col("node").alias("root"), here.alias("met"))


def _apart(met: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the buckets that still hold several components, by neighbourhood, once per pair of blocks."""
    member = met.select("token", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = member.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.min("node").alias("first")).filter("a != b").select("token", "first")
    member = stash(member.join(several, "token"))
    near = components(member.select(F.col("node").alias("u"), F.col("first").alias("v")))
    own = member.groupBy("node").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.collect_list("token").alias("met"))
    own = stash(own.join(near.withColumnRenamed("root", "bucket"), "node", "left").withColumn("bucket", F.coalesce("bucket", "node")))
    drop(member)
    # linked sets are in the same class of size or in neighbouring ones: a class is a little wider than their ratio
    size_class = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / SHARE) * (1 + 1e-9))).cast("long")
    large = own.groupBy("bucket").agg(F.sum("n").alias("words")).filter(F.col("words") > BLOCK).select("bucket", F.lit(True).alias("large"))
    placed = own.join(large, "bucket", "left").withColumn("c", F.when(F.col("large"), size_class).otherwise(F.lit(0).cast("long")))
    parts = placed.groupBy("bucket", "c").agg(F.ceil(F.sum("n") / BLOCK).cast("long").alias("parts"))
    around = parts.select("bucket", (F.col("c") + 1).alias("c"), F.col("parts").alias("below")).join(parts.select("bucket", (F.col("c") - 1).alias("c"), F.col("parts").alias("above")), ["bucket", "c"], "full_outer")
    dealt = placed.join(parts, ["bucket", "c"]).join(around, ["bucket", "c"], "left").withColumn("part", F.pmod(F.hash("node"), F.col("parts")).cast("long"))
    code = lambda c, part: c * (1 << 20) + part
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - F.lit(1).cast("long"))).otherwise(F.array().cast("array<long>"))
    c, part = F.col("c"), F.col("part")
    pair = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.alias("side"))
    same = F.transform(upto(F.col("parts")), lambda o: pair(code(c, F.least(part, o)), code(c, F.greatest(part, o)), F.when(part <= o, 0).otherwise(1)))
    higher = F.transform(upto(F.coalesce("above", F.lit(0).cast("long"))), lambda o: pair(code(c, part), code(c + 1, o), F.lit(0)))
    lower = F.transform(upto(F.coalesce("below", F.lit(0).cast("long"))), lambda o: pair(code(c - 1, o), code(c, part), F.lit(1)))
    return dealt.select("bucket", F.inline(F.concat(same, higher, lower)), "node", "n", "root", "met")


def join_classes(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``row_id``, ``n_shingles`` (size of its set) and ``component_id``, the least row id that links reach.

    A-Z are lower-cased, ASCII white space parts words, and a text of fewer than four words is
    one shingle. A null text counts as an empty one: texts without words have no shingles and
    link with nothing, not even each other, so their ``component_id`` is their own id. Repeated
    rows are equal texts, and so linked. Null ids are ids of no order: they never name a component
    that has others. An empty table gives no rows. Texts are worked on whole; other columns have no effect.
    """
    lowered = F.translate(F.coalesce(docs[text], F.lit("")), UPPER, LOWER)
    slim = docs.select(docs[row_id].alias("id"), lowered.alias("text"))
    slim = slim.select("id", F.unhex(F.md5("text")).alias("key"), "text")
    kind = slim.schema["id"].dataType.simpleString()
    rows = stash(slim.mapInArrow(thrifty(_digests), f"id {kind}, key binary, digest binary, n long"))
    nodes = stash(rows.filter("digest is not null").groupBy("digest").agg(F.min(F.struct("id", "key")).alias("one"), F.first("n").alias("n")).select(F.monotonically_increasing_id().alias("node"), "digest", "n", "one.id", "one.key"))
    texts = _texts(nodes, slim)
    postings = stash(texts.mapInArrow(thrifty(_tokens(lambda tokens: prefix(tokens, 0))), "node long, token long"))
    met = stash(_kept(postings, nodes))
    drop(postings)
    involved = stash(met.select("node").distinct())
    sets = stash(_texts(nodes.join(involved, "node", "left_semi"), slim).mapInArrow(thrifty(_sets), "node long, tokens array<long>").dropDuplicates(["node"]))
    stars = _links(_stars(met), sets)
    rest = _links(_apart(met, components(stars)), sets)
    roots = components(stars.union(rest))
    placed = rows.join(nodes.select("digest", "node"), "digest", "left").join(roots, "node", "left")
    placed = stash(placed.select("id", "n", F.coalesce("root", "node").alias("root")))
    drop(rows, nodes, met, involved, sets, stars, rest)
    least = placed.filter("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    return placed.join(least, "root", "left").select(F.col("id").alias(row_id), F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def _texts(nodes: DataFrame, slim: DataFrame) -> DataFrame:
    """node, text of a row of each node (repeated rows: of each of them)."""
    wanted = broadcast_if(nodes.select("node", F.col("id").alias("of"), F.col("key").alias("by")), nodes.count(), BROADCAST_NODES)
    return slim.join(wanted, slim["id"].eqNullSafe(F.col("of")) & (slim["key"] == F.col("by"))).select("node", "text")
