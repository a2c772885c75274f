"""Pairs of notes that are active together, counted where they meet: no pair is shuffled."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, TimestampType

from engrama.operators.packed import compressed, listed, lists_coded
from engrama.settings import Settings
from engrama.sources.shared import stash

#: Notes, and places of notes in the log, that a block has at most on average; a task holds two blocks. Of more than 16 blocks each has more notes, up to the last number.
BLOCK_NOTES, BLOCK_PLACES, MOST_NOTES = 4096, 2_000_000, 16_384
#: Parts of the order by first key that a block is made of, and how many there are at most.
PARTS, MOST_PARTS = 8, 1024
#: Pairs that a task counts at a time, and meetings that it looks at together.
CELLS = 2_000_000
#: Places of notes that a task packs at a time.
PLACES = 2_000_000
ROWS = 100_000
HOUR = 3_600_000_000

#: Meetings of one stripe of notes with a block: cell of the pair, place of either note in its block's list; by key within a cell.
Meetings = tuple[np.ndarray, np.ndarray, np.ndarray]


class Block:
    """Notes of a block and their places in the log, by note or by key."""

    def __init__(self, rows: pa.Table):
        self.ids = rows["id"].combine_chunks()
        lists = {c: rows[c].combine_chunks() for c in rows.column_names if pa.types.is_list(rows[c].type)}
        self.at = {c: x.flatten().to_numpy(zero_copy_only=False) for c, x in lists.items()}
        n = np.diff(lists["k"].offsets.to_numpy())
        self.ends, self.note = np.r_[0, np.cumsum(n)], np.repeat(np.arange(len(n)), n)

    def by_key(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.at["k"], kind="stable")
        return order, self.at["k"][order]


def meetings(left: Block, right: Block, same: bool, cells: int = CELLS) -> Iterator[tuple[int, Iterator[Meetings], int]]:
    """Stripe by stripe of the left block: its first note, its meetings in pieces, and how many they are."""
    order, keys = right.by_key()
    width = len(right.ids)
    stripe = max(1, cells // max(width, 1))
    for first in range(0, len(left.ids), stripe):
        begin, end = left.ends[first], left.ends[min(first + stripe, len(left.ids))]
        mine = begin + np.argsort(left.at["k"][begin:end], kind="stable")
        low, high = np.searchsorted(keys, left.at["k"][mine], "left"), np.searchsorted(keys, left.at["k"][mine], "right")
        n = high - low
        sums = np.cumsum(n)
        if not len(sums) or not sums[-1]:
            continue

        def pieces(first=first, mine=mine, low=low, n=n, sums=sums) -> Iterator[Meetings]:
            i = 0
            while i < len(n):
                j = max(i + 1, int(np.searchsorted(sums, (sums[i - 1] if i else 0) + cells, "right")))
                part = n[i:j]
                from_low = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part) + np.repeat(low[i:j], part)
                a, b = np.repeat(mine[i:j], part), order[from_low]
                if same:
                    upper = left.note[a] < right.note[b]
                    a, b = a[upper], b[upper]
                yield (left.note[a] - first) * width + right.note[b], a, b
                i = j

        yield first, pieces(), int(sums[-1])


def counts(left: Block, right: Block, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]]:
    """Per stripe the pairs that meet, with n, first and last."""
    width = len(right.ids)
    for first, pieces, total in meetings(left, right, same):
        cells = min(max(1, CELLS // width), len(left.ids) - first) * width
        if total * 16 < cells:  # few meet: sorted instead of counted in a table
            cell, a, _ = (np.concatenate(x) for x in zip(*pieces, strict=True))
            cell, begin, last, by = grouped(cell)
            n, key = last - begin + 1, left.at["k"][a[by]]
            low, high = key[begin], key[last]
        else:
            n, low, high = (np.zeros(cells, "int64") for _ in range(3))
            for cell, a, _ in pieces:
                key = left.at["k"][a]
                high[cell] = key  # keys rise: of several the last stays
                new = n[cell] == 0
                low[cell[new][::-1]] = key[new][::-1]
                n += np.bincount(cell, minlength=cells)
            cell = np.flatnonzero(n)
            n, low, high = n[cell], low[cell], high[cell]
        yield first + cell // width, cell % width, {"n": pa.array(n), "first": pa.array(low.astype("int64")), "last": pa.array(high.astype("int64"))}


def grouped(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct cells, where each begins and ends in the order by cell, and that order."""
    by = np.argsort(cell, kind="stable")
    sorted_ = cell[by]
    begin = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(cell) else np.zeros(0, "int64")
    return sorted_[begin], begin, np.r_[begin[1:], len(cell)][: len(begin)] - 1, by


class Learned:
    """What pairs have learned: frequency and weight of the last gain, queries idle by then, queries with both."""

    def __init__(self, n: int):
        self.f, self.w, self.idle, self.cab = np.zeros(n), np.zeros(n), np.zeros(n, "int64"), np.zeros(n, "int64")

    def advance(self, at: np.ndarray, begin: np.ndarray, last: np.ndarray, n: np.ndarray, rest: np.ndarray, gain: np.ndarray, settings: Settings) -> None:
        """More queries of pairs ``at``, the i-th's from begin[i] to last[i] in time: whether each counts, those that either note was idle in less those with both, and what is gained."""
        size, run = last - begin + 1, np.cumsum(n)
        cab = run + np.repeat(self.cab[at] - run[begin] + n[begin], size)
        idle = rest + cab
        self.cab[at] = cab[last]
        gains = np.flatnonzero(gain > 0)
        many = np.bincount(np.repeat(np.arange(len(at)), size)[gains], minlength=len(at))
        start, live, r = np.cumsum(many) - many, np.flatnonzero(many), 0
        while len(live):  # the r-th gain of all pairs that have as many
            x, to = gains[start[live] + r], at[live]
            alive = self.w[to] * settings.decay ** (idle[x] - self.idle[to]).astype(float) >= settings.forget_below
            self.f[to] = np.where(alive, self.f[to], 0.0) + gain[x]
            self.w[to] = settings.alpha * np.minimum(self.f[to] / 10, 1.0) + settings.beta
            self.idle[to] = idle[x]
            r += 1
            live = live[many[live] > r]


#: Flags of a note's place in a log: the query counts for decay, the note was active enough to learn, a user asked.
COUNTS, HELD, USER = 1, 2, 4


def replayed(asked: int, settings: Settings) -> Callable:
    """Per stripe the pairs that a log of ``asked`` counting queries leaves with their frequency and weight now.

    Keys are the queries' ranks; with each go q, the counting queries up to it, and flags.
    """

    room = CELLS  # as it is here, whatever the tasks import

    def active(block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Counting queries that had a note active: up to each of its places, and of each note."""
        run = np.r_[0, np.cumsum(block.at["flags"] & COUNTS, dtype="int64")]
        own = run[block.ends]
        return run[1:] - own[block.note], np.diff(own)

    def found(left: Block, right: Block, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]]:
        (ca, all_a), (cb, all_b) = active(left), active(right)
        width = len(right.ids)
        for first, pieces, total in meetings(left, right, same, room):
            few = total <= room
            if few:  # only pairs that meet have a state
                pieces = [tuple(np.concatenate(x) for x in zip(*pieces, strict=True))]
            state, cells = None if few else Learned(min(max(1, room // width), len(left.ids) - first) * width), None
            for cell, a, b in pieces:
                distinct, begin, last, by = grouped(cell)
                if few:
                    state, cells = Learned(len(distinct)), distinct
                a, b = a[by], b[by]
                flags = left.at["flags"][a]
                gain = np.where(flags & right.at["flags"][b] & HELD, np.where(flags & USER, 1.0, settings.derived_increment), 0.0)
                state.advance(np.arange(len(distinct)) if few else distinct, begin, last, (flags & COUNTS).astype("int64"), left.at["q"][a] - ca[a] - cb[b], gain, settings)
            kept = np.flatnonzero(state.f > 0)
            cell = cells[kept] if few else kept
            i, j = first + cell // width, cell % width
            weight = state.w[kept] * settings.decay ** (asked - all_a[i] - all_b[j] + state.cab[kept] - state.idle[kept]).astype(float)
            here = weight >= settings.forget_below
            yield i[here], j[here], {"frequency": pa.array(state.f[kept][here]), "weight": pa.array(weight[here])}

    return found


def in_blocks_by_key(lists: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``lists`` with the block ``own`` of each note, and the first and last key in each block.

    Blocks follow the order of notes' first keys, so that those of different
    times needn't meet. Where many notes begin together they are dealt by hash.
    """
    first, last = F.get("k", F.lit(0)), F.element_at("k", -1)
    size = lists.agg(F.count(F.lit(1)).alias("notes"), F.coalesce(F.sum(F.size("k")), F.lit(0)).alias("places"), F.min(first).alias("low"), F.max(last).alias("high")).first()
    most = max(BLOCK_NOTES, min(MOST_NOTES, size["notes"] // 16))
    blocks = max(-(-size["notes"] // most), -(-size["places"] // BLOCK_PLACES))
    if blocks <= 1:
        return lists.withColumn("own", F.lit(0)), [(size["low"], size["high"])]
    n = min(PARTS * blocks, MOST_PARTS)
    bounds = lists.agg(F.percentile_approx(first, [i / n for i in range(1, n)])).first()[0]
    bounds = F.lit(sorted(set(bounds)))
    parted = lists.withColumn("__part", F.size(F.filter(bounds, lambda b: b <= first)))
    stats = parted.groupBy("__part").agg(F.count(F.lit(1)).alias("notes"), F.sum(F.size("k")).alias("places"), F.min(first).alias("low"), F.max(last).alias("high")).collect()
    begin, pieces, spans, held = {}, {}, [], None
    for r in sorted(stats, key=lambda r: r["__part"]):
        share = max(r["notes"] / most, r["places"] / BLOCK_PLACES)
        if share <= 1 and held is not None and held + share <= 1:  # goes into the block before
            spans[-1], held = (min(spans[-1][0], r["low"]), max(spans[-1][1], r["high"])), held + share
            begin[r["__part"]], pieces[r["__part"]] = len(spans) - 1, 1
            continue
        many = max(1, math.ceil(share))
        begin[r["__part"]], pieces[r["__part"]] = len(spans), many
        spans += [(r["low"], r["high"])] * many
        held = share if many == 1 else None
    at = lambda known: F.get(F.lit([known.get(i, 0) for i in range(max(known) + 1)]), F.col("__part"))
    own = at(begin) + F.pmod(F.xxhash64("id"), at(pieces)).cast("int")
    return parted.withColumn("own", own).drop("__part"), spans


def sent_to_meetings(lists: DataFrame, spans: list[tuple[int, int]]) -> DataFrame:
    """meet long, rows binary: the notes of ``lists`` (with their block ``own``), packed, for each two blocks that they meet in."""
    blocks, most = len(spans), PLACES

    def chunks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        own, k = table["own"].to_numpy(), table["k"].combine_chunks()
        ends, keys = k.offsets.to_numpy(), k.flatten().to_numpy(zero_copy_only=False)
        first, last = keys[ends[:-1] - ends[0]], keys[ends[1:] - ends[0] - 1]
        meets, out = [], []
        for j, (low, high) in enumerate(spans):
            near = np.flatnonzero((low <= last) & (high >= first)) if blocks > 1 else np.arange(len(own))
            for i in np.unique(own[near]).tolist():
                meets.append(min(i, j) * blocks + max(i, j))
                out.append(compressed(lists_coded(table.take(pa.array(near[own[near] == i])))))
        yield pa.RecordBatch.from_arrays([pa.array(meets, "int64"), pa.array(out, "binary")], names=["meet", "rows"])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += len(batch["k"].flatten())
            if n >= most:
                yield from chunks(held)
                held, n = [], 0
        if held:
            yield from chunks(held)

    return lists.mapInArrow(sent, "meet long, rows binary")


def in_block_pairs(lists: DataFrame, found: Callable, values: str) -> DataFrame:
    """note_a < note_b and ``values``, of what ``found`` gives of each two blocks of notes (id, and lists of equal length, of which k rises: the keys).

    A note's list is shuffled once per block that has keys in its time, packed with others. Each two blocks meet in one task, which counts their pairs
    and gives each pair once; what a task holds is bounded by the size of blocks.
    """
    blocked, spans = in_blocks_by_key(lists.filter(F.size("k") > 0))
    blocks = len(spans)
    tasks = 1
    if blocks > 1:
        tasks = min(sum(a[0] <= b[1] and b[0] <= a[1] for i, a in enumerate(spans) for b in spans[i:]), 4096)
    dealt = sent_to_meetings(blocked.select(*lists.columns, F.col("own").cast("long").alias("own")), spans)
    dealt = dealt.repartition(tasks, "meet").sortWithinPartitions("meet")

    def met(held: list[pa.RecordBatch], meet: int) -> Iterator[pa.RecordBatch]:
        i, j = divmod(meet, blocks)
        rows = pa.concat_tables(lists_coded(pa.ipc.open_stream(x.as_buffer()).read_all(), back=True) for batch in held for x in batch["rows"])
        own = rows["own"].to_numpy()
        left = Block(rows.filter(pa.array(own == i)))
        right = left if i == j else Block(rows.filter(pa.array(own == j)))
        if not len(left.ids) or not len(right.ids):
            return
        for a, b, columns in found(left, right, i == j):
            for k in range(0, len(a), ROWS):
                cut = slice(k, k + ROWS)
                one, two = left.ids.take(pa.array(a[cut])), right.ids.take(pa.array(b[cut]))
                yield pa.RecordBatch.from_arrays([one, two, *(c[cut] for c in columns.values())], names=["one", "two", *columns])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            meet = batch["meet"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(meet)) + 1).tolist(), len(meet)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if begin == end:
                    continue
                if held and meet[begin] != at:
                    yield from met(held, int(at))
                    held = []
                held.append(batch.slice(begin, end - begin))
                at = meet[begin]
        if held:
            yield from met(held, int(at))

    kind = lists.schema["id"].dataType.simpleString()
    pairs = dealt.mapInArrow(each, f"one {kind}, two {kind}, {values}")
    rest = [c for c in pairs.columns if c not in ("one", "two")]
    return pairs.select(F.least("one", "two").alias("note_a"), F.greatest("one", "two").alias("note_b"), *rest)


def numbered(active: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """``active`` and a whole number that stands for its ``keys``; one key that is a whole number stands for itself."""
    if len(keys) == 1 and isinstance(active.schema[keys[0]].dataType, LongType):
        return active, F.col(keys[0])
    known = stash(active.select(*keys).na.drop().distinct().withColumn("__k", F.monotonically_increasing_id()))
    return active.join(known, keys), F.col("__k")


def together(active: DataFrame, keys: list[str], least: float) -> DataFrame:
    """note_a < note_b of notes (id, score) that are active together, with n, first and last: under how many ``keys``, and the first and the last where that is one number or time."""
    held = active.filter((F.col("score") >= least) & F.col("id").isNotNull())
    times = len(keys) == 1 and isinstance(active.schema[keys[0]].dataType, TimestampType)
    if times:
        held = held.withColumn(keys[0], F.unix_micros(keys[0]))
    held, key = numbered(held, keys)
    held = held.filter(key.isNotNull())
    lists = stash(listed(held.select("id", key.alias("k")), "id", "k"))
    # what is shuffled are hours, or whatever the keys are, from the first on
    base, step = lists.agg(F.min(F.get("k", F.lit(0)))).first()[0] or 0, 1
    if times and lists.filter(F.exists("k", lambda k: (k - base) % HOUR != 0)).isEmpty():
        step = HOUR
        lists = lists.withColumn("k", F.transform("k", lambda k: F.floor((k - base) / step).cast("int")))
    else:
        lists = lists.withColumn("k", F.transform("k", lambda k: k - base))
    back = lambda c: F.timestamp_micros(F.col(c) * step + base) if times else F.col(c) * step + base
    pairs = in_block_pairs(lists, counts, "n long, first long, last long")
    return pairs.select("note_a", "note_b", "n", back("first").alias("first"), back("last").alias("last"))
