"""Learned weights between notes: co-activation, decay, boosts, note quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engrama.operators.together import COUNTS, HELD, USER, in_block_pairs, replayed, together
from engrama.settings import Settings
from engrama.sources.shared import few, stash


#: Notes of one query that are paired in one task with as many others.
PAIR_BLOCK = 1000


def in_blocks(rows: DataFrame, keys: list[str], size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` (keys, id, ...) twice, so that equal (keys, __i, __j) bring every two rows of a key together once.

    The rows of a key are dealt into blocks, and each pair of blocks is a key of
    its own: a key with a million rows is many small joins instead of a large one.
    """
    blocks = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / (size or PAIR_BLOCK)).cast("int").alias("__n"))
    dealt = rows.join(blocks, keys).withColumn("__own", F.pmod(F.xxhash64("id"), F.col("__n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("__n") - 1))
    left = dealt.withColumn("__i", F.col("__own")).withColumn("__j", every).drop("__n", "__own")
    right = dealt.withColumn("__j", F.col("__own")).withColumn("__i", every).drop("__n", "__own")
    return left, right


def pairs(active: DataFrame, keys: list[str], least: float) -> DataFrame:
    """note_a < note_b of the notes (id, score) that are active together, per key."""
    held = active.filter(F.col("score") >= least).select(*keys, "id").distinct()
    left, right = in_blocks(held, keys)
    met = left.withColumnRenamed("id", "note_a").join(right.withColumnRenamed("id", "note_b"), [*keys, "__i", "__j"])
    return met.filter("note_a < note_b").drop("__i", "__j")


def weight_of(frequency: Column, settings: Settings = Settings()) -> Column:
    return settings.alpha * F.least(frequency / 10, F.lit(1.0)) + settings.beta


def coactivation(active: DataFrame, keys: list[str], settings: Settings = Settings(), increment: float = 1.0) -> DataFrame:
    """note_a, note_b, frequency, weight over all keys."""
    counted = together(active, keys, settings.pair_min_score).select("note_a", "note_b", (F.col("n") * increment).alias("frequency"))
    return counted.withColumn("weight", weight_of(F.col("frequency"), settings))


def learn(synapses: DataFrame, active: DataFrame, now: Column, source: str = "user", settings: Settings = Settings()) -> DataFrame:
    """Synapses after one query whose active notes are (id, score).

    Pairs of active notes gain; synapses of no active note decay and may be
    forgotten. ``source`` "derived" gains less, "nightly" does not let others
    decay.
    """
    gain = 1.0 if source == "user" else settings.derived_increment
    # both ends say whether a pair gains: synapses meet notes, not pairs
    ids = active.filter(F.col("id").isNotNull()).groupBy("id").agg(F.coalesce(F.max("score") >= settings.pair_min_score, F.lit(False)).alias("__held"))
    ids = few(ids)
    end = lambda c, held: ids.select(F.col("id").alias(c), F.col("__held").alias(held))
    marked = synapses.join(end("note_a", "__a"), "note_a", "left").join(end("note_b", "__b"), "note_b", "left")
    grown = F.coalesce(F.col("__a") & F.col("__b") & (F.col("note_a") < F.col("note_b")), F.lit(False))
    idle = F.col("__a").isNull() & F.col("__b").isNull() & F.lit(source != "nightly")
    frequency = F.coalesce("frequency", F.lit(0.0)) + F.when(grown, F.lit(gain)).otherwise(F.lit(0.0))
    weight = F.when(grown, weight_of(frequency, settings)).when(idle, F.col("weight") * settings.decay).otherwise(F.col("weight"))
    out = marked.select("note_a", "note_b", weight.alias("weight"), frequency.alias("frequency"), F.when(grown, now).otherwise(F.col("last_coactivated")).alias("last_coactivated"), F.coalesce("created", now).alias("created"), idle.alias("__idle"), grown.alias("__grown"))
    kept = out.filter(~F.col("__idle") | (F.col("weight") >= settings.forget_below)).drop("__idle", "__grown")
    met = pairs(active.withColumn("q", F.lit(1)), ["q"], settings.pair_min_score).select("note_a", "note_b")
    new = met.join(out.filter("__grown").select("note_a", "note_b"), ["note_a", "note_b"], "left_anti")
    first, at = F.lit(gain), lambda c: now.cast(kept.schema[c].dataType).alias(c)
    return kept.unionByName(new.select("note_a", "note_b", weight_of(first, settings).alias("weight"), first.alias("frequency"), at("last_coactivated"), at("created")))


def running_total(rows: DataFrame, order: str, value: str, total: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows up to each, by a distinct ``order``.

    A range sort and a sum per partition, of which the driver gets as many as
    there are partitions; no task sees all rows.
    """
    dealt = stash(rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    sums, at, before = dealt.groupBy("__part").agg(F.sum(value).alias("n")).collect(), 0, []
    for r in sorted(sums, key=lambda r: r["__part"]):
        before.append((r["__part"], at))
        at += r["n"] or 0
    first = rows.sparkSession.createDataFrame(before, "__part int, __before long")
    inside = F.sum(value).over(W.partitionBy("__part").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return dealt.join(F.broadcast(first), "__part").withColumn(total, F.col("__before") + inside).drop("__part", "__before")


#: What is known of pairs, notes and queries after a log, as ``fold`` gives it.
PAIR_STATE = "f double, w double, idle long, cab long"


def fold(log: DataFrame, before: tuple[DataFrame, DataFrame, int] | None = None, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame, int]:
    """What a log of queries (seq, id, score, source) adds to what was known ``before``: pairs, notes and the number of queries.

    Pairs (note_a, note_b, f, w, idle, cab) have the frequency and weight of
    their last gain, how many queries had neither note active by then, and how
    many had both by now; notes (id, c) how many had them active. Queries of
    the night count for none of these. Only pairs and notes that the log touches
    are given, so what is written after a batch grows with the batch: the decay of all others
    follows from the counts when it is asked for.

    Between two gains a weight decayed once per query with neither note active.
    A synapse that fell below the limit starts anew. What a pair gathers are its
    own co-activations, a number and a few flags each.
    """
    counts = (F.col("source") != "nightly").cast("long")
    known, seen, asked = before or (None, None, 0)
    seqs = running_total(log.select("seq", counts.alias("n")).distinct(), "seq", "n", "q").withColumn("q", F.col("q") + asked)
    rows = log.select("seq", "id", "score", "source").join(seqs.select("seq", "q"), "seq")
    own = W.partitionBy("id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("c", F.sum(counts).over(own)).withColumn("n", counts)
    if seen is not None:
        rows = rows.join(seen.select("id", F.col("c").alias("c0")), "id", "left").withColumn("c", F.col("c") + F.coalesce("c0", F.lit(0))).drop("c0")
    rows = stash(rows)
    left, right = in_blocks(rows.select("seq", "q", "source", "n", "id", "score", "c"), ["seq"])
    a = left.select("seq", "__i", "__j", "q", "source", "n", F.col("id").alias("note_a"), F.col("score").alias("sa"), F.col("c").alias("ca"))
    b = right.select("seq", "__i", "__j", F.col("id").alias("note_b"), F.col("score").alias("sb"), F.col("c").alias("cb"))
    both = a.join(b, ["seq", "__i", "__j"]).filter("note_a < note_b")
    gain = F.when(F.col("source") == "user", 1.0).otherwise(settings.derived_increment)
    least = settings.pair_min_score
    gains = F.when((F.col("sa") >= least) & (F.col("sb") >= least), gain)
    # pairs that have never gained are left out before anything of them is gathered
    learning = pairs(log, ["seq"], least).select("note_a", "note_b").distinct()
    if known is not None:
        learning = learning.unionByName(known.select("note_a", "note_b")).distinct()
    events = both.join(learning, ["note_a", "note_b"], "left_semi")
    rest = F.col("q") - F.col("ca") - F.col("cb")  # less what both were active in
    folded = events.groupBy("note_a", "note_b").agg(F.sort_array(F.collect_list(F.struct("seq", "n", rest.alias("rest"), gains.alias("gain")))).alias("e"))
    nothing = F.struct(F.lit(0.0).alias("f"), F.lit(0.0).alias("w"), F.lit(0).cast("long").alias("idle"), F.lit(0).cast("long").alias("cab"))
    if known is None:
        folded = folded.withColumn("s", nothing)
    else:
        folded = folded.join(known.select("note_a", "note_b", F.struct("f", "w", "idle", "cab").alias("s")), ["note_a", "note_b"], "left").withColumn("s", F.coalesce("s", nothing))

    def step(acc: Column, x: Column) -> Column:
        cab = acc["cab"] + x["n"]
        idle = x["rest"] + cab
        alive = acc["w"] * F.pow(F.lit(settings.decay), idle - acc["idle"]) >= settings.forget_below
        f = F.when(alive, acc["f"]).otherwise(F.lit(0.0)) + x["gain"]
        grown = F.struct(f.alias("f"), weight_of(f, settings).alias("w"), idle.alias("idle"), cab.alias("cab"))
        return F.when(x["gain"].isNull(), F.struct(acc["f"].alias("f"), acc["w"].alias("w"), acc["idle"].alias("idle"), cab.alias("cab"))).otherwise(grown)

    done = folded.select("note_a", "note_b", F.aggregate("e", F.col("s"), step).alias("s")).select("note_a", "note_b", "s.f", "s.w", "s.idle", "s.cab")
    notes = rows.groupBy("id").agg(F.max("c").alias("c"))
    return done, notes, rows.agg(F.max("q")).first()[0] or asked


def weights_now(known: DataFrame, seen: DataFrame, asked: int, settings: Settings = Settings()) -> DataFrame:
    """note_a, note_b, frequency, weight of all pairs by what is known of pairs, notes and queries; what has decayed below the limit is forgotten."""
    last = known.join(seen.select(F.col("id").alias("note_a"), F.col("c").alias("ca")), "note_a").join(seen.select(F.col("id").alias("note_b"), F.col("c").alias("cb")), "note_b")
    idle = F.lit(asked) - F.col("ca") - F.col("cb") + F.col("cab") - F.col("idle")
    weight = F.col("w") * F.pow(F.lit(settings.decay), idle)
    return last.filter("f > 0").select("note_a", "note_b", F.col("f").alias("frequency"), weight.alias("weight")).filter(F.col("weight") >= settings.forget_below)


def replay(log: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """note_a, note_b, frequency, weight after a log of queries (seq, id, score, source), as ``learn`` would leave them one by one.

    What ``fold`` gathers of a pair is gone through where two blocks of notes
    meet; what is shuffled are notes with the queries that had them active.
    """
    log = log.filter("seq is not null and id is not null")
    seqs = log.groupBy("seq").agg(F.max((F.col("source") != "nightly").cast("long")).alias("n")).withColumn("one", F.lit(1).cast("long"))
    seqs = stash(running_total(running_total(seqs, "seq", "n", "q"), "seq", "one", "k"))
    asked, queries = seqs.agg(F.coalesce(F.max("q"), F.lit(0)), F.coalesce(F.max("k"), F.lit(0))).first()
    kind = "int" if queries < 1 << 31 else "long"
    flag = lambda c, bit: F.when(c, F.lit(bit)).otherwise(F.lit(0))
    flags = flag(F.col("n") > 0, COUNTS) + flag(F.col("score") >= settings.pair_min_score, HELD) + flag(F.col("source") == "user", USER)
    places = log.join(few(seqs), "seq").select("id", F.col("k").cast(kind).alias("k"), F.col("q").cast(kind).alias("q"), flags.cast("tinyint").alias("flags"))
    places = places.repartition("id").groupBy("id", "k").agg(F.max("q").alias("q"), F.max("flags").alias("flags"))
    lists = places.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", "q", "flags"))).alias("p")).select("id", "p.k", "p.q", "p.flags")
    return in_block_pairs(stash(lists), replayed(asked, settings), "frequency double, weight double")


def endpoints(synapses: DataFrame) -> DataFrame:
    """A row per synapse and end: id, other, and the synapse's columns."""
    rest = [c for c in synapses.columns if c not in ("note_a", "note_b")]
    ends = F.explode(F.array(F.struct(F.col("note_a").alias("id"), F.col("note_b").alias("other")), F.struct(F.col("note_b").alias("id"), F.col("note_a").alias("other"))))
    return synapses.select(ends.alias("e"), *rest).select("e.id", "e.other", *rest)


def recent_notes(synapses: DataFrame, now: Column, nodes: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """id of the ends of synapses that were active in the last minutes and are strong enough."""
    since = now - F.make_dt_interval(mins=F.lit(settings.boost_minutes))
    ids = endpoints(synapses.filter((F.col("weight") >= settings.boost_min_weight) & (F.col("last_coactivated") > since))).select("id").distinct()
    return ids if nodes is None else ids.join(nodes.select("id"), "id", "left_semi")


def boosts(synapses: DataFrame, recent: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """id, boost: from a note's strongest synapses to recent notes other than itself."""
    strong = endpoints(synapses.filter(F.col("weight") >= settings.boost_min_weight)).join(few(recent.select(F.col("id").alias("other"))), "other", "left_semi").filter("id != other")
    top = strong.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("weight"), "other"))).filter(F.col("r") <= settings.boost_top)
    return top.groupBy("id").agg(F.least(F.sum("weight") * settings.boost_factor, F.lit(settings.boost_max)).alias("boost"))


def per_note(synapses: DataFrame, **totals: Column) -> DataFrame:
    """A row per note: what ``node_quality`` needs of its synapses, and sums of ``totals`` over those of which it is note_a.

    Stashed: synapses are gone through once, and a total over all of them is that over its column.
    """
    end = lambda c, own: F.struct(F.col(c).alias("id"), *[(t if own else F.when(F.lit(False), t)).alias(n) for n, t in totals.items()])
    ends = synapses.select(F.explode(F.array(end("note_a", True), end("note_b", False))).alias("e"), "weight", "frequency").select("e.*", "weight", "frequency")
    per = ends.groupBy("id").agg(F.avg((F.col("weight") > 0.7).cast("double")).alias("strong_ratio"), F.avg("weight").alias("mean_weight"), F.sum("frequency").alias("frequency"), F.max("frequency").alias("most"), *[F.sum(n).alias(n) for n in totals])
    return stash(per)


def node_quality(nodes: DataFrame, synapses: DataFrame, settings: Settings = Settings(), known: DataFrame | None = None) -> DataFrame:
    """id, score, strong_ratio, mean_weight, frequency, dormant; all 0 for a note without synapses. ``known``: what ``per_note`` gives of them."""
    per = per_note(synapses) if known is None else known
    top = per.agg(F.max("most").alias("top"))
    share = F.when(F.col("top") > 0, F.least(F.col("frequency") / F.col("top"), F.lit(1.0))).otherwise(F.lit(0.0))
    rated = nodes.select("id").join(per, "id", "left").join(F.broadcast(top))
    # sums differ in their last bits with the order of rows: the nudge settles values halfway between two digits
    score = F.round(F.coalesce(0.40 * F.col("strong_ratio") + 0.35 * F.col("mean_weight") + 0.25 * share + 1e-9, F.lit(0.0)), 4)
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c)
    return rated.select("id", score.alias("score"), r("strong_ratio"), r("mean_weight"), F.coalesce("frequency", F.lit(0.0)).alias("frequency")).withColumn("dormant", F.col("score") < settings.dormant_below)


def quality_stats(quality: DataFrame) -> DataFrame:
    return quality.agg(F.count(F.lit(1)).alias("total"), F.count_if("dormant").alias("dormant"), F.count_if(~F.col("dormant")).alias("active"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"))


def worst_first(quality: DataFrame, titles: DataFrame, dormant: str = "dormant") -> DataFrame:
    """Dormant notes with their titles (their id where they have none), the worst first, ties by id."""
    known = titles.select("id", F.col("title").alias("__title"))
    return quality.filter(F.col(dormant)).join(known, "id", "left").withColumn("title", F.coalesce("__title", F.col("id").cast("string"))).drop("__title").orderBy("score", "id")


def learned(synapses: DataFrame, quality: DataFrame, queries: int, active: DataFrame, nodes: DataFrame, now: Column, source: str = "user", settings: Settings = Settings()) -> tuple[DataFrame, DataFrame, int]:
    """Synapses, quality (id, score, dormant) and number of queries after one more query.

    Pairs learn, dormant notes that were active strongly enough wake up, and at
    every ``rescore_every``-th query all notes are rated anew.
    """
    after, queries = learn(synapses, active, now, source, settings), queries + 1
    if queries % settings.rescore_every == 0:
        return after, node_quality(nodes, after, settings).select("id", "score", "dormant"), queries
    return after, reactivate(quality.select("id", "score", "dormant"), active.filter(F.col("score") >= settings.pair_min_score), settings), queries


def reactivate(quality: DataFrame, active: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Dormant notes that were active strongly enough wake up with the higher score."""
    top = active.groupBy("id").agg(F.max("score").alias("__a"))
    wakes = F.col("dormant") & (F.coalesce("__a", F.lit(0.0)) >= settings.reactivate_from)
    return quality.join(top, "id", "left").withColumn("score", F.when(wakes, F.greatest("score", "__a")).otherwise(F.col("score"))).withColumn("dormant", F.col("dormant") & ~wakes).drop("__a")
