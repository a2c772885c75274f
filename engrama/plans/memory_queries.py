"""Memory and consolidation queries.

Two users with an event in the same hour are active together, with their
largest value as score; an hour is a query. ``now`` is the last event's time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.functions.numbers import rounded
from engrama.operators import consolidation, graph, memory
from engrama.operators.together import together
from engrama.plans.registry import query, table

SYN_SQL = """act as (select date_trunc('hour', ts) as h, user_id as id, max(value) as score from events group by 1, 2),
syn as (select a.id as note_a, b.id as note_b, cast(count(*) as double) as frequency, 0.7 * least(count(*) / 10.0, 1.0) + 0.3 as weight, max(a.h) as last_coactivated, min(a.h) as created
  from act a join act b on a.h = b.h and a.id < b.id where a.score >= 0.15 and b.score >= 0.15 group by 1, 2),
clock as (select max(ts) as now from events),
nodes as (select distinct user_id as id from events)"""
STRONG = "round(0.4 * avg(case when weight > 0.7 then 1.0 else 0.0 end) + 0.35 * avg(weight) + 0.25 * least(sum(frequency) / max(top), 1.0) + 1e-9, 4)"


def quality_sql(source: str = "syn") -> str:
    return f"""ends as (select note_a as id, weight, frequency from {source} union all select note_b, weight, frequency from {source}),
qual as (select n.id, coalesce(e.score, 0) as score, coalesce(e.frequency, 0) as frequency, coalesce(e.score, 0) < 0.25 as dormant from nodes n left join (select id, {STRONG} as score, sum(frequency) as frequency from ends cross join (select max(frequency) as top from {source}) group by 1) e on e.id = n.id)"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """h, id, score."""
    rows = table(spark, sf_dir, "events").select(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h"), F.col("user_id").alias("id"), "value")
    return rows.groupBy("h", "id").agg(F.max("value").alias("score"))


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """h, id, score of every event: who is active enough once in an hour is so by the largest score too."""
    return table(spark, sf_dir, "events").select(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h"), F.col("user_id").alias("id"), F.col("value").alias("score"))


def synapses(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = together(moments(spark, sf_dir), ["h"], 0.15).select("note_a", "note_b", F.col("n").cast("double").alias("frequency"), F.col("last").alias("last_coactivated"), F.col("first").alias("created"))
    return pairs.select("note_a", "note_b", memory.weight_of(F.col("frequency")).alias("weight"), "frequency", "last_coactivated", "created")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()


def now(spark: SparkSession, sf_dir: str) -> F.Column:
    """The last event's time: one value for the whole table."""
    return F.lit(table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp")).cast("string").alias("t")).first()["t"]).cast("timestamp")


@query(f"with {SYN_SQL} select note_a, note_b, frequency, round(weight, 6) as weight from syn")
def coactivation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.coactivation(moments(spark, sf_dir), ["h"]).select("note_a", "note_b", "frequency", F.round("weight", 6).alias("weight"))


@query(f"with {SYN_SQL} select note_a, note_b, round(weight, 6) as weight, strftime(last_coactivated, '%Y-%m-%d %H:%M:%S') as last_coactivated from syn order by syn.weight desc, note_a, note_b limit 10")
def strongest_synapses(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = synapses(spark, sf_dir).orderBy(F.desc("weight"), "note_a", "note_b").limit(10)
    return top.select("note_a", "note_b", F.round("weight", 6).alias("weight"), F.date_format("last_coactivated", "yyyy-MM-dd HH:mm:ss").alias("last_coactivated"))


LEARN_SQL = f"""with {SYN_SQL}, cur as (select id, score from act where h = (select max(h) from act) and score >= 0.0),
prs as (select a.id as note_a, b.id as note_b from cur a join cur b on a.id < b.id where a.score >= 0.15 and b.score >= 0.15),
met as (select coalesce(s.note_a, p.note_a) as note_a, coalesce(s.note_b, p.note_b) as note_b, coalesce(s.frequency, 0) + case when p.note_a is null then 0 else 1 end as frequency, s.weight, p.note_a is not null as grown from syn s full outer join prs p on s.note_a = p.note_a and s.note_b = p.note_b),
upd as (select note_a, note_b, frequency, case when grown then 0.7 * least(frequency / 10.0, 1.0) + 0.3 when note_a not in (select id from cur) and note_b not in (select id from cur) then weight * 0.95 else weight end as weight from met)"""


@query(f"{LEARN_SQL} select note_a, note_b, frequency, round(weight, 6) as weight from upd where weight >= 0.01")
def hebbian_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    act = activity(spark, sf_dir)
    last = act.join(F.broadcast(act.agg(F.max("h").alias("h"))), "h").select("id", "score")
    done = memory.learn(synapses(spark, sf_dir), last, now(spark, sf_dir))
    return done.select("note_a", "note_b", "frequency", F.round("weight", 6).alias("weight"))


SESSION_SQL = f"""{LEARN_SQL}, kept as (select * from upd where weight >= 0.01),
e0 as (select note_a as id, weight, frequency from syn union all select note_b, weight, frequency from syn),
q0 as (select n.id, coalesce(e.score, 0) as score from nodes n left join (select id, {STRONG} as score from e0 cross join (select max(frequency) as top from syn) group by 1) e on e.id = n.id),
e1 as (select note_a as id, weight, frequency from kept union all select note_b, weight, frequency from kept),
q1 as (select n.id, coalesce(e.score, 0) as score from nodes n left join (select id, {STRONG} as score from e1 cross join (select max(frequency) as top from kept) group by 1) e on e.id = n.id),
woken as (select q0.id, case when q0.score < 0.6 and c.score >= 0.5 and c.score >= 0.15 then greatest(q0.score, c.score) else q0.score end as score, q0.score < 0.6 and not coalesce(c.score >= 0.5 and c.score >= 0.15, false) as dormant from q0 left join cur c on c.id = q0.id)"""


@query(f"{SESSION_SQL} select 49 as queries, id, round(score, 4) as score, dormant from woken union all select 50, id, score, score < 0.25 from q1")
def hebbian_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the 49th query, which wakes notes, and the 50th, which rates all of them anew, leave of their quality."""
    act = activity(spark, sf_dir)
    last = act.join(F.broadcast(act.agg(F.max("h").alias("h"))), "h").select("id", "score")
    syn, nodes = synapses(spark, sf_dir), users(spark, sf_dir)
    rated = memory.node_quality(nodes, syn).select("id", "score", (F.col("score") < 0.6).alias("dormant"))
    out = None
    for before in (48, 49):
        _, quality, queries = memory.learned(syn, rated, before, last, nodes, now(spark, sf_dir))
        rows = quality.select(F.lit(queries).alias("queries"), "id", F.round("score", 4).alias("score"), "dormant")
        out = rows if out is None else out.unionByName(rows)
    return out


REPLAY_SQL = f"""with recursive {SYN_SQL},
lg as (select cast(epoch(h) as bigint) as seq, id, score, case when hour(h) = 3 then 'nightly' when hour(h) % 5 = 0 then 'derived' else 'user' end as source, case when hour(h) = 3 then 0 else 1 end as n from act),
qs as (select seq, sum(n) over (order by seq) as q from (select distinct seq, n from lg)),
rw as (select lg.*, qs.q, sum(lg.n) over (partition by id order by lg.seq) as c from lg join qs on qs.seq = lg.seq),
pr as (select a.id as note_a, b.id as note_b, a.seq, a.q - a.c - b.c as rest, a.n, case when a.score >= 0.15 and b.score >= 0.15 then case when a.source = 'user' then 1.0 else 0.3 end end as gain from rw a join rw b on a.seq = b.seq and a.id < b.id),
both_active as (select *, sum(n) over (partition by note_a, note_b order by seq) as cab from pr),
ev as (select note_a, note_b, cast(rest + cab as double) as idle, cast(gain as double) as gain, row_number() over (partition by note_a, note_b order by seq) as k from both_active where gain is not null),
fold as (select note_a, note_b, k, gain as f, 0.7 * least(gain / 10, 1.0) + 0.3 as w, idle from ev where k = 1
  union all select note_a, note_b, k, f, 0.7 * least(f / 10, 1.0) + 0.3, idle from (select ev.note_a, ev.note_b, ev.k, case when fold.w * pow(0.95, ev.idle - fold.idle) >= 0.01 then fold.f else 0 end + ev.gain as f, ev.idle from fold join ev on ev.note_a = fold.note_a and ev.note_b = fold.note_b and ev.k = fold.k + 1)),
done as (select note_a, note_b, arg_max(f, k) as f, arg_max(w, k) as w, arg_max(idle, k) as idle from fold group by 1, 2),
total as (select id, max(c) as c from rw group by 1), joint as (select note_a, note_b, max(cab) as cab from both_active group by 1, 2),
fin as (select d.note_a, d.note_b, d.f, d.w * pow(0.95, (select max(q) from qs) - a.c - b.c + j.cab - d.idle) as w from done d join total a on a.id = d.note_a join total b on b.id = d.note_b join joint j on j.note_a = d.note_a and j.note_b = d.note_b)
select note_a, note_b, round(f, 6) as frequency, round(w, 6) as weight from fin where w >= 0.01"""


@query(REPLAY_SQL)
def hebbian_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    act = activity(spark, sf_dir)
    seq = F.unix_timestamp("h").cast("long")
    source = F.when(F.hour("h") == 3, "nightly").when(F.hour("h") % 5 == 0, "derived").otherwise("user")
    log = act.select(seq.alias("seq"), "id", "score", source.alias("source"))
    return memory.replay(log).select("note_a", "note_b", rounded(F.col("frequency"), 6).alias("frequency"), rounded(F.col("weight"), 6).alias("weight"))


RECENT = "weight >= 0.15 and last_coactivated + interval 1 hour > now - interval 10 minutes"


@query(f"with {SYN_SQL} select distinct id from (select note_a as id from syn, clock where {RECENT} union all select note_b from syn, clock where {RECENT})")
def recent_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synapse counts as active until its hour ends."""
    ended = synapses(spark, sf_dir).withColumn("last_coactivated", F.col("last_coactivated") + F.expr("interval 1 hour"))
    return memory.recent_notes(ended, now(spark, sf_dir))


@query(
    f"with {SYN_SQL}, rec as (select distinct id from act where h >= (select max(h) from act)), e as (select note_a as id, note_b as other, weight from syn where weight >= 0.15 union all select note_b, note_a, weight from syn where weight >= 0.15), "
    "t as (select id, weight, row_number() over (partition by id order by weight desc, other) as r from e where other in (select id from rec)) select id, round(least(sum(weight) * 0.3, 0.5), 6) as boost from t where r <= 3 group by id"
)
def hebbian_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    act = activity(spark, sf_dir)
    recent = act.join(F.broadcast(act.agg(F.max("h").alias("h"))), "h").select("id").distinct()
    return memory.boosts(synapses(spark, sf_dir), recent).select("id", F.round("boost", 6).alias("boost"))


@query(f"with {SYN_SQL}, {quality_sql()} select id, score, frequency, dormant from qual")
def node_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.node_quality(users(spark, sf_dir), synapses(spark, sf_dir)).select("id", "score", "frequency", "dormant")


@query(f"with {SYN_SQL}, {quality_sql()} select count(*) as total, count(*) filter (where dormant) as dormant, count(*) filter (where not dormant) as active, round(avg(score), 6) as avg_score from qual")
def quality_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = memory.quality_stats(memory.node_quality(users(spark, sf_dir), synapses(spark, sf_dir)))
    return stats.select("total", "dormant", "active", F.round("avg_score", 6).alias("avg_score"))


@query(
    f"with {SYN_SQL}, {quality_sql()}, a as (select user_id as id, max(value) / 500 as s from events group by 1), d as (select id, score, score < 0.6 as dormant from qual) "
    "select d.id, round(case when dormant and a.s >= 0.5 then greatest(score, a.s) else score end, 6) as score, dormant and not a.s >= 0.5 as dormant from d left join a on a.id = d.id"
)
def reactivate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = memory.node_quality(users(spark, sf_dir), synapses(spark, sf_dir)).select("id", "score", (F.col("score") < 0.6).alias("dormant"))
    active = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg((F.max("value") / 500).alias("score"))
    return memory.reactivate(rated, active).select("id", F.round("score", 6).alias("score"), "dormant")


@query(f"with {SYN_SQL} select note_a, note_b, round(weight * 0.9, 6) as weight from syn")
def downscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidation.downscale(synapses(spark, sf_dir)).select("note_a", "note_b", "weight")


#: A third of the weights as if long decayed, so that pruning has something to do.
FADED_SQL = "fad as (select note_a, note_b, case when (note_a + note_b) % 3 = 0 then weight * 0.04 else weight end as weight, frequency, last_coactivated, created from syn)"


def faded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synapses(spark, sf_dir).withColumn("weight", F.when((F.col("note_a") + F.col("note_b")) % 3 == 0, F.col("weight") * 0.04).otherwise(F.col("weight")))


STALE = "(weight < 0.15 and frequency <= 1 and last_coactivated <= now - interval 48 hours)"


@query(f"with {SYN_SQL}, {FADED_SQL} select note_a, note_b, round(weight, 6) as weight from fad, clock where not {STALE}")
def stale_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidation.prune_stale(faded(spark, sf_dir), now(spark, sf_dir)).select("note_a", "note_b", F.round("weight", 6).alias("weight"))


@query(f"with {SYN_SQL}, {FADED_SQL} select note_a, note_b, round(weight, 6) as weight from fad where weight >= 0.02")
def structural_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidation.prune_structural(faded(spark, sf_dir)).select("note_a", "note_b", F.round("weight", 6).alias("weight"))


@query(f"with {SYN_SQL}, {FADED_SQL} select count(*) filter (where weight > 0.7) as strong, count(*) filter (where weight < 0.15) as weak, count(*) filter (where {STALE}) as stale_weak from fad, clock")
def tail_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidation.tail_stats(faded(spark, sf_dir), now(spark, sf_dir))


CONSOLIDATE_SQL = f"""with {SYN_SQL}, {FADED_SQL},
sc as (select note_a, note_b, round(weight * 0.9, 6) as weight, frequency, last_coactivated from fad),
fr as (select sc.* from sc, clock where not {STALE}),
kp as (select * from fr where weight >= 0.02),
{quality_sql('kp')},
dr as (select id from qual where dormant and id % 4 + 1 >= 3),
fin as (select * from kp where note_a not in (select id from dr) and note_b not in (select id from dr))"""


@query(f"{CONSOLIDATE_SQL} select (select count(*) from syn) as before, (select count(*) from fr) as after_stale, (select count(*) from kp) as after_structural, (select count(*) from fin) as after_dormant, (select count(*) from dr) as dropped_notes")
def consolidation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidated(spark, sf_dir)["report"]


def consolidated(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    nodes = users(spark, sf_dir)
    old = nodes.select("id", (F.col("id") % 4).cast("int").alias("dormant_cycles"))
    return consolidation.consolidate(faded(spark, sf_dir), old, nodes, now(spark, sf_dir))


@query(f"{CONSOLIDATE_SQL} select note_a, note_b, weight from fin")
def consolidated_synapses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidated(spark, sf_dir)["synapses"].select("note_a", "note_b", "weight")


@query(f"with {SYN_SQL}, m as (select note_a, note_b, frequency + 1 as frequency from syn where (note_a + note_b) % 2 = 0) select note_a, note_b, frequency from m union all select note_a, note_b, frequency from syn where (note_a, note_b) not in (select (note_a, note_b) from m)")
def state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    disk = synapses(spark, sf_dir).select("note_a", "note_b", "frequency")
    mine = disk.filter("(note_a + note_b) % 2 = 0").withColumn("frequency", F.col("frequency") + 1)
    return consolidation.merge_states(mine, disk, ["note_a", "note_b"])


@query(f"with {SYN_SQL}, m as (select least(note_a % 50, note_b % 50) as note_a, greatest(note_a % 50, note_b % 50) as note_b, weight, frequency from syn where note_a % 50 <> note_b % 50) select note_a, note_b, round(max(weight), 6) as weight from m group by 1, 2")
def id_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = users(spark, sf_dir).select(F.col("id").alias("old_id"), (F.col("id") % 50).alias("new_id"))
    moved = graph.migrate_ids(synapses(spark, sf_dir).select("note_a", "note_b", "weight", "frequency"), mapping)
    return moved.select("note_a", "note_b", F.round("weight", 6).alias("weight"))


@query(f"with {SYN_SQL} select count(*) as synapses, round(sum(weight), 4) as weight from syn where note_a % 3 <> 0 and note_b % 3 <> 0")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = consolidation.reconcile(synapses(spark, sf_dir), users(spark, sf_dir).filter("id % 3 != 0"))
    return valid.agg(F.count(F.lit(1)).alias("synapses"), F.round(F.sum("weight"), 4).alias("weight"))


@query(f"with {SYN_SQL}, {FADED_SQL} select note_a, note_b, frequency from fad where frequency <= 1 and weight < 0.5 and not (note_b = note_a + 1)")
def spurious_synapses(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = users(spark, sf_dir).select((F.col("id") + 1).alias("src"), F.col("id").alias("dst"))
    return consolidation.spurious(faded(spark, sf_dir), edges).select("note_a", "note_b", "frequency")


AUDIT_SQL = f"""with {SYN_SQL}, {FADED_SQL}, ok as (select id from nodes where id % 3 <> 0), ed as (select note_a as src, case when note_b % 5 = 0 then note_a else note_b end as dst from syn)
select (select count(*) from ok) as nodes, (select count(*) from ed) as edges, (select count(*) from ed where src = dst) as self_loops, (select coalesce(sum(n - 1), 0) from (select count(*) as n from ed group by src, dst)) as duplicates,
(select count(*) from fad) as synapses, (select count(*) from fad where weight < 0.15) as weak, (select count(*) from fad where weight > 0.7) as strong, (select count(*) from fad, clock where weight < 0.15 and last_coactivated <= now - interval 48 hours and (note_a + note_b) % 11 <> 0) as stale, (select count(*) from fad where (note_a + note_b) % 11 = 0) as malformed,
(select count(*) from ed where src not in (select id from ok)) + (select count(*) from ed where dst not in (select id from ok)) as invalid_edge_ends,
(select count(*) from fad where note_a not in (select id from ok)) + (select count(*) from fad where note_b not in (select id from ok)) as invalid_synapse_ends"""


@query(AUDIT_SQL)
def structural_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = users(spark, sf_dir).filter("id % 3 != 0")
    edges = synapses(spark, sf_dir).select(F.col("note_a").alias("src"), F.when(F.col("note_b") % 5 == 0, F.col("note_a")).otherwise(F.col("note_b")).alias("dst"), F.lit("x").alias("type"))
    at = F.when((F.col("note_a") + F.col("note_b")) % 11 == 0, "no time").otherwise(F.col("last_coactivated").cast("string"))
    return graph.audit(nodes, edges, faded(spark, sf_dir).withColumn("last_coactivated", at), now(spark, sf_dir))
