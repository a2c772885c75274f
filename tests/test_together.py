"""Pairs counted in blocks of notes, held against plain Python."""

import random
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from engrama.operators import memory, together


def naive(rows, least):
    at, out = {}, {}
    for k, i, s in rows:
        if s is not None and s >= least and i is not None and k is not None:
            at.setdefault(k, set()).add(i)
    for k in sorted(at):
        for a, b in combinations(sorted(at[k]), 2):
            n, first, _ = out.get((a, b), (0, k, k))
            out[a, b] = (n + 1, first, k)
    return out


@pytest.mark.parametrize("cells", [2_000_000, 40])
@pytest.mark.parametrize("notes", [4096, 7])
def test_blocks_equal_all_pairs(spark, monkeypatch, cells, notes):
    monkeypatch.setattr(together, "CELLS", cells)
    monkeypatch.setattr(together, "BLOCK_NOTES", notes)
    rng, day = random.Random(3), datetime(2024, 1, 1)
    for minutes in (60, 7):  # whole hours and other times
        rows = [(day + timedelta(minutes=minutes * rng.randint(0, 30)), f"n{rng.randint(0, 40)}", rng.choice([0.1, 0.2, None])) for _ in range(400)]
        rows += [(None, "n1", 0.9), (day, None, 0.9), (day, "alone", 0.9)]
        got = together.together(spark.createDataFrame(rows, "h timestamp, id string, score double"), ["h"], 0.15)
        assert {(r.note_a, r.note_b): (r.n, r.first, r.last) for r in got.collect()} == naive(rows, 0.15)


def test_few_meetings_and_keys_of_any_kind(spark):
    rows = [("q", 1, i, 0.5) for i in range(5)] + [("q", 2, 4, 0.5), ("p", 1, 4, 0.5), ("p", 1, 900, 0.5)] + [(f"x{i}", 1, 1000 + i, 0.5) for i in range(900)]
    active = spark.createDataFrame(rows, "v string, q int, id long, score double")
    got = {(r.note_a, r.note_b): r.frequency for r in memory.coactivation(active, ["v", "q"]).collect()}
    assert got == {p: 1.0 for p in [*combinations(range(5), 2), (4, 900)]}
    assert memory.coactivation(active.limit(0), ["v", "q"]).count() == 0


def test_no_pair_is_shuffled(spark):
    active = spark.createDataFrame([(q, i, 0.5) for q in range(4) for i in range(6)], "q long, id long, score double")
    plan = memory.coactivation(active, ["q"])._jdf.queryExecution().executedPlan().toString()
    assert "note_a" in plan and not [x for x in plan.splitlines() if "Exchange" in x and "note_a" in x]


def exchanges_of_pairs(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "note_" in x]


def test_a_query_and_consolidation_leave_pairs_where_they_are(spark):
    from pyspark.sql import functions as F

    from engrama.operators import consolidation

    kind = "note_a long, note_b long, weight double, frequency double, last_coactivated timestamp, created timestamp"
    t = datetime(2024, 1, 1)
    spark.createDataFrame([(a, b, 0.5, 2.0, t, t) for a, b in combinations(range(8), 2) if (a, b) != (1, 2)], kind).write.mode("overwrite").saveAsTable("held_pairs")
    held = spark.table("held_pairs")
    now = F.lit("2024-01-02").cast("timestamp")
    active = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.5), (4, 0.1)], "id long, score double")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables of unknown size
    try:
        after = memory.learn(held, active, now)
        got = {(r.note_a, r.note_b): (r.frequency, round(r.weight, 6)) for r in after.collect()}
        nodes = held.select(F.col("note_a").alias("id")).distinct()
        parts = [consolidation.with_notes(held, nodes), consolidation.without_notes(held, nodes.limit(2)), memory.boosts(held, nodes.limit(2)).select("id")]
        assert not [x for p in parts for x in exchanges_of_pairs(p)]
        assert not exchanges_of_pairs(consolidation.consolidate(held, nodes.withColumn("dormant_cycles", F.lit(0)), nodes, now)["synapses"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("drop table held_pairs")
    assert len(got) == 28 and got[1, 2] == (1.0, 0.37) and got[2, 3] == (3.0, 0.51) and got[4, 5] == (2.0, 0.5) and got[0, 5] == (2.0, 0.475)


@pytest.mark.parametrize(("cells", "notes"), [(2_000_000, 4096), (40, 7), (500, 4096)])
def test_a_log_is_replayed_where_blocks_meet(spark, monkeypatch, cells, notes):
    from engrama.settings import Settings

    monkeypatch.setattr(together, "CELLS", cells)
    monkeypatch.setattr(together, "BLOCK_NOTES", notes)
    rng, s = random.Random(11), Settings(decay=0.7)
    log = []
    for q in range(60):
        source = rng.choice(["user", "user", "derived", "nightly"])
        log += [(q * 10, f"n{i}", rng.choice([0.05, 0.4, 0.9, None]), source) for i in rng.sample(range(30), rng.choice([2, 6, 12]))]
    kind = "seq long, id string, score double, source string"
    plain = lambda df: {(r.note_a, r.note_b): (round(r.frequency, 9), round(r.weight, 9)) for r in df.collect()}
    rows = spark.createDataFrame(log, kind)
    done = memory.replay(rows, s)
    assert plain(done) == plain(memory.weights_now(*memory.fold(rows, None, s), s)) and 20 < len(plain(done)) < 435
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange" in x and "note_" in x] and "Join" not in plan
    odd = spark.createDataFrame([*log, *log, (None, "n1", 0.9, "user"), (5, None, 0.9, "user")], kind)  # a note that is named twice is one
    once = spark.createDataFrame([*log, (5, "alone", 0.9, "user")], kind)
    assert plain(memory.replay(odd, s)) == plain(memory.replay(once, s))
    assert memory.replay(rows.limit(0), s).count() == 0


def test_blocks_of_different_times_never_meet(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(together, "BLOCK_NOTES", 5)
    rng, day = random.Random(4), datetime(2024, 1, 1)
    rows = [(day + timedelta(days=40 * month, hours=rng.randint(0, 20)), f"m{month}n{rng.randint(0, 9)}", 0.5) for month in range(8) for _ in range(60)]
    rows += [(day, f"first{i}", 0.5) for i in range(12)]  # more than a block begins at one time
    active = spark.createDataFrame([*rows, *[(day + timedelta(days=d), "always", 0.5) for d in range(300)]], "h timestamp, id string, score double")
    got = together.together(active, ["h"], 0.15)
    assert {(r.note_a, r.note_b): (r.n, r.first, r.last) for r in got.collect()} == naive([tuple(r) for r in active.collect()], 0.15)

    sent = spark.sparkContext.accumulator(0)

    def found(left, right, same):
        sent.add(len(left.ids) + (0 if same else len(right.ids)))
        yield from together.counts(left, right, same)

    hours = spark.createDataFrame(rows, "h timestamp, id string, score double").groupBy("id").agg(F.sort_array(F.collect_set(F.unix_micros("h"))).alias("k"))
    notes, pairs = hours.count(), together.in_block_pairs(hours, found, "n long, first long, last long")
    assert pairs.count() == len(naive(rows, 0.15))
    assert notes < sent.value < 6 * notes  # each met all of 19 blocks before


@pytest.mark.parametrize("rows", [1_000_000, 50])
def test_states_merge_packed(spark, monkeypatch, rows):
    from engrama.operators import consolidation, packed

    monkeypatch.setattr(packed, "ROWS", rows)
    rng = random.Random(9)
    some = lambda n: [(rng.randint(-5, 20), rng.randint(0, 2**60), rng.choice([None, 1.0, 2.5]), rng.choice([None, ["x"], []])) for _ in range(n)]
    disk = [*some(300), (None, 1, 7.0, None), (1, None, 8.0, ["y"])]
    mine = [(a, b, 9.0, None) for a, b, *_ in disk[::2]] + some(20) + [(None, None, 3.0, None)]
    kind = "note_a long, note_b long, frequency double, tags array<string>"
    frame = lambda x, ids=kind: spark.createDataFrame(x, ids)
    wanted = [*mine, *(r for r in disk if None in r[:2] or (r[0], r[1]) not in {m[:2] for m in mine})]
    show = lambda x: sorted(map(repr, map(tuple, x)))
    done = consolidation.merge_states(frame(mine), frame(disk).select("tags", "note_b", "frequency", "note_a"), ["note_a", "note_b"])
    assert done.columns == ["note_a", "note_b", "frequency", "tags"] and show(done.collect()) == show(wanted)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange" in x and "note_" in x]  # no pair is shuffled by itself
    text = lambda x: [(f"n{a}", *rest) for a, *rest in x]
    named = consolidation.merge_states(*(frame(text(x), kind.replace("note_a long", "note_a string")) for x in (mine, disk)), ["note_a"])
    assert show(named.collect()) == show([*text(mine), *(r for r in text(disk) if r[0] not in {m[0] for m in text(mine)})])
    assert consolidation.merge_states(frame(mine).limit(0), frame(disk), ["note_a"]).count() == len(disk)
    assert consolidation.merge_states(frame(mine), frame(disk).limit(0), ["note_a"]).count() == len(mine)


@pytest.mark.parametrize("rows", [1_000_000, 7])
def test_lists_of_keys_travel_packed(spark, monkeypatch, rows):
    from engrama.operators import packed

    monkeypatch.setattr(packed, "ROWS", rows)
    monkeypatch.setattr(together, "PLACES", rows)
    monkeypatch.setattr(together, "BLOCK_NOTES", 9)
    rng = random.Random(5)
    for ids, kind in ((lambda: rng.randint(-9, 20), "long"), (lambda: rng.choice(["", "a", "\u00e9", "n1", "n10"]), "string")):
        found = [(ids(), rng.choice([-(2**62), 0, 5, 2**62, rng.randint(-50, 50)])) for _ in range(300)]
        frame = spark.createDataFrame(found, f"id {kind}, k long")
        wanted = {i: sorted({k for j, k in found if j == i}) for i, _ in found}
        done = packed.listed(frame, "id", "k")
        assert {r.id: r.k for r in done.collect()} == wanted and done.dtypes == [("id", frame.dtypes[0][1]), ("k", "array<bigint>")]
        assert packed.listed(frame.limit(0), "id", "k").count() == 0
    lists = spark.createDataFrame([(f"n{i}", list(range(i, 400)), [1] * (400 - i)) for i in range(40)], "id string, k array<int>, flags array<tinyint>")
    blocked, spans = together.in_blocks_by_key(lists)
    sent = together.sent_to_meetings(blocked, spans).collect()
    places = sum(len(r.k) for r in lists.collect()) * len(spans)
    assert len(spans) > 3 and (rows < 1000 or sum(len(r.rows) for r in sent) < 2 * places)  # five bytes a place before


def test_a_snapshot_goes_through_pairs_once(spark):
    from engrama.operators import payloads
    from engrama.plans.detail_queries import graph_snapshot

    plan = graph_snapshot(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # all that is told of pairs was gathered with the quality of notes
    t = datetime(2024, 1, 1)
    pairs = spark.createDataFrame([(1, 2, 0.5, 2.0, t), (2, 3, 0.9, None, t), (1, 8, 0.25, 1.0, t)], "note_a long, note_b long, weight double, frequency double, last_coactivated timestamp")
    for held, n, total in ((pairs, 3, 1.65), (pairs.limit(0), None, None)):
        per = memory.per_note(held, pairs=F.lit(1).cast("long"), weights=F.col("weight"))
        assert [tuple(r) for r in per.agg(F.sum("pairs"), F.sum("weights")).collect()] == [(n, total)]
        nodes = spark.createDataFrame([(i, f"t{i}") for i in (1, 2, 3, 4)], "id long, title string")
        show = lambda known: sorted(map(tuple, memory.node_quality(nodes, held, known=known).collect()))
        assert show(per) == show(None)
        links = held.select(F.col("note_a").alias("src"), F.col("note_b").alias("dst"))
        args = (nodes, links, held, links, memory.node_quality(nodes, held))
        counted = per.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("hebbian_synapses"), F.sum("weights").alias("else"))
        plain, known = payloads.snapshot(*args)["stats"], payloads.snapshot(*args, counted)["stats"]
        assert plain.columns == known.columns and plain.collect() == known.collect()


def test_who_is_active_enough_by_any_event_is_so_by_the_largest(spark, tmp_path):
    from engrama.plans import memory_queries

    day = datetime(2024, 1, 1)
    rows = [(day + timedelta(minutes=20 * m), u, v) for m in range(9) for u, v in ((1, 0.1), (1, 0.2), (2, None), (2, 0.15), (3, 0.14), (4, float("nan")), (None, 0.5))]
    spark.createDataFrame(rows, "ts timestamp, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    by_largest = memory.coactivation(memory_queries.activity(spark, str(tmp_path)), ["h"])
    done = memory_queries.coactivation_pairs(spark, str(tmp_path))
    show = lambda x: sorted((r.note_a, r.note_b, r.frequency, round(r.weight, 6)) for r in x.collect())
    assert show(done) == show(by_largest) == [(1, 2, 3.0, 0.51), (1, 4, 3.0, 0.51), (2, 4, 3.0, 0.51)]


@pytest.mark.parametrize("notes", [4096, 5])
def test_a_vault_counts_its_pairs_where_they_meet(spark, monkeypatch, notes):
    from engrama.operators import tenants
    from engrama.plans.detail_queries import tenant_rollup

    monkeypatch.setattr(together, "BLOCK_NOTES", notes)
    rng, day = random.Random(5), datetime(2024, 1, 1)
    vault = {i: rng.choice(["a", "b", None]) for i in range(30)} | {30: "alone"}
    rows = [(day + timedelta(hours=rng.randint(0, 20)), rng.randint(0, 35), rng.choice([0.1, 0.2])) for _ in range(300)]
    own = spark.createDataFrame([*vault.items()], "id long, vault_id string")
    active = spark.createDataFrame(rows, "h timestamp, id long, score double")
    wanted = {}
    for a, b in naive(rows, 0.15):
        if vault.get(a) and vault.get(a) == vault.get(b):
            wanted[vault[a]] = wanted.get(vault[a], 0) + 1
    assert dict(map(tuple, tenants.learned_by_vault(own, active).collect())) == wanted and len(wanted) == 2
    plan = tenant_rollup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "first" in plan and not [x for x in plan.splitlines() if "Exchange" in x and "note_" in x] and "note_a" not in plan  # pairs were sent to the driver and to every task


def test_consolidation_counts_in_the_pass_that_rates_notes(spark):
    from engrama.operators import consolidation

    t, now = datetime(2024, 1, 1), F.lit("2024-02-01").cast("timestamp")
    rows = [(1, 2, 0.9, 5.0, t), (1, 3, 0.1, 1.0, t), (2, 3, 0.01, 9.0, t), (4, 5, 0.02, 1.0, t), (5, 6, None, 2.0, None), (2, 6, 0.3, 1.0, t)]
    held = spark.createDataFrame(rows, "note_a long, note_b long, weight double, frequency double, last_coactivated timestamp")
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    left = {(1, 2): (0.81, 5.0), (2, 6): (0.27, 1.0)}
    rated = memory.node_quality(nodes, spark.createDataFrame([(*k, *v) for k, v in left.items()], "note_a long, note_b long, weight double, frequency double")).drop("dormant")
    for cycles, gone, last in ((0, 0, 2), (2, 5, 1)):  # nobody has slept for long; all that sleep have, 6 among them
        done = consolidation.consolidate(held, nodes.withColumn("dormant_cycles", F.lit(cycles)), nodes, now)
        got = done["synapses"].select("note_a", "note_b", "weight").collect()
        assert sorted(map(tuple, got)) == sorted((*k, v[0]) for k, v in left.items())[:last]
        assert done["report"].columns == ["before", "after_stale", "after_structural", "after_dormant", "dropped_notes"]
        assert tuple(done["report"].first()) == (6, 4, 2, last, gone)
        kept = {r.id for r in done["node_quality"].collect()}
        show = lambda x: sorted(tuple(r) for r in x.collect() if r.id in kept)
        assert show(done["node_quality"].select(*rated.columns)) == show(rated) and len(kept) == 7 - gone
        if not gone:
            assert "note_a" not in done["report"]._jdf.queryExecution().executedPlan().toString()  # pairs were gone through twice more
    assert tuple(consolidation.consolidate(held.limit(0), nodes.withColumn("dormant_cycles", F.lit(0)), nodes, now)["report"].first()) == (0, 0, 0, 0, 0)


def test_an_audit_goes_through_each_table_once(spark):
    from engrama.operators import graph

    nodes = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    edges = spark.createDataFrame([(1, 1, "x"), (1, 1, "x"), (1, 9, "x"), (1, 9, "y"), (None, 2, "x"), (None, 2, "x"), (8, None, None)], "src long, dst long, type string")
    held = spark.createDataFrame([(1, 2, 0.1, "2024-01-01 00:00:00"), (1, 9, 0.9, "no time"), (8, 9, 0.1, None), (None, 2, None, "2024-01-01 00:00:00")], "note_a long, note_b long, weight double, last_coactivated string")
    now = F.lit("2024-01-31").cast("timestamp")
    got = graph.audit(nodes, edges, held, now)
    assert got.first().asDict() == {"nodes": 3, "edges": 7, "self_loops": 2, "duplicates": 2, "synapses": 4, "weak": 2, "strong": 1, "stale": 1, "malformed": 1, "invalid_edge_ends": 6, "invalid_synapse_ends": 4}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert sum("src" in x and "LogicalRDD" in x for x in plan.splitlines()) == 1 == sum("weight" in x and "LogicalRDD" in x for x in plan.splitlines())
    assert set(graph.audit(nodes.limit(0), edges.limit(0), held.limit(0), now).first()) == {0}


def test_rounded_equals_round(spark):
    from engrama.functions.numbers import rounded

    rng = random.Random(2)
    values = [rng.uniform(-3, 3) for _ in range(3000)] + [rng.randint(-(10**7), 10**7) / 2e6 for _ in range(1000)] + [(2 * rng.randint(-9999, 9999) + 1) / 2e6 for _ in range(3000)]
    values += [0.0, -0.0, -1e-9, 1e300, -1e300, 5e8, 123456789.1234565, 1073.7418235, float("inf"), float("nan"), None]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(F.col("x"), F.round("x", 6).alias("a"), rounded(F.col("x"), 6).alias("b"))
    assert rows.filter(~F.col("a").eqNullSafe(F.col("b"))).collect() == []
