"""Operators on skewed inputs: one query, hub or cell that holds most of all rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from engrama.operators import activation, consolidation, memory, vectors
from engrama.settings import Settings

from .test_operators import simulate


def greedy(rows, per_node, total):
    taken, out = Counter(), []
    for s, t, x in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        if len(out) < total and taken[s] < per_node and taken[t] < per_node:
            out.append((s, t, x))
            taken[s] += 1
            taken[t] += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_phantom_rounds_equal_the_sequential_choice(spark, seed):
    rng = random.Random(seed)
    rows = list({(a, b): (a, b, rng.randint(1, 9) / 10) for a, b in ((f"n{rng.randint(0, 30)}", rng.choice(["hub", f"n{rng.randint(0, 60)}"])) for _ in range(250)) if a != b}.values())
    frame = spark.createDataFrame(rows, "source string, target string, similarity double")
    for total in (1000, 20):
        got = consolidation.phantom_links(frame, Settings(phantom_per_node=3, phantom_total=total)).collect()
        assert sorted(map(tuple, got)) == sorted(greedy(rows, 3, total))
    assert consolidation.phantom_links(frame.limit(0)).count() == 0


def test_pairs_of_a_query_with_most_notes(spark):
    rows = [(0, i, 0.5) for i in range(900)] + [(q, i, 0.5) for q in range(1, 11) for i in range(q, q + 10)]
    active = spark.createDataFrame(rows, "q long, id long, score double")
    left, right = memory.in_blocks(active, ["q"], 100)
    sizes = left.groupBy("q", "__i", "__j").count().collect()
    assert len([r for r in sizes if r.q == 0]) == 81 and max(r["count"] for r in sizes) < 200
    met = left.withColumnRenamed("id", "a").join(right.withColumnRenamed("id", "b"), ["q", "__i", "__j"]).filter("a < b")
    assert met.count() == met.select("q", "a", "b").distinct().count() == 900 * 899 // 2 + 10 * 45


def test_replay_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    log = spark.createDataFrame([(q, f"n{i}", rng.choice([0.05, 0.4]), "user") for q in range(20) for i in rng.sample(range(40), 30 if q == 7 else 6)], "seq long, id string, score double, source string")
    rows = lambda: sorted(tuple(r) for r in memory.replay(log).select("note_a", "note_b", F.round("frequency", 9), F.round("weight", 9)).collect())
    whole = rows()
    monkeypatch.setattr(memory, "PAIR_BLOCK", 4)
    assert rows() == whole and len(whole) > 50


def test_a_hub_is_cut_before_its_links_meet(spark):
    links = 200_000
    names = [f"t{i}" for i in range(links)]
    s = Settings(active_threshold=0.01, max_hop=2, neighbours_per_hop=10, hop_decay=0.5)
    cand = {"hub": 0.9} | {f"t{i * 1000 + 7}": 0.5 + i / 1000 for i in range(20)}
    expected = simulate([("hub", 0.9)], {"hub": names, "t19007": ["hub", "t5"]}, cand, {}, s)
    edges = spark.range(links).select(F.lit("hub").alias("src"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("dst"), F.col("id").cast("int").alias("edge_ord"))
    edges = edges.union(spark.createDataFrame([("t19007", "hub", 0), ("t19007", "t5", 1)], edges.schema)).repartition(8)
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = activation.khop(frame([(0, "hub", 0.9, 0)], "query_id int, id string, score double, seed_rank int"), edges, frame([(0, n, x) for n, x in cand.items()], "query_id int, id string, score double"), frame([], "id string, degree long"), s)
    assert {r.id: (round(r.score, 9), r.role, r.hop, r.parent) for r in got.collect()} == expected


def nearest_naive(ids, rows, n):
    m = np.array(rows, float)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    unit = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    cos = np.round(unit @ unit.T, 9)
    out = set()
    for i, name in enumerate(ids):
        best = sorted((-cos[i, j], other) for j, other in enumerate(ids) if j != i)[:n]
        out |= {(name, other, k + 1) for k, (_, other) in enumerate(best)}
    return out


@pytest.mark.parametrize("block", [8192, 40])
def test_nearest_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "CELL", 10)
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(12, 8))
    rows = [(middles[rng.integers(12) if i % 3 else 0] + rng.normal(size=8) * 0.1).round(6).tolist() for i in range(400)] + [[0.0] * 8, [0.0] * 8]
    ids = [f"v{i:04d}" for i in range(len(rows))]
    frame = spark.createDataFrame(list(zip(ids, rows)), "id string, embedding array<double>")
    got = {(r.a, r.b, r["rank"]) for r in vectors.nearest(frame, 5).collect()}
    expected = nearest_naive(ids, rows, 5)
    zero = {"v0400", "v0401"}
    assert {x for x in got if x[0] not in zero} == {x for x in expected if x[0] not in zero}
    assert len(got) == len(expected)


def test_bounds_skip_most_blocks_of_clustered_vectors(spark, monkeypatch):
    """Rows of the second pass grow with the vectors, not with their square."""
    monkeypatch.setattr(vectors, "BLOCK", 100)
    rng = np.random.default_rng(3)
    shares = []
    for n in (1000, 4000):
        middles = rng.normal(size=(n // 50, 16))
        rows = [(middles[i % len(middles)] + rng.normal(size=16) * 0.05).tolist() for i in range(n)]
        frame = spark.createDataFrame(list(enumerate(rows)), "id long, embedding array<double>")
        members, pivots, radius, blocks, parts = vectors.cells_of(frame)
        own = members.groupBy("home").applyInArrow(vectors._own_cells(3), "a long, b long, cos double")
        least = own.groupBy("a").agg(F.min("cos").alias("least"))
        visits = members.join(least, members["id"] == least["a"]).select("id", "x", "cell", "home", "least").mapInArrow(vectors._visits(pivots, radius, blocks, parts), "id long, x array<double>, home int, least double, block int, cells array<int>")
        there = int(parts.sum()) and members.select("home").distinct().count()
        shares.append(visits.count() / n / there)
    assert shares[0] < 0.3 and shares[1] < shares[0] / 2


def test_more_queries_than_are_broadcast_at_once(spark, monkeypatch):
    rng = random.Random(1)
    frame = spark.createDataFrame([(i, [rng.random() for _ in range(3)]) for i in range(40)], "id long, embedding array<double>")
    asked = frame.select(F.col("id").alias("query_id"), F.col("embedding").alias("qv"))
    rows = lambda: sorted((r.query_id, r.id, r["rank"]) for r in vectors.top_by_vector(frame, asked, 4).collect())
    whole = rows()
    monkeypatch.setattr(vectors, "QUERIES", 7)
    assert rows() == whole


def test_batches_of_a_log_equal_its_replay(spark, tmp_path, monkeypatch):
    from engrama.streaming import learning

    monkeypatch.setattr(learning, "COMPACT", 3)
    rng = random.Random(6)
    rows = [(q, f"n{i}", rng.choice([0.05, 0.3, 0.9]), source) for q in range(120) for source in [rng.choice(["user", "user", "derived", "nightly"])] for i in rng.sample(range(9), rng.choice([1, 2, 3, 4]))]
    frame = lambda part: spark.createDataFrame(part, "seq long, id string, score double, source string")
    s = Settings(decay=0.8)
    log = learning.LearningLog(spark, f"file://{tmp_path}/log", settings=s)
    plain = lambda df: sorted((r.note_a, r.note_b, round(r.frequency, 9), round(r.weight, 9)) for r in df.collect())
    assert log.synapses().count() == 0
    for k in range(6):
        part = frame([r for r in rows if r[0] // 20 == k])
        log.learn(part, k)
        log.learn(part, k)  # delivered twice
        assert plain(log.synapses()) == plain(memory.replay(frame([r for r in rows if r[0] // 20 <= k]), s))
    assert len(log.held()) < 4 and log.last() == 5


def test_a_batch_writes_as_much_as_it_touches(spark, tmp_path):
    from engrama.streaming.learning import LearningLog

    log = LearningLog(spark, f"file://{tmp_path}/log", "long")
    active = lambda q, ids: [(q, i, 0.5, "user") for i in ids]
    frame = lambda rows: spark.createDataFrame(rows, "seq long, id long, score double, source string")
    log.learn(frame(active(0, range(300))), 0)
    log.learn(frame(active(1, [1, 2, 3])), 1)
    sizes = [spark.read.parquet(f"file://{tmp_path}/log/batch-{n}/pairs").count() for n in (0, 1)]
    assert sizes == [300 * 299 // 2, 3]
    weights = {(r.note_a, r.note_b): round(r.weight, 6) for r in log.synapses().filter("note_a < 5 and note_b < 6").collect()}
    assert weights[1, 2] == 0.44 and weights[4, 5] == round(0.37 * 0.95, 6) and weights[1, 4] == 0.37


@pytest.mark.parametrize("met", [32_768, 7])
def test_best_matches_meet_in_blocks(spark, monkeypatch, met):
    monkeypatch.setattr(vectors, "MET", met)
    monkeypatch.setattr(vectors, "PART", 3)
    rng = random.Random(8)
    known = [(i, [rng.choice([0.0, 1.0, -1.0, 2.0]) for _ in range(3)]) for i in range(40)] + [(40, [1.0, 2.0]), (41, None), (42, [0.0, 0.0, 0.0]), (43, [1.0, None, 1.0]), (44, [])]
    asked = [(f"q{i}", [rng.choice([0.0, 1.0, -1.0, 3.0]) for _ in range(3)]) for i in range(30)] + [("two", [2.0, 4.0]), ("none", None), ("zero", [0.0, 0.0, 0.0]), ("far", [0.0, 0.0, 0.0, 1.0])]

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or None in a + b or not any(a) or not any(b):
            return 0.0
        return round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 12)

    wanted = {}
    for q, x in asked:
        best = min((-cosine(x, y), i) for i, y in known)
        if -best[0] >= 0.65:
            wanted[q] = (best[1], round(-best[0], 9))
    rows, collection = spark.createDataFrame(asked, "query_id string, qv array<double>"), spark.createDataFrame(known, "id long, embedding array<double>")
    found = vectors.best_match(rows, collection, 0.65)
    assert {r.query_id: (r.match, round(r.similarity, 9)) for r in found.collect()} == wanted and wanted["two"][0] == 40 and len(wanted) > 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan  # no row per query and vector
    assert vectors.best_match(rows, collection.limit(0), 0.65).count() == 0
