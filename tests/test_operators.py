import math
import random

from pyspark.sql import functions as F

from engrama.functions import vectors as v
from engrama.operators import activation, consolidation, graph, memory, sessions, vectors
from engrama.settings import Settings
from engrama.sources.notes import Source, counterparts_from_config, links, nodes, scan, sources_from_config, tenants_from_config
from engrama.sources.store import Store
from engrama.streaming import events as streams

FRUIT = [("apple", [1.0, 0, 0, 0]), ("banana", [0.9, 0.1, 0, 0]), ("cherry", [0.8, 0.2, 0, 0]), ("carrot", [0, 0, 1.0, 0]), ("spinach", [0, 0, 0.9, 0.1]), ("index", [0.5, 0.5, 0.5, 0]), ("empty", [])]


def test_nearest_and_top(spark):
    notes = spark.createDataFrame([(i, [float(x) for x in e]) for i, e in FRUIT], "id string, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0]), (1, [])], "query_id long, qv array<double>")
    assert [r.id for r in vectors.top_by_vector(notes, q, 3).orderBy("rank").collect()] == ["apple", "banana", "cherry"]
    near = {(r.a, r["rank"]): r.b for r in vectors.nearest(notes, 2).collect()}
    assert near["apple", 1] == "banana" and near["spinach", 1] == "carrot" and ("empty", 1) not in near
    assert abs(spark.range(1).select(v.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))).first()[0]) == 0


def simulate(seeds, out, cand, degree, s):
    """One query of bounded spreading with a queue."""
    damp = lambda n: 1 / (1 + 0.15 * (degree.get(n, 0) - s.hub_degree)) if degree.get(n, 0) > s.hub_degree else 1.0
    active, role, hop, parent, queue = dict(seeds), {n: "seed" for n, _ in seeds}, {n: 0 for n, _ in seeds}, {}, [(n, x, 0) for n, x in seeds]
    while queue:
        node, score, h = queue.pop(0)
        if h >= s.max_hop:
            continue
        near = sorted(enumerate(out.get(node, [])), key=lambda e: (-cand.get(e[1], 0.1), e[0]))[: s.neighbours_per_hop]
        for _, t in near:
            new = score * s.hop_decay * damp(t)
            if t in active:
                if new > active[t]:
                    active[t] = new
                    if role[t] != "seed":
                        hop[t], parent[t] = h + 1, node
            elif new > s.active_threshold:
                active[t], role[t], hop[t], parent[t] = new, "graph_neighbor", h + 1, node
                queue.append((t, new, h + 1))
    return {n: (round(x, 9), role[n], hop[n], parent.get(n)) for n, x in active.items()}


def test_khop_equals_a_queue(spark):
    rng = random.Random(3)
    cases, seeds, edges, cands, degs = {}, [], [], [], []
    s = Settings(active_threshold=0.05, max_hop=3, neighbours_per_hop=3, hub_degree=4)
    for q in range(25):
        names = [f"{q}-{i}" for i in range(12)]
        out = {n: [rng.choice(names) for _ in range(rng.randint(0, 5))] for n in names}
        own = [(n, round(rng.uniform(0.2, 1.4), 3)) for n in rng.sample(names, 3)]
        own.sort(key=lambda x: (-x[1], x[0]))
        cand = dict(own) | {n: round(rng.random(), 1) for n in rng.sample(names, 4) if n not in dict(own)}
        degree = {n: rng.randint(0, 9) for n in names}
        cases[q] = simulate(own, out, cand, degree, s)
        seeds += [(q, n, x, i) for i, (n, x) in enumerate(own)]
        edges += [(n, t, i) for n, ts in out.items() for i, t in enumerate(ts)]
        cands += [(q, n, float(x)) for n, x in cand.items()]
        degs += list(degree.items())
    got = activation.khop(
        spark.createDataFrame(seeds, "query_id int, id string, score double, seed_rank int"),
        spark.createDataFrame(edges, "src string, dst string, edge_ord int"),
        spark.createDataFrame(cands, "query_id int, id string, score double"),
        spark.createDataFrame(degs, "id string, degree long"),
        s,
    ).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.id] = (round(r.score, 9), r.role, r.hop, r.parent)
    assert found == cases


def test_replay_equals_step_by_step(spark):
    rng = random.Random(8)
    log = [(q, f"n{i}", rng.choice([0.05, 0.3, 0.9]), source) for q in range(160) for source in [rng.choice(["user", "user", "derived", "nightly"])] for i in rng.sample(range(9), rng.choice([0, 1, 2, 3]))]
    s, syn = Settings(decay=0.8), {}
    for q in range(160):
        own = {i: x for k, i, x, _ in log if k == q}
        if not own:
            continue
        source = next(src for k, _, _, src in log if k == q)
        strong = sorted(i for i, x in own.items() if x >= 0.15)
        for a in range(len(strong)):
            for b in strong[a + 1 :]:
                f = syn.get((strong[a], b), (0.0, 0.0))[0] + (1.0 if source == "user" else 0.3)
                syn[strong[a], b] = (f, 0.7 * min(f / 10, 1) + 0.3)
        if source != "nightly":
            for k in list(syn):
                if k[0] not in own and k[1] not in own:
                    f, w = syn[k]
                    if w * 0.8 < 0.01:
                        del syn[k]
                    else:
                        syn[k] = (f, w * 0.8)
    got = {(r.note_a, r.note_b): (r.frequency, r.weight) for r in memory.replay(spark.createDataFrame(log, "seq long, id string, score double, source string"), s).collect()}
    assert set(got) == set(syn)
    assert all(math.isclose(got[k][0], syn[k][0]) and math.isclose(got[k][1], syn[k][1], rel_tol=1e-9) for k in syn)


def test_thresholds(spark):
    rows = [("a", 0.1)] * 8 + [("a", 0.9), ("a", 1.0), ("b", 0.9), ("b", 0.9)]
    got = {r.query_id: r.threshold for r in activation.thresholds(spark.createDataFrame(rows, "query_id string, score double"), Settings(floor=0.0)).collect()}
    mean = sum(x for q, x in rows if q == "a") / 10
    assert math.isclose(got["a"], 0.1 + 0.3 * math.sqrt(sum((x - mean) ** 2 for q, x in rows if q == "a") / 9)) and got["b"] == 0.0


def test_consolidation(spark):
    syn = spark.createDataFrame([("a", "b", 0.9, 10.0, "2026-07-01 00:00:00"), ("a", "c", 0.5, 5.0, "2026-07-02 00:00:00"), ("b", "d", 0.1, 1.0, "2026-06-01 00:00:00"), ("c", "e", 0.01, 1.0, None), ("d", "e", 0.1, 1.0, "bad")], "note_a string, note_b string, weight double, frequency double, last_coactivated string")
    notes = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    old = spark.createDataFrame([("d", 4), ("e", 1)], "id string, dormant_cycles int")
    out = consolidation.consolidate(syn, old, notes, F.lit("2026-07-03 00:00:00").cast("timestamp"))
    assert tuple(out["report"].first()) == (5, 4, 3, 2, 1)
    assert {(r.note_a, r.note_b): r.weight for r in out["synapses"].collect()} == {("a", "b"): 0.81, ("a", "c"): 0.45}
    quality = {r.id: (r.dormant, r.dormant_cycles) for r in out["node_quality"].collect()}
    assert quality["e"] == (True, 2) and "d" not in quality and quality["a"][0] is False


def test_phantom_choice_is_greedy_and_capped(spark):
    rows = [("a", x, 1 - i / 10) for i, x in enumerate("bcdef")] + [("b", "a", 1.0), ("b", "c", 0.9)]
    got = consolidation.phantom_links(spark.createDataFrame(rows, "source string, target string, similarity double"), Settings(phantom_per_node=3, phantom_total=10)).collect()
    assert [(r.source, r.target) for r in got] == [("a", "b"), ("a", "c"), ("b", "c"), ("a", "d")]
    assert len(consolidation.phantom_links(spark.createDataFrame(rows, "source string, target string, similarity double"), Settings(phantom_total=2)).collect()) == 2


def write(folder, files):
    for name, content in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)


def test_vault_to_graph(spark, tmp_path):
    write(tmp_path, {"vault/alpha.md": "---\ntitle: Alpha\ntags: [x]\nactivated_from_ids: [\"vault:beta.md\", \"vault:gone.md\"]\n---\n[[beta]] [[concepts/gamma|Gamma]] [[lost]] [[alpha]]", "vault/beta.md": "[[gamma#part]]", "vault/concepts/gamma.md": "[[external:code/app/README]]", "vault/.hidden/no.md": "x", "code/app/README.md": "# r", "code/app/b.md": "[[README]]", "code/build/c.md": "x"})
    docs = scan(spark, Source.vault(str(tmp_path / "vault"))).unionByName(scan(spark, Source.outside("code", str(tmp_path / "code"))))
    assert sorted(r.relative_path for r in docs.collect()) == ["alpha.md", "app/README.md", "app/b.md", "beta.md", "concepts/gamma.md"]
    found = graph.resolve_in_source(links(docs), docs)
    assert {(r.src, r.target_raw): r.dst for r in found.collect()} == {
        ("vault:alpha.md", "beta"): "vault:beta.md", ("vault:alpha.md", "concepts/gamma"): "vault:concepts/gamma.md", ("vault:alpha.md", "lost"): None, ("vault:alpha.md", "alpha"): "vault:alpha.md",
        ("vault:beta.md", "gamma#part"): "vault:concepts/gamma.md", ("vault:concepts/gamma.md", "external:code/app/README"): "external:code/app/README.md", ("external:code/app/b.md", "README"): "external:code/app/README.md",
    }
    edges = graph.wikilink_edges(found)
    assert edges.count() == 5 and graph.unresolved(found).count() == 1
    born, missing = graph.provenance_edges(nodes(docs), edges)
    assert {(r.src, r.dst) for r in born.collect()} == {("vault:alpha.md", "vault:beta.md"), ("vault:beta.md", "vault:alpha.md")}
    assert [r.target for r in missing.collect()] == ["vault:gone.md"]
    star = graph.project_star(docs, edges)
    assert {(r.src, r.dst) for r in star.collect()} == {("external:code/app/README.md", "external:code/app/b.md")}
    spec = counterparts_from_config(spark, {"sources": [{"id": "code", "path": "x", "counterpart": {"group": "g", "vault": "beta.md", "external": "app/README.md"}}]})
    got = {(r.src, r.dst, r.type, r.weight) for r in graph.counterpart_edges(spec, docs, edges).collect()}
    assert got == {("vault:beta.md", "external:code/app/README.md", "counterpart", 1.0), ("external:code/app/README.md", "vault:beta.md", "counterpart", 1.0), ("external:code/app/b.md", "vault:beta.md", "project_context", 0.55)}


def test_configuration_is_checked():
    import pytest

    for bad in ({"sources": [{"id": "a b", "path": "x"}]}, {"sources": [{"id": "a"}]}, {"sources": [{"id": "a", "path": "x"}, {"id": "a", "path": "y"}]}):
        with pytest.raises(ValueError):
            sources_from_config(bad)
    assert sources_from_config({"sources": [{"id": "a", "path": "x"}]})[0].writable is False
    assert [t.vault_id for t in tenants_from_config({"path": "p"})] == ["default"]
    with pytest.raises(ValueError):
        tenants_from_config({"vaults": [{"id": "a", "path": "x"}, {"id": "a", "path": "y"}]})


def test_store_keeps_snapshots(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/state")
    assert store.load()["synapses"].count() == 0
    rows = spark.sql("select 'a' as note_a, 'b' as note_b, 0.5D as weight, 1D as frequency, timestamp'2024-01-01' as last_coactivated, timestamp'2024-01-01' as created")
    assert store.save({"synapses": rows}) == 1 and store.load()["synapses"].count() == 1
    assert store.save({"synapses": rows.limit(0)}) == 2 and store.load()["synapses"].count() == 0


def test_sessions(spark):
    long = "a question that is long enough to count " * 4
    rows = [("s1", 0, "user", long), ("s1", 1, "assistant", long), ("s2", 0, "user", "ok!"), ("s2", 1, "assistant", long * 2), ("s3", 5, "user", long), ("s3", 6, "tool", long)]
    m = spark.createDataFrame([(*r, 0.0) for r in rows], "session_id string, id long, role string, content string, timestamp double")
    done = spark.createDataFrame([("s3", 5)], "session_id string, last_message_id long")
    assert [r.session_id for r in sessions.candidate_sessions(m, done).collect()] == ["s1"]


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.write.parquet(str(folder))
    rows = table.withColumn("ts", F.col("ts").cast("timestamp"))
    stream = streams.event_stream(spark, str(folder), table._jdf.schema().toDDL())
    query = streams.tumbling(stream).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = rows.agg(F.max("ts")).first()[0]
    got = {(r.start, r.n) for r in spark.table("w").collect()}
    expected = {(r.start, r.n) for r in streams.tumbling(rows).collect() if (last - r.start).total_seconds() >= 7200}
    assert got == expected and got


def test_two_writers_keep_each_others_rows(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/state")
    row = lambda a, b, w: spark.sql(f"select '{a}' as note_a, '{b}' as note_b, {w}D as weight, 1D as frequency, timestamp'2024-01-01' as last_coactivated, timestamp'2024-01-01' as created")
    base = store.save({"synapses": row("a", "b", 0.5)})
    one, two = row("a", "b", 0.6).union(row("a", "c", 0.7)), row("a", "b", 0.9)
    store.save({"synapses": one}, base)
    store.save({"synapses": two}, base)
    assert {(r.note_a, r.note_b): r.weight for r in store.load()["synapses"].collect()} == {("a", "b"): 0.9, ("a", "c"): 0.7}
    store.save({"synapses": two}, store.version())  # nobody else has saved: deletions stick
    assert store.load()["synapses"].count() == 1


def test_a_batch_is_learned_once(spark, tmp_path):
    store, folder = Store(spark, f"file://{tmp_path}/state"), tmp_path / "in"
    spark.sql("select 'a' as id, 0.5D as score, timestamp'2024-01-01' as ts").write.parquet(str(folder))
    learned = []

    def learn(synapses, batch):
        learned.append(batch.count())
        return synapses

    run = lambda: streams.learn_live(streams.event_stream(spark, str(folder), "id string, score double, ts timestamp"), store, learn, str(tmp_path / "check")).awaitTermination(60)
    run()
    version = store.version()
    for f in (tmp_path / "check" / "commits").iterdir():  # as if the query had died before it could note the batch
        f.unlink()
    run()
    assert learned == [1] and store.version() == version


def test_frontmatter_fields_are_stamped_once(spark):
    from engrama.operators.genesis import merged_content, stamped

    cases = {
        "updated: a\nupdated: b": "updated: X$1\nupdated: b",
        "---\ntitle: t\nupdated: a\n---\nupdated: b": "---\ntitle: t\nupdated: X$1\n---\nupdated: b",
        "---\ntitle: t\n---\nbody": "---\ntitle: t\nupdated: X$1\n---\nbody",
        "no front": "no front",
        "not updated: x": "not updated: x",
    }
    rows = spark.createDataFrame(list(cases.items()), "c string, e string")
    assert all(r.got == r.e for r in rows.select("e", stamped(F.col("c"), "updated", F.lit("X$1")).alias("got")).collect())
    text, ids = spark.range(1).select(*merged_content(F.lit("---\nactivated_from_ids: [\"a\"]\n---\nold  \n"), F.lit(" new "), F.lit("D"), F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")))).first()
    assert list(ids) == ["a", "b"] and text == "---\nactivated_from_ids: [\"a\",\"b\"]\nupdated: D\n---\nold\n\n## Assimilated Evidence\n- **D** — new\n  - source: session recovery\n  - query: \n\n"


def test_consolidation_makes_phantom_links(spark):
    notes = spark.createDataFrame([(i, [float(x) for x in e]) for i, e in FRUIT], "id string, embedding array<double>")
    syn = spark.createDataFrame([("apple", "cherry", 0.9, 10.0, "2026-07-01 00:00:00")], "note_a string, note_b string, weight double, frequency double, last_coactivated string")
    edges = spark.createDataFrame([("apple", "banana")], "src string, dst string")
    out = consolidation.consolidate(syn, notes.select("id", F.lit(0).alias("dormant_cycles")), notes, F.lit("2026-07-03").cast("timestamp"), edges=edges, collection=notes)
    linked = {tuple(sorted((r.source, r.target))) for r in out["phantom_links"].collect()}
    assert ("apple", "cherry") in linked and ("carrot", "spinach") in linked and ("apple", "banana") not in linked


def test_running_total(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 9)) for i in rng.sample(range(10_000), 500)]
    got = {r.s: r.t for r in memory.running_total(spark.createDataFrame(rows, "s long, n long").repartition(5), "s", "n", "t").collect()}
    assert got == {s: sum(n for x, n in rows if x <= s) for s, _ in rows}


def test_neighbourhood_and_paths(spark):
    edges = spark.createDataFrame([("a", "b", "wikilink", 1.0), ("b", "c", "hebbian", 0.3), ("c", "d", "hebbian", 0.9), ("x", "y", "phantom", 0.5)], "src string, dst string, type string, weight double")
    near, touched = graph.neighbourhood(edges, "b")
    assert {r.id for r in near.collect()} == {"a", "b", "c"} and touched.count() == 2
    assert [r.id for r in graph.neighbourhood(edges, "alone")[0].collect()] == ["alone"]
    assert {(r.src, r.dst) for r in graph.path_edges(edges, ["d", "c", "b"]).collect()} == {("c", "d"), ("b", "c")} and graph.path_edges(edges, ["a"]).count() == 0
    assert {(r.src, r.dst) for r in graph.visible_edges(edges, overview=True).collect()} == {("a", "b"), ("c", "d"), ("x", "y")}


def test_a_dead_writer_does_not_block(spark, tmp_path, monkeypatch):
    from engrama.sources import store as stores

    monkeypatch.setattr(stores, "LEASE", 2)
    monkeypatch.setattr(stores, "KEPT", 2)
    store = Store(spark, f"file://{tmp_path}/state")
    (tmp_path / "state").mkdir()
    (tmp_path / "state" / "writer").touch()
    meta = lambda n: spark.sql(f"select {n}L as queries, timestamp'2024-01-0{n}' as created, timestamp'2024-02-01' as updated, 1 as consolidation_cycles")
    base = store.save({"meta": meta(3)})
    store.save({"meta": meta(9)}, base)
    store.save({"meta": meta(4)}, base)  # another writer has counted further
    assert tuple(store.load()["meta"].select("queries", F.day("created")).first()) == (9, 4)
    assert sorted(p.name for p in (tmp_path / "state").iterdir() if p.name.startswith("v")) == ["v2", "v3"]


def test_graph_cache(spark, tmp_path):
    from engrama.sources.store import cached_graph

    parsed = []

    def nodes_of(docs):
        parsed.append(sorted(r.id for r in docs.select("id").collect()))
        return docs.select("id", "mtime", F.upper("text").alias("title"))

    links_of = lambda docs: docs.select(F.col("id").alias("src"), F.col("text").alias("target_raw"))
    docs = lambda rows: spark.createDataFrame(rows, "id string, mtime long, text string")
    folder = f"file://{tmp_path}/graph"
    nodes, links, changes = cached_graph(spark, folder, docs([("a", 1, "b"), ("b", 1, "a"), ("c", 1, "a")]), nodes_of, links_of)
    assert nodes.count() == links.count() == changes.count() == 3
    now = docs([("a", 2, "x"), ("b", 1, "a"), ("d", 1, "b")])
    nodes, links, changes = cached_graph(spark, folder, now, nodes_of, links_of)
    assert parsed == [["a", "b", "c"], ["a", "d"]]
    assert {tuple(r) for r in changes.collect()} == {("a", "changed"), ("c", "deleted"), ("d", "added")}
    assert {tuple(r) for r in links.collect()} == {("a", "x"), ("b", "a"), ("d", "b")} and nodes.count() == 3


def test_vaults_do_not_see_each_other(spark, tmp_path, capsys):
    from engrama.operators import tenants
    from engrama.sources.notes import of_tenant

    rows = [(f"v{i % 3}", f"n{i}", " ".join(["alpha"] * (i % 5) + ["beta"] * (i % 2) + ["filler"] * (i % 7))) for i in range(90)]
    every = tenants.laid_out(spark.createDataFrame(rows, "vault_id string, id string, text string"), f"file://{tmp_path}")
    asked = spark.createDataFrame([("v0", 1, "alpha beta"), ("v1", 1, "alpha"), ("v2", 2, "beta beta alpha"), ("v9", 3, "alpha")], "vault_id string, query_id int, q string")
    plain = lambda df: sorted((r.vault_id, r.query_id, r.id, round(r.bm25, 9), r["rank"]) for r in df.collect())
    together = plain(tenants.top_by_vault(every, asked, F.col("text"), F.col("q"), 4))
    apart = []
    for v in ("v0", "v1", "v2"):
        apart += plain(tenants.top_by_vault(of_tenant(every, v, ["v0", "v1", "v2"]), asked.filter(F.col("vault_id") == v), F.col("text"), F.col("q"), 4))
    assert together == sorted(apart) and len(together) == 12
    tenants.top_by_vault(every, asked.filter("query_id = 2"), F.col("text"), F.col("q"), 4).explain("formatted")
    assert "dynamicpruning" in capsys.readouterr().out.lower()


def test_debounced_and_spaced_streams_equal_batches(spark, tmp_path):
    folder = tmp_path / "in"
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows = table.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("vault_id", F.col("user_id") % 3).withColumn("kind", F.when(F.col("event_type") == "signup", "added").otherwise("changed"))
    rows.orderBy("ts").coalesce(1).write.parquet(str(folder))
    last = rows.agg(F.max("ts")).first()[0]
    read = lambda: streams.event_stream(spark, str(folder), rows._jdf.schema().toDDL(), late="1 hour")

    def run(stream, name):
        stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(240)
        return spark.table(name)

    found = run(streams.debounced(read(), "30 minutes", "80 minutes"), "debounced")
    batch = streams.debounced(rows, "30 minutes", "80 minutes")
    got, expected = {tuple(r) for r in found.collect()}, {tuple(r) for r in batch.collect()}
    assert got <= expected and len(got) > 0.9 * len(expected)
    assert all((last - r.fires).total_seconds() < 3 * 3600 for r in batch.collect() if tuple(r) not in got)
    gap = 6 * 3600 * 1_000_000
    kept = {r.event_id for r in run(streams.spaced_stream(read(), ["event_type"], gap), "spaced").collect()}
    assert kept == {r.event_id for r in streams.spaced(rows, ["event_type"], gap).collect()} and kept


def test_embedding_in_batches_with_another_try(spark):
    calls = []

    def embed(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise OSError("busy")
        return [[] if t == "drop" else [float(len(t))] for t in texts]

    batch = __import__("pyarrow").RecordBatch.from_pydict({"id": list(range(5)), "text": ["a", "bb", "drop", "dddd", "e"]})
    notes = spark.createDataFrame(batch.to_pylist(), "id long, text string").coalesce(1)
    stored = notes.filter("id < 2").select("id", F.when(F.col("id") == 0, F.substring(F.sha2("text", 256), 1, 16)).otherwise("old").alias("content_hash"), F.array(F.lit(-1.0).cast("float")).alias("embedding"))
    done = {r.id: list(r.embedding) for r in vectors.refreshed(stored, notes, embed, size=2).collect()}
    assert done == {0: [-1.0], 1: [2.0], 3: [4.0], 4: [1.0]}


def test_links_are_resolved_anew_only_where_notes_changed(spark):
    old = [f"{'wiki/' if i % 3 else 'notes/'}n{i}" for i in range(200)]
    links = spark.createDataFrame([(f"s{i}", t) for i in range(200) for t in (f"n{i}", f"notes/n{i}", f"gone{i}")], "src string, target_raw string")
    ids = lambda x: spark.createDataFrame([(n,) for n in x], "id string")
    candidates = graph.name_candidates(links)
    before = graph.name_only(candidates).join(graph.best_candidates(candidates, ids(old)), "target_raw", "left")
    now = [n for n in old if n not in (old[7], old[9])] + ["queries/gone5", "a/n11"]
    changed = ids([old[7], old[9], "queries/gone5", "a/n11"])
    got = {r.target_raw: r.dst for r in graph.update_resolution(before, candidates, changed, ids(now)).collect()}
    assert got == {r.target_raw: r.dst for r in graph.resolve_by_name(links, ids(now)).select("target_raw", "dst").distinct().collect()}
    assert got["gone5"] == "queries/gone5" and got["n7"] is None
    assert graph.name_only(graph.touched_targets(candidates, changed)).count() == 7
