"""Queries over notes from several sources.

``documents`` play files: English ones are the vault's, each other language is
an external source; a file lies in the folder ``p<id mod 5>``, and the first
five are their folder's README.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.functions import paths, text
from engrama.operators import activation, genesis, graph, memory, payloads, ranking, sessions
from engrama.plans.graph_queries import MESSAGES_SQL, flat_sql, messages
from engrama.plans.memory_queries import SYN_SQL, activity, quality_sql, synapses, users
from engrama.plans.registry import query, table
from engrama.plans.text_queries import RANK_SQL, retrieval_metrics

FED_SQL = """f0 as (select doc_id, text, case when lang = 'en' then 'vault' else 'external' end as st, case when lang = 'en' then 'vault' else lang end as sid, concat('p', doc_id % 5) as g, concat('p', doc_id % 5, case when doc_id < 5 then '/README.md' else concat('/', doc_id, '.md') end) as rel from documents),
fed as (select *, concat(case when st = 'vault' then 'vault:' else concat('external:', sid, '/') end, rel) as id from f0)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source_type, source_id, relative_path, content."""
    vault, number = F.col("lang") == "en", F.col("doc_id").cast("string")
    folder = F.concat(F.lit("p"), (F.col("doc_id") % 5).cast("string"))
    name = F.when(F.col("doc_id") < 5, "/README.md").otherwise(F.concat(F.lit("/"), number, F.lit(".md")))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(vault, "vault").otherwise("external").alias("source_type"), F.when(vault, "vault").otherwise(F.col("lang")).alias("source_id"), F.concat(folder, name).alias("relative_path"), F.col("text").alias("content"))


def file_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).withColumn("id", paths.canonical_id(F.col("source_type"), F.col("source_id"), F.col("relative_path")))


SHOWN = ("src", "dst", "type", "weight", "relation", "group_id", "explicit", "generated")


@query(
    f"with {FED_SQL}, l as (select f.id as src, t.id as dst, k from fed f, (values (1), (2)) v(k), fed t where t.doc_id = f.doc_id + k) "
    "select src, dst, 'wikilink' as type, cast(1.0 as double) as weight, cast(null as varchar) as relation, cast(null as varchar) as group_id, k = 1 as explicit, false as generated from l"
)
def wikilink_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link to the next file that names its source, and one that had to be resolved."""
    ids = file_ids(spark, sf_dir)
    to = ids.select(F.col("doc_id").alias("to"), F.col("id").alias("dst"))
    steps = ids.select(F.col("id").alias("src"), "doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).withColumn("to", F.col("doc_id") + F.col("k"))
    links = steps.join(to, "to").select("src", F.when(F.col("k") == 1, F.col("dst")).otherwise(F.lit("somewhere")).alias("target_raw"), "dst", F.lit("").alias("display"))
    return graph.wikilink_edges(links.union(links.select("src", "target_raw", F.col("src"), "display"))).select(*SHOWN)


@query(
    f"with {FED_SQL}, p as (select f.id as a, t.id as b, f.doc_id as x from fed f join fed t on t.doc_id = f.doc_id + 1 where f.doc_id % 4 = 0), e as (select a as src, b as dst, x from p union all select b, a, x from p), old as (select a as src, b as dst from p where x % 8 = 0) "
    "select src, dst, 'neurogenesis_source' as type, cast(0.35 as double) as weight, 'activated_from' as relation, cast(null as varchar) as group_id, false as explicit, true as generated from e where (src, dst) not in (select (src, dst) from old) "
    "union all select id, concat(id, '-gone'), 'missing', null, null, null, null, null from fed where doc_id % 4 = 0"
)
def provenance_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth file comes from the next one and from one that is gone; some edges are there already."""
    ids = file_ids(spark, sf_dir)
    to = ids.select((F.col("doc_id") - 1).alias("doc_id"), F.col("id").alias("next"))
    held = ids.join(to, "doc_id", "left")
    born = F.col("doc_id") % 4 == 0
    nodes = held.select("id", F.when(born, F.array_compact(F.array("next", F.concat("id", F.lit("-gone"))))).otherwise(F.array().cast("array<string>")).alias("activated_from_ids"))
    old = held.filter((F.col("doc_id") % 8 == 0) & F.col("next").isNotNull()).select(F.col("id").alias("src"), F.col("next").alias("dst"), F.lit("neurogenesis_source").alias("type"))
    edges, missing = graph.provenance_edges(nodes, old)
    null = F.lit(None)
    lost = missing.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.lit("missing").alias("type"), null.cast("double").alias("weight"), null.cast("string").alias("relation"), null.cast("string").alias("group_id"), null.cast("boolean").alias("explicit"), null.cast("boolean").alias("generated"))
    return edges.select(*SHOWN).union(lost)


@query(
    f"with {FED_SQL}, s as (select a.id as src, m.id as dst, m.g from fed a join fed m on a.sid = m.sid and a.g = m.g where a.doc_id < 5 and a.st = 'external' and m.id <> a.id), old as (select src, dst from s join fed on fed.id = s.dst where doc_id % 3 = 0), e as (select src, dst, g from s union all select dst, src, g from s) "
    "select src, dst, 'project_context' as type, cast(0.35 as double) as weight, cast(null as varchar) as relation, g as group_id, false as explicit, true as generated from e where (src, dst) not in (select (src, dst) from old)"
)
def project_context_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of external projects and their README; a third are joined one way already."""
    ids = file_ids(spark, sf_dir)
    readme = ids.filter("doc_id < 5 and source_type = 'external'").select("source_id", F.split("relative_path", "/")[0].alias("g"), F.col("id").alias("src"))
    old = ids.filter("doc_id % 3 = 0").withColumn("g", F.split("relative_path", "/")[0]).join(readme, ["source_id", "g"]).select("src", F.col("id").alias("dst"))
    return graph.project_star(files(spark, sf_dir), old).select(*SHOWN)


SPEC_SQL = """spec as (select sid, concat('g-', sid) as group_id, case when sid in ('de', 'es') then 'same_project' else 'references_project' end as relation, min_by(id, doc_id) as ext, min_by(g, doc_id) as g, (select min_by(id, doc_id) from fed where st = 'vault') as inside from fed where st = 'external' group by sid)"""


@query(
    f"with {FED_SQL}, {SPEC_SQL}, d as (select inside as src, ext as dst, case when relation = 'same_project' then 'counterpart' else 'project_reference' end as type, cast(1.0 as double) as weight, relation, group_id from spec union all select ext, inside, case when relation = 'same_project' then 'counterpart' else 'project_reference' end, cast(1.0 as double), relation, group_id from spec), "
    "n as (select f.id as src, s.inside as dst, case when s.relation = 'same_project' then 'project_context' else 'project_reference' end as type, cast(0.55 as double) as weight, s.relation, s.group_id from fed f join spec s on f.sid = s.sid and f.g = s.g where f.id <> s.ext and f.doc_id % 3 <> 0) "
    "select *, false as explicit, true as generated from d union all select *, false, true from n"
)
def counterpart_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first file of each external source and the vault's first; a third of the files around is joined already, by edges of other columns."""
    own = files(spark, sf_dir)
    inside = own.filter("source_type = 'vault'").agg(F.min_by("relative_path", "doc_id").alias("vault_path"))
    outside = own.filter("source_type = 'external'").groupBy("source_id").agg(F.min_by("relative_path", "doc_id").alias("external_path"))
    relation = F.when(F.col("source_id").isin("de", "es"), "same_project").otherwise("references_project")
    specs = outside.join(F.broadcast(inside)).select("source_id", "vault_path", "external_path", F.concat(F.lit("g-"), "source_id").alias("group_id"), relation.alias("relation"))
    first = file_ids(spark, sf_dir).filter("source_type = 'vault'").agg(F.min_by("id", "doc_id").alias("dst"))
    anchors = specs.select(paths.canonical_id(F.lit("external"), F.col("source_id"), F.col("external_path")).alias("src"))
    old = file_ids(spark, sf_dir).filter("doc_id % 3 = 0 and source_type = 'external'").select(F.col("id").alias("src")).join(anchors, "src", "left_anti").join(F.broadcast(first)).select("src", "dst", F.lit("wikilink").alias("type"))
    return graph.counterpart_edges(specs, own, old).select(*SHOWN)


NOTE_SQL = r"""case doc_id % 3 when 0 then concat('---', chr(10), 'title: x', chr(10), 'updated: 2020-01-01', chr(10), '---', chr(10), 'updated: in the text', chr(10), text) when 1 then concat('---', chr(10), 'title: x', chr(10), '---', chr(10), text) else text end"""
_STAMP = "updated: 2026-01-02"


@query(
    rf"with n as (select doc_id, {NOTE_SQL} as content, case when doc_id % 4 = 0 then text else concat('fresh evidence ', doc_id) end as evidence from documents), "
    rf"m as (select *, contains({flat_sql('content')}, {flat_sql('evidence')}) as there, concat(regexp_replace(content, '\s+$', ''), chr(10), chr(10), '## Assimilated Evidence', chr(10), '- **2026-01-02** — ', trim(evidence), chr(10), '  - source: ', case when doc_id % 2 = 0 then 'session recovery' else 'a, b, c' end, chr(10), '  - query: what is new', chr(10), chr(10)) as merged from n) "
    rf"select doc_id, sha256(case when there then content when doc_id % 3 = 0 then regexp_replace(merged, '(?m)^updated: [^\n]*', '{_STAMP}') when doc_id % 3 = 1 then replace(merged, concat('title: x', chr(10), '---'), concat('title: x', chr(10), '{_STAMP}', chr(10), '---')) else merged end) as content, there as already from m"
)
def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for notes with a date (and a line like one below), without one, and without frontmatter."""
    c, k = F.col("text"), F.col("doc_id")
    content = F.when(k % 3 == 0, F.concat(F.lit("---\ntitle: x\nupdated: 2020-01-01\n---\nupdated: in the text\n"), c)).when(k % 3 == 1, F.concat(F.lit("---\ntitle: x\n---\n"), c)).otherwise(c)
    evidence = F.when(k % 4 == 0, c).otherwise(F.concat(F.lit("fresh evidence "), k.cast("string")))
    none = F.array().cast("array<string>")
    sources = F.when(k % 2 == 0, none).otherwise(F.array(*map(F.lit, "abcd")))
    merged, _ = genesis.merged_content(content, evidence, F.lit("2026-01-02"), none, none, sources, F.lit(" what\nis  new"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(merged.cast("binary"), 256).alias("content"), text.has_evidence(content, evidence).alias("already"))


@query(
    f"with {FED_SQL}, e as (select src, dst, 'wikilink' as type from (select f.id as src, t.id as dst from fed f join fed t on t.doc_id = f.doc_id + 1) union all select src, dst, 'counterpart' from (select f.id as src, t.id as dst from fed f join fed t on t.doc_id = f.doc_id + 7 where f.doc_id % 10 = 0)) "
    "select st as source_type, sid as source_id, count(*) as notes, (select count(*) from e where type = 'wikilink') as wikilinks, (select count(*) from e where type = 'counterpart') as counterparts from fed group by 1, 2"
)
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = file_ids(spark, sf_dir)
    step = lambda k: ids.select("doc_id", F.col("id").alias("src")).join(ids.select((F.col("doc_id") - k).alias("doc_id"), F.col("id").alias("dst")), "doc_id")
    edges = step(1).select("src", "dst", F.lit("wikilink").alias("type")).union(step(7).filter("doc_id % 10 = 0").select("src", "dst", F.lit("counterpart").alias("type")))
    return graph.source_counts(ids).join(F.broadcast(graph.link_counts(edges)))


@query(f"with {FED_SQL}, q as (select case when doc_id % 2 = 0 then upper(id) else id end as asked, id from fed) select asked, id from q")
def note_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = file_ids(spark, sf_dir)
    return graph.find_note(ids, ids.select(F.when(F.col("doc_id") % 2 == 0, F.upper("id")).otherwise(F.col("id")).alias("asked")))


@query("select f.doc_id as src, f.doc_id + k as dst from documents f, (values (1), (2)) v(k) where f.doc_id + k in (select doc_id from documents where doc_id % 5 <> 0)")
def dangling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to the next two documents, of which every fifth is ignored."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    links = docs.select(F.col("doc_id").alias("src"), F.explode(F.array(F.col("doc_id") + 1, F.col("doc_id") + 2)).alias("dst"))
    return graph.without_dangling(links, docs.filter("doc_id % 5 != 0").select(F.col("doc_id").alias("id")), ignored=True)


UPDATE_SQL = """old as (select doc_id as id, doc_id as mtime, sha256(text) as digest from documents where doc_id % 3 <> 0), now as (select doc_id as id, case when doc_id % 5 = 0 then doc_id + 1 else doc_id end as mtime, case when doc_id % 5 = 0 then sha256(concat(text, '!')) else sha256(text) end as digest from documents where doc_id % 7 <> 0),
gone as (select id from old where id not in (select id from now)), kept as (select n.id from now n join old o on o.id = n.id and o.mtime = n.mtime)"""


@query(f"with {UPDATE_SQL} select 'note' as kind, id, mtime, digest as value from now union all select 'link', n.id, k, cast(n.id + k as varchar) from now n, (values (1), (2)) v(k) where n.id not in (select id from kept) or n.id + k not in (select id from gone)")
def incremental_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After some files are new, changed or gone: the notes are those of a full build, and so are the links but those to what is gone."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    rows = lambda d: d.select("id", "mtime", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    steps = lambda d: d.select(F.col("id").alias("src"), F.explode(F.array(F.lit(1), F.lit(2))).alias("ord")).select("src", (F.col("src") + F.col("ord")).alias("target_raw"), "ord")
    old = docs.filter("id % 3 != 0").withColumn("mtime", F.col("id"))
    changed = F.col("id") % 5 == 0
    now = docs.filter("id % 7 != 0").select("id", F.when(changed, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), F.when(changed, F.col("id") + 1).otherwise(F.col("id")).alias("mtime"))
    nodes, links, _ = graph.incremental_update(rows(old), steps(old), now, rows, steps)
    listed = links.select(F.lit("link").alias("kind"), F.col("src").alias("id"), F.col("ord").cast("long").alias("mtime"), F.col("target_raw").cast("string").alias("value"))
    return nodes.select(F.lit("note").alias("kind"), "id", "mtime", F.col("digest").alias("value")).union(listed)


@query(
    f"with {FED_SQL}, {SYN_SQL}, {quality_sql()} select f.id, f.id as title, f.id as display_label, cast(null as varchar) as context_label, '' as tags, f.rel as path, f.rel as relative_path, f.sid as source_id, f.st as source_type, cast(null as varchar) as project_group, true as writable, substr(f.text, 1, 200) as text, f.rel as absolute_path, coalesce(q.dormant, false) as dormant, coalesce(q.score, 0) as quality_score from fed f left join qual q on q.id = f.doc_id"
)
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes as a client draws them, with the quality of the user of the same number."""
    ids = file_ids(spark, sf_dir)
    rated = memory.node_quality(users(spark, sf_dir), synapses(spark, sf_dir)).withColumnRenamed("id", "doc_id")
    own = ids.select("id", F.col("id").alias("title"), F.col("relative_path").alias("path"), "relative_path", "source_id", "source_type", F.col("content").alias("text"))
    return payloads.node_payload(own, rated.join(ids.select("doc_id", "id"), "doc_id"))


@query(
    f"with {FED_SQL}, s as (select a.id as src, m.id as dst, m.g from fed a join fed m on a.sid = m.sid and a.g = m.g where a.doc_id < 5 and a.st = 'external' and m.id <> a.id), e as (select src, dst, g from s union all select dst, src, g from s) "
    "select src as source, dst as target, '' as display, 'project_context' as type, cast(0.35 as double) as weight, false as explicit, cast(null as varchar) as relation, g as group_id, true as generated from e "
    "union all select f.id, t.id, '', 'wikilink', cast(1.0 as double), true, null, null, false from fed f join fed t on t.doc_id = f.doc_id + 1"
)
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated edges, and plain links that have the defaults."""
    ids = file_ids(spark, sf_dir)
    star = graph.project_star(files(spark, sf_dir), spark.createDataFrame([], "src string, dst string"))
    plain = ids.select("doc_id", F.col("id").alias("src")).join(ids.select((F.col("doc_id") - 1).alias("doc_id"), F.col("id").alias("dst")), "doc_id", "left").select("src", "dst")
    return payloads.edge_payload(star).unionByName(payloads.edge_payload(plain))


@query(
    "with new as (select doc_id, concat('note ', doc_id) as title from documents where doc_id % 3 = 0), e as (select n.doc_id as src, n.doc_id + k as dst, k from new n, (values (1), (2), (3), (4), (5), (6), (7), (8)) v(k)), old as (select doc_id, concat('note ', doc_id) as title from documents where doc_id % 3 <> 0) "
    "select n.doc_id as id, n.title, (select count(*) from e where e.src = n.doc_id) as n_edges, (select string_agg(cast(dst as varchar), ',' order by k) from e where e.src = n.doc_id) as targets, coalesce((select string_agg(title, ',' order by k) from (select o.title, e.k from e join old o on o.doc_id = e.dst where e.src = n.doc_id order by e.k limit 5)), '') as sources from new n"
)
def added_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document is new; it links to the next eight."""
    every = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("note "), F.col("doc_id").cast("string")).alias("title"))
    edges = every.filter("id % 3 = 0").select(F.col("id").alias("src"), F.posexplode(F.sequence(F.lit(1), F.lit(8))).alias("edge_ord", "k")).withColumn("dst", F.col("src") + F.col("k"))
    got = payloads.added_notes(every.filter("id % 3 != 0"), every, edges)
    return got.select("id", "title", F.size("edges").cast("long").alias("n_edges"), F.array_join(F.transform("edges", lambda e: e["target"].cast("string")), ",").alias("targets"), F.array_join("source_notes", ",").alias("sources"))


@query(
    "select c.vec_id as id, round(0.5 + (c.vec_id % 7) / 13.0, 4) as score, coalesce('note ' || d.doc_id, cast(c.vec_id as varchar)) as title, d.source as path from embeddings c left join (select * from documents where doc_id % 4 <> 0) d on d.doc_id = c.vec_id"
)
def active_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active notes of which a quarter is gone."""
    active = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("query_id"), F.col("vec_id").alias("id"), (0.5 + (F.col("vec_id") % 7) / 13.0).alias("score"))
    known = table(spark, sf_dir, "documents").filter("doc_id % 4 != 0").select(F.col("doc_id").alias("id"), F.concat(F.lit("note "), F.col("doc_id").cast("string")).alias("title"), F.col("source").alias("path"))
    return payloads.active_notes(active, known).select("id", "score", "title", "path")


KINDS_SQL = "e as (select note_a as src, note_b as dst, case (note_a + note_b) % 4 when 0 then 'hebbian' when 1 then 'phantom' when 2 then 'counterpart' end as type, weight from syn)"


def mixed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("note_a") + F.col("note_b")) % 4
    return synapses(spark, sf_dir).select(F.col("note_a").alias("src"), F.col("note_b").alias("dst"), F.when(k == 0, "hebbian").when(k == 1, "phantom").when(k == 2, "counterpart").alias("type"), "weight")


@query(
    f"with {SYN_SQL}, {KINDS_SQL} select 'direct' as mode, coalesce(type, 'wikilink') as type, count(*) as n from e where coalesce(type, 'wikilink') in ('wikilink', 'counterpart', 'project_context', 'project_reference') group by 2 "
    "union all select 'overview', coalesce(type, 'wikilink'), count(*) from e where coalesce(type, 'x') <> 'phantom' and (coalesce(type, 'x') <> 'hebbian' or weight >= 0.42) and src % 3 <> 0 and dst % 3 <> 0 group by 2"
)
def visible_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = mixed_edges(spark, sf_dir)
    count = lambda df, mode: df.groupBy(F.lit(mode).alias("mode"), F.coalesce("type", F.lit("wikilink")).alias("type")).agg(F.count(F.lit(1)).alias("n"))
    direct = graph.visible_edges(edges, direct_only=True)
    overview = graph.visible_edges(edges, hebbian_from=0.3, phantoms=False, overview=True, nodes=users(spark, sf_dir).filter("id % 3 != 0"))
    return count(direct, "direct").union(count(overview, "overview"))


@query(f"with {SYN_SQL}, c as (select min(id) as id from nodes), n as (select s.* from syn s, c where note_a = c.id or note_b = c.id) select id, (select count(*) from n) as edges from (select note_a as id from n union select note_b from n union select id from c)")
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is one learned edge away from the first user."""
    edges = mixed_edges(spark, sf_dir)
    first = users(spark, sf_dir).agg(F.min("id")).first()[0]
    near, touched = graph.neighbourhood(edges, first)
    return near.join(F.broadcast(touched.agg(F.count(F.lit(1)).alias("edges"))))


@query(
    f"with {SYN_SQL}, s0 as (select user_id as id, max(value) / 500 as score from events group by 1), rec as (select distinct id from act where h >= (select max(h) from act)), e as (select note_a as id, note_b as other, weight from syn where weight >= 0.15 union all select note_b, note_a, weight from syn where weight >= 0.15), "
    "t as (select id, weight, row_number() over (partition by id order by weight desc, other) as r from e where other in (select id from rec)), b as (select id, least(sum(weight) * 0.3, 0.5) as boost from t where r <= 3 group by id), "
    "x as (select s0.id, s0.score * (1 + coalesce(b.boost, 0)) as score, coalesce(b.boost, 0) as boost from s0 left join b on b.id = s0.id) select id, round(score, 6) as score, round(boost, 6) as boost, row_number() over (order by score desc, id) - 1 as seed_rank from x order by x.score desc, id limit 5"
)
def boosted_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds among users, raised by what they learned together with those of the last hour."""
    act = activity(spark, sf_dir)
    recent = act.join(F.broadcast(act.agg(F.max("h").alias("h"))), "h").select("id").distinct()
    scores = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg((F.max("value") / 500).alias("score")).withColumn("query_id", F.lit(0))
    best = activation.seeds(activation.boosted(scores, memory.boosts(synapses(spark, sf_dir), recent)))
    return best.select("id", F.round("score", 6).alias("score"), F.round("boost", 6).alias("boost"), F.col("seed_rank").cast("long").alias("seed_rank"))


@query(f"with {SYN_SQL}, {quality_sql()}, m as (select id % 50 as new_id, max_by(score, id) as score, max_by(dormant, id) as dormant from qual group by 1) select new_id as id, score, dormant from m")
def quality_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = memory.node_quality(users(spark, sf_dir), synapses(spark, sf_dir)).select("id", "score", "dormant")
    mapping = rated.select(F.col("id").alias("old_id"), (F.col("id") % 50).alias("new_id"))
    return graph.migrate_quality(rated, mapping)


@query(
    f"with {MESSAGES_SQL}, s as (select concat('session:', session_id) as source_id, max(id) + session_id as used_at from msg group by session_id order by used_at, source_id limit 3), n as (select concat('note:', doc_id) as source_id, 2 * doc_id as used_at from documents order by used_at, source_id limit 3) select source_id, used_at from (select * from s union all select * from n) order by used_at, source_id limit 3"
)
def merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest notes and sessions, merged and cut again."""
    spoken = messages(spark, sf_dir).groupBy("session_id").agg((F.max("id") + F.col("session_id")).alias("used_at")).select(F.concat(F.lit("session:"), F.col("session_id").cast("string")).alias("source_id"), "used_at")
    written = table(spark, sf_dir, "documents").select(F.concat(F.lit("note:"), F.col("doc_id").cast("string")).alias("source_id"), (2 * F.col("doc_id")).alias("used_at"))
    oldest = lambda df: df.orderBy("used_at", "source_id").limit(3)
    return sessions.merged_candidates(oldest(written), oldest(spoken))


@query("select conv_id, turn, role <> 'user' and turn % 3 <> 0 and turn % 2 = 0 as makes, turn % 3 <> 0 as learns, turn % 2 = 0 as answers from conversations")
def session_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of users play the scheduler's queries."""
    rows = table(spark, sf_dir, "conversations")
    makes, learns, answers = sessions.allowed(F.when(F.col("role") == "user", "cron"), F.when(F.col("turn") % 3 == 0, False), F.col("turn") % 2 == 0)
    return rows.select("conv_id", "turn", makes.alias("makes"), learns.alias("learns"), answers.alias("answers"))


@query(f"{RANK_SQL} select concat('c', query_id % 3) as category, count(*) as n, round(avg(precision), 4) as precision, round(avg(mrr), 4) as mrr, round(avg(ndcg), 4) as ndcg, count(*) filter (where first_hit < 0) as misses from metrics group by 1")
def ir_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval_metrics(spark, sf_dir).withColumn("category", F.concat(F.lit("c"), (F.col("query_id") % 3).cast("string")))
    means = ranking.summary(rows, ["precision", "mrr", "ndcg"], ["category"])
    value = lambda c: F.max(F.when(F.col("metric") == c, F.col("mean"))).alias(c)
    return ranking.misses(rows, ["category"]).join(means.groupBy("category").agg(value("precision"), value("mrr"), value("ndcg")), "category").select("category", "n", "precision", "mrr", "ndcg", "misses")
