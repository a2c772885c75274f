"""Graph, difference and selection queries.

Project stars as in ``text_queries``; ``pages`` links by path; two halves of a
table, by a rule on its ids, play the old and the new state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.functions.text import ACKNOWLEDGEMENTS, CONFLICTS
from engrama.operators import consolidation, genesis, graph, sessions, vectors
from engrama.plans.registry import query, table
from engrama.plans.text_queries import collection, degrees, notes, star_edges
from engrama.sources.notes import links as raw_links
from engrama.streaming import events as streams

STAR_SQL = """star as (select d.doc_id as id, a.anchor from documents d join (select source, min(doc_id) as anchor from documents group by 1) a on d.source = a.source where d.doc_id <> a.anchor),
edges as (select anchor as src, id as dst from star union all select id, anchor from star)"""
DEGREE_SQL = f"""{STAR_SQL},
deg as (select d.doc_id as id, coalesce(o.n, 0) + coalesce(i.n, 0) as degree from documents d left join (select src, count(*) as n from edges group by 1) o on o.src = d.doc_id left join (select dst, count(*) as n from edges group by 1) i on i.dst = d.doc_id)"""


@query(f"with {STAR_SQL} select src, dst from edges")
def project_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_edges(spark, sf_dir).select("src", "dst")


@query(f"with {DEGREE_SQL} select id, degree from deg")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrees(spark, sf_dir)


@query(f"with {STAR_SQL} select (select count(*) from documents) as neurons, (select count(*) from edges) as links, round((select count(*) from edges) / (select count(distinct src) from edges), 6) as avg_out_degree, (select max(n) from (select count(*) as n from edges group by src)) as max_out_degree")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = graph.graph_stats(notes(spark, sf_dir), star_edges(spark, sf_dir))
    return s.select("neurons", "links", F.round("avg_out_degree_of_sources", 6).alias("avg_out_degree"), "max_out_degree")


@query(f"with {DEGREE_SQL} select id, degree from deg order by degree desc, id limit 10")
def top_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrees(spark, sf_dir).orderBy(F.desc("degree"), "id").limit(10)


def markdown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``<lang>/<number>.md`` of the vault, with a link into another folder, one to a base name, one nowhere."""
    content = F.concat(F.lit("[["), "lang", F.lit("/"), (F.col("doc_id") + 1).cast("string"), F.lit("#part]] [["), (F.col("doc_id") + 2).cast("string"), F.lit("]] [[nowhere"), F.col("doc_id").cast("string"), F.lit("]]"))
    path = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select(F.lit("vault").alias("source_id"), F.lit("vault").alias("source_type"), path.alias("relative_path"), content.alias("content"), "doc_id")


@query(
    "with d as (select doc_id, lang, concat('vault:', lang, '/', doc_id, '.md') as id from documents) "
    "select d.id as src, 0 as edge_ord, t.id as dst from d left join d t on t.doc_id = d.doc_id + 1 and t.lang = d.lang "
    "union all select d.id, 1, t.id from d left join d t on t.doc_id = d.doc_id + 2 and t.lang = d.lang union all select d.id, 2, null from d"
)
def link_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = markdown_documents(spark, sf_dir)
    return graph.resolve_in_source(raw_links(docs), docs).select("src", "edge_ord", "dst")


#: Notes of the vault's languages, and for some numbers others of that base name in two namespaces.
NAMED_SQL = "n as (select concat(lang, '/', doc_id) as id, doc_id from documents union all select concat('wiki/', doc_id), doc_id from documents where doc_id % 3 = 0 union all select concat('concepts/', doc_id), doc_id from documents where doc_id % 2 = 0), f as (select doc_id, min(id) as id from n group by 1)"


@query(
    f"with {NAMED_SQL} select concat(d.lang, '/', d.doc_id) as src, 0 as edge_ord, coalesce(x.id, f.id) as dst from documents d left join n x on x.id = concat(d.lang, '/', d.doc_id + 1) left join f on f.doc_id = d.doc_id + 1 "
    "union all select concat(d.lang, '/', d.doc_id), 1, coalesce(w.id, c.id, f.id) from documents d left join n w on w.id = concat('wiki/', d.doc_id + 2) left join n c on c.id = concat('concepts/', d.doc_id + 2) left join f on f.doc_id = d.doc_id + 2 "
    "union all select concat(d.lang, '/', d.doc_id), 2, f.id from documents d left join f on f.doc_id = d.doc_id + 3 union all select concat(d.lang, '/', d.doc_id), 3, null from documents d"
)
def link_resolution_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link to a whole id, a bare one, one into a folder that isn't there, and one to nothing."""
    docs = table(spark, sf_dir, "documents")
    number = lambda k: (F.col("doc_id") + k).cast("string")
    own = F.concat("lang", F.lit("/"), number(0))
    ids = F.array_compact(F.array(own, F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("wiki/"), number(0))), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("concepts/"), number(0)))))
    nodes = docs.select(F.explode(ids).alias("id"))
    raw = F.array(F.concat("lang", F.lit("/"), number(1)), number(2), F.concat(F.lit("x/"), number(3)), F.concat(F.lit("nowhere"), number(0)))
    found = docs.select(own.alias("src"), F.posexplode(raw).alias("edge_ord", "target_raw"))
    return graph.resolve_by_name(found, nodes).select("src", "edge_ord", "dst")


@query(
    "with n as (select concat(lang, '/', doc_id) as id, doc_id, lang from documents where doc_id % 7 <> 0 union all select concat('wiki/', doc_id), doc_id, lang from documents where doc_id % 5 = 0), f as (select doc_id, min(id) as id from n group by 1), "
    "t as (select distinct cast(doc_id + 1 as varchar) as target_raw, doc_id + 1 as k, false as whole from documents union all select distinct concat(lang, '/', doc_id + 2), doc_id + 2, true from documents) "
    "select target_raw, case when whole then coalesce(x.id, f.id) else coalesce(w.id, f.id) end as dst from t left join n x on whole and x.id = target_raw left join n w on not whole and w.id = concat('wiki/', target_raw) left join f on f.doc_id = t.k"
)
def incremental_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What links mean once every seventh note is gone and every fifth has a page of its number in the wiki: only targets that these could be are resolved anew."""
    docs = table(spark, sf_dir, "documents")
    number = lambda k: (F.col("doc_id") + k).cast("string")
    own = docs.select(F.concat("lang", F.lit("/"), number(0)).alias("id"), "doc_id")
    pages = docs.filter("doc_id % 5 = 0").select(F.concat(F.lit("wiki/"), number(0)).alias("id"))
    links = docs.select(F.explode(F.array(number(1), F.concat("lang", F.lit("/"), number(2)))).alias("target_raw"))
    candidates = graph.name_candidates(links)
    before = graph.name_only(candidates).join(graph.best_candidates(candidates, own.select("id")), "target_raw", "left")
    gone = own.filter("doc_id % 7 = 0").select("id")
    now = own.filter("doc_id % 7 <> 0").select("id").union(pages)
    return graph.update_resolution(before, candidates, gone.union(pages), now)


HREFS = "select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as href from pages"


@query(f"with h as ({HREFS}) select page_id as src, href as target_raw, count(*) as n from h where href not in (select url from pages) group by 1, 2")
def unresolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = pages.select(F.col("page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target_raw"))
    known = pages.select(F.col("url").alias("target_raw"), F.col("page_id").alias("dst"))
    return graph.unresolved(found.join(known, "target_raw", "left")).groupBy("src", "target_raw").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {STAR_SQL}, e as (select least(src, dst) as a, greatest(src, dst) as b from edges group by 1, 2) select count(*) as pairs, sum(a) as sum_a, sum(b) as sum_b from e")
def undirected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = graph.undirected_once(star_edges(spark, sf_dir))
    return once.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("pairs"), F.sum("a").cast("decimal(38,0)").alias("sum_a"), F.sum("b").cast("decimal(38,0)").alias("sum_b")).select("pairs", F.col("sum_a").cast("long").alias("sum_a"), F.col("sum_b").cast("long").alias("sum_b"))


@query("select o_custkey as src, count(*) as orders, count(*) filter (where c.c_custkey is null) as missing from orders left join customer c on o_custkey = c.c_custkey group by 1")
def foreign_key_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left").groupBy(F.col("o_custkey").alias("src")).agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("c_custkey").isNull()).alias("missing"))


@query(f"with {STAR_SQL}, e as (select * from edges where src % 5 <> 0 and dst % 5 <> 0) select doc_id as id from documents where doc_id not in (select src from e union select dst from e)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without an edge once those of every fifth are gone."""
    edges = star_edges(spark, sf_dir).filter("src % 5 != 0 and dst % 5 != 0")
    return graph.orphans(notes(spark, sf_dir).select("id"), edges)


LENS_VEC = "greatest(0, list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])))"


@query(
    f"with {STAR_SQL}, s as (select e.vec_id as id from embeddings e join embeddings q on q.vec_id = 0 order by {LENS_VEC} desc, e.vec_id limit 12), n as (select distinct dst as id from edges where src in (select id from s) and dst not in (select id from s)) "
    "select id, hop from (select id, 0 as hop from s union all select id, 1 from n) order by hop, id limit 140"
)
def retrieval_lens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engrama.plans.text_queries import query_vector

    top = vectors.top_by_vector(collection(spark, sf_dir), query_vector(spark, sf_dir), 12).select("id", F.col("vector_score").alias("score"))
    return graph.retrieval_lens(top, star_edges(spark, sf_dir))


@query(
    "select coalesce(n.doc_id, o.doc_id) as id, case when o.doc_id is null then 'added' when n.doc_id is null then 'deleted' else 'changed' end as change from (select doc_id, text from documents where doc_id % 3 <> 0) o "
    "full outer join (select doc_id, case when doc_id % 5 = 0 then concat(text, '!') else text end as text from documents where doc_id % 7 <> 0) n on o.doc_id = n.doc_id where o.text is distinct from n.text"
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes(spark, sf_dir).select("id", "text")
    old = rows.filter("id % 3 != 0")
    new = rows.filter("id % 7 != 0").withColumn("text", F.when(F.col("id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return graph.snapshot_diff(old, new, ["text"])


@query(
    "with s as (select doc_id as id, substr(sha256(text), 1, 16) as h from documents where doc_id % 3 <> 0), c as (select doc_id as id, substr(sha256(case when doc_id % 5 = 0 then concat(text, '!') else text end), 1, 16) as h from documents where doc_id % 7 <> 0) "
    "select coalesce(c.id, s.id) as id, case when c.id is null then 'delete' when s.h is distinct from c.h then 'embed' else 'keep' end as action from s full outer join c on s.id = c.id"
)
def embedding_refresh_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engrama.functions.text import content_hash

    rows = notes(spark, sf_dir).select("id", "text")
    changed = F.when(F.col("id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    stored = rows.filter("id % 3 != 0").select("id", content_hash(F.col("text")).alias("content_hash"))
    current = rows.filter("id % 7 != 0").select("id", content_hash(changed).alias("content_hash"))
    return graph.refresh_plan(stored, current)


MESSAGES_SQL = "msg as (select conv_id as session_id, turn as id, role, text as content from conversations)"
#: Users of every third session only acknowledge, at length in one case.
SPOKEN_SQL = "msg as (select conv_id as session_id, turn as id, role, case when role = 'user' and conv_id % 3 = 0 then case when conv_id % 2 = 0 then 'Perfetto!!!!!!!!!!!!!!!!!!!!!!!!!!!!' else 'grazie. . . . . . . . . . . . . . .' end else text end as content from conversations)"
ONLY_THANKS = rf"regexp_full_match(trim(content), '(?i)({ACKNOWLEDGEMENTS})[.! ]*')"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content"), F.col("turn").alias("timestamp"))


@query(f"with {MESSAGES_SQL} select session_id, max(id) as last_message_id, count(*) as messages from msg group by 1")
def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_rollup(messages(spark, sf_dir)).drop("last_at")


@query(f"with {MESSAGES_SQL} select session_id, substr(string_agg(concat('[', role, ']\n', content), '\n\n' order by id), 1, 12000) as content from msg group by 1")
def session_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_text(messages(spark, sf_dir))


@query(
    f"with {SPOKEN_SQL}, new as (select m.* from msg m left join (select conv_id as session_id, min(turn) as l from conversations where conv_id % 4 = 0 group by 1) c on c.session_id = m.session_id where m.id > coalesce(c.l, -1) and role in ('user', 'assistant') and trim(content) <> '') "
    f"select session_id, max(id) as last_message_id, substr(string_agg(concat('[', role, ']\n', trim(content)), '\n\n' order by id), 1, 12000) as content from new group by 1 having bool_or(role = 'user' and length(trim(content)) >= 24 and not {ONLY_THANKS}) and length(string_agg(concat('[', role, ']\n', trim(content)), '\n\n' order by id)) >= 200"
)
def session_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    thanks = F.when(F.col("session_id") % 2 == 0, "Perfetto!!!!!!!!!!!!!!!!!!!!!!!!!!!!").otherwise("grazie. . . . . . . . . . . . . . .")
    said = F.when((F.col("role") == "user") & (F.col("session_id") % 3 == 0), thanks).otherwise(F.col("content"))
    rows = messages(spark, sf_dir).withColumn("content", said)
    done = rows.filter("session_id % 4 = 0").groupBy("session_id").agg(F.min("id").alias("last_message_id"))
    return sessions.candidate_sessions(rows, done)


@query(
    "select concat(lang, '/', doc_id, '.md') as path, doc_id as mtime, sha256(text) as sha256 from documents where doc_id >= 100 and lang <> 'de' and not (doc_id % 2 = 0) order by doc_id, path limit 3"
)
def candidate_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("doc_id").alias("mtime"), F.col("text").alias("content"))
    done = rows.filter("mtime % 2 = 0").select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
    return sessions.candidate_notes(rows, done, F.lit(100), ["**/*.md"], ["de/**"])


@query("select path, sha256, processed_at from (select doc_id % 10 as path, sha256(text) as sha256, doc_id as processed_at, row_number() over (partition by doc_id % 10 order by doc_id desc) as r from documents) where r = 1")
def checkpoint_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.col("doc_id").alias("processed_at"))
    return sessions.mark_processed(rows.filter("processed_at % 2 = 0"), rows.filter("processed_at % 2 = 1"), "path")


TITLE = "lower(trim(text))"


@query(f"select d.doc_id as concept_id, m.match from documents d join (select {TITLE} as k, min(doc_id) as match from documents group by 1) m on m.k = lower(trim(concat('  ', d.text, ' ')))")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    title = F.concat(F.lit("  "), "text", F.lit(" "))
    return genesis.exact_duplicates(docs.select(F.col("doc_id").alias("concept_id"), title.alias("title")), docs.select(F.col("doc_id").alias("id"), F.col("text").alias("title")))


NEAR_SQL = "near as (select x.vec_id as a, y.vec_id as b, greatest(0, list_cosine_similarity(cast(x.embedding as double[]), cast(y.embedding as double[]))) as s, row_number() over (partition by x.vec_id order by round(list_cosine_similarity(cast(x.embedding as double[]), cast(y.embedding as double[])), 12) desc, y.vec_id) as r from embeddings x join embeddings y on x.vec_id <> y.vec_id)"


#: Concepts whose vectors are drawn aside a little from every tenth note's, from an id on.
ASIDE = 1_000_000_000
CLOSE_SQL = f"""vecs as (select vec_id as id, cast(embedding as double[]) as v from embeddings union all select vec_id + {ASIDE}, list_transform(cast(embedding as double[]), lambda x: x + 0.02) from embeddings where vec_id % 10 = 0),
pairs as (select x.id as a, y.id as b, list_cosine_similarity(x.v, y.v) as c from vecs x join vecs y on x.id <> y.id),
close as (select a, b, greatest(0, c) as s, row_number() over (partition by a order by round(c, 12) desc, b) as r from pairs)"""


def with_aside(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = collection(spark, sf_dir).select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    aside = own.filter("id % 10 = 0").select((F.col("id") + ASIDE).alias("id"), F.transform("embedding", lambda x: x + 0.02).alias("embedding"))
    return own.union(aside)


@query(f"with {CLOSE_SQL} select a as concept_id, b as match, round(s, 6) as similarity from close where r = 1 and s >= 0.65")
def semantic_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vectors.nearest(with_aside(spark, sf_dir), 1).filter("similarity >= 0.65")
    return near.select(F.col("a").alias("concept_id"), F.col("b").alias("match"), F.round("similarity", 6).alias("similarity"))


PHANTOM_SQL = (
    f"{NEAR_SQL}, {STAR_SQL}, p as (select a as source, b as target, greatest(0, 1 - (1 - c) * (1 - c) / 2) as similarity from (select a, b, r, (select list_cosine_similarity(cast(x.embedding as double[]), cast(y.embedding as double[])) from embeddings x, embeddings y where x.vec_id = a and y.vec_id = b) as c from near where r <= 8)), "
    "cand as (select p.source, p.target, p.similarity from p left join edges e on e.src = p.source and e.dst = p.target where p.similarity >= 0.65 and e.src is null)"
)


@query(f"with {PHANTOM_SQL} select source, target, round(similarity, 6) as similarity from cand")
def phantom_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = consolidation.phantom_candidates(collection(spark, sf_dir), star_edges(spark, sf_dir))
    return found.select("source", "target", F.round("similarity", 6).alias("similarity"))


@query(
    f"with recursive {PHANTOM_SQL}, listed as materialized (select *, row_number() over (order by source, similarity desc, target) as r from cand), "
    "chosen as (select cast(0 as bigint) as r, cast([] as bigint[]) as ends, cast([] as bigint[]) as kept union all select r, case when fits then list_concat(ends, [source, target]) else ends end, case when fits then list_append(kept, r) else kept end "
    "from (select l.r, l.source, l.target, c.ends, c.kept, len(list_filter(c.ends, lambda x: x = l.source)) < 3 and len(list_filter(c.ends, lambda x: x = l.target)) < 3 as fits from chosen c join listed l on l.r = c.r + 1 where len(c.kept) < 100)), "
    "last as (select unnest(kept) as r from (select kept from chosen order by r desc limit 1)) select source, target, round(similarity, 6) as similarity from listed where r in (select r from last)"
)
def phantom_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = consolidation.phantom_candidates(collection(spark, sf_dir), star_edges(spark, sf_dir))
    return consolidation.phantom_links(found).select("source", "target", F.round("similarity", 6).alias("similarity"))


def slug_sql(title: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({title})), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '-')"


def flat_sql(body: str) -> str:
    return rf"lower(trim(regexp_replace({body}, '\s+', ' ', 'g')))"


DECIDE_SQL = (
    f"with {CLOSE_SQL}, c as (select doc_id as concept_id, doc_id // 5 as query_id, concat(left(text, 12), case when doc_id % 2 = 0 then '' else concat(' ', doc_id) end) as title, case when doc_id % 9 = 0 then concat('not ', text) when doc_id % 9 = 1 then text else concat('new ', doc_id) end as definition from documents), "
    "f as (select *, row_number() over (partition by query_id order by concept_id) as r from c qualify r <= 5), n as (select doc_id as id, left(text, 12) as title, text from documents), "
    f"m as (select f.*, coalesce(e.match, k.b) as match from f left join (select lower(trim(title)) as k, min(id) as match from n group by 1) e on e.k = lower(trim(f.title)) left join (select a - {ASIDE} - 1 as a, b from close where r = 1 and s >= 0.82 and a >= {ASIDE} and b < {ASIDE}) k on k.a = f.concept_id) "
    rf"select m.query_id, m.concept_id, case when m.match is not null and regexp_matches(m.definition, '(?i)\b(?:{CONFLICTS})\b') then 'skip' when m.match is not null and contains({flat_sql('n.text')}, {flat_sql('m.definition')}) then 'already_present' when m.match is not null then 'merge' "
    f"when {slug_sql('m.title')} in (select {slug_sql('title')} from n) then 'skip' else 'create' end as action, m.match as target from m left join n on n.id = m.match"
)


@query(DECIDE_SQL)
def genesis_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five concepts a query, so that every document is decided on: by title, by a near vector (that of the document before an odd one), or new."""
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    definition = F.when(k % 9 == 0, F.concat(F.lit("not "), "text")).when(k % 9 == 1, F.col("text")).otherwise(F.concat(F.lit("new "), k.cast("string")))
    title = F.concat(F.left("text", F.lit(12)), F.when(k % 2 == 0, "").otherwise(F.concat(F.lit(" "), k.cast("string"))))
    concepts = docs.select(k.alias("concept_id"), F.floor(k / 5).alias("query_id"), title.alias("title"), definition.alias("definition"))
    nodes = docs.select(k.alias("id"), F.left("text", F.lit(12)).alias("title"), "text")
    near = vectors.nearest(with_aside(spark, sf_dir), 1).filter((F.col("a") >= ASIDE) & (F.col("b") < ASIDE))
    near = near.select((F.col("a") - ASIDE - 1).alias("concept_id"), F.col("b").alias("match"), "similarity")
    return genesis.decisions(concepts, nodes, near, 5)


@query("select epoch_us(date_trunc('hour', ts)) as start_us, event_type, count(*) as n from events group by 1, 2")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.tumbling(rows, "1 hour", "ts", ["event_type"]).select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query(
    "with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as fresh from events), g as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as burst from e) "
    "select epoch_us(min(ts)) as start_us, epoch_us(max(ts) + interval 30 minutes) as end_us, user_id, count(*) as n from g group by user_id, burst"
)
def burst_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.bursts(rows, "30 minutes", "ts", ["user_id"]).select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "user_id", "n")


@query("select event_id, event_type, row_number() over (partition by event_type order by ts, event_id) as sequence from events")
def event_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sequenced(table(spark, sf_dir, "events"), vault="event_type").select("event_id", "event_type", F.col("sequence").cast("long").alias("sequence"))
