"""Text, lexical, vector and retrieval queries.

Notes are ``documents``, the query text is ``benchmark`` item 0 or every item,
the query vector that of ``vec_id`` 0 or every vector. Project stars join each
source's least document with its other ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engrama.functions import paths, text
from engrama.functions.stemming import stems, stems_sql
from engrama.functions.text import STOP_WORDS
from engrama.operators import activation, graph, lexical, ranking, vectors
from engrama.operators import lexical_index as index
from engrama.plans.registry import query, table
from engrama.settings import Settings
from engrama.sources.shared import shared_folder, signature, stash

STOP_SQL = "(" + ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS)) + ")"
DEFAULT = Settings()
#: Settings under which spreading reaches the second hop.
WIDE = Settings(active_threshold=0.001, neighbours_per_hop=10, hop_decay=0.5)


def terms_sql(source: str, key: str, body: str = "text", pattern: str = r"[\p{L}\p{N}_]+") -> str:
    return f"select {key}, term from (select {key}, unnest(regexp_extract_all(lower({body}), '{pattern}')) as term from {source}) where length(term) > 1 and term not in {STOP_SQL}"


#: CTE scores(query_id, id, bm25, matched) over tok(doc_id, term) and q(query_id, term, times).
SCORES_SQL = """dl as (select d.doc_id, coalesce(t.n, 0) as dl from documents d left join (select doc_id, count(*) as n from tok group by 1) t on d.doc_id = t.doc_id),
st as (select count(*) as n, greatest(avg(dl), 1.0) as avg_dl from dl),
tf as (select doc_id, term, count(*) as tf from tok where term in (select term from q) group by 1, 2),
df as (select term, count(*) as df from tf group by 1),
scores as (
  select q.query_id, tf.doc_id as id, sum(q.times * ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * dl.dl / st.avg_dl))) as bm25,
         array_to_string(list_sort(list(distinct tf.term)), ' ') as matched
  from tf join q on tf.term = q.term join df on tf.term = df.term join dl on tf.doc_id = dl.doc_id cross join st group by 1, 2)"""


def bm25_sql(pattern: str = r"[\p{L}\p{N}_]+", items: str = "benchmark where item_id = 0") -> str:
    """CTEs tok, q, scores(query_id, id, bm25, matched)."""
    return rf"""
tok as ({terms_sql('documents', 'doc_id', pattern=pattern)}),
q as (select item_id as query_id, term, count(*) as times from ({terms_sql(f'(select * from {items})', 'item_id', pattern=pattern)}) group by 1, 2),
{SCORES_SQL}"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source", "n_chars")


def items(spark: SparkSession, sf_dir: str, first: bool = True) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return rows.filter("query_id = 0") if first else rows


def scores(spark: SparkSession, sf_dir: str, first: bool = True, cut=text.tokens) -> DataFrame:
    return lexical.bm25(notes(spark, sf_dir), items(spark, sf_dir, first), F.col("text"), F.col("text"), DEFAULT, cut)


def stored_index(spark: SparkSession, sf_dir: str) -> index.Index:
    """The stored index over whole ``documents``, built when a version of the table is first asked for."""
    folder = f"{shared_folder(spark)}/engrama-lexical-{signature(spark, f'{sf_dir}/documents.parquet')}"
    return index.stored(notes(spark, sf_dir), F.col("text"), folder)


def best_notes(spark: SparkSession, sf_dir: str, k: int, first: bool = True) -> DataFrame:
    """query_id, id, bm25, matched of the k best notes of each item, from the stored index."""
    return index.Search(stored_index(spark, sf_dir), items(spark, sf_dir, first), F.col("text"), k, DEFAULT).top()


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection(spark, sf_dir).filter("id = 0").select("id", F.col("embedding").alias("qv")).select(F.col("id").alias("query_id"), "qv")


@query(f"select d.doc_id, coalesce(t.n, 0) as n_tokens from documents d left join (select doc_id, count(*) as n from ({terms_sql('documents', 'doc_id')}) group by 1) t on d.doc_id = t.doc_id")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.lengths(notes(spark, sf_dir), F.col("text")).select(F.col("id").alias("doc_id"), F.col("dl").alias("n_tokens"))


@query(f"select term, count(distinct doc_id) as df, count(*) as cf from ({terms_sql('documents', 'doc_id')}) group by 1")
def term_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(notes(spark, sf_dir), F.col("text")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query(f"with t as ({terms_sql('documents', 'doc_id')}), n as (select count(*) as n from documents) select term, round(ln(1 + (max(n.n) - count(distinct doc_id) + 0.5) / (count(distinct doc_id) + 0.5)), 6) as idf from t cross join n group by 1")
def inverse_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.term_stats(notes(spark, sf_dir), F.col("text")).select("term", F.round("idf", 6).alias("idf"))


@query(f"with {bm25_sql()} select id as doc_id, round(bm25, 6) as bm25 from scores order by scores.bm25 desc, id limit 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_notes(spark, sf_dir, 10).select(F.col("id").alias("doc_id"), F.round("bm25", 6).alias("bm25"))


@query(f"with {bm25_sql(items='benchmark')} select query_id, id as doc_id, round(bm25, 5) as bm25, matched from scores")
def bm25_all_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, first=False).select("query_id", F.col("id").alias("doc_id"), F.round("bm25", 5).alias("bm25"), F.array_join("matched", " ").alias("matched"))


@query(f"with {bm25_sql()} select id as doc_id, round(bm25 / max(bm25) over (), 6) as bm25_norm from scores where bm25 > 0")
def bm25_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.normalized(scores(spark, sf_dir)).select(F.col("id").alias("doc_id"), F.round("bm25_norm", 6).alias("bm25_norm"))


@query(f"with {bm25_sql()} select id as doc_id, round(least(ln(1 + bm25) / ln(11), 1.0), 6) as bm25_log from scores")
def bm25_log_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select(F.col("id").alias("doc_id"), F.round(lexical.normalized_alone(F.col("bm25")), 6).alias("bm25_log"))


@query(f"with {bm25_sql()} select id as doc_id, matched from scores")
def bm25_matched_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select(F.col("id").alias("doc_id"), F.array_join("matched", " ").alias("matched"))


@query(f"with {bm25_sql('[a-z0-9]+')} select id as doc_id, round(bm25, 6) as bm25 from scores")
def bm25_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, cut=text.ascii_tokens).select(F.col("id").alias("doc_id"), F.round("bm25", 6).alias("bm25"))


ASCII = "[a-z0-9]+"
STEMMED_SQL = f"""
raw as ({terms_sql('documents', 'doc_id', pattern=ASCII)}),
asked as ({terms_sql('benchmark', 'item_id', pattern=ASCII)}),
voc as materialized ({stems_sql('(select term from raw union select term from asked)')}),
tok as (select doc_id, stem as term from raw join voc using (term)),
q as (select item_id as query_id, stem as term, count(*) as times from asked join voc using (term) group by 1, 2),
{SCORES_SQL}"""


@query(f"with {STEMMED_SQL} select query_id, id as doc_id, round(bm25, 5) as bm25, matched from scores qualify row_number() over (partition by query_id order by round(bm25, 9) desc, id) <= 10")
def bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each item by BM25 over Italian stems."""
    docs, asked = notes(spark, sf_dir), items(spark, sf_dir, first=False)
    known = stash(stems(lexical.vocabulary(docs, asked, cut=text.ascii_tokens)))
    rows = lexical.bm25(docs, asked, F.col("text"), F.col("text"), DEFAULT, text.ascii_tokens, known)
    best = rows.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("bm25", 9)), "id"))).filter("r <= 10")
    return best.select("query_id", F.col("id").alias("doc_id"), F.round("bm25", 5).alias("bm25"), F.array_join("matched", " ").alias("matched"))


COS = "greatest(0, list_cosine_similarity(cast({a}.embedding as double[]), cast({b}.embedding as double[])))"
VEC_SQL = f"vec as (select e.vec_id as id, {COS.format(a='e', b='q')} as vector_score from embeddings e join embeddings q on q.vec_id = 0 order by vector_score desc, id limit 25)"


@query(f"with {VEC_SQL} select id as vec_id, round(vector_score, 6) as similarity from vec order by vector_score desc, id limit 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = vectors.top_by_vector(collection(spark, sf_dir), query_vector(spark, sf_dir), 10)
    return top.select(F.col("id").alias("vec_id"), F.round("vector_score", 6).alias("similarity"))


@query(
    "select a, b, round(greatest(0, cos), 6) as similarity, r as rank from (select x.vec_id as a, y.vec_id as b, list_cosine_similarity(cast(x.embedding as double[]), cast(y.embedding as double[])) as cos, "
    "row_number() over (partition by x.vec_id order by round(list_cosine_similarity(cast(x.embedding as double[]), cast(y.embedding as double[])), 12) desc, y.vec_id) as r from embeddings x join embeddings y on x.vec_id <> y.vec_id) where r <= 8"
)
def vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vectors.nearest(collection(spark, sf_dir), 8)
    return near.select("a", "b", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("select max(n) as n, round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1)), 6) as mean_cosine from (select i, sum(x) as s, count(*) as n from (select unnest(range(1, len(embedding) + 1)) as i, unnest(cast(embedding as double[])) / sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) as x from embeddings) group by i)")
def vector_cosine_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_stats(collection(spark, sf_dir)).select("n", F.round("mean_cosine", 6).alias("mean_cosine"))


FUSED_SQL = f"""{bm25_sql()},
{VEC_SQL},
lex as (select id, bm25 / max(bm25) over () as bm25_norm, bm25, matched from (select * from scores where bm25 > 0 order by bm25 desc, id limit 25)),
fused as (select coalesce(v.id, l.id) as id, coalesce(v.vector_score, 0) as vector_score, coalesce(l.bm25_norm, 0) as bm25_norm, 0.7 * coalesce(v.vector_score, 0) + 0.3 * coalesce(l.bm25_norm, 0) as score from vec v full outer join lex l on v.id = l.id),
star as (select d.doc_id as id, a.anchor, row_number() over (partition by a.anchor order by d.doc_id) - 1 as ord from documents d join (select source, min(doc_id) as anchor from documents group by 1) a on d.source = a.source where d.doc_id <> a.anchor),
edges as (select anchor as src, id as dst, ord as edge_ord from star union all select id, anchor, 0 from star),
deg as (select d.doc_id as id, coalesce(o.n, 0) + coalesce(i.n, 0) as degree from documents d left join (select src, count(*) as n from edges group by 1) o on o.src = d.doc_id left join (select dst, count(*) as n from edges group by 1) i on i.dst = d.doc_id),
damped as (select f.id, f.vector_score, f.bm25_norm, f.score * case when g.degree > 25 then 1 / (1 + 0.15 * (g.degree - 25)) else 1 end as score from fused f left join deg g on f.id = g.id),
thr as (select count(*) as n, case when count(*) < 3 then 0.15 else greatest(median(score) + 0.3 * coalesce(stddev_samp(score), 0), 0.15) end as threshold from damped),
kept as (select d.* from damped d cross join thr where thr.n < 5 or d.score >= thr.threshold),
seeds as (select id, vector_score, bm25_norm, score, row_number() over (order by score desc, id) - 1 as seed_rank from kept qualify seed_rank < 5)"""


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between each source's least document and its others, numbered per note."""
    own = notes(spark, sf_dir).select("id", "source")
    anchors = own.groupBy("source").agg(F.min("id").alias("anchor"))
    edges = graph.star(own, anchors, ["source"], "project_context", 0.35)
    return edges.withColumn("edge_ord", F.row_number().over(W.partitionBy("src").orderBy("dst")) - 1)


def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree(notes(spark, sf_dir), star_edges(spark, sf_dir))


def fused_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = 5 * DEFAULT.seed_count
    vector = vectors.top_by_vector(collection(spark, sf_dir), query_vector(spark, sf_dir), n)
    lex = lexical.normalized(stash(best_notes(spark, sf_dir, n)))
    return activation.fused(vector.withColumn("query_id", F.lit(0).cast("long")), lex), lex


@query(f"with {FUSED_SQL} select id, round(vector_score, 6) as vector_score, round(bm25_norm, 6) as bm25_norm, round(score, 6) as score from fused")
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return fused_scores(spark, sf_dir)[0].select("id", r("vector_score"), r("bm25_norm"), r("score"))


def damped_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activation.dampened(fused_scores(spark, sf_dir)[0], degrees(spark, sf_dir))


@query(f"with {FUSED_SQL} select id, round(score, 6) as score from damped")
def hub_dampened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damped_scores(spark, sf_dir).select("id", F.round("score", 6).alias("score"))


@query(f"with {FUSED_SQL} select n, round(threshold, 6) as threshold from thr")
def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activation.thresholds(damped_scores(spark, sf_dir)).select("n", F.round("threshold", 6).alias("threshold"))


def seed_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    kept = stash(activation.filtered(stash(damped_scores(spark, sf_dir))))
    return activation.seeds(kept), kept


@query(f"with {FUSED_SQL} select id, round(score, 6) as score, seed_rank from seeds")
def seed_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_scores(spark, sf_dir)[0].select("id", F.round("score", 6).alias("score"), F.col("seed_rank").cast("long").alias("seed_rank"))


@query(
    f"with {FUSED_SQL}, r as (select score, row_number() over (order by score desc, id) as r from damped) select round((select max(vector_score) from damped), 6) as max_vector, round((select max(bm25_norm) from damped), 6) as max_bm25, "
    "(select count(distinct term) from q) as n_terms, (select matched from lex order by bm25 desc, id limit 1) as matched, round((select score from r where r = 1), 6) as top, round(coalesce((select score from r where r = 2), 0), 6) as second, round((select score from r where r = 1) - coalesce((select score from r where r = 2), 0), 6) as margin"
)
def routing_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused, lex = fused_scores(spark, sf_dir)
    damped = activation.dampened(fused, degrees(spark, sf_dir))
    terms = lexical.query_terms(items(spark, sf_dir), F.col("text"))
    r = lambda c: F.round(c, 6).alias(c)
    return activation.diagnostics(damped, lex, terms).select(r("max_vector"), r("max_bm25"), "n_terms", "matched", r("top"), r("second"), r("margin"))


HOP_SQL = """
f0 as (select id, score as enq, seed_rank as ord from seeds),
near1 as (select f.ord, f.id as frm, f.enq, e.dst, coalesce(k.score, 0.1) as sim, e.edge_ord from f0 f join edges e on e.src = f.id left join kept k on k.id = e.dst),
cap1 as (select *, row_number() over (partition by ord order by sim desc, edge_ord, dst) as nbr from near1 qualify nbr <= 10),
new1 as (select c.dst as id, c.frm, c.ord, c.nbr, c.enq * 0.5 * case when g.degree > 25 then 1 / (1 + 0.15 * (g.degree - 25)) else 1 end as new from cap1 c left join deg g on g.id = c.dst),
best1 as (select id, max(new) as new, arg_min(frm, (-new, ord, nbr)) as frm, min((ord, nbr, new)) filter (where new > 0.001) as first from new1 group by 1),
a1 as (select coalesce(s.id, b.id) as id, case when s.id is not null then greatest(s.score, coalesce(b.new, s.score)) else b.new end as score, case when s.id is not null then 'seed' else 'graph_neighbor' end as role, case when s.id is not null then 0 else 1 end as hop, case when s.id is null then b.frm end as parent
  from seeds s full outer join best1 b on s.id = b.id where s.id is not null or b.new > 0.001),
f1 as (select b.id, b.first[3] as enq, row_number() over (order by b.first[1], b.first[2]) as ord from best1 b left join seeds s on s.id = b.id where s.id is null and b.new > 0.001),
near2 as (select f.ord, f.id as frm, f.enq, e.dst, coalesce(k.score, 0.1) as sim, e.edge_ord from f1 f join edges e on e.src = f.id left join kept k on k.id = e.dst),
cap2 as (select *, row_number() over (partition by ord order by sim desc, edge_ord, dst) as nbr from near2 qualify nbr <= 10),
new2 as (select c.dst as id, c.frm, c.ord, c.nbr, c.enq * 0.5 * case when g.degree > 25 then 1 / (1 + 0.15 * (g.degree - 25)) else 1 end as new from cap2 c left join deg g on g.id = c.dst),
best2 as (select id, max(new) as new, arg_min(frm, (-new, ord, nbr)) as frm from new2 group by 1),
a2 as (select coalesce(a.id, b.id) as id, case when a.id is not null then greatest(a.score, coalesce(b.new, a.score)) else b.new end as score, coalesce(a.role, 'graph_neighbor') as role,
  case when a.id is null or (a.role <> 'seed' and b.new > a.score) then 2 else a.hop end as hop, case when a.id is null or (a.role <> 'seed' and b.new > a.score) then b.frm else a.parent end as parent
  from a1 a full outer join best2 b on a.id = b.id where a.id is not null or b.new > 0.001)"""


@query(f"with {FUSED_SQL}, {HOP_SQL} select id, round(score, 6) as score, role, hop, parent from a2")
def khop_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds, kept = seed_scores(spark, sf_dir)
    active = activation.khop(seeds, star_edges(spark, sf_dir), kept, degrees(spark, sf_dir), WIDE)
    return active.select("id", F.round("score", 6).alias("score"), "role", "hop", "parent")


#: Settings under which firing goes on for several steps.
EAGER = Settings(fire_base=0.02, fire_k=0.01)
RING_SQL = """ring as (select d.doc_id as src, d.doc_id + k as dst from documents d, (values (1), (2), (3)) v(k) where d.doc_id + k in (select doc_id from documents)),
ringdeg as (select d.doc_id as id, coalesce(o.n, 0) + coalesce(i.n, 0) as degree from documents d left join (select src, count(*) as n from ring group by 1) o on o.src = d.doc_id left join (select dst, count(*) as n from ring group by 1) i on i.dst = d.doc_id)"""


def fire_sql(steps: int = 5, base: float = 0.02, k: float = 0.01) -> str:
    out = "z0 as (select id, score as value, 0 as step from seeds)"
    for n in range(1, steps + 1):
        out += f""",
i{n} as (select e.dst as id, sum(z.value * coalesce(kp.score, 0.3)) as incoming from z{n - 1} z join ring e on e.src = z.id left join kept kp on kp.id = z.id group by 1),
z{n} as (select * from z{n - 1} union all select i.id, least(i.incoming - ({base} + {k} * ln(1 + g.degree)), 1.0), {n} from i{n} i join ringdeg g on g.id = i.id where i.id not in (select id from z{n - 1}) and i.incoming - ({base} + {k} * ln(1 + g.degree)) > 0 and ({n} = 1 or (select coalesce(sum(value), 0) from z{n - 1} where step = {n - 1}) >= 0.0001))"""
    return out


#: Vector candidates alone, not dampened: hybrid scores over the ten times as many as there are seeds.
CANDIDATE_SQL = f"""{bm25_sql()},
cand as (select e.vec_id as id, {COS.format(a='e', b='q')} as vs from embeddings e join embeddings q on q.vec_id = 0 order by vs desc, id limit 50),
lexed as (select cand.id, vs, coalesce(s.bm25, 0) as bm25, max(coalesce(s.bm25, 0)) over () as top from cand left join scores s on s.id = cand.id),
hybrid as (select id, 0.7 * vs + 0.3 * case when top > 0 then bm25 / top else 0 end as score from lexed),
thr as (select count(*) as n, case when count(*) < 3 then 0.15 else greatest(median(score) + 0.3 * coalesce(stddev_samp(score), 0), 0.15) end as threshold from hybrid),
kept as (select hybrid.* from hybrid cross join thr where n < 5 or score >= threshold),
seeds as (select id, score, row_number() over (order by score desc, id) - 1 as seed_rank from kept qualify seed_rank < 5)"""


@query(f"with {CANDIDATE_SQL}, {RING_SQL}, {fire_sql()} select id, round(value, 6) as value, step from z5")
def integrate_fire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the seeds along links of each document to its next three."""
    vector = vectors.top_by_vector(collection(spark, sf_dir), query_vector(spark, sf_dir), 10 * DEFAULT.seed_count)
    hybrid = activation.over_candidates(vector.withColumn("query_id", F.lit(0).cast("long")), scores(spark, sf_dir))
    kept = stash(activation.filtered(stash(hybrid)))
    docs = notes(spark, sf_dir).select("id")
    ring = docs.select(F.col("id").alias("src"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k")).select("src", (F.col("src") + F.col("k")).alias("dst")).join(docs.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
    return activation.fire(activation.seeds(kept), ring, kept, graph.degree(docs, ring), EAGER).select("id", F.round("value", 6).alias("value"), "step")


METHOD_SQL = f"""{bm25_sql(items='benchmark')},
cand as (select q.vec_id as query_id, e.vec_id as id, {COS.format(a='e', b='q')} as vs from embeddings e cross join (select * from embeddings where vec_id in (select item_id from benchmark)) q qualify row_number() over (partition by q.vec_id order by {COS.format(a='e', b='q')} desc, e.vec_id) <= 50),
lexed as (select cand.query_id, cand.id, vs, coalesce(s.bm25, 0) as bm25, max(coalesce(s.bm25, 0)) over (partition by cand.query_id) as top from cand left join scores s on s.id = cand.id and s.query_id = cand.query_id),
normed as (select query_id, id, vs, case when top > 0 then bm25 / top else 0 end as b from lexed),
methods as (select 'vector' as method, query_id, id, vs as score from normed union all select 'bm25', query_id, id, b from normed union all select 'hybrid', query_id, id, 0.7 * vs + 0.3 * b from normed),
thr as (select method, query_id, case when count(*) < 3 then 0.05 else greatest(median(score) + 0.3 * coalesce(stddev_samp(score), 0), 0.05) end as threshold from methods group by 1, 2)"""


@query(f"with {METHOD_SQL} select m.method, m.query_id, m.id, round(m.score, 6) as score from methods m join thr t on t.method = m.method and t.query_id = m.query_id where m.score >= t.threshold")
def retrieval_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with the vector of its number, by each method over the fifty nearest notes, without spreading."""
    asked = collection(spark, sf_dir).join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")), "id", "left_semi").select(F.col("id").alias("query_id"), F.col("embedding").alias("qv"))
    vector = stash(vectors.top_by_vector(collection(spark, sf_dir), asked, 50))
    lex = stash(scores(spark, sf_dir, first=False).join(vector.select("query_id", "id"), ["query_id", "id"], "left_semi"))
    low = Settings(floor=0.05)
    out = None
    for method in ("vector", "bm25", "hybrid"):
        kept = activation.filtered(activation.over_candidates(vector, lex, method), low, few=0)
        rows = kept.select(F.lit(method).alias("method"), "query_id", "id", F.round("score", 6).alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"with {FUSED_SQL} select case when max(score) >= 0.65 then 'direct' when max(score) >= 0.45 then 'weak' when max(score) is null then 'none' else 'insufficient' end as state, count(*) as seeds from seeds")
def evidence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_scores(spark, sf_dir)[0].agg(activation.evidence_state(F.max("score")).alias("state"), F.count(F.lit(1)).alias("seeds"))


RANK_SQL = f"""with {bm25_sql(items='benchmark')},
ranked as (select query_id, id, row_number() over (partition by query_id order by round(bm25, 9) desc, id) as rank from scores qualify rank <= 10),
expected as (select q.query_id, l.doc_id as id from (select distinct item_id as query_id from benchmark) q join (select s.query_id, l.doc_id from scores s join labels l on l.doc_id = s.id where l.quality = 1) l on l.query_id = q.query_id),
hits as (select r.* from ranked r join expected e on r.query_id = e.query_id and r.id = e.id),
per as (select q.item_id as query_id, (select count(*) from expected e where e.query_id = q.item_id) as n, (select count(*) from hits h where h.query_id = q.item_id and h.rank <= 5) as h, (select coalesce(sum(1 / log2(h.rank + 1)), 0) from hits h where h.query_id = q.item_id and h.rank <= 5) as dcg, (select min(h.rank) from hits h where h.query_id = q.item_id) as first from benchmark q),
ok as (select * from per where n > 0 or query_id in (select query_id from ranked)),
m as (select query_id, h / 5.0 as precision, case when n = 0 then 1.0 else h / n end as recall, dcg, n, coalesce(1.0 / first, 0) as mrr, coalesce(first - 1, -1) as first_hit, (case when n >= 1 then 1 / log2(2) else 0 end + case when n >= 2 then 1 / log2(3) else 0 end + case when n >= 3 then 1 / log2(4) else 0 end + case when n >= 4 then 1 / log2(5) else 0 end + case when n >= 5 then 1 / log2(6) else 0 end) as ideal from ok),
metrics as (select query_id, precision, recall, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1, mrr, case when ideal > 0 then dcg / ideal else 0 end as ndcg, first_hit from m)"""


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stash(scores(spark, sf_dir, first=False).select("query_id", "id", "bm25"))
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("bm25", 9)), "id")
    ranked = got.withColumn("rank", F.row_number().over(order)).filter("rank <= 10").select("query_id", "id", "rank")
    good = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    return ranking.query_metrics(ranked, got.join(good, "id", "left_semi").select("query_id", "id"), 5)


@query(f"{RANK_SQL} select query_id, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, round(mrr, 6) as mrr, round(ndcg, 6) as ndcg, first_hit from metrics")
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return retrieval_metrics(spark, sf_dir).select("query_id", r("precision"), r("recall"), r("f1"), r("mrr"), r("ndcg"), "first_hit")


@query(f"{RANK_SQL} select 'precision' as metric, count(*) as n, round(avg(precision), 4) as mean, round(stddev_pop(precision), 4) as std, round(min(precision), 4) as min, round(max(precision), 4) as max from metrics union all select 'mrr', count(*), round(avg(mrr), 4), round(stddev_pop(mrr), 4), round(min(mrr), 4), round(max(mrr), 4) from metrics")
def ir_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.summary(retrieval_metrics(spark, sf_dir), ["precision", "mrr"])


NOTE_SQL = "concat('---\ntitle: Note ', doc_id, '\ntags: [', lang, ', ', source, ']\nsource: a\nsource: ', source, '\nno colon here\n---\n# ', replace(replace(replace(text, ' the ', ' [[the]] '), ' of ', ' [[of|shown]] '), ' de ', ' `[[de]]` '), '\n`[[code]]` [[', lang, '/', doc_id % 7, '|shown]] and [[ plain', doc_id % 3, ' ]]\n```\n[[fenced]]\n```\n> *tail*')"


def note_content() -> F.Column:
    """A Markdown note made of a whole document, some of whose words are links or code, the same in SQL."""
    linked = F.replace(F.replace(F.replace("text", F.lit(" the "), F.lit(" [[the]] ")), F.lit(" of "), F.lit(" [[of|shown]] ")), F.lit(" de "), F.lit(" `[[de]]` "))
    c = lambda x: F.col(x).cast("string")
    return F.concat(
        F.lit("---\ntitle: Note "), c("doc_id"), F.lit("\ntags: ["), "lang", F.lit(", "), "source", F.lit("]\nsource: a\nsource: "), "source", F.lit("\nno colon here\n---\n# "), linked,
        F.lit("\n`[[code]]` [["), "lang", F.lit("/"), (F.col("doc_id") % 7).cast("string"), F.lit("|shown]] and [[ plain"), (F.col("doc_id") % 3).cast("string"), F.lit(" ]]\n```\n[[fenced]]\n```\n> *tail*"),
    )


@query("select doc_id, concat('Note ', doc_id) as title, concat('[', lang, ', ', source, ']') as tags, source as last_source, 3 as n_keys from documents")
def frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    fm = table(spark, sf_dir, "documents").select("doc_id", text.frontmatter(note_content()).alias("fm"))
    return fm.select("doc_id", F.col("fm")["title"].alias("title"), F.col("fm")["tags"].alias("tags"), F.col("fm")["source"].alias("last_source"), F.size("fm").alias("n_keys"))


@query(
    "with n as (select doc_id, regexp_replace(replace(" + NOTE_SQL + r", concat('```', chr(10), '[[fenced]]', chr(10), '```'), ''), '`[^`\n]*`', '', 'g') as c from documents), "
    r"l as (select doc_id, regexp_extract_all(c, '\[\[([^\]|]+)(?:\|([^\]]+))?\]\]', 1) as t, regexp_extract_all(c, '\[\[([^\]|]+)(?:\|([^\]]+))?\]\]', 2) as d from n), "
    "u as (select doc_id, unnest(range(0, len(t))) as ord, t, d from l) select doc_id, ord, trim(t[ord + 1]) as target, case when trim(coalesce(d[ord + 1], '')) <> '' then trim(d[ord + 1]) else trim(t[ord + 1]) end as display from u"
)
def wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.wikilinks(note_content())).alias("ord", "l"))
    return found.select("doc_id", "ord", F.col("l.target").alias("target"), F.col("l.display").alias("display"))


@query(
    r"select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + NOTE_SQL + r", '^---\n(?s:(.*?))\n---\n', ''), '\[\[([^\]|]+)\|([^\]]+)\]\]', '\2', 'g'), '\[\[([^\]|]+)\]\]', '\1', 'g'), '[#*_`>\-]', ' ', 'g'), '\s+', ' ', 'g')) as plain from documents"
)
def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.plain_text(note_content()).alias("plain"))


#: Whole texts, and titles of which each list of labels has some.
TITLE_SQL = "case doc_id % 8 when 0 then 'GPT 4o-mini' when 1 then 'Ollama' when 2 then 'Graph Refresh' when 3 then 'honcho dialectic' when 4 then 'Pulse' when 5 then concat('v', doc_id, '.2') else text end"
SLUG_SQL = rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({TITLE_SQL})), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '-')"
NOISE_SQL = " or ".join(f"regexp_matches(slug, '{x}')" for x in text.NOISE)


@query(rf"with s as (select doc_id, {SLUG_SQL} as slug from documents) select doc_id, slug, length(slug) < 4 or regexp_full_match(slug, '[\d.v-]+') or {NOISE_SQL} as noise from s")
def slug_and_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 8
    title = F.when(k == 0, "GPT 4o-mini").when(k == 1, "Ollama").when(k == 2, "Graph Refresh").when(k == 3, "honcho dialectic").when(k == 4, "Pulse").when(k == 5, F.concat(F.lit("v"), F.col("doc_id").cast("string"), F.lit(".2"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.slugify(title).alias("slug"), text.is_noise(title).alias("noise"))


@query(f"select doc_id, regexp_matches(text, '(?i)\\b(?:{text.CONFLICTS})\\b') as conflicting from documents")
def conflict_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.looks_conflicting(F.col("text")).alias("conflicting"))


REPLY_SQL = "case (conv_id + turn) % 5 when 0 then concat(text, '<pad>') when 1 then concat('<pad> I cannot assist with ', text) when 2 then 'User safety: unsafe<pad>' when 3 then concat('as an AI, ', text) else '<pad> <pad>' end"
REFUSAL_SQL = " or ".join(f"regexp_matches(r, '{x}')" for x in text.REFUSALS)


@query(rf"with r as (select conv_id, turn, trim(replace({REPLY_SQL}, '<pad>', '')) as r from conversations where role = 'assistant') select conv_id, turn, case when r = '' or {REFUSAL_SQL} then '[no response from LLM]' else r end as response from r")
def response_sanitizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers, refusals of each kind, and padding."""
    k = (F.col("conv_id") + F.col("turn")) % 5
    reply = F.when(k == 0, F.concat("text", F.lit("<pad>"))).when(k == 1, F.concat(F.lit("<pad> I cannot assist with "), "text")).when(k == 2, "User safety: unsafe<pad>").when(k == 3, F.concat(F.lit("as an AI, "), "text")).otherwise("<pad> <pad>")
    return table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", text.sanitize_response(reply).alias("response"))


@query("select doc_id, substr(sha256(text), 1, 16) as content_hash from documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query(
    "select doc_id, concat(case when source like 'src1%' then concat('Src', substr(source, 4)) else 'AI Tools' end, ' — Note ', doc_id) as label from documents"
)
def context_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    outside = F.col("source").startswith("src1")
    relative = F.when(outside, F.concat("source", F.lit("/x.md"))).otherwise(F.lit("projects/ai-tools/x.md"))
    context = paths.context_label(F.when(outside, F.lit("external")).otherwise(F.lit("vault")), F.lit("s"), relative, F.lit(None).cast("string"))
    return docs.select("doc_id", paths.display_label(F.concat(F.lit("Note "), F.col("doc_id").cast("string")), context).alias("label"))


@query("select case when lang is null then '_unsorted' else lang end as tag, count(*) as n from documents group by 1")
def tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.tag_histogram(notes(spark, sf_dir), F.get(text.tags_of(F.concat(F.lit("["), "lang", F.lit(", x]"))), F.lit(0)))


@query("select p_partkey as id, p_name as name, rank from (select p_partkey, p_name, case when lower(p_name) = 'red' then 0 when lower(p_name) like 'red%' then 1 when lower(p_name) like '%red%' then 2 end as rank from part) where rank is not null order by rank, length(p_name), p_partkey limit 1")
def node_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.node_search(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "name", "red").select("id", "name", "rank")
