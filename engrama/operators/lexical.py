"""BM25 over notes: postings, statistics, scores."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrama.functions.text import tokens
from engrama.settings import Settings
from engrama.sources.shared import stash

Tokenizer = Callable[[Column], Column]


def postings(notes: DataFrame, text: Column, cut: Tokenizer = tokens) -> DataFrame:
    """id, term, tf."""
    return notes.select("id", F.explode(cut(text)).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(notes: DataFrame, text: Column, cut: Tokenizer = tokens) -> DataFrame:
    """id, dl: every note, also those without a term."""
    return notes.select("id", F.size(cut(text)).cast("long").alias("dl"))


def idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_stats(notes: DataFrame, text: Column, cut: Tokenizer = tokens) -> DataFrame:
    """term, df, idf; the number of notes counts all of them."""
    one = notes.select("id", F.explode(F.array_distinct(cut(text))).alias("term"))
    n = notes.agg(F.count(F.lit(1)).alias("n"))
    return one.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n)).select("term", "df", idf(F.col("df"), F.col("n")).alias("idf"))


def query_terms(queries: DataFrame, text: Column, cut: Tokenizer = tokens) -> DataFrame:
    """query_id, term, times."""
    return queries.select("query_id", F.explode(cut(text)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).cast("long").alias("times"))


#: The notes' own rows are dealt over this many keys.
SALTS = 64


def bm25(notes: DataFrame, queries: DataFrame, text: Column, query_text: Column, settings: Settings = Settings(), cut: Tokenizer = tokens, stems: DataFrame | None = None) -> DataFrame:
    """query_id, id, bm25, matched (sorted distinct terms) of notes that have a term of the query.

    One pass over the notes: each gives a row for itself with its length, and
    one per word that some query asks for. Only those leave the scan; they are
    written once, and statistics and scores read them. Repeated query words
    count each time. With ``stems`` (term, stem) words count as their stems.
    """
    own = "\0"  # no word: begins the keys that stand for notes
    wanted = query_terms(queries, query_text, cut)
    if stems is None:
        terms = wanted.select("term", F.col("term").alias("stem")).distinct()
    else:
        wanted = wanted.join(stems, "term").groupBy("query_id", F.col("stem").alias("term")).agg(F.sum("times").alias("times"))
        terms = stems.join(wanted.select(F.col("term").alias("stem")).distinct(), "stem", "left_semi").select("term", "stem")
    itself = notes.sparkSession.range(SALTS).select(F.concat(F.lit(own), F.col("id").cast("string")).alias("term"))
    terms = terms.union(itself.select("term", "term"))
    cutted = notes.select("id", cut(text).alias("w"))
    salted = F.concat(F.lit(own), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("string"))
    each = cutted.select("id", F.size("w").alias("dl"), F.explode(F.concat(F.array(salted), "w")).alias("term"))
    held = stash(each.join(terms, "term").groupBy("id", F.col("stem").alias("term")).agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl")))
    stats = held.filter(F.col("term").startswith(own)).agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avg_dl"))
    tf = held.filter(~F.col("term").startswith(own))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = wanted.join(df, "term").join(F.broadcast(stats))
    weighted = weighted.select("query_id", "term", (F.col("times") * idf(F.col("df"), F.col("n"))).alias("w"), "avg_dl")
    k1, b = settings.k1, settings.b
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    return tf.join(weighted, "term").groupBy("query_id", "id").agg(F.sum(part).alias("bm25"), F.sort_array(F.collect_set("term")).alias("matched"))


def vocabulary(*texts: DataFrame, cut: Tokenizer = tokens) -> DataFrame:
    """term: the distinct words of tables with ``text``."""
    parts = [t.select(F.explode(cut(F.col("text"))).alias("term")).distinct() for t in texts]
    return reduce(DataFrame.union, parts).distinct()


def normalized(scores: DataFrame) -> DataFrame:
    """bm25_norm: over the largest score of the query; zero scores are left out."""
    top = scores.groupBy("query_id").agg(F.max("bm25").alias("__top"))
    return scores.filter("bm25 > 0").join(top, "query_id").withColumn("bm25_norm", F.col("bm25") / F.col("__top")).drop("__top")


def normalized_alone(raw: Column, top: Column | None = None) -> Column:
    """One score in 0..1: over a known maximum, or on a log scale."""
    if top is not None:
        return F.least(raw / top, F.lit(1.0))
    return F.least(F.log1p(raw) / F.log1p(F.lit(10.0)), F.lit(1.0))
