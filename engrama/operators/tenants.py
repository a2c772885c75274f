"""Many vaults in one table: the tenant is part of every key, and of the folders that rows lie in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engrama.functions.text import tokens
from engrama.operators.lexical import Tokenizer, idf
from engrama.operators.memory import running_total
from engrama.operators.together import together
from engrama.settings import Settings
from engrama.sources.shared import exists, few, shared_folder, stash

VAULT = "vault_id"


def laid_out(rows: DataFrame, folder: str | None = None, name: str = "notes") -> DataFrame:
    """``rows`` (vault_id, ...) read back from a table with a folder per vault, so that a query touches its own tenants' files only."""
    spark = rows.sparkSession
    path = f"{folder or shared_folder(spark)}/{name}"
    rows.repartition(VAULT, F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy(VAULT).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def top_by_vault(notes: DataFrame, queries: DataFrame, text: Column, query_text: Column, k: int, settings: Settings = Settings(), cut: Tokenizer = tokens) -> DataFrame:
    """vault_id, query_id, id, bm25, rank: the k best notes of the query's own vault for each query (vault_id, query_id), ties by id.

    All vaults at once, each with its own statistics: what one tenant stores changes no other's scores. Only the
    folders of vaults that are asked are read.
    """
    asked = queries.select(VAULT, "query_id", F.explode(cut(query_text)).alias("term")).groupBy(VAULT, "query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    own = notes.join(F.broadcast(queries.select(VAULT).distinct()), VAULT, "left_semi")
    words = own.select(VAULT, "id", cut(text).alias("w")).withColumn("dl", F.size("w"))
    stats = words.groupBy(VAULT).agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avg_dl"))
    wanted = asked.select(VAULT, "term").distinct()
    tf = words.select(VAULT, "id", "dl", F.explode("w").alias("term")).join(wanted, [VAULT, "term"]).groupBy(VAULT, "id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy(VAULT, "term").agg(F.count(F.lit(1)).alias("df"))
    weights = asked.join(df, [VAULT, "term"]).join(stats, VAULT).select(VAULT, "query_id", "term", (F.col("times") * idf(F.col("df"), F.col("n"))).alias("w"), "avg_dl")
    k1, b = settings.k1, settings.b
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    scores = tf.join(weights, [VAULT, "term"]).groupBy(VAULT, "query_id", "id").agg(F.sum(part).alias("bm25"))
    order = W.partitionBy(VAULT, "query_id").orderBy(F.desc(F.round("bm25", 9)), "id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def laid_out_once(rows: DataFrame, folder: str, name: str) -> DataFrame:
    """The table of that name, laid out when it isn't there yet."""
    spark, path = rows.sparkSession, f"{folder}/{name}"
    if exists(spark, f"{path}/_SUCCESS"):
        return spark.read.schema(rows.schema).parquet(path)
    return laid_out(rows, folder, name)


#: Bits of a key that are its seconds, some 35,000 years; those above are the vault.
APART = 40


def learned_by_vault(notes: DataFrame, active: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vault_id, synapses: how many pairs of notes of one vault learn from being ``active`` (h, id, score) in the same hour.

    Hours are keys of a vault each, so that only its own notes meet; what leaves a task are counts, and no pair
    is sent anywhere. A vault's keys lie together: blocks of different vaults don't meet either.
    """
    known = notes.select(VAULT).na.drop().distinct().withColumn("one", F.lit(1).cast("long"))
    vaults = stash(running_total(known, VAULT, "one", "__v").select(VAULT, "__v"))
    own = notes.select("id", VAULT).join(few(vaults), VAULT).select("id", "__v")
    keyed = active.filter(F.col("score") >= settings.pair_min_score).join(own, "id").select("id", "score", (F.shiftleft("__v", APART) + F.unix_seconds("h")).alias("k"))
    met = together(keyed, ["k"], settings.pair_min_score)
    counted = met.groupBy(F.shiftright("first", APART).alias("__v")).agg(F.count(F.lit(1)).alias("synapses"))
    return counted.join(few(vaults), "__v").select(VAULT, "synapses")


def rollup(notes: DataFrame, embedded: DataFrame, learned: DataFrame, queries: DataFrame) -> DataFrame:
    """vault_id, neurons, chars, embeddings, synapses, queries of each vault that has notes.

    ``notes`` have n_chars; ``embedded`` are ids with a vector; ``learned`` are vaults with their synapses; ``queries`` have a row per query.
    """
    vectors = notes.join(embedded, "id", "left_semi").groupBy(VAULT).agg(F.count(F.lit(1)).alias("embeddings"))
    counted = notes.groupBy(VAULT).agg(F.count(F.lit(1)).alias("neurons"), F.sum("n_chars").alias("chars"))
    for part in (vectors, learned, queries.groupBy(VAULT).agg(F.count(F.lit(1)).alias("queries"))):
        counted = counted.join(part, VAULT, "left")
    return counted.select(VAULT, "neurons", "chars", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("embeddings", "synapses", "queries")])
