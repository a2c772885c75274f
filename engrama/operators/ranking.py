"""Retrieval quality: precision, recall, F1, reciprocal rank, nDCG."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10)


def query_metrics(ranked: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """query_id, precision, recall, f1, mrr, ndcg, first_hit of ranked (query_id, id, rank from 1) against expected (query_id, id).

    Without anything expected, recall is 1. ``first_hit`` counts from 0, -1 for none.
    """
    asked = ranked.select("query_id").union(expected.select("query_id")).distinct()
    wanted = expected.groupBy("query_id").agg(F.count_distinct("id").alias("n"))
    hits = ranked.join(expected.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi")
    inside = F.col("rank") <= k
    found = hits.groupBy("query_id").agg(F.count_if(inside).alias("h"), F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.min("rank").alias("first"))
    rows = asked.join(wanted, "query_id", "left").join(found, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("h", F.lit(0)).alias("h"), F.coalesce("dcg", F.lit(0.0)).alias("dcg"), "first")
    p = F.col("h") / k
    r = F.when(F.col("n") == 0, 1.0).otherwise(F.col("h") / F.col("n"))
    ideal = reduce(lambda a, b: a + b, [F.when(F.col("n") >= i, 1 / F.log2(F.lit(i + 1.0))).otherwise(0.0) for i in range(1, k + 1)])
    return rows.select(
        "query_id",
        p.alias("precision"),
        r.alias("recall"),
        F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(ideal > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"),
        F.coalesce(F.col("first") - 1, F.lit(-1)).cast("long").alias("first_hit"),
    )


def summary(metrics: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """metric, n, mean, std (population), min, max, rounded to four digits; per group where asked."""
    rows = metrics.select(*(by or []), F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("m")).select(*(by or []), "m.metric", "m.v")
    r = lambda c: F.round(c, 4)
    return rows.groupBy(*(by or []), "metric").agg(F.count("v").alias("n"), r(F.avg("v")).alias("mean"), r(F.stddev_pop("v")).alias("std"), r(F.min("v")).alias("min"), r(F.max("v")).alias("max"))


def misses(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, misses: queries, and those that found nothing expected; per group where asked."""
    return metrics.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("first_hit") < 0).alias("misses"))


def sparsity(ranked: DataFrame, total: Column) -> DataFrame:
    """query_id, sparsity: the share of notes that stayed inactive."""
    return ranked.groupBy("query_id").agg((1 - F.count(F.lit(1)) / F.first(total)).alias("sparsity"))
