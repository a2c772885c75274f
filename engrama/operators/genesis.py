"""New notes from concepts: filters, duplicates, merge or create."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engrama.functions import text
from engrama.settings import Settings


def exact_duplicates(concepts: DataFrame, nodes: DataFrame) -> DataFrame:
    """concept_id, match: the first note of the same title, case and outer space aside."""
    key = lambda c: F.lower(F.trim(c))
    named = nodes.groupBy(key("title").alias("k")).agg(F.min("id").alias("match"))
    return concepts.select("concept_id", key("title").alias("k")).join(named, "k").select("concept_id", "match")


def usable(concepts: DataFrame, nodes: DataFrame, near: DataFrame, most: int = 5) -> DataFrame:
    """Concepts with title and definition, not noise, not a note's title, not near one (concept_id, similarity); the first of each group (query_id)."""
    shaped = concepts.filter((F.trim(F.coalesce("title", F.lit(""))) != "") & (F.trim(F.coalesce("definition", F.lit(""))) != "")).filter(~text.is_noise(F.col("title")))
    fresh = shaped.join(exact_duplicates(shaped, nodes), "concept_id", "left_anti").join(near.select("concept_id"), "concept_id", "left_anti")
    return fresh.withColumn("__r", F.row_number().over(W.partitionBy("query_id").orderBy("concept_id"))).filter(F.col("__r") <= most).drop("__r")


def decisions(concepts: DataFrame, nodes: DataFrame, near: DataFrame, most: int, settings: Settings = Settings()) -> DataFrame:
    """concept_id, action, target for the first concepts of each query.

    A note of the same title, else the nearest one that is similar enough, is
    merged into, unless the definition contradicts; text that it already has
    is ``already_present``; without such a note a new one is created, unless its
    file exists.
    """
    first = concepts.withColumn("__r", F.row_number().over(W.partitionBy("query_id").orderBy("concept_id"))).filter(F.col("__r") <= most)
    exact = exact_duplicates(first, nodes).withColumnRenamed("match", "__exact")
    close = near.filter(F.col("similarity") >= settings.merge_from).select("concept_id", F.col("match").alias("__near"))
    met = first.join(exact, "concept_id", "left").join(close, "concept_id", "left").withColumn("target", F.coalesce("__exact", "__near"))
    held = met.join(nodes.select(F.col("id").alias("target"), F.col("text").alias("__text")), "target", "left")
    slugs = nodes.select(text.slugify(F.col("title")).alias("__slug"), F.lit(True).alias("__exists")).distinct()
    known = held.withColumn("__slug", text.slugify(F.col("title"))).join(slugs, "__slug", "left")
    action = (
        F.when(F.col("target").isNotNull() & text.looks_conflicting(F.col("definition")), "skip")
        .when(F.col("target").isNotNull() & text.has_evidence(F.coalesce("__text", F.lit("")), F.col("definition")), "already_present")
        .when(F.col("target").isNotNull(), "merge")
        .when(F.coalesce("__exists", F.lit(False)), "skip")
        .otherwise("create")
    )
    return known.select("query_id", "concept_id", action.alias("action"), "target")


def source_ids(routing: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """query_id, ids: the seeds whose score lets them count as a concept's origin, best first."""
    return routing.filter(F.coalesce("score", F.lit(1.0)) >= settings.source_min_score).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.coalesce("score", F.lit(1.0))).alias("s"), "id"))), lambda x: x["id"]).alias("ids"))


def stamped(content: Column, field: str, value: Column) -> Column:
    """The note with a frontmatter field set: its first line of that name, else a new last line of the frontmatter; without one, as it is."""
    first = rf"(?s)\A((?:.*?\n)??){field}:\s*[^\n]*"
    end = F.locate("\n---", content, 5)
    inserted = F.concat(F.substring(content, F.lit(1), end - 1), F.lit(f"\n{field}: "), value, F.substring(content, end, F.length(content)))
    return (
        F.when(content.rlike(first), F.regexp_replace(content, F.lit(first), F.concat(F.lit(f"$1{field}: "), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")))))
        .when(content.startswith("---\n") & (end > 0), inserted)
        .otherwise(content)
    )


def merged_content(content: Column, evidence: Column, date: Column, known: Column, more: Column, sources: Column | None = None, query: Column | None = None) -> tuple[Column, Column]:
    """A note's content with the evidence appended, its date stamped and its origins united, unless the evidence is there or blank; and those origins.

    ``sources`` are the notes it came from, of which three are named; without
    any it came from a recovered session.
    """
    origins = F.array_union(known, more)
    named = F.array_join(F.slice(sources, 1, 3), ", ") if sources is not None else F.lit("")
    asked = F.substring(F.trim(F.regexp_replace(F.coalesce(query, F.lit("")), r"\s+", " ")), 1, 240) if query is not None else F.lit("")
    # the form of a section is a fixed value
    section = F.concat(
        F.lit("\n\n## Assimilated Evidence\n- **"), date, F.lit("** — "), F.regexp_replace(evidence, r"^\s+|\s+$", ""),
        F.lit("\n  - source: "), F.when(named == "", F.lit("session recovery")).otherwise(named), F.lit("\n  - query: "), asked, F.lit("\n\n"),
    )
    merged = F.concat(F.regexp_replace(content, r"\s+\z", ""), section)
    merged = F.when(F.size(more) > 0, stamped(merged, "activated_from_ids", F.to_json(origins))).otherwise(merged)
    return F.when(text.has_evidence(content, evidence), content).otherwise(stamped(merged, "updated", date)), origins
