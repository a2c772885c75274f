"""Rows as a client gets them: the graph as a whole, notes that are new, notes that are active."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands for a column that a table of notes doesn't have: fixed values.
NODE_DEFAULTS = {"context_label": None, "tags": "", "path": "", "relative_path": "", "source_id": "vault", "source_type": "vault", "project_group": None, "writable": True, "text": ""}
EDGE_DEFAULTS = {"display": "", "type": "wikilink", "weight": 1.0, "explicit": True, "relation": None, "group_id": None, "generated": False}


def _or(df: DataFrame, name: str, default: object) -> Column:
    kind = {bool: "boolean", float: "double"}.get(type(default), "string")
    fallback = F.lit(default).cast(kind)
    return (F.coalesce(F.col(name), fallback) if name in df.columns else fallback).alias(name)


def node_payload(nodes: DataFrame, quality: DataFrame | None = None, most: int = 200) -> DataFrame:
    """Notes with defaults for what is missing, their text cut, and whether they are dormant."""
    own = nodes.select(
        "id",
        "title",
        (F.coalesce("display_label", "title") if "display_label" in nodes.columns else F.col("title")).alias("display_label"),
        *[_or(nodes, c, d) for c, d in NODE_DEFAULTS.items()],
        (F.coalesce("absolute_path", "path") if "absolute_path" in nodes.columns else _or(nodes, "path", "")).alias("absolute_path"),
    ).withColumn("text", F.substring("text", 1, most))
    if quality is None:
        return own.withColumn("dormant", F.lit(False)).withColumn("quality_score", F.lit(0.0))
    rated = quality.select("id", F.col("dormant").alias("__d"), F.col("score").alias("__s"))
    return own.join(rated, "id", "left").withColumn("dormant", F.coalesce("__d", F.lit(False))).withColumn("quality_score", F.coalesce("__s", F.lit(0.0))).drop("__d", "__s")


def edge_payload(edges: DataFrame) -> DataFrame:
    """Resolved edges with defaults; what an edge without a display shows is its relation."""
    shown = F.coalesce(*[F.col(c) for c in ("display", "relation") if c in edges.columns], F.lit("")).alias("display")
    return edges.filter("dst is not null").select(F.col("src").alias("source"), F.col("dst").alias("target"), shown, *[_or(edges, c, d) for c, d in EDGE_DEFAULTS.items() if c != "display"])


def snapshot(nodes: DataFrame, edges: DataFrame, synapses: DataFrame, phantoms: DataFrame, quality: DataFrame, counted: DataFrame | None = None) -> dict[str, DataFrame]:
    """The graph as a client draws it: notes, edges, learned and phantom links, and one row of counts.

    ``counted``: one row of those counts that are known already.
    """
    size = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    sizes = {"neurons": nodes, "synapses": edges, "hebbian_synapses": synapses, "dormant_neurons": quality.filter("dormant"), "phantom_links": phantoms}
    known = [] if counted is None else [n for n in counted.columns if n in sizes]
    rows = [size(df, n) for n, df in sizes.items() if n not in known] + ([counted.select(*known)] if known else [])
    stats = rows[0]
    for row in rows[1:]:
        stats = stats.join(F.broadcast(row))  # one row each
    stats = stats.select(*sizes)
    learned = synapses.select("note_a", "note_b", "weight", F.coalesce("frequency", F.lit(0.0)).alias("frequency"), "last_coactivated", F.lit("hebbian").alias("type"))
    return {"nodes": node_payload(nodes, quality), "edges": edge_payload(edges), "hebbian": learned, "phantom": phantoms, "stats": stats}


def added_notes(old: DataFrame, new: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """Notes that are new, with their edges in order, and the titles of the first ``most`` targets that had been there.

    ``edges`` need src, dst, edge_ord; a note without any has empty lists.
    """
    fresh = new.join(old.select("id"), "id", "left_anti")
    out = edges.join(fresh.select(F.col("id").alias("src")), "src", "left_semi").join(old.select(F.col("id").alias("dst"), F.coalesce("title", F.col("id").cast("string")).alias("__t")), "dst", "left")
    fields = [F.col("dst").alias("target"), *[_or(edges, c, EDGE_DEFAULTS[c]) for c in ("type", "weight", "relation", "group_id")]]
    listed = out.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("edge_ord", F.struct(*fields).alias("e"), F.col("__t").alias("t")))).alias("l"))
    rows = fresh.join(listed, "id", "left")
    l = F.coalesce("l", F.expr("cast(array() as " + listed.schema["l"].dataType.simpleString() + ")"))
    met = F.filter(F.transform(l, lambda x: x["t"]), lambda t: t.isNotNull())
    return rows.select("id", "title", F.slice(met, 1, most).alias("source_notes"), F.transform(l, lambda x: x["e"]).alias("edges"))


def active_notes(active: DataFrame, nodes: DataFrame) -> DataFrame:
    """Active notes (query_id, id, score, ...) with what their notes say; a note that is gone bears its id as title."""
    known = [c for c in ("display_label", "path", "relative_path", "source_type", "source_id") if c in nodes.columns]
    own = nodes.select("id", F.col("title").alias("__title"), *known)
    return active.join(own, "id", "left").withColumn("title", F.coalesce("__title", F.col("id").cast("string"))).withColumn("score", F.round("score", 4)).drop("__title")
