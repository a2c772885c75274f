"""Links between notes: resolution, generated edges, degrees, audit, differences."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrama.functions import paths
from engrama.sources.shared import few, stash

#: Folders in which a bare name is looked for, in this order: fixed values.
NAMESPACES = ("wiki/", "concepts/", "entities/", "comparisons/", "queries/")
NESTED_NAMESPACES = ("wiki/concepts/", "wiki/entities/", "wiki/comparisons/", "wiki/queries/")
EDGE = "src string, dst string, display string, type string, weight double, explicit boolean, relation string, group_id string, generated boolean, traversable boolean"


def _base(path: str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def name_candidates(links: DataFrame) -> DataFrame:
    """target_raw, rank, by_base, key: what could be meant by each distinct target, whole ids first and last any note of its base name."""
    wanted = links.select("target_raw").distinct()
    ids = F.array(F.col("target_raw"), *[F.concat(F.lit(p), F.col("target_raw")) for p in NAMESPACES])
    whole = wanted.select("target_raw", F.posexplode(ids).alias("rank", "key")).select("target_raw", "rank", F.lit(False).alias("by_base"), "key")
    return whole.union(wanted.select("target_raw", F.lit(len(NAMESPACES) + 1), F.lit(True), _base("target_raw")))


def best_candidates(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """target_raw, dst of the targets that mean a note; of a base name the first note in id order."""
    keys = nodes.select("id", F.explode(F.array(F.struct(F.lit(False).alias("by_base"), F.col("id").alias("key")), F.struct(F.lit(True).alias("by_base"), _base("id").alias("key")))).alias("k")).select("id", "k.by_base", "k.key")
    return candidates.join(keys, ["by_base", "key"]).groupBy("target_raw").agg(F.min(F.struct("rank", "id"))["id"].alias("dst"))


def resolve_by_name(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """links (src, target_raw, ...) with ``dst``: the exact id, then a namespace's, then the first note of that base name in id order; else null."""
    return links.join(best_candidates(name_candidates(links), nodes), "target_raw", "left")


def touched_targets(candidates: DataFrame, changed: DataFrame) -> DataFrame:
    """The candidates of those targets that could mean a note that is new, gone or renamed (``changed``: id)."""
    keys = changed.select(F.lit(False).alias("by_base"), F.col("id").alias("key")).union(changed.select(F.lit(True), _base("id"))).distinct()
    targets = candidates.join(keys, ["by_base", "key"], "left_semi").select("target_raw").distinct()
    return candidates.join(targets, "target_raw", "left_semi").select(*candidates.columns)


def update_resolution(resolved: DataFrame, candidates: DataFrame, changed: DataFrame, nodes: DataFrame) -> DataFrame:
    """target_raw, dst after notes came and went, of which only the targets are resolved anew that could mean one of those.

    ``resolved`` holds what was meant before, ``candidates`` (kept with it) what
    could be; ``nodes`` are all notes there are now. Targets without an entry in
    ``resolved`` are new and resolved too.
    """
    fresh = name_only(candidates).join(resolved.select("target_raw"), "target_raw", "left_anti")
    todo = touched_targets(candidates, changed).unionByName(candidates.join(fresh, "target_raw", "left_semi").select(*candidates.columns)).distinct()
    again = best_candidates(todo, nodes)
    names = name_only(todo).join(again, "target_raw", "left")
    return resolved.select("target_raw", "dst").join(names.select("target_raw"), "target_raw", "left_anti").unionByName(names)


def name_only(candidates: DataFrame) -> DataFrame:
    return candidates.select("target_raw").distinct()


def resolve_in_source(links: DataFrame, documents: DataFrame) -> DataFrame:
    """links (source_type, source_id, src_path, target_raw, ...) with ``dst``, never across sources unless the target names one.

    Heading and block parts are cut off. Candidates: the path from the root and
    from every folder above the note, nearest last, and for the vault its
    namespaces; the first that exists wins.
    """
    own = documents.select("source_type", "source_id", F.regexp_replace("relative_path", r"(?i)\.md$", "").alias("path"), paths.canonical_id(F.col("source_type"), F.col("source_id"), F.col("relative_path")).alias("dst"))
    bare = F.regexp_replace(F.trim(F.regexp_replace("target_raw", r"[#^].*$", "")), r"(?i)\.md$", "")
    named = paths.explicit_target(F.col("target_raw"))
    folders = F.slice(F.split("src_path", "/"), F.lit(1), F.size(F.split("src_path", "/")) - 1)
    above = F.transform(F.sequence(F.lit(0), F.size(folders)), lambda n: F.concat(F.array_join(F.slice(folders, F.lit(1), n), "/"), F.when(n > 0, F.lit("/")).otherwise(F.lit("")), bare))
    spaces = F.when(F.col("source_type") == "vault", F.array(*[F.concat(F.lit(p), bare) for p in (*NAMESPACES, *NESTED_NAMESPACES)])).otherwise(F.array().cast("array<string>"))
    tried = F.when(named.isNotNull(), F.array(F.regexp_replace(F.regexp_replace(named["path"], r"[#^].*$", ""), r"(?i)\.md$", ""))).otherwise(F.concat(above, spaces))
    numbered = links.withColumn("__l", F.monotonically_increasing_id())
    cast = numbered.select("__l", F.coalesce(named["source_type"], F.col("source_type")).alias("source_type"), F.coalesce(named["source_id"], F.col("source_id")).alias("source_id"), F.posexplode(tried).alias("rank", "path"))
    best = cast.join(own, ["source_type", "source_id", "path"]).groupBy("__l").agg(F.min_by("dst", "rank").alias("dst"))
    return numbered.join(best, "__l", "left").drop("__l")


def unresolved(links: DataFrame) -> DataFrame:
    return links.filter(F.col("dst").isNull())


def wikilink_edges(links: DataFrame) -> DataFrame:
    """Resolved links other than to oneself; explicit are those whose target names its source."""
    explicit = paths.explicit_target(F.col("target_raw")).isNotNull()
    return links.filter(F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).select("src", "dst", "display", *_kind("wikilink", 1.0, explicit=explicit))


def without_dangling(links: DataFrame, nodes: DataFrame, ignored: bool) -> DataFrame:
    """Links that lead to a note, where some notes were ignored; else all of them."""
    return links.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select(*links.columns) if ignored else links


def _kind(name: str | Column, weight: float, explicit: bool | Column = False, generated: bool = False, relation: Column | None = None, group: Column | None = None) -> list[Column]:
    null = F.lit(None).cast("string")
    return [(F.lit(name) if isinstance(name, str) else name).alias("type"), F.lit(weight).alias("weight"), (F.lit(explicit) if isinstance(explicit, bool) else explicit).alias("explicit"), (null if relation is None else relation).alias("relation"), (null if group is None else group).alias("group_id"), F.lit(generated).alias("generated"), F.lit(True).alias("traversable")]


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse."""
    turned = edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns])
    return edges.unionByName(turned)


def new_edges(candidates: DataFrame, existing: DataFrame, by_type: bool = False) -> DataFrame:
    """Candidates, once each and not to oneself, between nodes that no edge (of that type) joins yet."""
    keys = ["src", "dst", "type"] if by_type else ["src", "dst"]
    return candidates.filter("src != dst").dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def provenance_edges(nodes: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between a note and the notes it was made from, both ways; and origins that are no notes."""
    named = nodes.select("id", F.explode("activated_from_ids").alias("origin"))
    known = nodes.select(F.col("id").alias("origin"))
    pairs = named.join(known, "origin").select(F.col("id").alias("src"), F.col("origin").alias("dst"), F.lit("").alias("display"), *_kind("neurogenesis_source", 0.35, generated=True, relation=F.lit("activated_from")))
    missing = named.join(known, "origin", "left_anti").select(F.lit("neurogenesis_source").alias("kind"), F.col("id").alias("source"), F.col("origin").alias("target"))
    return new_edges(both_ways(pairs), existing, by_type=True), missing


def star(members: DataFrame, anchors: DataFrame, keys: list[str], kind: str, weight: float) -> DataFrame:
    """Edges between each member (id) and the anchor (anchor) of its keys, both ways."""
    pairs = members.join(anchors, keys).filter("id != anchor").select(F.col("anchor").alias("src"), F.col("id").alias("dst"), F.lit("").alias("display"), *_kind(kind, weight, generated=True, group=F.col(keys[-1]).cast("string")))
    return both_ways(pairs)


def project_star(documents: DataFrame, existing: DataFrame, weight: float = 0.35) -> DataFrame:
    """Notes of an external project to its ``<group>/README.md``; only where no edge is yet."""
    own = documents.filter("source_type = 'external'").select("source_id", paths.project_group(F.col("source_type"), F.col("relative_path")).alias("group_id"), "relative_path", paths.canonical_id(F.col("source_type"), F.col("source_id"), F.col("relative_path")).alias("id")).filter("group_id is not null")
    anchors = own.filter(F.lower("relative_path") == F.lower(F.concat("group_id", F.lit("/README.md")))).select("source_id", "group_id", F.col("id").alias("anchor"))
    return new_edges(star(own, anchors, ["source_id", "group_id"], "project_context", weight), existing)


def counterpart_edges(counterparts: DataFrame, documents: DataFrame, existing: DataFrame) -> DataFrame:
    """Edges between a vault note and its counterpart, both ways, then from the project's other notes to the vault note.

    A counterpart whose notes are missing is an error.
    """
    ids = documents.select("source_type", "source_id", "relative_path", paths.canonical_id(F.col("source_type"), F.col("source_id"), F.col("relative_path")).alias("id"))
    inside = ids.filter("source_type = 'vault'").select(F.col("relative_path").alias("vault_path"), F.col("id").alias("vault_node"))
    outside = ids.filter("source_type = 'external'").select("source_id", F.col("relative_path").alias("external_path"), F.col("id").alias("external_node"))
    met = counterparts.join(inside, "vault_path", "left").join(outside, ["source_id", "external_path"], "left")
    checked = met.select("*", F.when(F.col("vault_node").isNull() | F.col("external_node").isNull(), F.raise_error(F.concat(F.lit("counterpart without a note: "), "vault_path", F.lit(" / "), "external_path"))).alias("__ok")).filter("__ok is null")
    kind = F.when(F.col("relation") == "same_project", "counterpart").otherwise("project_reference")
    direct = both_ways(checked.select(F.col("vault_node").alias("src"), F.col("external_node").alias("dst"), F.lit("").alias("display"), *_kind(kind, 1.0, generated=True, relation=F.col("relation"), group=F.col("group_id"))))
    direct = new_edges(direct, existing, by_type=True)
    group = F.split("external_path", "/")[0]
    own = outside.withColumn("__g", group)
    spread = own.drop("external_path").join(checked.select("source_id", "group_id", "relation", "vault_node", group.alias("__g")), ["source_id", "__g"])
    kind = F.when(F.col("relation") == "same_project", "project_context").otherwise("project_reference")
    near = spread.select(F.col("external_node").alias("src"), F.col("vault_node").alias("dst"), F.lit("").alias("display"), *_kind(kind, 0.55, generated=True, relation=F.col("relation"), group=F.col("group_id")))
    return direct.unionByName(new_edges(near, existing.select("src", "dst").union(direct.select("src", "dst"))))


def counterpart_groups(nodes: DataFrame, counterparts: DataFrame) -> DataFrame:
    """``nodes`` whose two ends of a ``same_project`` counterpart are in its group; of several groups the last by name."""
    same = counterparts.filter("relation = 'same_project'")
    inside = same.select(paths.canonical_id(F.lit("vault"), F.lit("vault"), F.col("vault_path")).alias("id"), "group_id")
    outside = same.select(paths.canonical_id(F.lit("external"), F.col("source_id"), F.col("external_path")).alias("id"), "group_id")
    named = inside.union(outside).groupBy("id").agg(F.max("group_id").alias("__g"))
    return nodes.join(named, "id", "left").withColumn("project_group", F.coalesce("__g", "project_group")).select(*nodes.columns)


def degree(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, degree: links out, resolved or not, plus resolved links in; sources that are no notes count too."""
    ends = links.select(F.col("src").alias("id")).unionByName(links.filter("dst is not null").select(F.col("dst").alias("id")))
    counted = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").union(counted.select("id")).distinct().join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def graph_stats(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """neurons, links, avg_out_degree_of_sources, max_out_degree."""
    out = links.groupBy("src").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("links"), F.count(F.lit(1)).alias("sources"), F.coalesce(F.max("n"), F.lit(0)).alias("max_out_degree"))
    return nodes.agg(F.count(F.lit(1)).alias("neurons")).join(F.broadcast(out)).select("neurons", "links", (F.col("links") / F.greatest("sources", F.lit(1))).alias("avg_out_degree_of_sources"), "max_out_degree")


def undirected_once(edges: DataFrame) -> DataFrame:
    """One edge per type and unordered pair."""
    return edges.dropDuplicates(["type", "__lo", "__hi"]) if "__lo" in edges.columns else edges.withColumn("__lo", F.least("src", "dst")).withColumn("__hi", F.greatest("src", "dst")).dropDuplicates(["type", "__lo", "__hi"]).drop("__lo", "__hi")


def client_degree(nodes: DataFrame, edges: DataFrame, synapses: DataFrame, phantoms: DataFrame, least: float = 0.15) -> DataFrame:
    """id, degree, glow of every note: ends of links of all three kinds between notes, and the weight of its strong synapses over the largest such sum (1 at least).

    A structural link counts once per type and direction; synapses (note_a, note_b, weight) and phantom links (source, target) once each.
    """
    here = nodes.select("id")
    known = few(here)
    structural = edges.select(F.coalesce("type", F.lit("wikilink")).alias("type"), "src", "dst").distinct().select("src", "dst", F.lit(0.0).alias("w"))
    learned = synapses.select(F.col("note_a").alias("src"), F.col("note_b").alias("dst"), F.when(F.col("weight") >= least, F.col("weight")).otherwise(F.lit(0.0)).alias("w"))
    every = structural.unionByName(learned).unionByName(phantoms.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.lit(0.0).alias("w")))
    inside = every.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    ends = inside.select(F.explode(F.array("src", "dst")).alias("id"), "w").groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("raw"))
    ends = stash(ends)
    most = ends.agg(F.greatest(F.coalesce(F.max("raw"), F.lit(0.0)), F.lit(1.0)).alias("most"))
    return here.join(ends, "id", "left").join(F.broadcast(most)).select("id", F.coalesce("degree", F.lit(0)).alias("degree"), (F.coalesce("raw", F.lit(0.0)) / F.col("most")).alias("glow"))


def orphans(nodes: DataFrame, *edge_sets: DataFrame) -> DataFrame:
    """Notes that no edge touches."""
    ends = reduce(DataFrame.union, [e.select("src").union(e.select("dst")) for e in edge_sets]).distinct().select(F.col("src").alias("id"))
    return nodes.join(ends, "id", "left_anti")


def audit(nodes: DataFrame, edges: DataFrame, synapses: DataFrame, now: Column, stale_hours: int = 48) -> DataFrame:
    """One row of counts: invalid endpoints, self loops, duplicates, weak, strong and stale synapses, malformed times."""
    ids = few(nodes.select("id").distinct())
    known = lambda df, end, flag: df.join(ids.select(F.col("id").alias(end), F.lit(True).alias(flag)), end, "left")
    invalid = F.col("__a").isNull().cast("long") + F.col("__b").isNull().cast("long")
    none = lambda c: F.coalesce(F.sum(c), F.lit(0))
    # all that is told of edges follows from the different ones and how often each is there
    different = edges.groupBy("src", "dst", "type").agg(F.count(F.lit(1)).alias("n"))
    e = known(known(different, "src", "__a"), "dst", "__b").agg(
        none("n").alias("edges"),
        none(F.when(F.col("src") == F.col("dst"), F.col("n"))).alias("self_loops"),
        none(F.col("n") - 1).alias("duplicates"),
        none(F.col("n") * invalid).alias("invalid_edge_ends"),
    )
    at = F.try_to_timestamp(F.col("last_coactivated").cast("string"))
    s = known(known(synapses, "note_a", "__a"), "note_b", "__b").agg(
        F.count(F.lit(1)).alias("synapses"),
        F.count_if(F.col("weight") < 0.15).alias("weak"),
        F.count_if(F.col("weight") > 0.7).alias("strong"),
        F.count_if(F.coalesce((F.col("weight") < 0.15) & (at <= now - F.make_dt_interval(hours=F.lit(stale_hours))), F.lit(False))).alias("stale"),
        F.count_if(F.col("last_coactivated").isNotNull() & at.isNull()).alias("malformed"),
        none(invalid).alias("invalid_synapse_ends"),
    )
    counts = nodes.agg(F.count(F.lit(1)).alias("nodes")).join(F.broadcast(e)).join(F.broadcast(s))  # one row each
    return counts.select("nodes", "edges", "self_loops", "duplicates", "synapses", "weak", "strong", "stale", "malformed", "invalid_edge_ends", "invalid_synapse_ends")


def snapshot_diff(old: DataFrame, new: DataFrame, compared: list[str]) -> DataFrame:
    """id, change: added, deleted or changed."""
    o, n = old.alias("o"), new.alias("n")
    same = reduce(lambda a, b: a & b, [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in compared])
    change = F.when(F.col("o.id").isNull(), "added").when(F.col("n.id").isNull(), "deleted").when(~same, "changed")
    return o.join(n, F.col("o.id") == F.col("n.id"), "full_outer").select(F.coalesce("n.id", "o.id").alias("id"), change.alias("change")).filter("change is not null")


def incremental_update(cached_nodes: DataFrame, cached_links: DataFrame, documents: DataFrame, nodes_of: Callable[[DataFrame], DataFrame], links_of: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Notes, raw links and changes (id, change) after a scan, of which only new and changed documents are parsed.

    ``documents`` and ``cached_nodes`` have ``id`` and ``mtime``; ``cached_links``
    ``src``, ``target_raw`` and more. Links of changed and deleted notes go, and
    of the others those to deleted ones; targets are resolved by the caller, so
    a note that is new also gets the links that waited for it.
    """
    changes = snapshot_diff(cached_nodes.select("id", "mtime"), documents.select("id", "mtime"), ["mtime"])
    fresh = documents.join(changes.filter("change != 'deleted'").select("id"), "id", "left_semi").select(*documents.columns)
    stale = changes.filter("change != 'added'").select("id")
    gone = changes.filter("change = 'deleted'").select(F.col("id").alias("target_raw"))
    nodes = cached_nodes.join(stale, "id", "left_anti").unionByName(nodes_of(fresh).select(*cached_nodes.columns))
    kept = cached_links.join(stale.withColumnRenamed("id", "src"), "src", "left_anti").join(gone, "target_raw", "left_anti").select(*cached_links.columns)
    return nodes, kept.unionByName(links_of(fresh).select(*cached_links.columns)), changes


def refresh_plan(stored: DataFrame, current: DataFrame, force: bool = False) -> DataFrame:
    """id, action: embed (new or changed hash, or all), delete, keep. Both sides: id, content_hash."""
    s, c = stored.alias("s"), current.alias("c")
    action = F.when(F.col("c.id").isNull(), "delete").when(F.lit(force) | ~F.col("s.content_hash").eqNullSafe(F.col("c.content_hash")), "embed").otherwise("keep")
    return s.join(c, F.col("s.id") == F.col("c.id"), "full_outer").select(F.coalesce("c.id", "s.id").alias("id"), action.alias("action"))


def migrate_ids(synapses: DataFrame, mapping: DataFrame) -> DataFrame:
    """Pairs under their new ids (old_id, new_id), ordered again; of those that collide the heaviest stays."""
    m = few(mapping.select("old_id", "new_id"))
    one = synapses.join(m.withColumnRenamed("new_id", "__a"), F.col("note_a") == F.col("old_id"), "left").drop("old_id")
    two = one.join(m.withColumnRenamed("new_id", "__b"), F.col("note_b") == F.col("old_id"), "left").drop("old_id")
    a, b = F.coalesce("__a", "note_a"), F.coalesce("__b", "note_b")
    rest = [c for c in synapses.columns if c not in ("note_a", "note_b")]
    moved = two.select(F.least(a, b).alias("note_a"), F.greatest(a, b).alias("note_b"), F.struct("weight", *[c for c in rest if c != "weight"]).alias("r"))
    return moved.filter("note_a != note_b").groupBy("note_a", "note_b").agg(F.max("r").alias("r")).select("note_a", "note_b", *[F.col(f"r.{c}").alias(c) for c in rest])


def migrate_quality(quality: DataFrame, mapping: DataFrame, order: str = "id") -> DataFrame:
    """Quality rows under their new ids (old_id, new_id); of those that collide the last by ``order`` stays."""
    moved = quality.join(mapping.select(F.col("old_id").alias("id"), "new_id"), "id", "left")
    rest = [c for c in quality.columns if c != "id"]
    last = moved.groupBy(F.coalesce("new_id", "id").alias("__new")).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return last.select(F.col("__new").alias("id"), *[F.col(f"r.{c}").alias(c) for c in rest]).select(*quality.columns)


def source_counts(nodes: DataFrame) -> DataFrame:
    """source_type, source_id, notes."""
    return nodes.groupBy("source_type", "source_id").agg(F.count(F.lit(1)).alias("notes"))


def link_counts(edges: DataFrame) -> DataFrame:
    """One row: resolved wikilinks and counterpart edges."""
    return edges.agg(F.count_if(F.col("type") == "wikilink").alias("wikilinks"), F.count_if(F.col("type") == "counterpart").alias("counterparts"))


def find_note(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """asked, id: the note of exactly the asked id, else the first in id order that differs in case only."""
    met = wanted.join(nodes.select("id"), F.lower("asked") == F.lower("id"))
    return met.groupBy("asked").agg(F.min_by("id", F.struct(F.col("id") != F.col("asked"), "id")).alias("id"))


#: Edges that are shown where only direct ones are: fixed values.
DIRECT = ("wikilink", "counterpart", "project_context", "project_reference")
#: Weight of learned edges from which an overview shows them: a fixed value.
OVERVIEW_WEIGHT = 0.42


def visible_edges(edges: DataFrame, hebbian_from: float = 0.0, direct_only: bool = False, phantoms: bool = True, hidden: tuple[str, ...] = (), overview: bool = False, nodes: DataFrame | None = None) -> DataFrame:
    """Edges (src, dst, type, weight) that the controls let through; with ``nodes``, only between those."""
    kind = F.coalesce("type", F.lit("wikilink"))
    if direct_only:
        shown = edges.filter(kind.isin(*DIRECT))
    else:
        least = max(hebbian_from, OVERVIEW_WEIGHT) if overview else hebbian_from
        shown = edges.filter(~kind.isin(*hidden) & ((kind != "hebbian") | (F.coalesce("weight", F.lit(0.0)) >= least)) & ((kind != "phantom") | F.lit(phantoms)))
    if nodes is None:
        return shown
    here = nodes.select(F.col("id").alias("src"))
    return shown.join(here, "src", "left_semi").join(here.withColumnRenamed("src", "dst"), "dst", "left_semi").select(*edges.columns)


def neighbourhood(edges: DataFrame, id: object) -> tuple[DataFrame, DataFrame]:
    """The notes (id) one visible edge around a note, itself among them, and those edges."""
    near = edges.filter((F.col("src") == F.lit(id)) | (F.col("dst") == F.lit(id)))
    ends = near.select(F.col("src").alias("id")).union(near.select("dst"))
    return ends.union(edges.sparkSession.range(1).select(F.lit(id).cast(edges.schema["src"].dataType))).distinct(), near


def path_edges(edges: DataFrame, path: list) -> DataFrame:
    """Edges between neighbours on a path of notes, either way."""
    steps = edges.sparkSession.createDataFrame(list(zip(path, path[1:], strict=False)) or [(None, None)], edges.select("src", "dst").schema)
    return edges.join(F.broadcast(steps.union(steps.select("dst", "src")).distinct()), ["src", "dst"], "left_semi").select(*edges.columns)


def retrieval_lens(seeds: DataFrame, edges: DataFrame, top: int = 12, most: int = 140) -> DataFrame:
    """Seeds (id, score), the best first, and one undirected hop around them: id, hop."""
    best = seeds.orderBy(F.desc("score"), "id").limit(top).select("id")
    near = edges.select(F.col("src").alias("id"), F.col("dst").alias("to")).union(edges.select("dst", "src")).join(best, "id").select(F.col("to").alias("id")).distinct()
    seen = best.withColumn("hop", F.lit(0)).union(near.join(best, "id", "left_anti").withColumn("hop", F.lit(1)))
    return seen.orderBy("hop", "id").limit(most)


def tag_histogram(nodes: DataFrame, first_tag: Column) -> DataFrame:
    return nodes.select(F.coalesce(first_tag, F.lit("_unsorted")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def node_search(nodes: DataFrame, label: str, wanted: str) -> DataFrame:
    """The best match by name: equal, then prefix, then containing; shorter names first."""
    name, w = F.lower(label), wanted.lower()
    rank = F.when(name == w, 0).when(name.startswith(w), 1).when(F.contains(name, F.lit(w)), 2)
    return nodes.withColumn("rank", rank).filter("rank is not null").orderBy("rank", F.length(label), "id").limit(1)
