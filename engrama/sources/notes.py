"""Note files as rows, and what configures them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.functions import paths, text

#: Folders of external sources that hold derived files: fixed values.
DERIVED = (
    "**/.git/**", "**/.hg/**", "**/.svn/**", "**/node_modules/**", "**/.venv/**", "**/venv/**", "**/__pycache__/**", "**/build/**", "**/dist/**",
    "**/target/**", "**/graphify-out/**", "**/test-results/**", "**/coverage/**", "**/playwright-report/**", "**/htmlcov/**", "**/.next/**", "**/.cache/**",
)
RELATIONS = ("same_project", "references_project")
_ID = re.compile(r"[A-Za-z0-9_-]+")


@dataclass(frozen=True)
class Source:
    """A folder of Markdown files: the vault, or an external one, read-only by default."""

    source_id: str
    root: str
    external: bool = False
    include: tuple[str, ...] = ("**/*.md",)
    exclude: tuple[str, ...] = ()
    writable: bool = True

    @classmethod
    def vault(cls, root: str, **options) -> Source:
        return cls("vault", root, **options)

    @classmethod
    def outside(cls, source_id: str, root: str, **options) -> Source:
        extra = tuple(options.pop("exclude", ()))
        return cls(source_id, root, external=True, exclude=DERIVED + extra, writable=options.pop("writable", False), **options)


def sources_from_config(config: dict) -> list[Source]:
    """External sources of a configuration; ids must be well formed and distinct, paths given."""
    out, seen = [], set()
    for entry in config.get("sources", []):
        name, path = entry.get("id"), entry.get("path")
        if not name or not _ID.fullmatch(str(name)):
            raise ValueError(f"bad source id: {name!r}")
        if name in seen or name == "vault":
            raise ValueError(f"source id used twice: {name}")
        if not path:
            raise ValueError(f"source without a path: {name}")
        seen.add(name)
        options = {k: tuple(entry[k]) for k in ("include", "exclude") if k in entry}
        out.append(Source.outside(name, path, writable=bool(entry.get("writable", False)), **options))
    return out


def counterparts_from_config(spark: SparkSession, config: dict) -> DataFrame:
    """Rows (source_id, group_id, vault_path, external_path, relation)."""
    rows = []
    for source in config.get("sources", []):
        for c in source.get("counterparts", [source["counterpart"]] if "counterpart" in source else []):
            relation = c.get("relation", "same_project")
            if relation not in RELATIONS:
                raise ValueError(f"unknown relation: {relation}")
            missing = [k for k in ("group", "vault", "external") if not c.get(k)]
            if missing:
                raise ValueError(f"counterpart of {source.get('id')} lacks {missing}")
            rows.append((source["id"], c["group"], c["vault"], c["external"], relation))
    return spark.createDataFrame(rows, "source_id string, group_id string, vault_path string, external_path string, relation string")


def scan(spark: SparkSession, source: Source) -> DataFrame:
    """Files of a source: source_id, source_type, relative_path, absolute_path, content, writable, mtime.

    Hidden files and folders are skipped, and only Markdown files are listed. A
    missing root is an error of the reader.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][dD]").load(source.root)
    at = re.sub(r"^[a-z]+:/*(?=/)", "", source.root).rstrip("/")
    relative = F.regexp_replace(F.regexp_replace(F.col("path"), r"^[a-z]+:/*(?=/)", ""), "^" + re.escape(at) + "/", "")
    rows = files.select(relative.alias("relative_path"), F.col("path").alias("absolute_path"), "content", F.col("modificationTime").cast("double").alias("mtime"))
    wanted = rows.filter(F.col("relative_path").rlike(r"(?i)\.md$") & ~F.col("relative_path").rlike(r"(^|/)\."))
    wanted = wanted.filter(paths.matches_any(F.col("relative_path"), source.include) & ~paths.matches_any(F.col("relative_path"), source.exclude))
    return wanted.select(
        F.lit(source.source_id).alias("source_id"),
        F.lit("external" if source.external else "vault").alias("source_type"),
        "relative_path",
        "absolute_path",
        F.decode("content", "UTF-8").alias("content"),
        F.lit(source.writable).alias("writable"),
        "mtime",
    )


def scan_all(spark: SparkSession, sources: list[Source]) -> DataFrame:
    first, *others = [scan(spark, s) for s in sources]
    for other in others:
        first = first.unionByName(other)
    return first


def nodes(documents: DataFrame) -> DataFrame:
    """Notes of scanned documents: id, title, tags, text, path, mtime, activated_from_ids and display columns."""
    front = text.frontmatter(F.col("content"))
    d = documents.withColumn("fm", front)
    group = F.coalesce(F.col("fm")["project_group"], paths.project_group(F.col("source_type"), F.col("relative_path")))
    title = F.coalesce(F.when(F.col("fm")["title"] != "", F.col("fm")["title"]), paths.basename(F.col("relative_path")))
    context = paths.context_label(F.col("source_type"), F.col("source_id"), F.col("relative_path"), group, F.col("fm")["project"], F.col("fm")["project_name"])
    return d.select(
        paths.canonical_id(F.col("source_type"), F.col("source_id"), F.col("relative_path")).alias("id"),
        title.alias("title"),
        F.coalesce(F.col("fm")["tags"], F.lit("")).alias("tags"),
        text.plain_text(F.col("content")).alias("text"),
        F.col("relative_path").alias("path"),
        "mtime",
        text.json_list(F.col("fm")["activated_from_ids"]).alias("activated_from_ids"),
        "source_id",
        "source_type",
        "writable",
        group.alias("project_group"),
        context.alias("context_label"),
        paths.display_label(title, context).alias("display_label"),
    )


def links(documents: DataFrame) -> DataFrame:
    """Raw links: src, source_type, source_id, src_path, target_raw, display, edge_ord."""
    found = documents.select(paths.canonical_id(F.col("source_type"), F.col("source_id"), F.col("relative_path")).alias("src"), "source_type", "source_id", F.col("relative_path").alias("src_path"), F.posexplode(text.wikilinks(F.col("content"))).alias("edge_ord", "l"))
    return found.select("src", "source_type", "source_id", "src_path", F.col("l.target").alias("target_raw"), F.col("l.display").alias("display"), "edge_ord")


def rendered_note(title: Column, definition: Column, tags: Column, ids: Column, date: Column) -> Column:
    """A new note's file content."""
    return F.concat(
        F.lit("---\ntitle: "), text.yaml_escape(title), F.lit("\ntags: "), tags, F.lit("\ncreated: "), date, F.lit("\nactivated_from_ids: "), text.id_list(ids),
        F.lit("\n---\n\n# "), text.sanitize_note(title), F.lit("\n\n"), text.sanitize_note(definition, 2000), F.lit("\n"),
    )


@dataclass(frozen=True)
class Tenant:
    """A vault of a multi-tenant deployment; every table it owns carries ``vault_id``."""

    vault_id: str
    name: str
    path: str
    settings: dict = field(default_factory=dict)


def tenants_from_config(config: dict) -> list[Tenant]:
    """One ``default`` tenant, or those listed; ids distinct and well formed; unset overrides are inherited."""
    shared = {k: config[k] for k in ("ignore", "hybrid", "language", "llm") if k in config}
    listed = config.get("vaults") or [{"id": "default", "path": config.get("path", "")}]
    out = []
    for v in listed:
        if not _ID.fullmatch(str(v.get("id", ""))) or not v.get("path"):
            raise ValueError(f"bad vault: {v}")
        out.append(Tenant(v["id"], v.get("name", v["id"]), v["path"], {**shared, **{k: v[k] for k in shared if k in v}}))
    if len({t.vault_id for t in out}) < len(out):
        raise ValueError("vault id used twice")
    return out


def of_tenant(rows: DataFrame, vault_id: str, known: list[str]) -> DataFrame:
    if vault_id not in known:
        raise ValueError(f"unknown vault {vault_id!r}; known: {', '.join(sorted(known))}")
    return rows.filter(F.col("vault_id") == vault_id)
