"""Paths, ids, globs and labels of notes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations that stay upper case in labels: fixed values.
ACRONYMS = ("ai", "api", "cd", "ci", "cpu", "gpu", "glm", "http", "https", "llm", "mcp", "mlx", "pr", "tui", "ui")


def _segment(glob: str) -> str:
    """One path segment of a glob as a regular expression."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2 + glob.startswith("!", i + 1)) if c == "[" else -1
        if end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = end
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return out


def glob_regex(glob: str) -> str:
    """Full-match regular expression of a glob in which ``**`` is zero or more segments."""
    parts, out = glob.strip("/").split("/"), ""
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".*" if last and i == 0 else "(?:/.*)?" if last else "(?:[^/]+/)*"
        else:
            out += _segment(part) + ("" if last or (parts[i + 1] == "**" and i + 1 == len(parts) - 1) else "/")
    return f"^{out}$"


def anchored_right(glob: str) -> str:
    """The same for a relative pattern that may begin at any segment; ``**`` is one segment there."""
    return "^(?:.*/)?" + "/".join("[^/]*" if p == "**" else _segment(p) for p in glob.strip("/").split("/")) + "$"


def matches_any(path: Column, globs: list[str] | tuple[str, ...]) -> Column:
    clean = F.btrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))
    tests = [clean.rlike(glob_regex(g)) | clean.rlike(anchored_right(g)) for g in globs]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def matches_name(note_id: Column, globs: list[str] | tuple[str, ...]) -> Column:
    """Shell-style match of whole ids, in which ``*`` crosses segments."""
    tests = [note_id.rlike("^" + _segment(g).replace("[^/]", ".") + "$") for g in globs]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def is_ignored(source_type: Column, source_id: Column, relative: Column, globs: list[str] | tuple[str, ...]) -> Column:
    """Whether any glob matches the id, the id without its prefix, or either without the suffix."""
    full = canonical_id(source_type, source_id, relative)
    spellings = [full, F.regexp_replace(full, r"\.md$", ""), relative, F.regexp_replace(relative, r"\.md$", "")]
    return reduce(lambda a, b: a | b, [matches_name(s, globs) for s in spellings], F.lit(False))


def canonical_id(source_type: Column, source_id: Column, relative: Column) -> Column:
    suffixed = F.when(relative.rlike(r"(?i)\.md$"), relative).otherwise(F.concat(relative, F.lit(".md")))
    return F.when(source_type == "vault", F.concat(F.lit("vault:"), suffixed)).otherwise(F.concat(F.lit("external:"), source_id, F.lit("/"), suffixed))


def explicit_target(raw: Column) -> Column:
    """(source_type, source_id, path) of a target that names its source, else null."""
    vault, external = r"^vault:(.+)$", r"^external:([^/]+)/(.+)$"
    return F.when(raw.rlike(vault), F.struct(F.lit("vault").alias("source_type"), F.lit("vault").alias("source_id"), F.regexp_extract(raw, vault, 1).alias("path"))).when(
        raw.rlike(external), F.struct(F.lit("external").alias("source_type"), F.regexp_extract(raw, external, 1).alias("source_id"), F.regexp_extract(raw, external, 2).alias("path"))
    )


def basename(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.md$", "")


def project_group(source_type: Column, relative: Column) -> Column:
    """First segment of an external path of two segments or more."""
    parts = F.split(relative, "/")
    return F.when((source_type == "external") & (F.size(parts) >= 2), parts[0])


def pretty_context(value: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), "[_-]", " "), r"\s+", " ")), " ")
    shown = F.transform(words, lambda w: F.when(F.lower(w).isin(*ACRONYMS), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))))
    label = F.array_join(shown, " ")
    return F.when(label != "", label)


def context_label(source_type: Column, source_id: Column, relative: Column, group: Column, project: Column | None = None, project_name: Column | None = None) -> Column:
    """Explicit project, then the external project or source, then ``projects/<name>/...``; else null."""
    parts = F.filter(F.split(F.coalesce(relative, F.lit("")), "/"), lambda p: p != "")
    none = F.lit(None).cast("string")
    external = F.when(source_type == "external", pretty_context(F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(source_id)))
    inside = F.when((source_type != "external") & (F.size(parts) >= 3) & (F.lower(F.get(parts, F.lit(0))) == "projects"), pretty_context(F.get(parts, F.lit(1))))
    return F.coalesce(pretty_context(project) if project is not None else none, pretty_context(project_name) if project_name is not None else none, pretty_context(group), external, inside)


def display_label(title: Column, context: Column) -> Column:
    shown = F.when(F.trim(F.coalesce(title, F.lit(""))) == "", F.lit("Untitled")).otherwise(F.trim(title))
    return F.when(F.coalesce(context, F.lit("")) .eqNullSafe("") | (F.lower(context) == F.lower(shown)), shown).otherwise(F.concat(context, F.lit(" — "), shown))


def collection_name(vault_id: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-]+", vault_id):
        raise ValueError(f"bad vault id: {vault_id}")
    return f"vault_{re.sub(r'[^A-Za-z0-9_-]', '_', vault_id).strip('_')}_notes"
