"""What the semantic pass reads: changed notes, recent sessions, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrama.functions.paths import matches_any
from engrama.functions.text import is_acknowledgement


def session_rollup(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.max("id").alias("last_message_id"), F.max("timestamp").alias("last_at"), F.count(F.lit(1)).alias("messages"))


def session_text(messages: DataFrame, most: int = 12_000) -> DataFrame:
    """session_id, content: ``[role]`` and text of each message in order, cut."""
    part = F.struct("id", F.concat(F.lit("["), "role", F.lit("]\n"), "content").alias("p"))
    return messages.groupBy("session_id").agg(F.substring(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["p"]), "\n\n"), 1, most).alias("content"))


def candidate_sessions(messages: DataFrame, checkpoint: DataFrame, sessions: DataFrame | None = None, since: Column | None = None, least_user: int = 24, least_text: int = 200, most: int = 12_000, limit: int | None = None) -> DataFrame:
    """session_id, last_message_id, content of sessions that say something new.

    New messages of users and assistants that are not blank; at least one of a
    user that is long enough and no mere acknowledgement; enough text in all.
    Sessions of the scheduler are skipped. With a ``limit`` the sessions that
    were used the longest ago.
    """
    new = messages.join(checkpoint.select("session_id", F.col("last_message_id").alias("__last")), "session_id", "left").filter((F.col("id") > F.coalesce("__last", F.lit(-1))) & F.col("role").isin("user", "assistant") & (F.trim(F.coalesce("content", F.lit(""))) != ""))
    if sessions is not None:
        new = new.join(sessions.filter("source != 'cron'").select(F.col("id").alias("session_id")), "session_id", "left_semi")
    if since is not None:
        new = new.join(messages.groupBy("session_id").agg(F.max("timestamp").alias("__t")).filter(F.col("__t") >= since).select("session_id"), "session_id", "left_semi")
    spoken = (F.col("role") == "user") & (F.length(F.trim("content")) >= least_user) & ~is_acknowledgement(F.col("content"))
    part = F.struct("id", F.concat(F.lit("["), "role", F.lit("]\n"), F.trim("content")).alias("p"))
    rolled = new.groupBy("session_id").agg(F.max("id").alias("last_message_id"), F.bool_or(spoken).alias("__said"), F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["p"]), "\n\n").alias("content"))
    fit = rolled.filter(F.col("__said") & (F.length("content") >= least_text)).select("session_id", "last_message_id", F.substring("content", 1, most).alias("content"))
    if limit is None:
        return fit
    at = messages.groupBy("session_id").agg(F.max("timestamp").alias("__t"))
    return fit.join(at, "session_id").orderBy("__t", "session_id").limit(limit).drop("__t")


def merged_candidates(notes: DataFrame, sessions: DataFrame, most: int = 3) -> DataFrame:
    """source_id, used_at: the candidates of both kinds (source_id, used_at), oldest first, cut once more."""
    return notes.select("source_id", "used_at").union(sessions.select("source_id", "used_at")).orderBy("used_at", "source_id").limit(most)


def allowed(source: Column, learn: Column, respond: Column) -> tuple[Column, Column, Column]:
    """Whether a query may make notes (never the scheduler's, and only where it learns from an answer), learn, and be answered."""
    learns, answers = F.coalesce(learn, F.lit(True)), F.coalesce(respond, F.lit(True))
    return ~source.eqNullSafe("cron") & learns & answers, learns, answers


def candidate_notes(notes: DataFrame, checkpoint: DataFrame, since: Column, include: list[str], exclude: list[str], most: int | None = 3) -> DataFrame:
    """path, mtime, sha256 of notes changed since and not yet processed in this form, oldest first."""
    now = notes.filter(F.col("mtime") >= since).filter(matches_any(F.col("path"), include) & ~matches_any(F.col("path"), exclude)).select("path", "mtime", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
    todo = now.join(checkpoint.select("path", "sha256"), ["path", "sha256"], "left_anti")
    return todo if most is None else todo.orderBy("mtime", "path").limit(most)


def mark_processed(checkpoint: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The checkpoint with the later entry of each key (processed_at decides)."""
    rest = [c for c in checkpoint.columns if c != key]
    rows = checkpoint.unionByName(done.select(*checkpoint.columns)).groupBy(key).agg(F.max_by(F.struct(*rest), "processed_at").alias("r"))
    return rows.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])
