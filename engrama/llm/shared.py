"""Size checks before a broadcast, and what cuts a lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrama.sources.shared import drop, shared_folder, stash

__all__ = ["broadcast_if", "drop", "quoted", "shared_folder", "stash", "unused"]


def unused(columns: list[str], name: str) -> str:
    """A column name that the table doesn't have, whatever the case."""
    held = {c.lower() for c in columns}
    while name.lower() in held:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """A column by its name, whatever signs that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def broadcast_if(df: DataFrame, rows: int, at_most: int) -> DataFrame:
    """``df`` marked for broadcast if it has few enough rows, else as it is."""
    return F.broadcast(df) if rows <= at_most else df
