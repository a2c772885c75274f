"""Column functions on numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """What ``round`` gives of a double, which it makes of a decimal: that is asked only where a value may lie halfway between two digits, or is large."""
    shifted = x * float(10**digits) + 0.5
    over = shifted - F.floor(shifted)
    return F.when((F.abs(shifted) < float(1 << 30)) & (over > 1e-3) & (over < 1 - 1e-3), F.floor(shifted) / F.lit(float(10**digits))).otherwise(F.round(x, digits))
