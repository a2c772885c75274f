"""Vector arithmetic on arrays, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(doubles(a), lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, zero or differently long vectors."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), dot(a, b) / scale).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """Cosine, not below 0."""
    return F.greatest(F.lit(0.0), cosine(a, b))


def distance_similarity(cos: Column) -> Column:
    """What a distance d = 1 - cosine is turned into as if it were Euclidean: 1 - d*d/2, not below 0."""
    d = F.lit(1.0) - cos
    return F.greatest(F.lit(0.0), F.lit(1.0) - d * d / 2)
