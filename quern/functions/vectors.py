"""Vector expressions over array columns, in double precision on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where lengths differ or a norm is 0."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), dot(a, b) / F.when(scale > 0, scale)).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """Cosine, clamped to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(a, b)))


def parse_literal(text: Column) -> Column:
    """Array of doubles from '[1,2]'; empty where it is malformed or holds a null."""
    v = F.from_json(text, "array<double>")
    return F.when(v.isNull() | F.exists(v, lambda x: x.isNull()), F.array().cast("array<double>")).otherwise(v)
