"""Vector functions as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a, b) -> Column:
    """Cosine; 0 if either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def is_valid(v, n: int) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) == n) & finite & (norm(v) > 0), F.lit(False))


def truncated(v, n: int) -> Column:
    """The first ``n`` components, scaled to length 1 (left as they are if they have none)."""
    head = F.slice(v, 1, n)
    size = norm(head)
    return F.transform(head, lambda x: x / F.when(size > 0, size).otherwise(1.0))


def to_text(v) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def from_text(s) -> Column:
    return F.from_json(s, "array<double>")
