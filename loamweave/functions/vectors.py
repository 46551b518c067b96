"""Vector arithmetic and score normalisation as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "l2")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def finite(vector: Column, dim: int) -> Column:
    """Exactly ``dim`` finite components; false for null."""
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def score(value: Column, metric: str, unit: bool = True, scale: float | None = None) -> Column:
    """A distance or product as a score in [0, 1]; cosine takes distances, dot and l2 need unit vectors or a scale."""
    if metric == "cosine":
        raw = 1 - value / 2
    elif metric == "dot" and unit:
        raw = (value + 1) / 2
    elif metric == "l2" and unit:
        raw = 1 - value * value / 4
    elif metric == "l2" and scale and scale > 0:
        raw = F.exp(-value * value / (2 * scale * scale))
    else:
        raise ValueError(f"no score for metric {metric!r} with these vectors")
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))
