"""Vector functions on array columns, and the small arithmetic around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from reapline.functions.url import _col


def dot(a, b) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """Cosine similarity; null when a vector is missing or zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def unit(a) -> Column:
    """Vector scaled to length 1, so that later cosines are plain dot products."""
    length = norm(a)
    return F.when(length > 0, F.transform(_col(a), lambda x: x.cast("double") / length))


def clamp01(s) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _col(s)))


def to_similarity(score) -> Column:
    """Map distances and scores of several conventions to 0..1.

    Kept for stored scores: it is not monotone between -1 and 0.  New code uses the
    clamped cosine.
    """
    v = _col(score).cast("double")
    return (
        F.when(v.between(0.0, 1.0), v)
        .when((v > 1.0) & (v <= 2.0), 1.0 - v / 2.0)
        .when((v >= -1.0) & (v < 0.0), 1.0 + v)
        .otherwise(clamp01(1.0 / (1.0 + F.abs(v))))
    )


def normalize_weights(weights: Sequence[float], defaults: Sequence[float]) -> tuple[float, ...]:
    """Non-negative weights that sum to 1; the defaults when nothing is left."""
    kept = [max(0.0, float(w)) for w in weights]
    total = sum(kept)
    return tuple(w / total for w in kept) if total > 0 else tuple(float(d) for d in defaults)
