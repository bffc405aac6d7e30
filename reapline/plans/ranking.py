"""Ranking shapes that stay partial before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int | None, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key, numbered; all of them without ``k``.

    Spark turns the filter on ``row_number`` into a group limit below the exchange, so
    each task sends at most ``k`` rows of a key, however large the key is.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the smallest ``order`` per key, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the largest ``order`` per key, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)


def is_small(df: DataFrame, limit_rows: int = 100_000) -> bool:
    """Whether a table has at most ``limit_rows`` rows; counting stops at the limit."""
    return df.limit(limit_rows + 1).count() <= limit_rows


def broadcast_if_small(df: DataFrame, limit_rows: int = 100_000) -> DataFrame:
    """Broadcast hint only where counting proves the size; else Spark chooses the join."""
    return F.broadcast(df) if is_small(df, limit_rows) else df
