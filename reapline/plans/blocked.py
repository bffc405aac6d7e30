"""Ordered work inside keys of any size.

A plain ``Window.partitionBy(key)`` sends a whole key to one task.  Here a key is cut
into blocks along its order (time slices or number ranges), windows run inside
(key, block), and only one small row per block is scanned along the key to find
what each block inherits from the ones before it.  The result equals the plain
window; a key that holds a third of all rows is spread over its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"


def micros(column: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    c = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(c.cast("timestamp"))


def time_block(column: str, seconds: int = 3600) -> Column:
    """Block of a timestamp column; monotone in time."""
    return F.floor(micros(column) / F.lit(seconds * 1_000_000)).cast("long")


def number_block(column: str, size: int = 100_000) -> Column:
    """Block of a numeric position; monotone in the position."""
    return F.floor(F.col(column) / F.lit(size)).cast("long")


class Blocked:
    """Window functions over ``keys`` ordered by ``order``, computed block by block.

    ``order`` must be a total order inside a key and ``block`` monotone in it.
    """

    def __init__(self, keys: Sequence[str], order: Sequence[str], block: Column):
        self.keys = list(keys)
        self.order = list(order)
        self.block = block

    def prepare(self, df: DataFrame) -> DataFrame:
        return df if BLOCK in df.columns else df.withColumn(BLOCK, self.block)

    @property
    def _inside(self):
        return Window.partitionBy(*self.keys, BLOCK).orderBy(*self.order)

    @property
    def _along(self):
        return Window.partitionBy(*self.keys).orderBy(BLOCK)

    def _attach(self, df: DataFrame, carried: DataFrame) -> DataFrame:
        names = [*self.keys, BLOCK]
        right = carried.withColumnsRenamed({n: f"_c_{n}" for n in names})
        condition = [df[n].eqNullSafe(right[f"_c_{n}"]) for n in names]
        return df.join(right, condition, "left").drop(*[f"_c_{n}" for n in names])

    def lag(self, df: DataFrame, outputs: dict[str, str]) -> DataFrame:
        """``outputs`` maps a new column to the column whose previous value it holds."""
        df = self.prepare(df)
        value = F.struct(*[F.col(c).alias(o) for o, c in outputs.items()])
        last = df.groupBy(*self.keys, BLOCK).agg(F.max_by(value, F.struct(*self.order)).alias("_last"))
        carried = last.select(*self.keys, BLOCK, F.lag("_last").over(self._along).alias("_carry"))
        df = self._attach(df, carried).withColumn("_prev", F.coalesce(F.lag(value).over(self._inside), F.col("_carry")))
        return df.withColumns({o: F.col(f"_prev.{o}") for o in outputs}).drop("_prev", "_carry")

    def running(self, df: DataFrame, outputs: dict[str, tuple[str, Column]]) -> DataFrame:
        """Running aggregates up to and including the row.

        ``outputs`` maps a new column to (kind, expression); kind is sum, count, max,
        min or last (last value that is not null).
        """
        df = self.prepare(df)
        df = df.withColumns({f"_v_{o}": expr for o, (_, expr) in outputs.items()})
        per_block, along, local = [], [], {}
        before = self._along.rowsBetween(Window.unboundedPreceding, -1)
        upto = self._inside.rowsBetween(Window.unboundedPreceding, 0)
        for o, (kind, _) in outputs.items():
            v, b, c = F.col(f"_v_{o}"), f"_b_{o}", f"_c_{o}"
            if kind == "last":
                per_block.append(F.max_by(v, F.when(v.isNotNull(), F.struct(*self.order))).alias(b))
                along.append(F.last(b, ignorenulls=True).over(before).alias(c))
                local[o] = F.coalesce(F.last(v, ignorenulls=True).over(upto), F.col(c))
            elif kind in ("sum", "count"):
                agg = F.sum if kind == "sum" else F.count
                per_block.append(agg(v).alias(b))
                along.append(F.sum(b).over(before).alias(c))
                local[o] = F.coalesce(agg(v).over(upto), F.lit(0)) + F.coalesce(F.col(c), F.lit(0))
            elif kind in ("max", "min"):
                agg = F.max if kind == "max" else F.min
                both = F.greatest if kind == "max" else F.least
                per_block.append(agg(v).alias(b))
                along.append(agg(b).over(before).alias(c))
                local[o] = both(agg(v).over(upto), F.col(c))
            else:
                raise ValueError(f"unknown running aggregate {kind}")
        carried = df.groupBy(*self.keys, BLOCK).agg(*per_block).select(*self.keys, BLOCK, *along)
        df = self._attach(df, carried).withColumns(local)
        return df.drop(*[f"_v_{o}" for o in outputs], *[f"_c_{o}" for o in outputs])

    def row_number(self, df: DataFrame, name: str) -> DataFrame:
        return self.running(df, {name: ("count", F.lit(1))})

    def streak(self, df: DataFrame, name: str, changed: Column) -> DataFrame:
        """Position inside a run of rows; a row where ``changed`` holds starts a new run."""
        df = self.row_number(df, "_rn")
        df = self.running(df, {"_start": ("max", F.when(changed, F.col("_rn")))})
        return df.withColumn(name, F.col("_rn") - F.coalesce("_start", F.lit(1)) + 1).drop("_rn", "_start")

    def done(self, df: DataFrame) -> DataFrame:
        return df.drop(BLOCK)
