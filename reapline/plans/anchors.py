"""Windows that start at the first event after the previous window ended.

Such windows form a chain per key: each anchor decides the next one.  Following the
chain row by row would put a key into one task.  Here every event first finds its own
successor (the first event a window later) inside time blocks; successors are then
composed over blocks of 2, 4, 8, ... widths, and unfolded again from the first event.
Only events that can be entered from outside a block survive to the next round, so all
rounds together read about twice the events, for keys of any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reapline.session import durable


def _successors(events: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Add ``nxt``: first event time at least ``width`` after the row; events are distinct times."""
    rows = events.withColumns({"_at": F.col("t"), "_probe": F.lit(None).cast("long")})
    probes = events.select(
        *keys, F.lit(None).cast("long").alias("t"), (F.col("b") + 1).alias("b"), (F.col("t") + width).alias("_at"), F.col("t").alias("_probe")
    )
    following = Window.partitionBy(*keys, "b").orderBy("_at", F.col("t").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    inside = rows.unionByName(probes).withColumn("_in", F.first("t", ignorenulls=True).over(following))
    blocks = rows.unionByName(probes).groupBy(*keys, "b").agg(F.min("t").alias("_first"))
    later = Window.partitionBy(*keys).orderBy("b").rowsBetween(1, Window.unboundedFollowing)
    earlier = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    used = F.when(F.col("_first").isNotNull(), F.col("b"))
    blocks = blocks.select(
        *keys, "b", F.first("_first", ignorenulls=True).over(later).alias("_later"), F.last(used, ignorenulls=True).over(earlier).alias("before"), "_first"
    )
    found = inside.where(F.col("_probe").isNotNull()).join(blocks.select(*keys, "b", "_later"), [*keys, "b"]).select(
        *keys, F.col("_probe").alias("t"), F.coalesce("_in", "_later").alias("nxt")
    )
    marked = events.join(blocks.select(*keys, "b", "before", "_first"), [*keys, "b"])
    marked = marked.withColumn("first_in_block", F.col("t") == F.col("_first")).drop("_first")
    return marked.join(found, [*keys, "t"])


def anchor_chain(events: DataFrame, keys: Sequence[str], time: str, width: int) -> DataFrame:
    """Anchor times per key: the first event, then always the first event ``width`` later.

    ``time`` is an integer column, ``width`` in the same unit.
    """
    keys = list(keys)
    distinct = events.select(*keys, F.col(time).cast("long").alias("t")).distinct()
    span = distinct.agg(F.min("t"), F.max("t")).first()
    if span[0] is None:
        return distinct
    low = span[0] // width
    levels = max(1, (span[1] // width - low + 1 - 1).bit_length())
    block = F.floor(F.col("t") / F.lit(width)).cast("long") - low
    base = durable(_successors(distinct.withColumn("b", block), keys, width))
    place = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long") - low
    exits = [base.select(*keys, "t", F.col("nxt").alias("out"))]
    for k in range(1, levels):
        size = 1 << k
        start = F.floor(F.col("b") / size) * size
        enters = (F.col("b") == start) | (F.col("first_in_block") & (F.coalesce(F.col("before"), F.lit(-1)) <= start))
        entry = base.where(enters).select(*keys, "t", "b")
        below = exits[-1]
        one = entry.join(below, [*keys, "t"])
        onward = below.select(*keys, F.col("t").alias("out"), F.col("out").alias("_further"))
        same = F.floor(place("out") / size) == F.floor(F.col("b") / size)
        two = one.join(onward, [*keys, "out"], "left")
        exits.append(
            durable(two.select(*keys, "t", F.when(F.coalesce(same, F.lit(False)), F.col("_further")).otherwise(F.col("out")).alias("out")))
        )
    chain = distinct.groupBy(*keys).agg(F.min("t").alias("t"))
    for k in range(levels, 0, -1):
        size = 1 << k
        jump = chain.join(exits[k - 1], [*keys, "t"])
        inside = F.floor(place("out") / size) == F.floor(place("t") / size)
        chain = durable(chain.unionByName(jump.where(inside).select(*keys, F.col("out").alias("t"))))
    return chain
