"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reapline.session import durable

FOREST_NODES = 1_000_000  # nodes a task holds before its stars leave it
ONE_TASK = 400_000  # links that one task may finish; more go through star rounds


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as one edge from each node to the smallest node it reaches there."""
    above: dict[int, int] = {}

    def root(node: int) -> int:
        top = node
        while (up := above.setdefault(top, top)) != top:
            top = up
        while node != top:
            above[node], node = top, above[node]
        return top

    def edges() -> pa.RecordBatch:
        nodes = [n for n, up in above.items() if n != up]
        return pa.record_batch([pa.array(nodes, pa.int64()), pa.array(list(map(root, nodes)), pa.int64())], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            one, two = root(u), root(v)
            if one != two:
                above[max(one, two)] = min(one, two)
        if len(above) > FOREST_NODES:
            yield edges()
            above.clear()
    yield edges()


def _to_minimum(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge with the smallest node among u and all its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(least.hint("merge"), "u")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _to_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    small = _to_minimum(large)
    return small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """``node, component`` for every node with a link; ``component`` is the smallest node reachable.

    Each task first shrinks its own edges to stars.  If at most ``one_task`` edges are left, one task
    finishes them.  Else each round moves edges towards smaller neighbours by aggregates and
    joins on the node and is cut with a checkpoint; the number of rounds is logarithmic, so chains and stars
    of any size end.  Links in either order, repeated links and self-links are fine; null
    ends are dropped; an empty table gives no row.  Nothing is collected but one
    count and one sum per checkpoint.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    edges, before = durable(edges.mapInArrow(_forest, "u long, v long")), None
    if edges.limit(one_task + 1).count() <= one_task:
        return _labels(edges.repartition(1).mapInArrow(_forest, "u long, v long"))
    for _ in range(max_rounds):
        edges = durable(_round(edges))
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return _labels(edges)


def _labels(stars: DataFrame) -> DataFrame:
    stars = durable(stars)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
