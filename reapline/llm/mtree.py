"""Exact top-k inner product search with an M-tree: paged metric nodes, best-first, bounded by triangle inequalities.

The tree has four levels.  The root holds a fixed number of routing vectors; below each lie
subtrees, below these pages, below these vectors.  Every node has a routing vector, a covering
radius, the largest norm and the smallest id below it; every entry keeps its distance to its parent.
For a query q and a vector x within r of c: <q, x> <= <q, c> + |q| r, and, from the distance of c
to its parent p alone, <q, x> <= (|q|^2 + |x|^2 - gap^2) / 2 with gap = | |q - p| - |c - p| | - r.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reapline.llm.common import durable
from reapline.plans.ranking import top_k

ROOT_ENTRIES = 64  # routing vectors of the root
SAMPLE = 4096  # vectors they are chosen from
PAGE = 128  # vectors of a page
SUBTREE = 4096  # vectors of a subtree, at most
SLACK = 1e-6  # relative, for distances in floating point; scores themselves are whole numbers


def _rounded(bound: np.ndarray) -> np.ndarray:
    """The largest whole score under a bound."""
    return np.floor(bound + SLACK * np.abs(bound) + SLACK)


def integers(vector: str, scale: int = 1024):
    """floor(scale * component) of a vector column; null if a component is null or not finite."""
    doubles = F.transform(F.col(vector), lambda v: v.cast("double"))
    fine = F.forall(doubles, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(fine & (F.size(vector) > 0), F.transform(doubles, lambda v: F.floor(v * scale).cast("long")))


def routing_vectors(sample: np.ndarray, count: int = ROOT_ENTRIES) -> np.ndarray:
    """Vectors of the sample far from one another, each next one the farthest from those before."""
    chosen = [0]
    distance = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < count and distance.max() > 0:
        chosen.append(int(distance.argmax()))
        distance = np.minimum(distance, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen].astype(np.float64)


def _matrix(column: pa.ListArray, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _assign(batches: Iterator[pa.RecordBatch], root) -> Iterator[pa.RecordBatch]:
    """(cell, distance to it) of each vector."""
    centres = root.value
    for batch in batches:
        for start in range(0, batch.num_rows, 2048):
            part = batch.slice(start, 2048)
            x = _matrix(part.column(1), centres.shape[1]).astype(np.float64)
            squares = (x**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * x @ centres.T
            cell = squares.argmin(1)
            away = np.linalg.norm(x - centres[cell], axis=1)
            yield pa.record_batch([pa.array(cell, pa.int32()), pa.array(away), part.column(0), part.column(1)], ["cell", "away", "vec_id", "vector"])


class Best:
    """The k best (score, smaller id first) of one query so far."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def offer(self, score: int, vec_id: int) -> None:
        entry = (score, -vec_id)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)

    @property
    def least(self) -> tuple[float, int]:
        """(score, id) that a new entry must beat."""
        return (self.heap[0][0], -self.heap[0][1]) if len(self.heap) == self.k else (-np.inf, 0)


class Subtree:
    """Pages of vectors below one entry of the root."""

    def __init__(self, parent: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.parent, self.ids, self.vectors = parent, ids, vectors
        self.centre = vectors[len(vectors) // 2].astype(np.float64)
        starts = np.arange(0, len(ids), PAGE)
        self.starts = starts
        x = vectors.astype(np.float64)
        self.centres = x[np.minimum(starts + PAGE // 2, len(ids) - 1)]
        self.to_page = np.linalg.norm(x - np.repeat(self.centres, PAGE, axis=0)[: len(ids)], axis=1)  # entry to its page
        self.page_to_tree = np.linalg.norm(self.centres - self.centre, axis=1)  # page to the subtree
        self.page_radius = np.maximum.reduceat(self.to_page, starts)
        self.squares = (x**2).sum(1)
        self.page_square = np.maximum.reduceat(self.squares, starts)
        self.page_first = np.minimum.reduceat(ids, starts)
        self.radius = float(np.linalg.norm(x - self.centre, axis=1).max())

    def search(self, q: np.ndarray, own: int | None, best: Best) -> int:
        """Offers what can still enter ``best``; returns the number of distances computed."""
        qf, qq = q.astype(np.float64), float((q.astype(np.float64) ** 2).sum())
        norm = qq**0.5
        gap = np.maximum(0, np.abs(np.linalg.norm(qf - self.centre) - self.page_to_tree) - self.page_radius)
        bound = _rounded((qq + self.page_square - gap**2) / 2)  # from stored distances only
        least, least_id = best.least
        alive = np.flatnonzero((bound > least) | (bound == least) & (self.page_first < least_id))
        computed = 1 + len(alive)
        dots = self.centres[alive] @ qf
        bound = np.minimum(bound[alive], _rounded(dots + norm * self.page_radius[alive]))
        for k in np.lexsort((self.page_first[alive], -bound)):
            least, least_id = best.least
            page = alive[k]
            if bound[k] < least:
                break
            if bound[k] == least and self.page_first[page] >= least_id:
                continue
            rows = slice(self.starts[page], self.starts[page] + PAGE)
            away = max(0.0, float(qq + (self.centres[page] ** 2).sum() - 2 * dots[k])) ** 0.5
            entry = _rounded((qq + self.squares[rows] - (away - self.to_page[rows]) ** 2) / 2)
            ids = self.ids[rows]
            chosen = np.flatnonzero(((entry > least) | (entry == least) & (ids < least_id)) & (True if own is None else ids != own))
            computed += len(chosen)
            scores = self.vectors[rows][chosen] @ q
            for score, vec_id in zip(scores.tolist(), ids[chosen].tolist()):
                best.offer(score, vec_id)
        return computed

    def parts(self) -> list:
        return [self.parent.tobytes(), self.ids.tobytes(), self.vectors.tobytes()]


BUILT = "node long, cell int, centre binary, to_root double, radius double, square double, first_id long, ids binary, vectors binary, q_ids binary, q_vectors binary, q_least binary"


def _build(batches: Iterator[pa.RecordBatch], root, k: int, every: int) -> Iterator[pa.RecordBatch]:
    """Cuts a partition sorted by (cell, distance, id) into subtrees; its own queries search theirs at once."""
    from pyspark import TaskContext

    centres = root.value
    number = TaskContext.get().partitionId() << 32

    def close(cell: int, ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        nonlocal number
        tree = Subtree(centres[cell], ids, vectors)
        asking = np.flatnonzero(ids % every == 0)
        least = []
        for i in asking:
            best = Best(k)
            tree.search(vectors[i], int(ids[i]), best)
            least.append(best.least)
        number += 1
        row = {
            "node": number, "cell": int(cell), "centre": tree.centre.tobytes(), "to_root": float(np.linalg.norm(tree.centre - centres[cell])), "radius": tree.radius,
            "square": float(tree.squares.max()), "first_id": int(ids.min()), "ids": ids.tobytes(), "vectors": vectors.tobytes(),
            "q_ids": ids[asking].tobytes(), "q_vectors": vectors[asking].tobytes(), "q_least": np.array(least, np.float64).tobytes(),
        }
        types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
        schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in BUILT.split(", ")])
        return pa.RecordBatch.from_pylist([row], schema=schema)

    cell, ids, rows, held = None, [], [], 0
    for batch in batches:
        cells = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:]):
            while start < end:
                if cell is not None and (cells[start] != cell or held >= SUBTREE):
                    yield close(cell, np.concatenate(ids), np.concatenate(rows))
                    ids, rows, held = [], [], 0
                cell = int(cells[start])
                step = min(end, start + SUBTREE - held)
                part = batch.slice(start, step - start)
                ids.append(part.column(2).to_numpy())
                rows.append(_matrix(part.column(3), centres.shape[1]))
                held, start = held + step - start, step
    if held:
        yield close(cell, np.concatenate(ids), np.concatenate(rows))


PACK = "pack long, cell int, q_ids binary, q_vectors binary, q_least binary"


def _at_root(batches: Iterator[pa.RecordBatch], root, cells: dict) -> Iterator[pa.RecordBatch]:
    """For each pack of queries, the cells that some of its queries must enter, with those queries."""
    centres = root.value
    for batch in batches:
        for row in batch.to_pylist():
            ids, q, least = _queries(row, centres.shape[1])
            qf = q.astype(np.float64)
            norm = np.linalg.norm(qf, axis=1)
            for cell, (radius, first) in cells.items():
                bound = _rounded(qf @ centres[cell] + norm * radius)
                keep = (bound > least[:, 0]) | (bound == least[:, 0]) & (first <= least[:, 1])
                if keep.any():
                    yield _pack(row["node"], {"cell": cell}, ids[keep], q[keep], least[keep])


def _queries(row: dict, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_vectors"], np.int64).reshape(-1, dimension), np.frombuffer(row["q_least"], np.float64).reshape(-1, 2)


def _pack(pack: int, extra: dict, ids, q, least) -> pa.RecordBatch:
    columns = {"pack": pa.array([pack], pa.int64()), **{c: pa.array([v], pa.int32() if c == "cell" else pa.int64()) for c, v in extra.items()}}
    columns |= {"q_ids": pa.array([ids.tobytes()], pa.binary()), "q_vectors": pa.array([q.tobytes()], pa.binary()), "q_least": pa.array([least.tobytes()], pa.binary())}
    return pa.record_batch(list(columns.values()), list(columns))


def _at_subtree(batches: Iterator[pa.RecordBatch], root) -> Iterator[pa.RecordBatch]:
    """Of a pack's queries at a subtree's entry, those that must go on: first by stored distances, then by the entry's own."""
    centres = root.value
    for batch in batches:
        for row in batch.to_pylist():
            ids, q, least = _queries(row, centres.shape[1])
            qf = q.astype(np.float64)
            squares = (qf**2).sum(1)
            gap = np.maximum(0, np.abs(np.linalg.norm(qf - centres[row["cell"]], axis=1) - row["to_root"]) - row["radius"])
            bound = _rounded((squares + row["square"] - gap**2) / 2)
            keep = np.flatnonzero((bound > least[:, 0]) | (bound == least[:, 0]) & (row["first_id"] <= least[:, 1]))
            bound = _rounded(qf[keep] @ np.frombuffer(row["centre"], np.float64) + np.sqrt(squares[keep]) * row["radius"])
            keep = keep[(bound > least[keep, 0]) | (bound == least[keep, 0]) & (row["first_id"] <= least[keep, 1])]
            if len(keep):
                yield _pack(row["pack"], {"node": row["node"]}, ids[keep], q[keep], least[keep])


FOUND = "query_id long, vec_id long, score long"


def _in_subtree(batches: Iterator[pa.RecordBatch], root, k: int) -> Iterator[pa.RecordBatch]:
    """Best-first search of one subtree for the queries of one pack at a time; at most k rows per query leave."""
    centres = root.value
    node, tree = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["node"] != node:
                ids = np.frombuffer(row["ids"], np.int64)
                node, tree = row["node"], Subtree(centres[row["cell"]], ids, np.frombuffer(row["vectors"], np.int64).reshape(len(ids), -1))
            out = []
            for query, q, (least, least_id) in zip(*_queries(row, centres.shape[1])):
                best = _Above(k, least, least_id)
                tree.search(q, int(query), best)
                out += [(int(query), -i, s) for s, i in best.heap]
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], ["query_id", "vec_id", "score"])


class _Above(Best):
    """Also knows a (score, id) that k rows elsewhere reach; rows equal to it are wanted, for they may be those rows."""

    def __init__(self, k: int, least: float, least_id: float):
        super().__init__(k)
        self.floor = (least, least_id + 1)

    @property
    def least(self) -> tuple[float, int]:
        own = super().least
        return max(own, self.floor, key=lambda e: (e[0], -e[1]))


def top_neighbours(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows for every row whose id is divisible by ``every``.

    Components become floor(scale * x); the score is the whole inner product, ties go to the
    smaller id.  Rows with a null id, a null or empty vector, or a component that is null or not finite take no part;
    all vectors must have one length.  Rows repeating an id are candidates each, save for
    queries of that id.  With fewer than k candidates all are returned; an empty table gives no row.

    Only the root's routing vectors come from a bounded sample; every row is indexed.
    Rows are range-partitioned by (cell, distance to the cell's routing vector, id), so a cell or a
    group of equal vectors of any size falls into many subtrees of bounded size.  Queries
    travel in packs: each is searched in its own subtree while that is built, which
    sets the score to beat; packs then go only to cells and subtrees whose bounds reach that
    score, and there best-first from page to page.
    """
    source = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), integers(vector, scale).alias("vector")).where("vec_id is not null and vector is not null")
    sample = source.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
    spark = vectors.sparkSession
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    root = spark.sparkContext.broadcast(routing_vectors(np.array(sample["vector"].to_pylist(), np.int64)))
    assigned = source.mapInArrow(partial(_assign, root=root), "cell int, away double, vec_id long, vector array<long>")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["cell", "away", "vec_id"]
    dealt = assigned.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    nodes = durable(dealt.mapInArrow(partial(_build, root=root, k=k, every=every), BUILT))
    cells = {r.cell: (r.radius, r.first) for r in nodes.groupBy("cell").agg(F.max(F.col("to_root") + F.col("radius")).alias("radius"), F.min("first_id").alias("first")).collect()}  # a row per root entry
    asking = nodes.where(F.length("q_ids") > 0).select("node", "q_ids", "q_vectors", "q_least")
    packs = asking.mapInArrow(partial(_at_root, root=root, cells=cells), PACK)
    entries = nodes.select("node", "cell", "centre", "to_root", "radius", "square", "first_id")
    visits = packs.join(entries, "cell").mapInArrow(partial(_at_subtree, root=root), PACK.replace("cell int", "node long"))
    trees = nodes.select("node", "cell", "ids", "vectors")
    found = visits.join(trees, "node").mapInArrow(partial(_in_subtree, root=root, k=k), FOUND)
    return top_k(found, ["query_id"], [F.desc("score"), "vec_id"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
