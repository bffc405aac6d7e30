"""Hard negatives by a threshold join over inverted indexes with pruned dimensions.

Rows are cut into blocks.  A block indexes its rows dimension by dimension, the heaviest first.  A row
leaves out its last dimensions where the norm of that suffix times the largest norm of the asking
anchors stays below their lowest threshold: such a part alone cannot lift a score over it.  Scores are
accumulated a few dimensions at a time, and a row is dropped once its partial score plus the
product of the remaining norms is below the anchor's threshold; survivors are scored in full.
The positives' threshold is the k-th best score inside the anchor's own block.  Negatives start
with a threshold close under the positive's score, which is lowered round by round for those
windows that are not full.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reapline.llm.common import durable
from reapline.llm.mtree import integers
from reapline.plans.ranking import top_k

BLOCK_BYTES = 16_000_000  # of the vectors of a block
WIDTH = 8  # dimensions accumulated between two prunings
PACK = 256  # anchors that share one pruned index
STEPS = (32, 8)  # the first thresholds lie a 32nd, then an 8th, of the positive's score below it; the last is the window's end
SLACK = 1e-9  # relative, for norms in floating point; scores are whole numbers below 2**53
KIND_BLOCK, KIND_ANCHOR = 0, 1


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the length of each vector, its heaviest dimension with its sign, and that dimension's share of the norm."""
    for batch in batches:
        for start in range(0, batch.num_rows, 2048):
            part = batch.slice(start, 2048)
            cells, shares = [], []
            for vector in part.column(2):
                x = np.array(vector.as_py(), np.float64)
                k = int(np.abs(x).argmax())
                cells.append(2 * k + (x[k] < 0))
                shares.append(abs(x[k]) / max(1.0, np.linalg.norm(x)))
            sizes = part.column(2).value_lengths()
            yield pa.RecordBatch.from_arrays([sizes.cast(pa.int32()), pa.array(cells, pa.int32()), pa.array(shares, pa.float64()), *part.columns], ["size", "cell", "share", "vec_id", "label", "vector"])


BUILT = pa.schema([
    ("block", pa.int64()), ("kind", pa.int32()), ("size", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()),
    ("row", pa.int64()), ("anchor_id", pa.int64()), ("label", pa.int64()), ("threshold", pa.float64()),
])
BUILT_SQL = "block long, kind int, size int, ids binary, labels binary, vectors binary, row long, anchor_id long, label long, threshold double"


def _build(batches: Iterator[pa.RecordBatch], every: int, positives: int) -> Iterator[pa.RecordBatch]:
    """Cuts a sorted partition into blocks; an anchor is also given its k-th best score among its own block's rows of its label."""
    block = TaskContext.get().partitionId() << 16

    def close(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        nonlocal block
        block += 1
        if np.linalg.norm(vectors.astype(np.float64), axis=1).max() ** 2 >= 2**53:
            raise ValueError("inner products must stay below 2**53")
        rows = [{"block": block, "kind": KIND_BLOCK, "size": vectors.shape[1], "ids": ids.tobytes(), "labels": labels.tobytes(), "vectors": vectors.tobytes()}]
        x = vectors.astype(np.float64)
        for i in np.flatnonzero(ids % every == 0).tolist():
            same = np.flatnonzero(labels == labels[i])
            scores = x[same[same != i]] @ x[i]
            threshold = float(np.partition(scores, -positives)[-positives]) if len(scores) >= positives else -np.inf
            rows.append({"block": block, "kind": KIND_ANCHOR, "size": vectors.shape[1], "vectors": vectors[i].tobytes(), "row": (block << 24) + i, "anchor_id": int(ids[i]), "label": int(labels[i]), "threshold": threshold})
        return pa.RecordBatch.from_pylist(rows, schema=BUILT)

    parts, held, size = [], 0, None
    for batch in batches:
        sizes = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
        for start, end in zip(cuts[:-1], cuts[1:]):
            while start < end:
                room = max(1, BLOCK_BYTES // (8 * int(sizes[start])))
                if held and (sizes[start] != size or held >= room):
                    yield close(*map(np.concatenate, zip(*parts)))
                    parts, held = [], 0
                size = int(sizes[start])
                step = min(end, start + room - held)
                part = batch.slice(start, step - start)
                parts.append((part.column(3).to_numpy(), part.column(4).to_numpy(), part.column(5).flatten().to_numpy().reshape(-1, size)))
                held, start = held + step - start, step
    if held:
        yield close(*map(np.concatenate, zip(*parts)))


class Index:
    """Rows of a block by dimension, with the norms of what follows each group of dimensions."""

    def __init__(self, number: int, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.number, self.ids, self.labels = number, ids, labels
        x = vectors.astype(np.float64)
        self.order = np.argsort(-(x**2).sum(axis=0), kind="stable")
        self.x = x[:, self.order]
        self.cuts = [*range(0, x.shape[1], WIDTH), x.shape[1]]
        groups = np.add.reduceat(self.x**2, self.cuts[:-1], axis=1)
        self.rest = np.zeros((len(x), len(self.cuts)))
        self.rest[:, :-1] = np.sqrt(np.cumsum(groups[:, ::-1], axis=1)[:, ::-1])

    def prune(self, threshold: float, norm: float) -> None:
        """Leaves out, for each row, the last groups of dimensions that alone cannot reach the threshold for any asking anchor."""
        self.indexed = (self.rest[:, :-1] * norm * (1 + SLACK) >= threshold).sum(axis=1)

    def above(self, q: np.ndarray, wanted: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the wanted rows with at least that score."""
        q = q[self.order].astype(np.float64)
        norms = np.zeros(len(self.cuts))
        norms[:-1] = np.sqrt(np.cumsum(np.add.reduceat(q**2, self.cuts[:-1])[::-1])[::-1])
        rows = np.flatnonzero(wanted & (self.indexed > 0))
        partial_score = np.zeros(len(rows))
        for g, (start, end) in enumerate(zip(self.cuts[:-1], self.cuts[1:])):
            last = self.indexed[rows]
            listed = last > g
            if not listed.any():
                break
            if listed.all():
                partial_score += self.x[rows, start:end] @ q[start:end]
            else:
                partial_score[listed] += self.x[rows[listed], start:end] @ q[start:end]
            seen = np.minimum(last, g + 1)
            reach = partial_score + norms[seen] * self.rest[rows, seen] * (1 + SLACK) + SLACK
            alive = reach >= threshold
            rows, partial_score = rows[alive], partial_score[alive]
        scores = np.rint(self.x[rows] @ q).astype(np.int64)
        reached = scores >= threshold
        return rows[reached], scores[reached]

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        return np.lexsort((self.ids[rows], -scores))[:k]


FOUND = "row long, positive_score long, vec_id long, score long"


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Streams blocks, each followed by the anchors that search it, in packs.

    An anchor without windows asks for rows of its label over its threshold; one with windows for
    other labels' rows, the k best of each window [threshold, positive's score].
    """
    index, pack = None, []

    def answer() -> Iterator[pa.RecordBatch]:
        nonlocal pack
        out = []
        if pack:
            least = min(min(a["thresholds"]) for a in pack)
            index.prune(least, max(np.linalg.norm(a["q"].astype(np.float64)) for a in pack))
        for a in pack:
            windows = a["scores"] or [None]
            wanted = index.labels == a["label"] if windows == [None] else index.labels != a["label"]
            if a["row"] >> 24 == index.number:
                wanted[a["row"] & 0xFFFFFF] = False
            rows, scores = index.above(a["q"], wanted, min(a["thresholds"]))
            for top, least in zip(windows, a["thresholds"]):
                inside = np.flatnonzero((scores >= least) & (scores <= (np.inf if top is None else top)))
                chosen = inside[index.best(rows[inside], scores[inside], k)]
                out += [(a["row"], top, vec_id, score) for vec_id, score in zip(index.ids[rows[chosen]].tolist(), scores[chosen].tolist())]
        pack = []
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], ["row", "positive_score", "vec_id", "score"])

    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            for r in batch.slice(start, 64).to_pylist():
                if r["kind"] == KIND_BLOCK:
                    yield from answer()
                    ids = np.frombuffer(r["ids"], np.int64)
                    index = Index(r["block"], ids, np.frombuffer(r["labels"], np.int64), np.frombuffer(r["vectors"], np.int64).reshape(len(ids), -1))
                elif r["size"] == index.x.shape[1]:
                    pack.append({"row": r["row"], "label": r["label"], "q": np.frombuffer(r["vectors"], np.int64), "scores": r["scores"], "thresholds": r["thresholds"]})
                    if len(pack) >= PACK:
                        yield from answer()
    yield from answer()


def _against_blocks(asking: DataFrame, built: DataFrame, numbers: DataFrame, blocks: int, k: int) -> DataFrame:
    """Anchors, ``row, size, label, vectors, scores, thresholds``, searched in every block of their length."""
    none = lambda kind: F.lit(None).cast(kind)
    dealt = asking.withColumn("number", F.explode(F.sequence(F.lit(1), F.lit(blocks)))).join(numbers, "number")
    columns = ["block", "kind", "size", "ids", "labels", "vectors", "row", "label", "scores", "thresholds"]
    stored = built.where(F.col("kind") == KIND_BLOCK).withColumns({"scores": none("array<long>"), "thresholds": none("array<double>")}).select(*columns)
    asked = dealt.withColumns({"kind": F.lit(KIND_ANCHOR), "ids": none("binary"), "labels": none("binary")}).select(*columns)
    return stored.unionByName(asked).repartition("block").sortWithinPartitions("block", "kind").mapInArrow(partial(_search, k=k), FOUND)


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 5, percent: int = 80, every: int = 100, scale: int = 256,
                   vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become floor(scale * x); a score is the whole inner product; higher scores come first,
    then smaller ids.  Anchors are rows whose id is divisible by ``every``; their positives are the
    first other rows of their label, and a positive's negatives the first rows of other labels whose score lies
    between ``percent`` % of the positive's score and that score.  A negative positive's score leaves no such range.

    Rows with a null id, label or vector, an empty vector, or a component that is null or not finite take no
    part.  Vectors are compared with those of their own length.  Rows repeating an id are rows of
    their own: an anchor leaves out itself alone.  Fewer candidates give fewer rows; an
    empty table gives none; other columns are ignored.  Scores from 2**53 on are refused.

    Every block of rows (of fixed bytes) meets every anchor, anchor by anchor in one stream, so neither rows
    nor anchors pile up in a task; rows of one label spread over all blocks.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), integers(vector, scale).alias("vector"))
    source = source.where("vec_id is not null and label is not null and vector is not null")
    celled = source.mapInArrow(_cells, "size int, cell int, share double, vec_id long, label long, vector array<long>")
    order = ["size", "cell", "share", "vec_id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    built = durable(celled.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(partial(_build, every=every, positives=positives), BUILT_SQL))
    # one row per block of megabytes: numbered in one short list
    numbers = built.where(F.col("kind") == KIND_BLOCK).select("block", F.row_number().over(Window.orderBy("block")).alias("number"))
    blocks = numbers.count()
    anchors = built.where(F.col("kind") == KIND_ANCHOR).select("row", "size", "label", "vectors", "anchor_id", "threshold")
    if not blocks:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

    search = partial(_against_blocks, built=built, numbers=numbers, blocks=blocks)
    first = anchors.select("row", "size", "label", "vectors", F.lit(None).cast("array<long>").alias("scores"), F.array("threshold").alias("thresholds"))
    nearest = top_k(search(first, k=positives).drop("positive_score"), ["row"], [F.desc("score"), "vec_id"], positives)
    found = durable(nearest.select("row", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    low = F.expr(f"cast(ceil({percent} * positive_score / cast(100 as decimal(3, 0))) as long)")
    open_windows, settled = found.where("positive_score >= 0").select("row", "positive_score").distinct().withColumn("low", low), []
    for step in (*STEPS, None):
        threshold = F.col("low") if step is None else F.greatest("low", F.col("positive_score") - F.ceil(F.col("positive_score") / step))
        asked = durable(open_windows.withColumn("threshold", threshold.cast("double")))
        if asked.isEmpty():
            break
        listed = asked.groupBy("row").agg(F.collect_list(F.struct("positive_score", "threshold")).alias("windows"))  # at most ``positives`` of an anchor
        asking = anchors.drop("threshold", "anchor_id").join(listed, "row").select(
            "row", "size", "label", "vectors", F.col("windows.positive_score").alias("scores"), F.col("windows.threshold").alias("thresholds"))
        window = ["row", "positive_score"]
        hits = durable(top_k(search(asking, k=negatives), window, [F.desc("score"), "vec_id"], negatives))
        full = hits.groupBy(*window).agg(F.count(F.lit(1)).alias("n")).join(asked, window, "right").withColumn(
            "done", (F.coalesce("n", F.lit(0)) >= negatives) | (F.col("threshold") <= F.col("low")))
        settled.append(hits.join(full.where("done").select(*window), window))
        open_windows = full.where("not done").select(*window, "low")
    if not settled:
        settled = [spark.createDataFrame([], "row long, positive_score long, vec_id long, score long, rank int")]
    mined = settled[0]
    for more in settled[1:]:
        mined = mined.unionByName(more)
    return found.join(mined, ["row", "positive_score"]).join(anchors.select("row", "anchor_id"), "row").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
