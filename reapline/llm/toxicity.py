"""Toxicity: ordinal regression with cumulative links over sparse text features."""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reapline.llm.common import held_out
from reapline.llm.features import BITS, begin, text_features
from reapline.llm.quality import FEATURISED, featurise, labelled_sample

SAMPLE = 20_000  # labelled rows that train a model, at most
TEXTS, DEVIATIONS = 3, 3.0  # a word is used if in so many labelled texts, with a mean grade so many standard deviations off


class OrdinalModel:
    """P(grade >= j) = sigmoid(w.x - theta_j) with one weight vector for all thresholds theta_1 <= theta_2 <= ..."""

    def __init__(self, grades: list[int], thresholds: np.ndarray, weights: np.ndarray | None):
        self.grades, self.thresholds, self.weights = grades, thresholds, weights

    @classmethod
    def fit(cls, rows: list[tuple[int, np.ndarray]], epochs: int = 24, rate: float = 0.3, l1: float = 2e-5, batch: int = 64) -> OrdinalModel:
        """Proximal AdaGrad on the sum of the thresholds' logistic losses.

        Only words whose texts have clearly other grades than the rest get a weight, so that
        long texts gather no noise; the L1 step keeps weights small.  Rows are (grade, features) in a fixed order.  A single grade, or none, gives a constant.
        """
        grades = sorted({g for g, _ in rows}) or [0]
        if len(grades) == 1:
            return cls(grades, np.zeros(0), None)
        level = np.array([grades.index(g) for g, _ in rows])
        k = len(grades) - 1
        size = 1 << BITS
        every, of = np.concatenate([f for _, f in rows]), np.repeat(level, [len(f) for _, f in rows])
        texts = np.bincount(every, minlength=size)
        off = np.bincount(every, of, size) - texts * level.mean()
        telling = (texts >= TEXTS) & (np.abs(off) >= DEVIATIONS * np.sqrt(texts * level.var()))
        share = np.array([(level > j).mean() for j in range(k)])
        thresholds = -np.log(share / (1 - share))
        weights, seen, seen_t = np.zeros(size), np.full(size, 1e-2), np.full(k, 1e-2)
        rng = np.random.default_rng(11)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for start in range(0, len(order), batch):
                chosen = order[start : start + batch]
                parts = [rows[i][1][telling[rows[i][1]]] for i in chosen]
                lengths = np.array([len(p) for p in parts])
                features, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), lengths)
                raw = np.bincount(owner, weights[features], len(parts))
                error = 1 / (1 + np.exp(-np.clip(raw[:, None] - thresholds, -40, 40))) - (level[chosen][:, None] > np.arange(k))
                used, where = np.unique(features, return_inverse=True)
                if not len(used):
                    continue
                g = np.bincount(where, error.sum(axis=1)[owner], len(used))
                seen[used] += g**2
                step = rate / np.sqrt(seen[used])
                moved = weights[used] - step * g
                weights[used] = np.sign(moved) * np.maximum(0, np.abs(moved) - step * l1 * len(chosen))
                gt = -error.sum(axis=0)
                seen_t += gt**2
                thresholds = np.maximum.accumulate(thresholds - rate * gt / np.sqrt(seen_t))
        return cls(grades, thresholds, weights)

    def chances(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(grade >= j) for every grade but the lowest; columns never grow with j."""
        if self.weights is None:
            return np.zeros((len(rows), 0))
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        raw = np.bincount(owner, self.weights[np.concatenate(rows)], len(rows)) if len(owner) else np.zeros(len(rows))
        return 1 / (1 + np.exp(-np.clip(raw[:, None] - self.thresholds, -40, 40)))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, grades=self.grades, thresholds=self.thresholds, **({} if self.weights is None else {"weights": self.weights}))
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> OrdinalModel:
        with np.load(io.BytesIO(data)) as z:
            return cls(z["grades"].tolist(), z["thresholds"], z["weights"] if "weights" in z else None)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        for order, label, features in zip(*(batch.column(i) for i in range(3))):
            rows.append((order.as_py(), label.as_py(), features.values.to_numpy()))
    rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
    yield pa.record_batch([pa.array([OrdinalModel.fit([r[1:] for r in rows]).dump()], pa.binary())], ["model"])


def train_toxicity(documents: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = SAMPLE) -> bytes:
    """A model trained in one task on at most ``limit`` labelled rows outside the held-out fold."""
    sample = labelled_sample(documents.select("doc_id", F.col("text").cast("string").alias("text")), labels, label, limit)
    rows = sample.select(F.xxhash64("doc_id", "text").alias("_order"), "_label", "text").mapInArrow(partial(featurise, metadata=(), shape=False), FEATURISED)
    found = rows.repartition(1).mapInArrow(_fit, "model binary").collect()
    return bytes(found[0].model) if found else OrdinalModel.fit([]).dump()


def _grade(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    begin()
    machine = OrdinalModel.load(model.value)
    grades = np.array(machine.grades)
    for batch in batches:
        for start in range(0, batch.num_rows, 128):
            part = batch.slice(start, 128)
            above = machine.chances([text_features(t.as_py(), shape=False)[0] for t in part.column(1)])
            expected = grades[0] + above @ np.diff(grades)
            grade = grades[(above >= 0.5).sum(axis=1)]
            score = above[:, 0] if above.shape[1] else np.full(part.num_rows, float(grades[0] > 0))
            yield pa.record_batch(
                [part.column(0), pa.array(score, pa.float64()), pa.array(expected.astype(float)), pa.array(grade, pa.int32()), pa.array((grade > 0).astype(np.int32))],
                ["doc_id", "score", "severity", "grade", "predicted"])


def toxicity(documents: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """``doc_id, held_out, score, severity, grade, predicted`` of every whole text.

    ``score`` is the chance of any grade above the lowest, ``severity`` the expected grade,
    ``grade`` the highest one whose threshold is passed with a chance of one half,
    ``predicted`` 1 if that is above 0.  Only words are inputs.  Null and empty texts have
    no word and get the base rate.  Of several labels of one id the smallest counts.
    Without labels everything has grade 0; null ids are scored too, repeated rows alike;
    other columns are ignored; an empty table gives no row.
    """
    model = documents.sparkSession.sparkContext.broadcast(train_toxicity(documents, labels, label))  # a few megabytes at most
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = source.mapInArrow(partial(_grade, model=model), "doc_id long, score double, severity double, grade int, predicted int")
    return found.select("doc_id", held_out().alias("held_out"), "score", "severity", "grade", "predicted")
