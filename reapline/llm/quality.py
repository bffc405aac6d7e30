"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reapline.llm.common import held_out, rows_of
from reapline.llm.features import BITS, begin, text_features

SAMPLE = 10_000  # labelled rows that train a model, at most
RANK = 8  # length of a feature's interaction vector


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, text, label, other columns) of at most ``limit`` labelled documents outside the held-out fold.

    The sample is the first ``limit`` labelled ids by hash, so it is the same on every run;
    being that small, its ids are sent to all tasks.  Of several labels of one id the
    smallest counts.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).withColumnRenamed("doc_id", "_labelled")
    )
    return documents.join(F.broadcast(ids), documents["doc_id"] == ids["_labelled"]).drop("_labelled")


def featurise(batches: Iterator[pa.RecordBatch], metadata: Sequence[str], shape: bool = True) -> Iterator[pa.RecordBatch]:
    """Rows (order, label, features, values) of labelled texts."""
    begin()
    names = ["_order", "_label", "text", *metadata]
    for order, label, text, *rest in rows_of(batches, names):
        features, values = text_features(text, list(zip(metadata, rest)), shape)
        yield pa.record_batch(
            [pa.array([order], pa.int64()), pa.array([label], pa.int32()), pa.array([features], pa.list_(pa.int64())), pa.array([values], pa.list_(pa.float32()))],
            ["order", "label", "features", "values"])


FEATURISED = "order long, label int, features array<long>, values array<float>"


class FactorisationMachine:
    """Scores w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j in time linear in the features present.

    The pair term is half of |sum v_i x_i|^2 - sum |v_i x_i|^2.
    """

    def __init__(self, bias: float = 0.0, linear: np.ndarray | None = None, factors: np.ndarray | None = None):
        self.bias, self.linear, self.factors = bias, linear, factors

    @staticmethod
    def _sums(features, values, starts, linear, factors):
        weighted = factors[features] * values[:, None]
        total = np.add.reduceat(weighted, starts, axis=0)
        return weighted, total, np.add.reduceat(linear[features] * values, starts) + 0.5 * (total**2 - np.add.reduceat(weighted**2, starts, axis=0)).sum(axis=1)

    @classmethod
    def fit(cls, rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 6, rate: float = 0.15, l2: float = 1e-4, batch: int = 128) -> FactorisationMachine:
        """AdaGrad on the logistic loss; rows are (label, features, values) in a fixed order.

        Without rows every score is 0.5; rows of a single class only move the bias.
        """
        labels = np.array([r[0] > 0 for r in rows], np.float32)
        if len(rows) == 0 or labels.min() == labels.max():
            return cls(0.0 if len(rows) == 0 else float(8 * labels[0] - 4), None, None)
        rng = np.random.default_rng(7)
        size = 1 << BITS
        prior = float(labels.mean())
        model = cls(float(np.log(prior / (1 - prior))), np.zeros(size, np.float32), rng.normal(0, 0.01, (size, RANK)).astype(np.float32))
        seen_w, seen_v, seen_b = np.full(size, 1e-2, np.float32), np.full((size, RANK), 1e-2, np.float32), 1e-2
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for start in range(0, len(order), batch):
                part = [rows[i] for i in order[start : start + batch]]
                features, values = np.concatenate([p[1] for p in part]), np.concatenate([p[2] for p in part])
                lengths = np.array([len(p[1]) for p in part])
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                weighted, total, raw = cls._sums(features, values, starts, model.linear, model.factors)
                error = 1 / (1 + np.exp(-(raw + model.bias))) - labels[order[start : start + batch]]
                owner = np.repeat(np.arange(len(part)), lengths)
                slope = (error[owner] * values).astype(np.float32)
                used, where = np.unique(features, return_inverse=True)
                gw = np.bincount(where, slope, len(used)).astype(np.float32) + l2 * model.linear[used]
                pull = slope[:, None] * (total[owner] - weighted)
                gv = np.stack([np.bincount(where, pull[:, f], len(used)) for f in range(RANK)], axis=1).astype(np.float32) + l2 * model.factors[used]
                seen_w[used] += gw**2
                seen_v[used] += gv**2
                model.linear[used] -= rate * gw / np.sqrt(seen_w[used])
                model.factors[used] -= 0.5 * rate * gv / np.sqrt(seen_v[used])
                gb = float(error.sum())
                seen_b += gb**2
                model.bias -= rate * gb / seen_b**0.5
        return model

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if self.linear is None:
            return np.full(len(rows), 1 / (1 + np.exp(-self.bias)))
        starts = np.concatenate([[0], np.cumsum([len(f) for f, _ in rows])[:-1]]).astype(np.int64)
        raw = self._sums(np.concatenate([f for f, _ in rows]), np.concatenate([v for _, v in rows]), starts, self.linear, self.factors)[2]
        return 1 / (1 + np.exp(-np.clip(raw.astype(np.float64) + self.bias, -40, 40)))

    def dump(self) -> bytes:
        out = io.BytesIO()
        if self.linear is None:
            np.savez_compressed(out, bias=self.bias)
        else:
            np.savez_compressed(out, bias=self.bias, linear=self.linear, factors=self.factors)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> FactorisationMachine:
        with np.load(io.BytesIO(data)) as z:
            return cls(float(z["bias"]), *((z["linear"], z["factors"]) if "linear" in z else (None, None)))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        for order, label, features, values in zip(*(batch.column(i) for i in range(4))):
            rows.append((order.as_py(), label.as_py(), features.values.to_numpy(), values.values.to_numpy()))
    rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
    yield pa.record_batch([pa.array([FactorisationMachine.fit([r[1:] for r in rows]).dump()], pa.binary())], ["model"])


def train_quality(documents: DataFrame, labels: DataFrame, label: str = "quality", metadata: Sequence[str] = (), limit: int = SAMPLE) -> bytes:
    """A model trained in one task on at most ``limit`` labelled rows; only the model's bytes reach the driver."""
    sample = labelled_sample(documents.select("doc_id", F.col("text").cast("string").alias("text"), *metadata), labels, label, limit)
    rows = sample.select(F.xxhash64("doc_id", "text").alias("_order"), "_label", "text", *metadata).mapInArrow(partial(featurise, metadata=tuple(metadata)), FEATURISED)
    found = rows.repartition(1).mapInArrow(_fit, "model binary").collect()
    return bytes(found[0].model) if found else FactorisationMachine().dump()


def _score(batches: Iterator[pa.RecordBatch], model, metadata: Sequence[str]) -> Iterator[pa.RecordBatch]:
    begin()
    machine = FactorisationMachine.load(model.value)
    for batch in batches:
        scores = []
        for start in range(0, batch.num_rows, 128):
            part = batch.slice(start, 128)
            rest = [part.column(i + 2).to_pylist() for i in range(len(metadata))]
            scores.append(machine.score([text_features(t.as_py(), [(m, r[i]) for m, r in zip(metadata, rest)]) for i, t in enumerate(part.column(1))]))
        score = np.concatenate(scores) if scores else np.zeros(0)
        yield pa.record_batch([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])


def score_quality(documents: DataFrame, model: bytes, metadata: Sequence[str] = ()) -> DataFrame:
    """``doc_id, score, predicted`` of every row: the chance that label 1 fits its whole text.

    Null and empty texts are scored like any other, on statistics that are all 0.  Null
    metadata is left out.  The model has a fixed size of at most a few megabytes and is
    sent to every task.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *metadata)
    return source.mapInArrow(partial(_score, model=shared, metadata=tuple(metadata)), "doc_id long, score double, predicted int")


def quality_scores(documents: DataFrame, labels: DataFrame, metadata: Sequence[str] = ("n_chars",)) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, learned from labels outside the held-out fold.

    Inputs of a score are the text and ``metadata``.  Without labels every score is 0.5 and
    every document is kept; rows without an id are scored too; repeated rows get equal
    scores; other columns, whatever their names, are ignored.
    """
    scored = score_quality(documents, train_quality(documents, labels, "quality", metadata), metadata)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_quality(documents: DataFrame, labels: DataFrame, metadata: Sequence[str] = ("n_chars",), least: float = 0.5) -> DataFrame:
    """The rows of ``documents`` with a score of at least ``least``, all columns unchanged."""
    model = documents.sparkSession.sparkContext.broadcast(train_quality(documents, labels, "quality", metadata))
    # every column passes through the tasks, so that no join back by id is needed
    return documents.mapInArrow(partial(_keep, model=model, metadata=tuple(metadata), least=least), documents.schema)


def _keep(batches: Iterator[pa.RecordBatch], model, metadata: Sequence[str], least: float) -> Iterator[pa.RecordBatch]:
    begin()
    machine = FactorisationMachine.load(model.value)
    for batch in batches:
        for start in range(0, batch.num_rows, 128):
            part = batch.slice(start, 128)
            texts = part.column(part.schema.get_field_index("text")).to_pylist()
            rest = [part.column(part.schema.get_field_index(m)).to_pylist() for m in metadata]
            scores = machine.score([text_features(t, [(m, r[i]) for m, r in zip(metadata, rest)]) for i, t in enumerate(texts)])
            yield part.filter(pa.array(scores >= least))
