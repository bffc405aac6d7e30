"""Hard negatives against all pairs, pruning on random blocks, and odd rows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from reapline.llm.negatives import Index, hard_negatives
from reapline.llm.queries import QUERIES


def brute_force(rows, positives=5, negatives=5, percent=80, every=100, scale=256):
    held = [(i, l, [math.floor(scale * x) for x in v]) for i, l, v in rows
            if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (anchor, label, q) in enumerate(held):
        if anchor % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i, l == label) for j, (i, l, v) in enumerate(held) if j != k and len(v) == len(q))
        for score, positive, _ in [s for s in scored if s[2]][:positives]:
            fitting = [s for s in scored if not s[2] and percent * -score <= 100 * -s[0] <= 100 * -score][:negatives]
            out += [(anchor, positive, r, i, -score, -s) for r, (s, i, _) in enumerate(fitting, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_odd_rows(spark):
    """Nulls, NaN, infinity, empty and shorter vectors, repeated ids and rows, ties, clashing columns, an empty table."""
    rng = random.Random(4)
    rows = [(i, i % 4, [rng.choice([0.0, 0.25, 0.5, 1.0, -0.3]) for _ in range(6)]) for i in range(400)]
    rows += [(400, None, [1.0] * 6), (None, 1, [1.0] * 6), (500, 1, None), (500, 1, []), (600, 1, [None] * 6), (600, 1, [float("nan")] * 6), (600, 2, [float("inf")] * 6)]
    rows += [(700, 1, [1.0, 2.0, 3.0]), (701, 1, [1.0, 2.0, 2.0]), (702, 2, [1.0, 2.0, 2.0]), (703, 2, [0.5, 1.0, 1.0])]
    rows += [(0, 0, [1.0] * 6), (100, 0, [0.5] * 6), (100, 0, [0.5] * 6), (801, 3, [0.5] * 6), (801, 3, [0.5] * 6), (1000, 9, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("x") for c in ("row", "block", "kind", "score", "low", "cell")})
    expected = brute_force(rows)
    assert len(expected) > 60 and rows_of(hard_negatives(df)) == expected
    assert rows_of(hard_negatives(df, positives=2, negatives=3, percent=0, every=50)) == brute_force(rows, 2, 3, 0, 50)
    assert hard_negatives(df.where("vec_id = -1")).count() == 0
    assert hard_negatives(df.where("vec_id = 1000")).count() == 0


def test_windows_that_fill_only_after_lowering(spark):
    """Negatives far under the positive's score, close under it, and none at all."""
    rows = [(0, 0, [1.0, 0.0]), (1, 0, [8.0, 0.0]), (2, 0, [4.0, 0.0])]
    rows += [(10 + k, 1, [8.0 * (1 - 0.02 * k), float(k)]) for k in range(30)]
    assert rows_of(hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))) == brute_force(rows)


def test_pruned_index_finds_all():
    rng = np.random.default_rng(2)
    vectors = rng.integers(-40, 41, (500, 20))
    vectors[:, 3] *= 9
    index = Index(1, np.arange(500), np.zeros(500, np.int64), vectors)
    for _ in range(50):
        q = rng.integers(-40, 41, 20)
        scores = vectors @ q
        for threshold in (np.quantile(scores, 0.99), np.quantile(scores, 0.5), 0.0, -np.inf):
            index.prune(threshold, float(np.linalg.norm(q)) * 1.5)
            rows, found = index.above(q, np.ones(500, bool), threshold)
            assert rows.tolist() == np.flatnonzero(scores >= threshold).tolist() and (found == scores[rows]).all()
    index.prune(np.linalg.norm(vectors, axis=1).max() * 50, 40.0)
    assert not index.indexed.any()


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    relabelled = [(i, (l + 1) % 10 if i % 7 == 0 else l, v) for i, l, v in rows]
    assert rows_of(QUERIES["op11_hard_negatives"](spark, folder)) == brute_force(relabelled)
