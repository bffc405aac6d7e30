"""Block searches against all pairs: small blocks, ties, parts, entries without a site."""

import random

import numpy as np
from pyspark.sql import functions as F

from reapline.operators import caches, retrieval
from reapline.plans import blocks


def test_vectors_in_small_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(300)]
    rows = [r for r in rows if any(r[2])] + [(900, 0, None)]
    df = spark.createDataFrame(rows, "id long, part int, vector array<double>")
    asked = df.where("id % 7 = 0").withColumnRenamed("id", "query_id")
    for part in (None, "part"):
        for other in (False, True):
            got = retrieval.dense_topk(df, asked, 4, doc_id="id", part=part, block_rows=16, other_rows=other).collect()
            expected = []
            for q, p, v in rows:
                if q % 7 or v is None:
                    continue
                scored = sorted((-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 6), i) for i, o, w in rows
                                if w is not None and (part is None or o == p) and not (other and i == q))[:4]
                expected += [(q, i, -s + 0.0, r) for r, (s, i) in enumerate(scored, 1)]
            assert sorted((r.query_id, r.id, r.score, r["rank"]) for r in got) == sorted(expected)
    assert retrieval.dense_topk(df.limit(0), asked, 3, doc_id="id").count() == 0
    assert retrieval.dense_topk(df, asked.limit(0), 3, doc_id="id").count() == 0


def test_word_overlaps_in_small_blocks(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(30)]
    made = lambda: rng.sample(words[: rng.choice([5, 12, 30])], rng.randrange(0, 5))
    entries = [(i, rng.choice(["a", "b", "", None]), made(), rng.choice([True, None, False]), rng.choice([0, None, 2])) for i in range(200)]
    requests = [(i, rng.choice(["a", "b", "c", "", None]), made()) for i in range(40)]
    cache = spark.createDataFrame(entries, "cache_id long, domain_key string, words array<string>, is_success boolean, failure_count int")
    asked = spark.createDataFrame(requests, "request_id long, domain_key string, words array<string>")
    expected = []
    for q, site, w in requests:
        scored = []
        for c, own, v, fine, failed in entries:
            shared = len(set(w) & set(v))
            if fine is not False and (failed or 0) < 2 and shared and (not site or not own or site == own):
                scored.append((-np.floor(shared / len(set(w) | set(v)) * 1e6 + 0.5) / 1e6, c))
        expected += [(q, c, -s, r) for r, (s, c) in enumerate(sorted(scored)[:5], 1)]
    got = caches.jaccard_lookup(asked, cache, 5, block_rows=8).collect()
    assert sorted((r.request_id, r.cache_id, r.score, r["rank"]) for r in got) == sorted(expected)
    assert caches.jaccard_lookup(asked, cache.where(F.lit(False))).count() == 0


def test_staged_lookups_in_small_cells(spark, monkeypatch):
    monkeypatch.setattr(caches, "SITE_ROWS", 16, raising=False)
    rng = np.random.default_rng(8)
    names = ("task_vector", "goal_vector", "dom_vector", "step_vector")
    vector = lambda: rng.integers(0, 4, 3).astype(float).tolist()
    rows = [(i, f"s{i % 2}", *[vector() for _ in names]) for i in range(150)]
    odd = [(900, "s0", None, *rows[0][3:]), (901, "s0", [0.0, 0.0, 0.0], *rows[0][3:]), (902, "s0", [1.0, None, 1.0], *rows[0][3:]), (903, "s1", [1.0, 1.0], *rows[0][3:]), (904, None, *rows[0][2:])]
    df = spark.createDataFrame(rows + odd, "cache_id long, domain_key string, " + ", ".join(f"{n} array<double>" for n in names)).withColumn("expire_at", F.lit("2030-01-01"))
    asked = df.where("cache_id % 5 = 0 or cache_id > 800").withColumnRenamed("cache_id", "request_id")

    def cosine(a, b):
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return float(np.dot(a, b) / size) if size > 0 else 0.0

    def expected(score_of, least, best=3):
        out = []
        usual = rows + [odd[-2]]
        for q in [r for r in usual if r[0] % 5 == 0 or r[0] > 800]:
            scored = []
            for c in usual:
                if q[1] == c[1] and len(q[2]) == len(c[2]):
                    task, goal, dom, step = (cosine(a, b) for a, b in zip(q[2:], c[2:]))
                    score = round(score_of(goal, dom, step), 6)
                    if round(task, 6) >= 0.8 and score >= least:
                        scored.append((-score, c[0], round(task, 6)))
            out += [(q[0], c, t, -s, r) for r, (s, c, t) in enumerate(sorted(scored)[:best], 1)]
        return sorted(out)

    found = lambda hits: sorted((r.request_id, r.cache_id, r.task_similarity, r.score, r["rank"]) for r in hits.collect())
    code, dom = caches.staged_code_lookup(asked, df), caches.staged_dom_lookup(asked, df, F.lit("2024-01-01").cast("timestamp"))
    assert found(code) == expected(lambda goal, dom, step: goal, 0.88)
    assert found(dom) == expected(lambda goal, dom, step: dom * 0.65 + step * 0.35, 0.9)
    for hits in (code, dom):
        plan = hits._jdf.queryExecution().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan


def test_word_blocks_are_bounded_by_words(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_WORDS", (40, 40), raising=False)
    monkeypatch.setattr(blocks, "SLICE", 7, raising=False)
    rng = random.Random(9)
    rows = [(i, rng.sample(range(90), rng.choice([3, 20, 60]))) for i in range(90)] + [(i, rows_of) for i in range(90, 97) for rows_of in [list(range(12))]]
    df = spark.createDataFrame(rows, "id long, words array<int>").select("id", F.lit("a").alias("part"), F.transform("words", lambda w: w.cast("string")).alias("words"))
    asked = df.where("id % 4 = 0").select(F.col("id").alias("_row"), "part", "words")
    seen = []
    whole = blocks.best_first
    monkeypatch.setattr(blocks, "best_first", lambda stored, *rest: seen.append(stored) or whole(stored, *rest))
    got = blocks.overlapping_sets(df, asked, 3, "id", 32).collect()
    expected = []
    for q, w in rows:
        scored = [(-np.floor(len(set(w) & set(v)) / len(set(w) | set(v)) * 1e6 + 0.5) / 1e6, i) for i, v in rows if set(w) & set(v)]
        expected += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(scored)[:3], 1) if q % 4 == 0]
    assert sorted((r._row, r.id, r.score, r["rank"]) for r in got) == sorted(expected)
    for r in seen[0].select("ids", F.length("owners").alias("bytes")).collect():
        assert len(r.ids) == 1 or r.bytes <= 40 * 4


def test_shuffled_words_do_not_grow_with_blocks(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "a", [f"w{w}" for w in rng.sample(range(4000), 60)]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, part string, words array<string>")
    asked = df.where("id % 4 = 0").select(F.col("id").alias("_row"), "part", "words")

    def shuffled():
        return sum(e.totalShuffleWrite() for e in map(store.executorList(False).apply, range(store.executorList(False).size())))

    store, written, results = spark.sparkContext._jsc.sc().statusStore(), [], []
    for words in (10**6, 600):
        monkeypatch.setattr(blocks, "BLOCK_WORDS", (words, words))
        before = shuffled()
        results.append(sorted(map(tuple, blocks.overlapping_sets(df, asked, 3, "id", 1000).collect())))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        written.append(shuffled() - before)
    assert results[0] == results[1]
    assert written[1] < 2 * written[0]
