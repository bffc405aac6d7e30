"""Cache admission, reuse, rebinding, duplicates and retrieval against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reapline.functions.text import word_set
from reapline.operators import caches, retrieval

def now():
    return F.lit("2026-07-21T12:00:00").cast("timestamp")
CANDIDATE = "kind string, cache_id string, score double, created_at string, fingerprint_version string"


def reasons(spark, rows, failed=(), **options):
    df = spark.createDataFrame(rows, CANDIDATE)
    bad = spark.createDataFrame([(f,) for f in failed], "cache_id string")
    out = caches.admit(df, {k: options.pop("threshold", 0.9) for k in ("action", "code", "dom")}, options.pop("ttl", {"action": 24, "code": 48, "dom": 12}), now(), bad, **options)
    return {r.cache_id: r.reason for r in out.collect()}


def test_admission_reasons(spark):
    assert reasons(spark, [("action", "bad", 0.99, "2026-07-21T08:00:00+00:00", "sf2")], ["bad"]) == {"bad": "failed_quarantine"}
    assert reasons(spark, [("dom", "old", 0.99, "2026-07-20T12:00:00+00:00", "sf2")]) == {"old": "expired"}
    started = F.lit("2026-07-21T10:00:00").cast("timestamp")
    assert reasons(spark, [("code", "new", 0.99, "2026-07-21T11:00:00+00:00", "sf2")], task_started_at=started) == {"new": "same_run_write"}
    assert reasons(spark, [("action", "v1", 0.99, "2026-07-21T08:00:00+00:00", "sf1")], required_version="sf2") == {"v1": "fingerprint_version_mismatch"}


def test_admission_of_several(spark):
    at = "2026-07-21T09:00:00+00:00"
    rows = [("code", "low", 0.7, at, ""), ("code", "good", 0.98, at, ""), ("code", "failed", 0.99, at, "")]
    assert reasons(spark, rows, ["failed"]) == {"low": "below_threshold", "good": "eligible", "failed": "failed_quarantine"}


def test_legacy_candidate(spark):
    rows = [("action", "legacy", 1.0, None, None)]
    assert reasons(spark, rows, ttl={"action": 1}, threshold=0.95, required_version="sf2", allow_legacy=True) == {"legacy": "eligible"}


def test_unverified_and_failed_actions_are_not_reused(spark):
    words = word_set(F.lit("extract products title"))
    cache = spark.createDataFrame(
        [("ok", "example.test", True, 0), ("unverified", "example.test", False, 0), ("failed", "example.test", True, 2), ("other", "else.test", True, 0)],
        "cache_id string, domain_key string, is_success boolean, failure_count int",
    ).withColumn("words", words)
    requests = spark.createDataFrame([(1, "example.test")], "request_id int, domain_key string").withColumn("words", word_set(F.lit("extract the title")))
    got = caches.jaccard_lookup(requests, cache).collect()
    assert [(r.cache_id, r.score) for r in got] == [("ok", 0.5)]


def test_hot_site_lookup_equals_brute_force(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", [f"w{(i * j) % 23}" for j in range(1, 6)]) for i in range(120)]
    df = spark.createDataFrame(rows, "cache_id int, domain_key string, words array<string>").withColumns({"is_success": F.lit(True), "failure_count": F.lit(0)})
    requests = df.where("cache_id % 10 = 0").select(F.col("cache_id").alias("request_id"), "domain_key", "words")
    got = {}
    for r in caches.jaccard_lookup(requests, df, 4).collect():
        got.setdefault(r.request_id, {})[r["rank"]] = (r.score, r.cache_id)
    for i, d, w in rows[::10]:
        scored = []
        for c, d2, w2 in rows:
            a, b = set(w), set(w2)
            if d == d2 and a & b:
                scored.append((-round(len(a & b) / len(a | b), 6), c))
        assert [got[i][k] for k in sorted(got[i])] == [(-s, c) for s, c in sorted(scored)[:4]]


def test_rebind_targets(spark):
    kind = "request_id int, snapshot_id string, ref string, capability string, descriptor map<string,string>, ordinal int, control_ordinal int"
    stored = spark.createDataFrame(
        [
            (1, "s", "e1", "forms", {"name": "Go", "role": "button"}, 0, None), (2, "s", "e9", "forms", {"name": "Only"}, 0, None),
            (3, "s", "e8", "forms", {"name": "Twin"}, 3, None), (4, "s", "e7", "forms", {"name": "Gone"}, 0, None), (5, "s", "e8", "forms", {"name": "Twin"}, 7, None),
        ],
        kind,
    )
    current = spark.createDataFrame(
        [
            ("s", "e1", "forms", {"name": "Go", "role": "button", "tag": "b"}, 0, None), ("s", "e2", "forms", {"name": "Only"}, 1, None),
            ("s", "e3", "forms", {"name": "Twin"}, 2, None), ("s", "e4", "forms", {"name": "Twin"}, 3, None),
        ],
        "snapshot_id string, ref string, capability string, descriptor map<string,string>, ordinal int, control_ordinal int",
    )
    got = {r.request_id: (r.rebound_ref, r.rebound_by) for r in caches.rebind_targets(stored, current).collect()}
    assert got == {1: ("e1", "same"), 2: ("e2", "descriptor"), 3: ("e4", "position"), 4: (None, None), 5: (None, None)}


def test_rebind_targets_against_every_pair(spark):
    rng = random.Random(5)
    kind = "snapshot_id string, ref string, capability string, descriptor map<string,string>, ordinal int, control_ordinal int"

    def row(i):
        held = {k: rng.choice(["a", "b", "", None]) for k in ("name", "role", "tag") if rng.random() < 0.7}
        return (rng.choice(["s", "t", None]), f"e{i % 25}", rng.choice(["x", "y", None]), None if rng.random() < 0.05 else held, rng.choice([0, 1, 2, 3, None]), rng.choice([0, None]))

    now, asked = [row(i) for i in range(60)], [(i, *row(i)) for i in range(120)]
    stored = spark.createDataFrame(asked, "request_id int, " + kind)
    got = {r.request_id: (r.rebound_ref, r.rebound_by) for r in caches.rebind_targets(stored, spark.createDataFrame(now, kind)).collect()}

    def match(d, c, capability, place):
        filled = {k: v for k, v in d.items() if v}
        return bool(filled) and c == capability and all((place or {}).get(k) == v for k, v in filled.items())

    for i, s, ref, c, d, o, co in asked:
        page = [n for n in now if s is not None and n[0] == s]
        if any(n[1] == ref and (d is None or match(d, c, n[2], n[3])) for n in page):
            want = (ref, "same")
        else:
            hits = [n for n in page if d is not None and match(d, c, n[2], n[3])]
            near = [n for n in hits if n[4:] == (o, co)]
            want = (hits[0][1], "descriptor") if len(hits) == 1 else (near[0][1], "position") if len(near) == 1 else (None, None)
        assert got[i] == want, (i, got[i], want)
    assert {how for _, how in got.values()} == {"same", "descriptor", "position", None}
    assert caches.rebind_targets(stored, spark.createDataFrame([], kind)).where("rebound_ref is not null").count() == 0


def test_rebind_targets_by_kind_takes_one_exchange(spark, monkeypatch):
    kind = "snapshot_id string, ref string, capability string, descriptor map<string,string>, ordinal int, control_ordinal int"
    now = [("s", f"e{i}", "x", {"name": "ab"[i % 2], "role": str(i // 2), "tag": "t"}, i % 3, None) for i in range(12)]
    asked = [(i, "s", f"e{i % 5}", "x", {k: v for k, v in (("name", "ab"[i % 2]), ("role", str(i // 4)), ("tag", "t")) if i % 7 != len(k)}, 1, None) for i in range(40)]
    stored, current = spark.createDataFrame(asked, "request_id int, " + kind), spark.createDataFrame(now, kind)
    common = caches.rebind_targets(stored, current)
    assert common._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    rows = lambda df: sorted((r.request_id, r.rebound_ref or "", r.rebound_by or "") for r in df.collect())
    odd = spark.createDataFrame([(1, "s", "g", "x", {"a": "=b"}, 1, None), (2, "s", "g", "x", {"a=": "b"}, 1, None)], "request_id int, " + kind)
    assert rows(caches.rebind_targets(odd, spark.createDataFrame([("s", "f", "x", {"a": "=b"}, 1, None)], kind))) == [(1, "f", "descriptor"), (2, "", "")]
    monkeypatch.setattr(caches, "KINDS", 1)  # the others by their rarest entry
    few = caches.rebind_targets(stored, current)
    assert rows(common) == rows(few) and len({r[2] for r in rows(few)}) > 2


def test_near_duplicates_compare_with_earlier_entries(spark):
    new = spark.createDataFrame([(1, "d", [1.0, 0.0]), (2, "d", [1.0, 0.01]), (3, "d", [0.0, 1.0]), (4, "x", [1.0, 0.0])], "entry_id int, domain_key string, v array<double>")
    cache = spark.createDataFrame([("c", "d", [0.0, 2.0])], "cache_id string, domain_key string, v array<double>")
    got = {r.entry_id: r.is_duplicate for r in caches.near_duplicates(new, cache, ("v",), (1.0,)).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False}


def test_weighted_lookup_equals_weighted_cosines(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "d", rng.normal(size=4).tolist(), rng.normal(size=3).tolist()) for i in range(30)]
    cache = spark.createDataFrame(rows, "cache_id int, domain_key string, a array<double>, b array<double>")
    requests = cache.where("cache_id < 3").withColumnRenamed("cache_id", "request_id")
    got = {}
    for r in caches.multi_vector_lookup(requests, cache, ("a", "b"), (0.7, 0.3), 5).collect():
        got.setdefault(r.request_id, {})[r["rank"]] = r.cache_id
    cos = lambda x, y: float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
    for i, _, a, b in rows[:3]:
        want = sorted(rows, key=lambda r: (-round(0.7 * cos(a, r[2]) + 0.3 * cos(b, r[3]), 6), r[0]))[:5]
        assert [got[i][k] for k in sorted(got[i])] == [r[0] for r in want]


def test_dense_topk_in_several_query_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id int, vector array<double>").repartition(3)
    queries = docs.where("doc_id < 9").withColumnRenamed("doc_id", "query_id")
    one = retrieval.dense_topk(docs, queries, 4).orderBy("query_id", "rank").collect()
    many = retrieval.dense_topk(docs, queries, 4, block_rows=2).orderBy("query_id", "rank").collect()
    assert one == many
    assert [r.doc_id for r in one if r["rank"] == 1] == list(range(9))


def test_mmr_equals_greedy_selection(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id int, vector array<double>")
    q = rng.normal(size=5)
    queries = spark.createDataFrame([(0, q.tolist())], "query_id int, vector array<double>")
    got = [r.doc_id for r in sorted(retrieval.mmr(docs, queries, 5).collect(), key=lambda r: r["rank"])]
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rel = v @ (q / np.linalg.norm(q))
    pool = sorted(range(40), key=lambda i: (-round(rel[i], 6), i))[:10]
    chosen = [pool[0]]
    while len(chosen) < 5:
        chosen.append(max((i for i in pool if i not in chosen), key=lambda i: 0.6 * rel[i] - 0.4 * max(v[i] @ v[j] for j in chosen)))
    assert got == chosen


def test_bm25_on_a_few_texts(spark):
    texts = ["red fox", "red red dog", "blue whale 鲸鱼", "green tea", "old man"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    queries = spark.createDataFrame([(0, "Red fox"), (1, "鲸鱼")], "query_id int, text string")
    got = retrieval.bm25(docs, queries, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(0, 0), (0, 1), (1, 2)]
    avg = (2 + 3 + 3 + 2 + 2) / 5
    idf = lambda df: math.log(5 - df + 0.5) - math.log(df + 0.5)
    part = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got[0].score == pytest.approx(idf(2) * part(1, 2) + idf(1) * part(1, 2), abs=1e-6)


def test_locator_overlap(spark):
    failed = spark.createDataFrame([("r", "css: .a"), ("r", "x"), ("q", "")], "run_id string, failed_locator string")
    known = spark.createDataFrame([("r", "CSS:.a.b"), ("q", "y")], "run_id string, locator string")
    got = {(r.run_id, r.failed_locator): r.overlaps for r in caches.locator_overlap(failed, known).collect()}
    assert got == {("r", "css: .a"): True, ("r", "x"): False, ("q", ""): False}


def test_quarantine_and_expiry_come_before_k(spark):
    v = [1.0, 0.0]
    cache = spark.createDataFrame(
        [(i, "a", v, v, v, v, "2020-01-01T00:00:00" if i < 40 else "2030-01-01T00:00:00") for i in range(41)],
        "cache_id long, domain_key string, task_vector array<double>, goal_vector array<double>, dom_vector array<double>, step_vector array<double>, expire_at string",
    )
    asked = cache.where("cache_id = 40").withColumnRenamed("cache_id", "request_id").drop("expire_at")
    now = F.lit("2024-01-01").cast("timestamp")
    assert [r.cache_id for r in caches.staged_dom_lookup(asked, cache, now, 3).collect()] == [40]
    failed = cache.where("cache_id < 40").select(F.lit("codecache").alias("cache_type"), "domain_key", "cache_id", F.lit("2030-01-01").cast("timestamp").alias("expire_at"))
    assert [r.cache_id for r in caches.staged_code_lookup(asked, cache, 3, failed, now).collect()] == [40]


def test_near_entries_with_another_goal_hide_nothing(spark):
    same, other = [1.0, 0.0], [0.0, 1.0]
    cache = spark.createDataFrame([(i, "a", same, other if i < 40 else same) for i in range(41)], "cache_id long, domain_key string, task_vector array<double>, goal_vector array<double>")
    asked = spark.createDataFrame([(1, "a", same, same)], "request_id long, domain_key string, task_vector array<double>, goal_vector array<double>")
    assert [r.cache_id for r in caches.staged_code_lookup(asked, cache).collect()] == [40]


def test_keyword_search_tasks_are_bounded_by_documents(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TASK_DOCS", 3, raising=False)
    docs = spark.createDataFrame([(i, f"red fox {'blue ' * (i % 4)}hen{i % 5}") for i in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "blue hen3"), (2, "nothing")], "query_id long, text string")
    hits = retrieval.bm25(docs, asked, 4)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_doc" in plan and ", 20), REPARTITION_BY_NUM" in plan
    rows = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    found = rows(hits)
    monkeypatch.setattr(retrieval, "TASK_DOCS", 10_000, raising=False)
    assert len(found) == 4 and found == rows(retrieval.bm25(docs, asked, 4))
