"""Blocked windows, anchored chains and exact medians against plain computations."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from reapline.operators import access, runs
from reapline.plans.anchors import anchor_chain
from reapline.plans.blocked import Blocked, number_block
from reapline.plans.ranking import first_per_key, last_per_key, top_k

SECOND = 1_000_000
COMMON = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


@COMMON
@given(rows=st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60), st.one_of(st.none(), st.integers(-5, 5))), min_size=1, max_size=40, unique_by=lambda r: (r[0], r[1])))
def test_blocked_equals_plain_window(spark, rows):
    df = spark.createDataFrame(rows, "k string, o long, v long")
    b = Blocked(["k"], ["o"], number_block("o", 7))
    got = b.lag(df, {"p": "v"})
    got = b.running(got, {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v")), "n": ("count", F.lit(1))})
    got = b.done(b.streak(got, "run", ~F.col("v").eqNullSafe(F.col("p"))))
    w = Window.partitionBy("k").orderBy("o")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumns(
        {
            "p": F.lag("v").over(w), "s": F.coalesce(F.sum("v").over(upto), F.lit(0)), "m": F.max("v").over(upto),
            "l": F.last("v", ignorenulls=True).over(upto), "n": F.row_number().over(w).cast("long"),
        }
    )
    plain = plain.withColumn("_c", F.sum((~F.col("v").eqNullSafe(F.col("p"))).cast("int")).over(upto))
    plain = plain.withColumn("run", F.row_number().over(Window.partitionBy("k", "_c").orderBy("o")).cast("long")).drop("_c")
    order = ["k", "o"]
    assert got.select(*plain.columns).orderBy(*order).collect() == plain.orderBy(*order).collect()


def chain_by_hand(times, width):
    anchors, end = [], None
    for t in sorted(set(times)):
        if end is None or t >= end:
            anchors.append(t)
            end = t + width
    return anchors


@pytest.mark.parametrize("seed", range(2))
def test_anchor_chain_equals_fold(spark, seed):
    rng = random.Random(seed)
    width = rng.choice([5, 60, 100])
    rows = [(k, rng.randrange(0, rng.choice([90, 4000]))) for k in "abc" for _ in range(rng.choice([1, 30, 300]))]
    df = spark.createDataFrame(rows, "k string, t long")
    got = {}
    for r in anchor_chain(df, ["k"], "t", width).collect():
        got.setdefault(r.k, []).append(r.t)
    assert {k: sorted(v) for k, v in got.items()} == {k: chain_by_hand([t for q, t in rows if q == k], width) for k in "abc"}


def ledger_by_hand(events, max_requests, window):
    state, out = {}, {}
    for d, t, seq, kind, interval, cooldown in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        started, used, last, cool = state.get(d, (None, 0, None, None))
        if kind == "response":
            if cooldown is not None:
                started = t if started is None else started
                cool = t + cooldown if cool is None else max(cool, t + cooldown)
                state[d] = (started, used, last, cool)
            continue
        if cool is not None and t < cool:
            out[seq] = ("domain_cooldown", 0)
            continue
        if started is None or t - started >= window:
            started, used = t, 0
        if used >= max_requests:
            out[seq] = ("domain_request_budget_exhausted", 0)
            continue
        start = t if last is None else max(t, last + interval)
        out[seq] = ("allowed", start - t)
        state[d] = (started, used + 1, start, cool)
    return out


EVENTS = "domain string, t long, seq long, kind string, interval_us long, cooldown_us long"


def random_events(seed):
    rng = random.Random(seed)
    rows = []
    for seq in range(160):
        kind = "response" if rng.random() < 0.1 else "request"
        # One site holds most of the rows.
        rows.append(
            (rng.choice("aaaab"), rng.randrange(0, 900) * SECOND, seq, kind, rng.choice([0, 2, 7]) * SECOND if kind == "request" else None,
             rng.choice([None, 30, 50]) and rng.choice([30, 50]) * SECOND if kind == "response" else None)
        )
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_batch_ledger_equals_fold(spark, seed):
    events = random_events(seed)
    df = access.access_ledger(spark.createDataFrame(events, EVENTS), max_requests=4, window_seconds=60)
    got = {r.seq: (r.reason, r.waited_us) for r in df.collect()}
    assert got == ledger_by_hand(events, 4, 60 * SECOND)


def test_refusal_before_first_request_opens_window(spark):
    events = [("a", 0, 0, "response", None, 10 * SECOND), ("a", 5 * SECOND, 1, "request", 0, None), ("a", 20 * SECOND, 2, "request", 0, None), ("a", 61 * SECOND, 3, "request", 0, None)]
    df = access.access_ledger(spark.createDataFrame(events, EVENTS), max_requests=1, window_seconds=60)
    assert {r.seq: r.reason for r in df.collect()} == {1: "domain_cooldown", 2: "allowed", 3: "allowed"}


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0, 1.0, 9.0, 1.0], [2.0] * 7, [float(i * i % 97) for i in range(101)]])
def test_exact_median(spark, values):
    import statistics

    df = spark.createDataFrame([(v,) for v in values], "v double")
    for within in (1, 3, 1000):
        assert runs.exact_median(df, "v", within).first()[0] == statistics.median(values)


def test_exact_median_of_uneven_values(spark):
    import statistics

    near = [(i * 7919 % 30011) * 1e-9 for i in range(30_000)]
    values = [-1e300, *near, *[near[5]] * 9_000, 1e12, 1e300]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for within, intervals in ((1, 16), (50, 256), (100_000, 256)):
        assert runs.exact_median(df, "v", within, intervals).first()[0] == statistics.median(values)
    assert runs.exact_median(df.where("v is null"), "v").first()[0] is None


def test_per_key_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, o int, v string")
    assert {r.k: r.v for r in first_per_key(df, ["k"], ["o"]).collect()} == {"a": "x", "b": "z"}
    assert {r.k: r.v for r in last_per_key(df, ["k"], ["o"]).collect()} == {"a": "y", "b": "z"}


def test_top_k_is_limited_before_the_exchange(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    plan = top_k(df, ["k"], [F.desc("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert "Partial" in plan


def test_blocked_scan_shuffles_rows_by_block(spark):
    b = Blocked(["id"], ["o"], number_block("o", 10))
    df = spark.range(100).withColumn("o", F.col("id"))
    plan = b.running(df, {"s": ("sum", F.lit(1))})._jdf.queryExecution().executedPlan().toString()
    assert "_block" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
