"""Traces, runs, journeys and verdicts on literal cases."""

import random
from datetime import datetime
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from reapline.operators import journeys, runs, traces, verdicts

TRACE = (
    "id long, thread_id string, event_type string, model string, started_at timestamp, duration_ms double, input_tokens long, output_tokens long, "
    "total_tokens long, estimated_tokens boolean"
)
AT = datetime(2026, 1, 1)


def trace(spark, rows):
    return spark.createDataFrame([(i, t, k, "m", AT, 5.0, a, b, a + b, e) for i, (t, k, a, b, e) in enumerate(rows)], TRACE)


def test_trace_cost(spark):
    prices = spark.createDataFrame([("m", 2.0, 4.0)], "model string, input_per_million double, output_per_million double")
    events = trace(spark, [("t", "llm", 100, 20, False), ("t", "browser_action", 0, 0, False)])
    row = traces.trace_summary(traces.price_usage(events, prices)).first()
    assert (row.total_tokens, row.cost_usd, row.browser_action_count, row.llm_call_count) == (120, 0.00028, 1, 1)
    totals = traces.trace_totals(traces.trace_summary(traces.price_usage(events, prices))).first()
    assert totals.token_precision == "provider_reported"


def test_usage_of_latest_run_only(spark):
    events = trace(spark, [("old", "llm", 80, 20, False), ("new", "llm", 30, 10, False), ("new", "browser_action", 0, 0, False)])
    table = spark.createDataFrame([("case", 1, ["old"]), ("case", 2, ["new"])], "case_key string, pos int, thread_ids array<string>")
    row = traces.usage_by_case(table, events).first()
    assert (row.tokens, row.llm_calls, row.browser_actions) == (40, 1, 1)


RUN = (
    "run_id int, pos int, source_file string, case_key string, model string, status string, exception string, elapsed_seconds double, accuracy_score double, "
    "checks map<string,boolean>, unique_item_count long, session_closed boolean, total_tokens long, input_tokens long, output_tokens long, llm_call_count long, "
    "browser_action_count long, cost_usd double, llm_duration_ms double, estimated_call_count long"
)


def run(i, model, ok, tokens, elapsed, case="example"):
    return (i, i, "f", case, model, "completed" if ok else "failed", None, elapsed, 100.0 if ok else 0.0, {"target_opened": ok, "autonomous_completion": ok}, 2 if ok else 0,
            True, tokens, tokens - 10, 10, 2, 0, 0.0, 1250.0, 0)


def test_model_matrix(spark):
    df = spark.createDataFrame([run(1, "fast", True, 100, 2.0), run(2, "fast", False, 300, 4.0), run(3, "steady", True, 150, 3.0)], RUN)
    rows = {r.model: r for r in runs.model_matrix(df).collect()}
    fast = rows["fast"]
    assert (fast.success_rate, fast.average_tokens, fast.average_elapsed_seconds, fast.llm_duration_seconds) == (50.0, 200.0, 3.0, 2.5)
    assert runs.model_ranking(runs.model_matrix(df)).where("rank = 1").first().model == "steady"


def test_acceptance_needs_repeats(spark):
    df = spark.createDataFrame([run(i, "m", True, 1, 1.0, f"c{i % 5}") for i in range(15)], RUN)
    assert runs.acceptance(df).first().accepted is True
    assert runs.acceptance(df.where("run_id < 14")).first().accepted is False


def test_error_digest_and_missing_cases(spark):
    df = spark.createDataFrame([run(1, "m", True, 1, 1.0)], RUN).withColumn("exception", F.lit(None).cast("string"))
    results = spark.createDataFrame(
        [(1, 1, "timeout", "slow"), (1, 2, "timeout", "slow"), (1, 3, None, "odd"), (1, 4, None, None)], "run_id int, pos long, error_code string, error_message string"
    )
    got = [(r.message, r.times) for r in sorted(runs.error_digest(df, results).collect(), key=lambda r: r.first_pos)]
    assert got == [("timeout: slow", 2), ("error: odd", 1)]
    expected = spark.createDataFrame([("example",), ("other",)], "case_key string")
    assert [r.case_key for r in runs.missing_cases(expected, df).collect()] == ["other"]


def test_streaks_and_stagnation(spark):
    df = spark.createDataFrame([("r", i, e, n) for i, (e, n) in enumerate([("x", 5), ("x", 5), ("y", 5), (None, 9), (None, 9)])], "run_id string, ord long, error string, item_count long")
    got = [(r.streak, r.is_stuck) for r in journeys.error_streaks(df, block=2).orderBy("ord").collect()]
    assert got == [(1, False), (2, True), (1, False), (1, False), (2, False)]
    assert [r.stagnant_rounds for r in journeys.stagnation(df, block=2).orderBy("ord").collect()] == [0, 1, 2, 0, 1]


def test_loop_needs_all_recent_steps(spark):
    df = spark.createDataFrame([("r", i, a) for i, a in enumerate(["click a button", "click a button", "click a button!", "open"])], "run_id string, ord long, action string")
    assert [r.is_loop for r in journeys.repeated_actions(df, block=2).orderBy("ord").collect()] == [False, False, True, False]


def test_duplicate_actions_by_matching_blocks(spark):
    rng = random.Random(3)
    texts = [None, "", "click {\"ref\": \"e1\"}", "点击 第一页", "x" * 400]
    rows = []
    for run in range(6):
        last = "open the page and read " + "word " * (5 + 30 * (run % 2))
        for i in range(30):
            if rng.random() < 0.2:
                last = rng.choice(texts)
            elif last and rng.random() < 0.5:
                k = rng.randrange(len(last))
                last = last[:k] + rng.choice("abc ") + last[k + rng.randrange(6) :]
            rows.append((run, i, last))
    df = spark.createDataFrame(rows, "run_id long, ord long, action string")
    got = {(r.run_id, r.ord): r.is_loop for r in journeys.duplicate_actions(df, block=7).collect()}
    at = {(r, i): a for r, i, a in rows}

    def near(a, b):
        return a is not None and b is not None and SequenceMatcher(None, a, b).ratio() >= 0.92

    want = {k: bool(a) and all(near(a, at.get((k[0], k[1] - j))) for j in (1, 2)) for k, a in at.items()}
    assert got == want and True in want.values()
    assert journeys.duplicate_actions(df.limit(0)).count() == 0


def test_invalid_action_reasons(spark):
    kind = "run_id int, step int, skill string, params map<string,string>, has_refs boolean, target_required boolean"
    actions = spark.createDataFrame(
        [(1, 1, "", {}, True, False), (1, 2, "click", {"ref": "g_1"}, True, False), (1, 3, "click", {"ref": "e2"}, True, True), (1, 4, "type", {"ref": "e1"}, True, True), (1, 5, "scroll", {}, True, False)],
        kind,
    )
    chosen = spark.createDataFrame([(1, 3, "selected", "e1"), (1, 4, "selected", "e1")], "run_id int, step int, status string, target_ref string")
    got = {r.step: r.reason for r in verdicts.invalid_actions(actions, chosen).collect()}
    assert got == {1: "missing_skill", 2: "virtual_group_ref", 3: "target_ref_mismatch", 4: None, 5: None}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("threshold", [0.2, 0.45, 0.92])
def test_repeated_actions_equal_whole_distances(spark, threshold):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdé 人") for _ in range(n))
    base = word(600)
    texts = [base, base[:300] + "x" + base[300:], base[40:], word(500), word(700), base[::-1], "", "a", base[:130], word(129), None, base, base, base]
    texts += ["a" * 25, "a" * 23 + "bb", "a" * 25, "a" * 24, "a" * 21]
    rows = [("r", i, t) for i, t in enumerate(texts)]
    like = lambda a, b: a is not None and b is not None and 1 - edits(a, b) / max(len(a), len(b), 1) >= threshold
    want = [i >= 2 and bool(t) and like(t, texts[i - 1]) and like(t, texts[i - 2]) for i, t in enumerate(texts)]
    df = journeys.repeated_actions(spark.createDataFrame(rows, "run_id string, ord int, action string"), threshold=threshold)
    assert [r.is_loop for r in df.orderBy("ord").collect()] == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("levenshtein(action") == 2  # the whole distance to each of two steps, once
