"""Readers and sinks on files in a temporary folder."""

import json

import pytest
from pyspark.sql import functions as F

from reapline.operators import runs as run_ops
from reapline.operators import snapshots
from reapline.sources import manifests, readers, writers


def test_records_of_three_formats_and_latest_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"title": "A", "n": 1, "tags": ["x"]}]), encoding="utf-8")
    (tmp_path / "b.jsonl").write_text('{"title": "B"}\n{"title": "C", "url": "u"}\n', encoding="utf-8")
    (tmp_path / "c.csv").write_text("title,price\nD,3\n", encoding="utf-8")
    df = readers.read_records(spark, str(tmp_path))
    assert sorted(r.title for r in df.collect()) == ["A", "B", "C", "D"]
    assert df.where("title = 'A'").first().tags == '["x"]'
    import os

    os.utime(tmp_path / "b.jsonl", (4_000_000_000, 4_000_000_000))
    newest = readers.latest_file(readers.read_records(spark, str(tmp_path)))
    assert sorted(r.title for r in newest.collect()) == ["B", "C"]


def artifact(path, key, ok=True, items=2):
    checks = {"target_opened": ok}
    run = {
        "case": {"key": key, "name": key, "url": f"https://{key}.test/", "expected_min_items": 1, "expected_max_items": 5}, "model": "m", "status": "completed",
        "elapsed_seconds": 2.5, "thread_ids": ["t"], "usage": {"total_tokens": 10, "llm_call_count": 1}, "session_close": {"ok": True},
        "evaluation": {"checks": checks, "accuracy_score": 100.0, "unique_item_count": items},
        "results": [{"ok": True, "action": "extract", "page_url": "p", "items": [{"title": f"T{i}", "url": f"https://x/{i}"} for i in range(items)]}],
    }
    path.write_text(json.dumps({"runs": [run]}), encoding="utf-8")


def test_read_runs_and_export(spark, tmp_path):
    artifact(tmp_path / "one.json", "one")
    artifact(tmp_path / "two.json", "two")
    df = readers.read_runs(spark, [str(tmp_path / "one.json"), str(tmp_path / "two.json")])
    assert df.where(run_ops.strict_pass()).count() == 2
    items = readers.run_items(readers.run_results(df)).join(df.select("run_id", "case_key"), "run_id").select("case_key", "pos", "fields")
    expected = df.select("case_key")
    out = str(tmp_path / "delivery")
    manifest = writers.export_delivery(expected, df, items, out).first()
    assert (manifest.task_count, manifest.total_record_count) == (2, 4)
    assert spark.read.json(f"{out}/data").count() == 4
    missing = spark.createDataFrame([("one",), ("three",)], "case_key string")
    with pytest.raises(RuntimeError, match="three: missing run"):
        writers.export_delivery(missing, df, items, str(tmp_path / "refused"))
    assert not (tmp_path / "refused").exists()
    artifact(tmp_path / "bad.json", "bad", ok=False)
    bad = readers.read_runs(spark, str(tmp_path / "bad.json"))
    rows = readers.run_items(readers.run_results(bad)).withColumn("case_key", F.lit("bad"))
    with pytest.raises(RuntimeError, match="failed evaluation checks"):
        writers.export_delivery(bad.select("case_key"), bad, rows, str(tmp_path / "refused"))


def test_snapshots_from_files(spark, tmp_path):
    folder = tmp_path / "sess"
    folder.mkdir()
    node = lambda ref, text: {"ref": ref, "tag": "a", "role": "link", "text": text}
    data = {"ok": True, "data": {"page": {"url": "u"}, "index": {"interactable_elements": [node("e1", "")], "surface_index": [node("e1", "later"), node("r2", "x")], "deep_index": [], "data_regions": [{"ref": "r2", "kind": "list", "item_count": 3}]}}}
    (folder / "ss_0007.full.json").write_text(json.dumps(data), encoding="utf-8")
    df = readers.read_snapshots(spark, str(tmp_path))
    row = df.first()
    assert (row.session, row.seq, row.snapshot_id) == ("sess", 7, "ss_0007")
    nodes = {r.ref: r for r in snapshots.merge_nodes(readers.snapshot_lists(df)).collect()}
    assert nodes["e1"].text == "later" and nodes["e1"].ref_type == "element" and nodes["r2"].ref_type == "container"
    assert readers.snapshot_regions(df).first().item_count == 3


def test_write_records_by_extension(spark, tmp_path):
    df = spark.createDataFrame([("A", "https://www.a.test:80/x", ["t"])], "title string, source_url string, tags array<string>")
    assert writers.write_records(df, str(tmp_path / "out.csv")) == "csv"
    back = spark.read.option("header", True).csv(str(tmp_path / "out.csv")).first()
    assert (back.title, back.tags, back.domain) == ("A", '["t"]', "a.test")
    assert writers.write_records(df, str(tmp_path / "plain")) == "json"
    with pytest.raises(ValueError, match="unknown format"):
        writers.write_records(df, str(tmp_path / "x"), "xml")


def test_csv_union_orders_names(spark, tmp_path):
    df = spark.createDataFrame([(1, {"b": "1"}), (2, {"b": "2", "a": "3"})], "pos int, fields map<string,string>")
    assert writers.csv_union(df).columns == ["b", "a"]
    writers.write_csv_union(df, str(tmp_path / "u"))
    assert spark.read.option("header", True).csv(str(tmp_path / "u")).count() == 2


def test_appended_rows_and_queries(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.append_rows(spark.createDataFrame([(1,)], "a int"), path)
    writers.append_rows(spark.createDataFrame([("x", 2)], "b string, a int"), path)
    df = writers.read_appended(spark, path)
    assert set(df.columns) == {"a", "b", "created_at"}
    assert readers.query_table(spark, "select count(*) as n from {t} where a = '2'", t=df).first().n == 1
    with pytest.raises(ValueError, match="only reading"):
        readers.query_table(spark, "drop table x")


def test_trace_and_failure_sinks(spark, tmp_path):
    df = spark.sql("select 1L as id, 't' as thread_id, timestamp '2026-01-02 03:04:05' as started_at")
    writers.append_trace(df, str(tmp_path / "trace"))
    assert str(spark.read.parquet(str(tmp_path / "trace")).first().date) == "2026-01-02"
    bad = spark.createDataFrame([("c", "code", None), ("", "code", "x")], "cache_id string, cache_type string, reason string")
    writers.log_cache_failures(bad, str(tmp_path / "fail"))
    assert spark.read.json(str(tmp_path / "fail")).count() == 1


def test_ingest_settles_percent_signs(spark, tmp_path):
    rows = [(i, 1, {"text": f"long enough text {i}", "share": "5%" if i == 0 else str(i)}) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id int, batch_id int, fields map<string,string>")
    writers.ingest_docs(df, str(tmp_path / "kb"), F.lit("s"), F.lit("now"))
    stored = {r.doc_id: r.dyn for r in spark.read.parquet(str(tmp_path / "kb")).collect()}
    assert "share" not in stored[0] and stored[3]["share"].value == 3.0


def test_manifest_upsert_keeps_creation(spark):
    kind = "thread_id string, status string, created_at int, updated_at int"
    old, new = spark.createDataFrame([("t", "running", 1, 1)], kind), spark.createDataFrame([("t", "completed", 5, 5), ("u", "failed", 4, 4)], kind)
    got = {r.thread_id: (r.status, r.created_at) for r in manifests.upsert_manifest(old, new).collect()}
    assert got == {"t": ("completed", 1), "u": ("failed", 4)}
    assert manifests.recent_manifests(manifests.upsert_manifest(old, new), 0).count() == 1


def test_snapshot_numbers_continue(spark):
    stored = spark.createDataFrame([("s", 9)], "session string, seq int")
    new = spark.createDataFrame([("s", 1, "{}"), ("s", 2, "{}"), ("n", 3, "x")], "session string, arrival long, data string")
    got = {(r.session, r.snapshot_id) for r in writers.append_snapshot(stored, new, F.current_timestamp()).collect()}
    assert got == {("s", "ss_0010"), ("s", "ss_0011"), ("n", "ss_0001")}
