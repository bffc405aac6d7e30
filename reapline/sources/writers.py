"""Sinks: records by extension, flat CSV, append-only tables, traces, snapshots, deliveries.

All writers append or write a new folder through Spark's commit protocol; none collects.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reapline.functions.url import domain_folder
from reapline.functions.values import sorted_json


def write_records(df: DataFrame, path: str, fmt: str | None = None, url: str | None = "source_url", saved_at: Column | None = None) -> str:
    """Write records in the format of the path's extension, one folder per site.

    The time of writing is a column, so that nothing is overwritten or renamed.
    """
    ext = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    kind = ext if ext in ("json", "jsonl", "csv") else (fmt or "json")
    if kind not in ("json", "jsonl", "csv"):
        raise ValueError(f"unknown format {kind}")
    stamped = df.withColumn("saved_at", saved_at if saved_at is not None else F.current_timestamp())
    keys = []
    if url and url in df.columns:
        stamped = stamped.withColumn("domain", F.coalesce(F.nullif(domain_folder(url), F.lit("")), F.lit("unknown")))
        keys = ["domain"]
    flat = flatten_nested(stamped) if kind == "csv" else stamped
    writer = flat.write.mode("append").partitionBy(*keys) if keys else flat.write.mode("append")
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.json(path)
    return kind


def flatten_nested(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = {
        f.name: F.to_json(F.col(f"`{f.name}`")) for f in df.schema.fields if f.dataType.typeName() in ("struct", "array", "map", "variant")
    }
    return df.withColumns(nested) if nested else df


def field_order(records: DataFrame, order: Sequence[str] = ("pos",), fields: str = "fields") -> DataFrame:
    """Names occurring in records, by where they first occur."""
    keys = records.select(F.struct(*order).alias("_at"), F.posexplode(F.map_keys(fields)).alias("i", "field"))
    return keys.groupBy("field").agg(F.min(F.struct("_at", "i")).alias("first")).orderBy("first", "field").select("field")


def csv_union(records: DataFrame, order: Sequence[str] = ("pos",), fields: str = "fields", max_fields: int = 10_000) -> DataFrame:
    """Records as columns: the ordered union of all their names.

    Only the distinct names, a bounded list, are fetched to build the projection.
    """
    names = [r["field"] for r in field_order(records, order, fields).limit(max_fields + 1).collect()]
    if len(names) > max_fields:
        raise ValueError(f"more than {max_fields} different fields; write JSON instead")
    return records.select(*[F.col(fields)[n].alias(n) for n in names])


def write_csv_union(records: DataFrame, path: str, order: Sequence[str] = ("pos",), fields: str = "fields") -> None:
    csv_union(records, order, fields).write.mode("append").option("header", True).csv(path)


def append_rows(df: DataFrame, path: str, created_at: Column | None = None) -> None:
    """Append rows as text columns with the time of writing; new columns widen the table on read."""
    text = flatten_nested(df)
    columns = [F.col(f"`{c}`").cast("string").alias(c) for c in text.columns]
    text.select(*columns, (created_at if created_at is not None else F.current_timestamp()).alias("created_at")).write.mode("append").parquet(path)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def append_trace(events: DataFrame, path: str) -> None:
    """Append trace events, one folder per day, sorted for reads by thread."""
    daily = events.withColumn("date", F.to_date("started_at"))
    daily.sortWithinPartitions("thread_id", "id").write.mode("append").partitionBy("date").parquet(path)


def log_cache_failures(failures: DataFrame, path: str, at: Column | None = None) -> None:
    """Append cache failures as JSON lines."""
    when = at if at is not None else F.current_timestamp()
    failures.where(F.coalesce("cache_id", F.lit("")) != "").select(
        "cache_id", "cache_type", when.alias("timestamp"), F.coalesce("reason", F.lit("")).alias("reason")
    ).write.mode("append").json(path)


def append_snapshot(stored: DataFrame, new: DataFrame, captured_at: Column) -> DataFrame:
    """Next snapshot ids per session with a content hash; rows ready to append.

    ``stored``: session, seq.  ``new``: session, arrival, data (JSON text or nested).
    Arrivals are numbered in blocks, so a busy session does not become one task.
    """
    from reapline.plans.blocked import Blocked, number_block

    last = stored.groupBy("session").agg(F.max("seq").alias("_last"))
    by_arrival = Blocked(["session"], ["arrival"], number_block("arrival", 10_000))
    numbered = by_arrival.done(by_arrival.row_number(new, "_n"))
    seq = (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("int")
    body = F.col("data") if new.schema["data"].dataType.typeName() == "string" else F.to_json("data")
    return (
        numbered.join(last, "session", "left")
        .withColumns({"seq": seq, "content_hash": F.substring(F.sha2(body, 256), 1, 16), "captured_at": captured_at})
        .withColumn("snapshot_id", F.concat(F.lit("ss_"), F.lpad(F.col("seq").cast("string"), 4, "0")))
        .withColumn("snapshot_id", F.when(F.col("seq") > 9999, F.concat(F.lit("ss_"), F.col("seq").cast("string"))).otherwise(F.col("snapshot_id")))
        .drop("_n", "_last")
    )


def ingest_docs(records: DataFrame, path: str, source: Column, crawled_at: Column, batch: str = "batch_id", doc: str = "doc_id") -> None:
    """Build documents, settle number formats inside each batch, and append."""
    from reapline.operators.documents import build_docs, doc_metadata, percent_consistency

    docs = doc_metadata(build_docs(records), source, crawled_at)
    percent_consistency(docs, batch, doc).drop("fields").write.mode("append").parquet(path)


def export_delivery(expected: DataFrame, runs: DataFrame, records: DataFrame, path: str) -> DataFrame:
    """Write records per case with manifest and summary, or fail without writing.

    ``expected``: case_key.  ``runs``: latest run per case.  ``records``: case_key, pos,
    fields.  Fails when a case has no run, did not complete, failed a check, or when its
    records do not match the counted items.
    """
    from reapline.operators.runs import delivery_manifest, missing_cases, task_pass

    counted = records.groupBy("case_key").agg(F.count(F.lit(1)).alias("_records"))
    judged = runs.join(expected, "case_key", "left_semi").join(counted, "case_key", "left").withColumn("_records", F.coalesce("_records", F.lit(0)))
    problem = (
        F.when(F.col("status") != "completed", F.concat(F.lit("status="), F.col("status")))
        .when(F.col("_records") != F.col("unique_item_count"), F.concat_ws(" ", F.col("_records").cast("string"), F.lit("records, expected"), F.col("unique_item_count").cast("string")))
        .when(~task_pass(), "failed evaluation checks")
    )
    absent = missing_cases(expected, runs).select("case_key", F.lit("missing run").alias("problem"))
    bad = absent.unionByName(judged.withColumn("problem", problem).where("problem is not null").select("case_key", "problem"))
    some = bad.orderBy("case_key").limit(20).collect()
    if some:
        raise RuntimeError("delivery refused: " + "; ".join(f"{r.case_key}: {r.problem}" for r in some))
    wanted = records.join(expected, "case_key", "left_semi")
    wanted.withColumn("record", sorted_json("fields")).drop("fields").write.mode("errorifexists").partitionBy("case_key").json(f"{path}/data")
    summary = judged.select("case_key", "status", F.col("_records").alias("record_count"), "accuracy_score", "elapsed_seconds")
    summary.write.mode("errorifexists").option("header", True).csv(f"{path}/summary")
    manifest = delivery_manifest(judged)
    manifest.write.mode("errorifexists").json(f"{path}/manifest")
    return manifest


