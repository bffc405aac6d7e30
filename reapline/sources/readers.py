"""Readers of crawl artifacts: record files, run artifacts, snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reapline import schemas

FILE_COLUMNS = ("source_file", "file_modified_at")


def _marked(df: DataFrame) -> DataFrame:
    return df.withColumns({"source_file": F.col("_metadata.file_path"), "file_modified_at": F.col("_metadata.file_modification_time")})


def read_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All json, jsonl and csv files under a path as one record table.

    The extension decides the format.  Columns are united by name; every row knows its
    file.  Give a ``schema`` for large inputs: without one Spark reads the files twice.
    """
    readers = {
        "*.json": lambda r: r.option("multiLine", True).json,
        "*.jsonl": lambda r: r.json,
        "*.csv": lambda r: r.option("header", True).csv,
    }
    found = []
    for pattern, pick in readers.items():
        reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        try:
            df = pick(reader.schema(schema) if schema else reader)(path)
        except Exception as error:  # a folder without files of this kind
            if "UNABLE_TO_INFER_SCHEMA" in str(error):
                continue
            raise
        if df.columns:
            found.append(_marked(df))
    if not found:
        raise FileNotFoundError(f"no json, jsonl or csv files under {path}")
    if len(found) > 1 and not schema:
        found = [_as_text(df) for df in found]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def _as_text(df: DataFrame) -> DataFrame:
    """Values as text, nested ones as JSON, so that files of different kinds unite."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in FILE_COLUMNS or f.dataType.typeName() == "string":
            columns.append(c)
        elif f.dataType.typeName() in ("struct", "array", "map"):
            columns.append(F.to_json(c).alias(f.name))
        else:
            columns.append(c.cast("string").alias(f.name))
    return df.select(*columns)


def latest_file(records: DataFrame) -> DataFrame:
    """Rows of the most recently modified file."""
    newest = records.agg(F.max_by("source_file", F.struct("file_modified_at", "source_file")).alias("source_file"))
    return records.join(newest, "source_file", "left_semi")


def read_runs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Runs of benchmark artifacts, one row per run, flat columns plus their results."""
    wrapped = f"runs array<struct<{_ddl_fields(spark, schemas.RUN)}>>"
    raw = spark.read.schema(wrapped).option("multiLine", True).json(paths)
    rows = raw.select(F.col("_metadata.file_path").alias("source_file"), F.posexplode("runs").alias("pos", "run"))
    zero = F.lit(0)
    usage = lambda n: F.coalesce(F.col(f"run.usage.{n}"), zero).alias(n)
    return rows.select(
        F.xxhash64("source_file", "pos").alias("run_id"), "source_file", "pos",
        F.coalesce("run.case.key", F.lit("")).alias("case_key"), F.col("run.case.name").alias("case_name"), F.col("run.case.url").alias("url"),
        F.col("run.case.task").alias("task"), F.col("run.case.capability").alias("capability"),
        F.coalesce("run.case.expected_min_items", zero).alias("expected_min_items"),
        F.coalesce("run.case.expected_max_items", zero).alias("expected_max_items"),
        "run.model", "run.repeat", "run.status", "run.exception", F.coalesce("run.elapsed_seconds", F.lit(0.0)).alias("elapsed_seconds"),
        "run.thread_ids", F.coalesce("run.evaluation.checks", F.create_map().cast("map<string,boolean>")).alias("checks"),
        F.coalesce("run.evaluation.accuracy_score", F.lit(0.0)).alias("accuracy_score"),
        F.coalesce("run.evaluation.unique_item_count", zero).cast("bigint").alias("unique_item_count"),
        F.coalesce("run.evaluation.detail_batch_ran", F.lit(False)).alias("detail_batch_ran"),
        F.coalesce("run.session_close.ok", F.lit(False)).alias("session_closed"),
        *[usage(n) for n in ("input_tokens", "output_tokens", "total_tokens", "llm_call_count", "browser_action_count", "cost_usd", "llm_duration_ms", "estimated_call_count")],
        F.col("run.results").alias("results"),
    )


def run_results(runs: DataFrame) -> DataFrame:
    """Results of every run, one row each."""
    return runs.select("run_id", F.posexplode("results").alias("pos", "r")).select(
        "run_id", F.col("pos").cast("bigint").alias("pos"), F.coalesce("r.ok", F.lit(False)).alias("ok"), "r.action",
        F.col("r.error.code").alias("error_code"), F.col("r.error.message").alias("error_message"), "r.page_url", "r.items",
    )


def run_items(results: DataFrame) -> DataFrame:
    """Records inside the results, one row each."""
    return results.select("run_id", "action", "ok", F.col("pos").alias("page_number"), F.posexplode("items").alias("pos", "fields"))


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Full snapshots, with session and sequence taken from ``<session>/ss_<n>.full.json``."""
    raw = (
        spark.read.schema(schemas.SNAPSHOT).option("multiLine", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "ss_*.full.json").json(folder)
    )
    file = F.col("_metadata.file_path")
    return raw.select(
        F.url_decode(F.regexp_extract(file, r"([^/]+)/ss_\d+\.full\.json$", 1)).alias("session"),
        F.regexp_extract(file, r"ss_(\d+)", 1).cast("int").alias("seq"), F.regexp_extract(file, r"(ss_\d+)", 1).alias("snapshot_id"), "ok", "data",
    )


def snapshot_lists(snapshots: DataFrame) -> list[DataFrame]:
    """The three node lists of snapshots in the order in which they take precedence."""
    out = []
    for name in ("interactable_elements", "surface_index", "deep_index"):
        out.append(
            snapshots.select(
                F.concat_ws("/", "session", "snapshot_id").alias("snapshot_id"), F.posexplode(f"data.index.{name}").alias("ord", "n")
            ).select("snapshot_id", "ord", "n.*")
        )
    return out


def snapshot_regions(snapshots: DataFrame) -> DataFrame:
    return snapshots.select(
        F.concat_ws("/", "session", "snapshot_id").alias("snapshot_id"), F.posexplode("data.index.data_regions").alias("ord", "r")
    ).select("snapshot_id", "ord", "r.*")


def query_table(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Read-only SQL over stored tables; the given ones appear as ``{name}`` in the text."""
    first = sql.lstrip().split(None, 1)[0].lower() if sql.strip() else ""
    if first not in ("select", "with", "values", "from"):
        raise ValueError("only reading queries are accepted")
    return spark.sql(sql, **tables)


def _ddl_fields(spark: SparkSession, ddl: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]
