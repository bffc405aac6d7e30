"""Run manifests: one current row per thread over an append-only history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reapline.functions.labels import run_status


def manifest_rows(states: DataFrame, now: Column) -> DataFrame:
    """Manifest rows of run states.

    ``states``: thread_id, user_task, is_complete, error, next_nodes, current_url,
    item_count, completed_pages, session, last_verified_action_key.
    """
    thread = F.trim("thread_id")
    return states.where(thread != "").select(
        thread.alias("thread_id"), F.coalesce("user_task", F.lit("")).alias("user_task"), run_status("is_complete", "error", "next_nodes").alias("status"),
        F.nullif("session", F.lit("")).alias("session"), F.coalesce("current_url", F.lit("")).alias("current_url"), "item_count", "completed_pages",
        "next_nodes", "last_verified_action_key", now.alias("created_at"), now.alias("updated_at"),
    )


def upsert_manifest(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Current manifests: the newest values of every thread, with its first creation time."""
    every = stored.unionByName(new, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in ("thread_id", "created_at")]
    latest = every.groupBy("thread_id").agg(F.min("created_at").alias("created_at"), F.max_by(F.struct(*rest), "updated_at").alias("_m"))
    return latest.select("thread_id", "created_at", "_m.*").select(*every.columns)


def recent_manifests(manifests: DataFrame, n: int = 10) -> DataFrame:
    """Newest n manifests, at least 1 and at most 100."""
    return manifests.orderBy(F.desc("updated_at"), "thread_id").limit(max(1, min(int(n), 100)))


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Snapshot with the highest sequence number of every session."""
    return snapshots.groupBy("session").agg(F.max("seq").alias("seq"), F.max_by("snapshot_id", "seq").alias("snapshot_id"))


