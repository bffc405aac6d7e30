"""Knowledge documents: text, metadata, number formats, field registry, sorted listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reapline.functions.values import coerce_number, record_text

# Columns every document has, and fields that are never metadata.
FIXED_FIELDS = ("source", "title", "category", "data_type", "platform", "crawled_at")
TEXT_FIELDS = ("text", "content", "page_content")
INTERNAL_FIELDS = ("text", "pk", "vector")
MIN_TEXT = 10


def build_docs(records: DataFrame, fields: str = "fields") -> DataFrame:
    """Add the whole document text; records with hardly any text are dropped."""
    return records.withColumn("text", record_text(fields)).where(F.length("text") >= MIN_TEXT)


def doc_metadata(records: DataFrame, source: Column, crawled_at: Column, fields: str = "fields") -> DataFrame:
    """Fixed columns with fallbacks, and the other fields as typed values.

    ``dyn`` maps a name to struct(value, text, was_percent); "no value" cells are absent.
    """
    m = F.col(fields)
    empty = F.lit("")
    fixed = {
        "source": F.coalesce(m["source"], source),
        "title": F.coalesce(m["title"], m["name"], empty),
        "category": F.coalesce(m["category"], m["type"], empty),
        "data_type": F.coalesce(m["data_type"], F.lit("crawled")),
        "platform": F.coalesce(m["platform"], empty),
        "crawled_at": F.coalesce(m["crawled_at"], crawled_at),
    }
    rest = F.map_filter(m, lambda k, _: ~k.isin(*FIXED_FIELDS, *TEXT_FIELDS))
    typed = F.map_filter(F.transform_values(rest, lambda _, v: coerce_number(v)), lambda _, v: v.isNotNull())
    return records.withColumns({**fixed, "dyn": typed})


def percent_consistency(docs: DataFrame, batch: str = "batch_id", doc: str = "doc_id", min_samples: int = 3) -> DataFrame:
    """Drop percent values from numeric fields where percent signs are the exception.

    Counts per (batch, field) are aggregated first; only fields found inconsistent, a
    short list, meet the documents again, once per document.
    """
    cells = docs.select(batch, F.explode(F.map_entries("dyn")).alias("e"))
    stats = (
        cells.where(F.col("e.value.value").isNotNull()).groupBy(batch, F.col("e.key").alias("field"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("e.value.was_percent").alias("p"))
    )
    odd = (
        stats.where((F.col("n") >= min_samples) & (F.col("p") > 0) & (F.col("p") / F.col("n") < 0.5))
        .groupBy(batch).agg(F.collect_set("field").alias("_odd"))
    )
    kept = F.map_filter("dyn", lambda k, v: ~(v["was_percent"] & F.array_contains(F.col("_odd"), k)))
    joined = docs.join(odd, batch, "left")
    return joined.withColumn("dyn", F.when(F.col("_odd").isNull(), F.col("dyn")).otherwise(kept)).drop("_odd")


def field_registry(docs: DataFrame, seen_on: str = "seen_on") -> DataFrame:
    """Every dynamic field with first date, number of documents and type.

    A field is numeric once a single number was seen under it.
    """
    cells = docs.select(F.col(seen_on).alias("_d"), F.explode(F.map_entries("dyn")).alias("e"))
    numeric = F.bool_or(F.col("e.value.value").isNotNull())
    return (
        cells.where(~F.col("e.key").isin(*FIXED_FIELDS, *INTERNAL_FIELDS)).groupBy(F.col("e.key").alias("field"))
        .agg(F.min("_d").alias("first_seen"), F.count(F.lit(1)).alias("count"), F.when(numeric, "number").otherwise("string").alias("type"))
    )


def merge_registry(known: DataFrame, added: DataFrame) -> DataFrame:
    """Registry after another batch; a numeric type is never taken back."""
    return known.unionByName(added).groupBy("field").agg(
        F.min("first_seen").alias("first_seen"), F.sum("count").alias("count"),
        F.when(F.bool_or(F.col("type") == "number"), "number").otherwise("string").alias("type"),
    )


def registry_listing(registry: DataFrame) -> DataFrame:
    """Fields by how often they occur."""
    return registry.orderBy(F.desc("count"), "field")


def filter_docs(docs: DataFrame, expression: str) -> DataFrame:
    """Documents under a SQL condition over fixed columns and ``dyn['name'].value`` or ``.text``."""
    return docs.where(F.expr(expression))


def dyn_number(name: str) -> Column:
    return F.col("dyn")[name]["value"]


def dyn_text(name: str) -> Column:
    return F.col("dyn")[name]["text"]


def sorted_docs(docs: DataFrame, value: Column, descending: bool, k: int, tie: str) -> DataFrame:
    """First k documents by a numeric value; documents without one come last either way."""
    number = value.try_cast("double")
    order = F.desc_nulls_last("_v") if descending else F.asc_nulls_last("_v")
    return docs.withColumn("_v", number).orderBy(order, tie).limit(k).drop("_v")


def not_expired(df: DataFrame, now: Column, column: str = "expire_at") -> DataFrame:
    """Rows that expire now or later; unreadable times count as expired."""
    return df.where(F.coalesce(F.col(column).try_cast("timestamp") >= now, F.lit(False)))
