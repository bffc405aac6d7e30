"""Temperature mixing: source weights from exponentiated shares, realised as budgeted block permutations."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from reapline.llm.common import WORD, durable

STEPS = 60  # halvings of the exponent's interval
SOURCES = 10_000  # sources whose weights are made on the driver, at most
BLOCK_TOKENS = 1 << 16  # tokens of one block of a source's permutation, about
BLOCKS = 100_000  # blocks of one source, at most
UNIT = 10**9  # weights are fixed to this many parts, so that quotas do not hang on a last bit


def token_count(text: str = "text") -> Column:
    """Words of a whole text; none for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def tempered(tokens: Sequence[int], exponent: float) -> list[float]:
    """Shares of the sources, each to the power ``exponent``, made to sum to 1; empty sources get 0."""
    total = sum(tokens)
    powers = [(t / total) ** exponent if t else 0.0 for t in tokens]
    return [p / math.fsum(powers) for p in powers]


def entropy(weights: Sequence[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w)


def repeats(tokens: Sequence[int], weights: Sequence[float]) -> float:
    """How often the most repeated source is passed when the least repeated one is passed once."""
    rates = [w / t for w, t in zip(weights, tokens) if t]
    return max(rates) / min(rates)


def exponent_for(tokens: Sequence[int], target_entropy: float | None = None, max_repeats: float | None = None) -> float:
    """The exponent in [0, 1] that meets the targets, by bisection.

    1 keeps the sources' own shares, 0 makes all equal.  Entropy and repetition both grow
    as the exponent falls.  ``target_entropy`` asks for at least that entropy with the largest such
    exponent; ``max_repeats`` asks for the smallest exponent within the limit.  With both,
    the limit on repetition wins.
    """
    if not any(tokens):
        return 1.0

    def lowest_fitting(fits) -> float:
        low, high = 0.0, 1.0
        if fits(low):
            return low
        for _ in range(STEPS):
            middle = (low + high) / 2
            low, high = (low, middle) if fits(middle) else (middle, high)
        return high

    flat = 0.0
    if max_repeats is not None:
        flat = lowest_fitting(lambda a: repeats(tokens, tempered(tokens, a)) <= max_repeats)
    if target_entropy is None:
        return flat
    if entropy(tempered(tokens, 1.0)) >= target_entropy:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (middle, high) if entropy(tempered(tokens, middle)) >= target_entropy else (low, middle)
    return max(low, flat)


def source_weights(counts: dict, target_entropy: float | None, max_repeats: float | None, budget: int | None) -> dict:
    """Per source its (weight, quota of tokens).

    Without a budget the quotas add up to the least total that passes every document of
    every source at least once.
    """
    names = sorted(counts, key=lambda s: (s is None, s))
    tokens = [counts[s] for s in names]
    if not any(tokens):
        return {s: (0.0, 0) for s in names}
    weights = tempered(tokens, exponent_for(tokens, target_entropy, max_repeats))
    parts = [round(w * UNIT) for w in weights]
    if budget is None:
        budget = max(-(-t * UNIT // p) for t, p in zip(tokens, parts) if p)
        return {s: (p / UNIT, max(t, budget * p // UNIT)) for s, t, p in zip(names, tokens, parts)}
    return {s: (p / UNIT, budget * p // UNIT) for s, p in zip(names, parts)}


def mixture(documents: DataFrame, target_entropy: float | None = None, max_repeats: float | None = 4.0, budget: int | None = None, seed: int = 17) -> DataFrame:
    """The columns of ``documents``, with ``_tokens`` (words), ``_weight`` of the source and ``_copies`` of each row.

    A source's rows are dealt into blocks by a hash of ``seed`` and their id; the blocks in hash
    order are its permutation.  A quota is spent by passing the permutation as often as it
    fits, then block by block, then row by row (hash order) through the block that no longer
    fits whole; the row that crosses the quota goes in, so a source misses its quota by less
    than one row.

    Sums are made per (source, block) below the shuffle; only blocks of about
    ``BLOCK_TOKENS`` tokens are ever ordered row by row, and only one per source, so a source
    with a third of all rows is no larger task than others.  Only one number per source
    reaches the driver, for at most ``SOURCES`` sources.

    Null sources form a source of their own.  Null and empty texts have no token; they are
    passed as often as their block.  Repeated rows are dealt together and passed each.  An
    empty table gives an empty result; clashing column names are not used by the result
    but for the three above, which are replaced.
    """
    mixed = _mixed(documents, target_entropy, max_repeats, budget, seed)
    added = ("_tokens", "_weight", "_copies")
    return mixed.select(*[F.col("_row").getField(c).alias(c) for c in documents.columns if c not in added], *added)


def permuted(
    documents: DataFrame, target_entropy: float | None = None, max_repeats: float | None = 4.0, budget: int | None = None, seed: int = 17,
    tokens: Column | None = None,
) -> DataFrame:
    """The mixture as sequences: a row per copy of a document, in the order its source is passed.

    The columns of ``documents``, with ``_tokens``, ``_weight``, ``_pass`` (from 0) and
    ``_position``: the tokens of the source's sequence before this copy.  Each pass
    permutes the blocks of the source anew by a hash; inside a block rows keep their hash
    order.  Copies, nulls, repeated rows and names are as in ``mixture``; rows alike in id
    and tokens stand one after the other in no fixed order.  ``tokens`` replaces the count
    of words by another column of whole numbers, such as ids counted before.

    Rows meet by (source, block), so a hot source is spread over its blocks; of a source
    and pass only one row per block is ordered, at most ``BLOCKS``.
    """
    mixed = _mixed(documents, target_entropy, max_repeats, budget, seed, tokens)
    blocks = mixed.groupBy("_name", "_block", "_full").agg(F.sum("_tokens").alias("_n"), F.max("_copies").alias("_passes")).where("_passes > 0")
    passes = blocks.withColumn("_pass", F.explode(F.sequence(F.lit(0), (F.col("_passes") - 1).cast("int"))))
    by_pass = Window.partitionBy("_name", "_pass").orderBy(
        F.xxhash64((F.lit(seed + 2) + F.col("_full") - F.col("_pass")).cast("int"), "_block"), "_block"
    ).rowsBetween(Window.unboundedPreceding, -1)
    begins = durable(passes.withColumn("_begin", F.coalesce(F.sum("_n").over(by_pass), F.lit(0))).select(
        F.col("_name").alias("_p_name"), F.col("_block").alias("_p_block"), "_pass", "_begin"
    ))
    inside = Window.partitionBy("_name", "_block").orderBy("_order", F.col("_row.doc_id"), "_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = mixed.withColumn("_inside", F.coalesce(F.sum("_tokens").over(inside), F.lit(0))).join(
        begins, F.col("_name").eqNullSafe(F.col("_p_name")) & (F.col("_block") == F.col("_p_block")) & (F.col("_pass") < F.col("_copies"))
    )
    added = ("_tokens", "_weight", "_pass", "_position")
    return placed.withColumn("_position", F.col("_pass") * F.col("_count") + F.col("_begin") + F.col("_inside")).select(
        *[F.col("_row").getField(c).alias(c) for c in documents.columns if c not in added], *added
    )


def _mixed(
    documents: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: int | None, seed: int, tokens: Column | None = None
) -> DataFrame:
    """``_row`` (all columns of a document) with what the mixture adds: inside the struct no name can clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row")
    docs = documents.select("doc_id", "source", (token_count() if tokens is None else tokens).alias("_tokens"), row)
    sums = docs.groupBy("source").agg(F.sum("_tokens").alias("n")).limit(SOURCES + 1).collect()
    if len(sums) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    counts = {r["source"]: int(r["n"] or 0) for r in sums}
    weights = source_weights(counts, target_entropy, max_repeats, budget)
    spark = documents.sparkSession
    rows = [
        (s, w, counts[s], quota // counts[s] if counts[s] else 1, quota % counts[s] if counts[s] else 0, min(BLOCKS, max(1, -(-counts[s] // BLOCK_TOKENS))))
        for s, (w, quota) in weights.items()
    ]
    names = ("_name", "_weight", "_count", "_full", "_rest", "_blocks")
    listed = F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in rows])), "array<struct<_name:string,_weight:double,_count:long,_full:long,_rest:long,_blocks:long>>")
    plan = F.broadcast(spark.range(1).select(F.inline(listed)))  # a row per source, at most SOURCES
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    dealt = docs.join(plan, F.col("source").eqNullSafe(F.col("_name"))).withColumns({"_order": order, "_block": F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), F.col("_blocks"))})

    blocks = dealt.where("_rest > 0").groupBy("_name", "_rest", "_block").agg(F.sum("_tokens").alias("_n"))
    by_hash = Window.partitionBy("_name").orderBy(F.xxhash64(F.lit(seed + 2), "_block"), "_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = durable(
        blocks.withColumn("_end", F.sum("_n").over(by_hash)).withColumn("_begin", F.col("_end") - F.col("_n"))
        .where("_begin < _rest").select(F.col("_name").alias("_b_name"), F.col("_block").alias("_b_block"), (F.col("_end") <= F.col("_rest")).alias("_whole"), (F.col("_rest") - F.col("_begin")).alias("_left"))
    )
    split = F.broadcast(blocks.where("not _whole"))  # one block per source at most
    inside = Window.partitionBy("_name").orderBy("_order", "_id", "_tokens").rowsBetween(Window.unboundedPreceding, -1)
    crossing = (
        dealt.select("_name", "_block", "_order", F.col("doc_id").alias("_id"), "_tokens")
        .join(split, F.col("_name").eqNullSafe(F.col("_b_name")) & (F.col("_block") == F.col("_b_block")))
        .withColumn("_before", F.coalesce(F.sum("_tokens").over(inside), F.lit(0))).where("_before < _left")
        .groupBy("_name").agg(F.max(F.struct("_order", "_id")).alias("_last"))
    )
    limits = F.broadcast(split.join(crossing, F.col("_b_name").eqNullSafe(F.col("_name"))).select(F.col("_b_name").alias("_s_name"), F.col("_b_block").alias("_s_block"), "_last"))
    # blocks are few (a source has a row per BLOCK_TOKENS words, BLOCKS at most), texts are not: send the blocks
    whole = F.broadcast(blocks.where("_whole").select(F.col("_b_name").alias("_w_name"), F.col("_b_block").alias("_w_block")))
    out = (
        dealt.join(whole, F.col("_name").eqNullSafe(F.col("_w_name")) & (F.col("_block") == F.col("_w_block")), "left")
        .join(limits, F.col("_name").eqNullSafe(F.col("_s_name")) & (F.col("_block") == F.col("_s_block")), "left")
    )
    more = F.col("_w_block").isNotNull() | F.coalesce(F.struct("_order", F.col("doc_id").alias("_id")) <= F.col("_last"), F.lit(False))
    return out.withColumn("_copies", F.col("_full") + more.cast("long")).select(
        "_row", "_tokens", "_weight", "_copies", "_name", "_block", "_order", "_count", "_full"
    )


def mix(documents: DataFrame, target_entropy: float | None = None, max_repeats: float | None = 4.0, budget: int | None = None, seed: int = 17) -> DataFrame:
    """The rows of ``documents``, each as often as the mixture passes it; all columns as they were, whatever their names."""
    mixed = _mixed(documents, target_entropy, max_repeats, budget, seed).where("_copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*[F.col("_row").getField(c).alias(c) for c in documents.columns])
