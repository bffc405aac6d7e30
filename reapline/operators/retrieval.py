"""Search over document tables: keywords, vectors, diversity, fusion and re-ranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reapline.functions.text import search_tokens
from reapline.functions.vectors import cosine, unit
from reapline.plans.blocks import nearest_rows
from reapline.plans.ranking import first_per_key, is_small, top_k
from reapline.session import durable

K1, B, EPSILON = 1.5, 0.75, 0.25
TASK_DOCS = 2048  # documents that a task of the keyword search scores
RRF_CONSTANT = 60
PIVOTS, PIVOT_SAMPLE = 64, 2048  # cells of the vector search, and the rows that their centres are chosen from


def bm25(
    docs: DataFrame, queries: DataFrame, k: int, tokens_of: Callable[[str], Column] = search_tokens,
    doc_id: str = "doc_id", query_id: str = "query_id",
) -> DataFrame:
    """Keyword search over the whole table: the k best documents of every query.

    Okapi weighting; a term in more than half of all documents gets a quarter of the mean
    weight.  Documents are hashed by id once, a bounded number to a task, so term counts and
    scores need no further exchange and no more memory on larger tables; words no query asks for
    are dropped there, and only k candidates per query and task go into the final ranking.  The
    query words are shipped to the tasks only if counting shows them to be few.
    """
    asked = queries.select(query_id, F.explode(tokens_of("text")).alias("term")).groupBy(query_id, "term").agg(
        F.count(F.lit(1)).alias("q_tf")
    )
    ship = F.broadcast if is_small(asked) else (lambda df: df)
    words = ship(asked.select("term").distinct())
    tokenized = docs.select(F.col(doc_id).alias("_doc"), tokens_of("text").alias("_tokens"))
    totals = tokenized.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg(F.size("_tokens")).alias("avgdl")).alias("r")).scalar()
    frequency = tokenized.select(F.explode(F.array_distinct("_tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = frequency.withColumn("idf", F.log(totals["n"] - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = weighted.agg(F.avg("idf") * EPSILON).scalar()
    terms = (
        asked.join(weighted, "term")
        .withColumn("weight", F.col("q_tf") * F.when(F.col("idf") < 0, floor).otherwise(F.col("idf")))
        .select("term", query_id, "weight")
    )
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // TASK_DOCS))
    dealt = docs.select(F.col(doc_id).alias("_doc"), "text").repartition(tasks, "_doc").select("_doc", tokens_of("text").alias("_tokens"))
    counted = (
        dealt.select("_doc", F.size("_tokens").alias("_dl"), F.explode("_tokens").alias("term"))
        .join(words, "term", "left_semi")
        .groupBy("_doc", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("_dl").alias("_dl"))
    )
    saturated = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("_dl") / totals["avgdl"]))
    scored = (
        counted.join(ship(terms), "term")
        .groupBy("_doc", query_id).agg(F.round(F.sum(F.col("weight") * saturated), 6).alias("score"))
        .withColumnRenamed("_doc", doc_id)
    )
    return top_k(scored, [query_id], [F.desc("score"), doc_id], k)


def dense_topk(
    docs: DataFrame, queries: DataFrame, k: int, *, doc_id: str = "doc_id", vector: str = "vector", query_id: str = "query_id",
    query_vector: str | None = None, part: str | None = None, earlier_only: bool = False, block_rows: int = 4096, digits: int = 6,
    normalize: bool = True, other_rows: bool = False,
) -> DataFrame:
    """Exact cosine top k of every query; queries and documents both stay on Spark.

    Documents lie in blocks around pivots; a query first searches the block that promises most and then
    only those whose triangle bound reaches its k-th score (``plans.blocks``).  ``part``
    restricts matches to equal parts, and ``earlier_only`` to documents with a smaller id
    than the query; ``other_rows`` leaves out the query's own id.  Without ``normalize`` the score
    is the plain dot product.  Rows
    without a vector take no part; rows repeating a query's id are answered together, by the best of their scores.
    """
    query_vector = query_vector or vector
    part_of = F.col(part) if part else F.lit(0)
    source = docs.where(F.col(vector).isNotNull()).select(F.col(doc_id).alias("id"), part_of.alias("part"), F.col(vector).alias("vector"))
    asked = durable(queries.where(F.col(query_vector).isNotNull()).select(
        F.monotonically_increasing_id().alias("_row"), F.col(query_id).alias("request"), part_of.alias("part"), F.col(query_vector).alias("vector")))
    name = "_found" if doc_id == query_id else doc_id
    found = nearest_rows(source, asked, k, name, normalize, digits, earlier_only, other_rows, block_rows, PIVOTS, PIVOT_SAMPLE)
    named = found.drop("rank").join(asked.select("_row", F.col("request").alias(query_id)), "_row")
    return top_k(named.select(query_id, name, "score"), [query_id], [F.desc("score"), name], k)


def mmr(
    docs: DataFrame, queries: DataFrame, k: int, fetch_k: int | None = None, balance: float = 0.6, *, doc_id: str = "doc_id",
    vector: str = "vector", query_id: str = "query_id", query_vector: str | None = None, other_rows: bool = False,
) -> DataFrame:
    """Diverse top k: the fetch_k nearest, re-selected one by one against those chosen.

    The grouped step sees fetch_k rows per query, whatever the size of the table.
    """
    fetch = fetch_k or 2 * k
    query_vector = query_vector or vector
    near = dense_topk(docs, queries, fetch, doc_id=doc_id, vector=vector, query_id=query_id, query_vector=query_vector, other_rows=other_rows)
    rows = (
        near.join(docs.select(doc_id, F.col(vector).alias("_v")), doc_id)
        .join(queries.select(query_id, F.col(query_vector).alias("_q")), query_id)
        .select(query_id, doc_id, "rank", "_v", "_q")
    )
    d_type, q_type = docs.schema[doc_id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        v = np.stack(pdf["_v"].to_numpy()).astype(np.float64)
        q = np.asarray(pdf["_q"].iloc[0], dtype=np.float64)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        q = q / max(np.linalg.norm(q), 1e-300)
        relevance, pairwise = v @ q, v @ v.T
        chosen = [int(np.argmax(relevance))]
        while len(chosen) < min(k, len(pdf)):
            gain = balance * relevance - (1 - balance) * pairwise[:, chosen].max(axis=1)
            gain[chosen] = -np.inf
            chosen.append(int(np.argmax(gain)))
        return pd.DataFrame({query_id: pdf[query_id].iloc[0], doc_id: pdf[doc_id].to_numpy()[chosen], "rank": range(1, len(chosen) + 1)})

    return rows.groupBy(query_id).applyInPandas(select, f"{query_id} {q_type}, {doc_id} {d_type}, rank int")


def rrf(
    ranked: Sequence[DataFrame], weights: Sequence[float], constant: int = RRF_CONSTANT, query_id: str = "query_id", text: str = "text"
) -> DataFrame:
    """Fuse ranked lists: weight / (position + constant), summed over equal passages.

    Each list: query, doc_id, text and a rank that starts at 1.
    """
    parts = [
        r.select(query_id, "doc_id", text, (F.lit(float(w)) / (F.col("rank") - 1 + constant)).alias("_s")) for r, w in zip(ranked, weights)
    ]
    fused = reduce(DataFrame.unionByName, parts).groupBy(query_id, F.sha2(text, 256).alias("_key")).agg(
        F.round(F.sum("_s"), 9).alias("score"), F.min("doc_id").alias("doc_id"), F.min(text).alias(text)
    )
    return fused.drop("_key")


def dedup_prefix(passages: DataFrame, n: int = 100, query_id: str = "query_id", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Best passage per beginning of n characters."""
    keyed = passages.withColumns({"_p": F.substring(text, 1, n), "_o": -F.col("score")})
    return first_per_key(keyed, [query_id, "_p"], ["_o", doc_id]).drop("_p", "_o")


def rerank(candidates: DataFrame, scorer: Callable[[Column, Column], Column], k: int, query_id: str = "query_id") -> DataFrame:
    """k best candidates under a caller's scorer of (query text, whole passage)."""
    scored = candidates.withColumn("rerank_score", scorer(F.col("query_text"), F.col("text")))
    return top_k(scored, [query_id], [F.desc("rerank_score"), "doc_id"], k)


def hybrid_search(
    docs: DataFrame, queries: DataFrame, k: int, scorer: Callable[[Column, Column], Column] | None = None,
    weights: Sequence[float] = (0.5, 0.5), recall: int = 3,
) -> DataFrame:
    """Vector and keyword search fused, cleaned of equal beginnings, and re-ranked.

    ``docs``: doc_id, text, vector.  ``queries``: query_id, text, vector.
    """
    texts = docs.select("doc_id", "text")
    dense = mmr(docs, queries, recall * k).join(texts, "doc_id")
    sparse = bm25(docs, queries, recall * k).join(texts, "doc_id")
    fused = dedup_prefix(rrf([dense, sparse], weights))
    if scorer is None:
        return top_k(fused, ["query_id"], [F.desc("score"), "doc_id"], k)
    asked = fused.join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
    return rerank(asked, scorer, k).drop("query_text")


def hashing_embedder(dim: int = 64) -> Callable[[Column | str], Column]:
    """Deterministic vectors from hashed words: for tests and for tables without a model."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        import zlib

        def one(s):
            v = np.zeros(dim, dtype=np.float32)
            for word in (s or "").lower().split():
                h = zlib.crc32(word.encode())
                v[h % dim] += 1.0 if h & 0x10000 else -1.0
            return v

        return texts.map(one)

    return embed


def embed(df: DataFrame, text: str, model: Callable[[Column | str], Column], out: str = "vector") -> DataFrame:
    """Add vectors from a caller's model."""
    return df.withColumn(out, model(F.col(text)))


def similarity_of(left: str, right: str) -> Column:
    return F.coalesce(cosine(left, right), F.lit(0.0))


def _scaled(v: Column, w: float) -> Column:
    return F.transform(v, lambda x: x * F.lit(w))


def weighted_vector(vectors: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    """Unit vectors side by side, scaled: their dot product is the weighted sum of cosines.

    Stored rows use unit weights; requests carry the weights.
    """
    parts = []
    for i, name in enumerate(vectors):
        v = F.coalesce(unit(name), F.transform(F.col(name), lambda x: x.cast("double")))
        w = 1.0 if weights is None else float(weights[i])
        parts.append(v if w == 1.0 else _scaled(v, w))
    return F.concat(*parts)
