"""Exact cosine search: the top k rows of an index for one query or for many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .keyed import join_bounded
from .ordered import positions

#: Queries that go to all tasks at once.
QUERIES_AT_ONCE = 4096
#: Scores that agree to so many decimals are ties, and the smaller key comes first.
TIE_DECIMALS = 9


def magnitude(v: Column) -> Column:
    """The Euclidean length of a vector."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    """The dot product; 0 for vectors of different size."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; 0 if one is empty, all zero, or of another size."""
    norm = magnitude(a) * magnitude(b)
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def valid(index: DataFrame, dim: int, key: str = "chunk_index", embedding: str = "embedding") -> DataFrame:
    """The rows a search can use: a key, and a vector of the right size. All-zero vectors stay, with score 0."""
    return index.filter(F.col(key).isNotNull() & (F.size(embedding) == dim))


def store_info(index: DataFrame, dim: int, embedding: str = "embedding") -> DataFrame:
    """``(rows, skipped, dimension)``: what a loader keeps and leaves out; dimension 0 if nothing is kept."""
    good = F.coalesce(F.size(embedding) == dim, F.lit(False))
    return index.agg(
        F.count_if(good).alias("rows"), F.count_if(~good).alias("skipped"), F.when(F.count_if(good) > 0, F.lit(dim)).otherwise(0).alias("dimension")
    )


def search_one(index: DataFrame, query: list[float], k: int = 5, dim: int | None = None, key: str = "chunk_index", embedding: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, score, *keep)`` of the ``k`` best rows for one query, in the JVM: a distributed top-k without a full sort.

    An empty query, one of a size other than ``dim``, or ``k`` of 0 or less gives no rows. Ties go to the smaller key.
    """
    dim = len(query or []) if dim is None else dim
    schema = [F.col(key), F.col("score"), *keep]
    usable = valid(index, dim, key, embedding)
    if not query or len(query) != dim or k <= 0:
        return usable.withColumn("score", F.lit(0.0)).select(*schema).limit(0)
    length = float(np.sqrt(sum(x * x for x in query)))
    value = F.array(*[F.lit(float(x)) for x in query])
    norm = magnitude(F.col(embedding)) * length
    scored = usable.withColumn("score", F.when(norm > 0, dot(F.col(embedding), value) / norm).otherwise(F.lit(0.0)))
    return scored.select(*schema).orderBy(F.round("score", TIE_DECIMALS).desc(), key).limit(k)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> pa.RecordBatch:
    """Each query's best rows of a block, by matrix products of bounded size."""
    out_q, out_r, out_s = [], [], []
    order = np.argsort(row_ids, kind="stable")
    rows, row_ids = rows[order], row_ids[order]
    step = max(1, 4_000_000 // max(1, len(rows)))
    for start in range(0, len(queries), step):
        scores = queries[start : start + step] @ rows.T
        rounded = np.round(scores, TIE_DECIMALS)
        if len(rows) > k:
            # all that tie with the k-th, so that the smaller keys among them can be kept
            kth = -np.partition(-rounded, k - 1, axis=1)[:, k - 1]
            at_q, at_r = np.nonzero(rounded >= kth[:, None])
        else:
            at_q, at_r = np.nonzero(np.ones_like(rounded, bool))
        ranked = np.lexsort((row_ids[at_r], -rounded[at_q, at_r], at_q))
        at_q, at_r = at_q[ranked], at_r[ranked]
        place = np.arange(len(at_q)) - np.searchsorted(at_q, at_q)
        keep = place < k
        out_q.append(query_ids[start + at_q[keep]])
        out_r.append(row_ids[at_r[keep]])
        out_s.append(scores[at_q[keep], at_r[keep]])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_r, out_s)], ["query_id", "row_id", "score"])


def search(queries: DataFrame, index: DataFrame, k: int = 5, dim: int = 384, query_id: str = "query_id", query_vector: str = "embedding",
           key: str = "chunk_index", embedding: str = "embedding") -> DataFrame:
    """``(query_id, rank, key, score)``: the ``k`` best rows of the index for every query.

    Scores are computed in double precision by matrix products in Arrow batches. Queries, which are
    counted, go in groups of about ``QUERIES_AT_ONCE`` to the tasks that scan the index, so that only
    each batch's best rows are shuffled, never the index. A group more is a scan more: for a large
    share of the index as queries an approximate index is the better way. The best rows are merged
    by a window that keeps ``k`` for each query. Ties go to the smaller key; queries of another size
    have no rows; an all-zero vector scores 0; ``k`` of 0 or less gives no rows.
    """
    spark = index.sparkSession
    schema = "query_id long, row_id long, score double"
    asked = queries.filter(F.col(query_id).isNotNull() & (F.size(query_vector) == dim)).select(F.col(query_id).cast("long").alias("query_id"), F.col(query_vector).alias("q"))
    rows = valid(index, dim, key, embedding).select(F.col(key).cast("long").alias("row_id"), F.col(embedding).alias("v"))
    if k <= 0:
        return spark.createDataFrame([], f"{query_id} long, rank int, {key} long, score double")

    def best_of(group: DataFrame) -> DataFrame:
        table = group.toArrow()
        ids = np.asarray(table.column("query_id").combine_chunks(), np.int64) if table.num_rows else np.zeros(0, np.int64)
        vectors = _unit(_matrix(table.column("q").combine_chunks(), dim)) if table.num_rows else np.zeros((0, dim))
        shared = spark.sparkContext.broadcast((ids, vectors))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors = shared.value
            for batch in batches:
                if batch.num_rows and len(ids):
                    yield _best(vectors, ids, _unit(_matrix(batch.column("v"), dim)), np.asarray(batch.column("row_id")), k)

        return rows.mapInArrow(scan, schema)

    n = asked.count()
    if n <= QUERIES_AT_ONCE:
        partial = best_of(asked)
    else:
        groups = -(-n // QUERIES_AT_ONCE)
        parted = materialize(asked.withColumn("_group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")), "queries")
        found = [materialize(best_of(parted.filter(F.col("_group") == g).drop("_group")), "best") for g in range(groups)]
        partial = found[0]
        for more in found[1:]:
            partial = partial.unionByName(more)
    order = W.partitionBy("query_id").orderBy(F.round("score", TIE_DECIMALS).desc(), "row_id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query_id").alias(query_id), "rank", F.col("row_id").alias(key), "score")


def to_sources(hits: DataFrame) -> DataFrame:
    """Hits in the shape of citations: document, page as an integer, snippet, and score as a double."""
    return hits.select(
        *[c for c in ("query_id", "rank") if c in hits.columns],
        F.col("source_document").alias("doc"), F.col("page_number").cast(T.IntegerType()).alias("page"), F.col("text").alias("snippet"), F.col("score").cast("double").alias("score"),
    )


def latency_stats(timings: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """Mean and the p50, p90 and p99 of a benchmark: the element at ``floor(p * (n - 1))`` of the sorted values.

    Values are placed in one order by group and value (:func:`.ordered.positions`), so that no group
    is a single window or array; what precedes a group is the least place of its values.
    """
    group = F.col(by) if by else F.lit(0)
    placed = positions(timings.filter(F.col(value).isNotNull()).select(group.alias("_g"), F.col(value).alias("_v")), ["_g", "_v"])
    sizes = placed.groupBy("_g").agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.min("_position").alias("_first"))
    near = join_bounded(placed.withColumn("_k", F.coalesce(F.xxhash64("_g"), F.lit(0))), sizes.withColumn("_k", F.coalesce(F.xxhash64("_g"), F.lit(0))).withColumnRenamed("_g", "_name"), ["_k"], F.col("_position"))
    at = F.col("_position") - F.col("_first")
    picks = [F.max(F.when(at == F.floor(F.lit(p) * (F.col("n") - 1)), F.col("_v"))).alias(name) for p, name in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))]
    found = near.groupBy("_k").agg(F.first("_name").alias("_name"), F.first("n").alias("n"), F.first("mean").alias("mean"), *picks)
    return found.select(*([F.col("_name").alias(by)] if by else []), "n", "mean", "p50", "p90", "p99")
