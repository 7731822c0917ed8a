"""Queries of the vector search family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vector
from ..operators.keyed import once_per_key
from ..session import table

DIM = 384


def index_of(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that the vector store loads, each key once."""
    return once_per_key(table(spark, d, "document_chunks"), "chunk_index")


def _asked(index: DataFrame) -> DataFrame:
    """The stated query set: every row whose key is divisible by 100."""
    return index.filter("chunk_index % 100 = 0").select(F.col("chunk_index").alias("query_id"), "embedding")


def topk_batch(spark: SparkSession, d: str) -> DataFrame:
    index = index_of(spark, d)
    return vector.search(_asked(index), index, k=10, dim=DIM).withColumn("score", F.round("score", 6))


def topk_sources(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: five passages for every question vector, as citations with their text."""
    index = index_of(spark, d)
    hits = vector.search(_asked(index), index, k=5, dim=DIM)
    texts = index.select("chunk_index", "text", "source_document", "page_number")
    return vector.to_sources(hits.join(texts, hits["chunk_index"] == texts["chunk_index"]).drop("chunk_index")).withColumn("score", F.round("score", 6))


def topk_one(spark: SparkSession, d: str) -> DataFrame:
    """One query, as in the online path: the usable row of the least key that has a direction."""
    index = index_of(spark, d)
    first = vector.valid(index, DIM).filter(F.exists("embedding", lambda x: x != 0)).orderBy("chunk_index").select("embedding").limit(1).collect()
    hits = vector.search_one(index, list(first[0][0]) if first else [], k=10, dim=DIM, keep=("source_document", "page_number"))
    return hits.withColumn("score", F.round("score", 6))


def self_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Whether every question vector finds itself, or an equal vector, first."""
    index = index_of(spark, d)
    best = vector.search(_asked(index.filter(F.exists("embedding", lambda x: x != 0))), index, k=1, dim=DIM)
    return best.select("query_id", (F.col("score") >= 0.999).alias("found"))


def label_topk(spark: SparkSession, d: str) -> DataFrame:
    """How often the ten nearest of a vector have its label."""
    rows = table(spark, d, "embeddings")
    dim = 64
    hits = vector.search(rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), rows, k=11, dim=dim, key="vec_id")
    hits = hits.filter("query_id <> vec_id")
    names = rows.select("vec_id", "label")
    own = names.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    return hits.join(names, "vec_id").join(own, "query_id").groupBy("query_label").agg(F.count("*").alias("hits"), F.count_if(F.col("label") == F.col("query_label")).alias("same_label"))


_INDEX = "SELECT DISTINCT ON (chunk_index) * FROM document_chunks WHERE chunk_index IS NOT NULL"
_SCORE = "CASE WHEN list_max(a.v) = 0 AND list_min(a.v) = 0 OR list_max(b.v) = 0 AND list_min(b.v) = 0 THEN 0.0 ELSE list_cosine_similarity(a.v, b.v) END"
_HITS = f"""
    idx AS MATERIALIZED (SELECT chunk_index, text, source_document, page_number, CAST(embedding AS DOUBLE[]) AS v FROM ({_INDEX}) WHERE len(embedding) = 384),
    scored AS (SELECT a.chunk_index AS query_id, b.chunk_index, b.text, b.source_document, b.page_number, {_SCORE} AS score
               FROM idx a, idx b WHERE a.chunk_index % 100 = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_index) AS rank FROM scored)
"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "vec_topk_batch": topk_batch,
    "vec_topk_sources": topk_sources,
    "vec_topk_one": topk_one,
    "vec_self_retrieval": self_retrieval,
    "vec_store_info": lambda spark, d: vector.store_info(index_of(spark, d), DIM),
    "vec_label_topk": label_topk,
    "vec_bench_stats": lambda spark, d: vector.latency_stats(table(spark, d, "events"), "value", "event_type").withColumn("mean", F.round("mean", 6)),
}
SQL: dict[str, str] = {
    "vec_topk_batch": f"WITH {_HITS} SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, CAST(chunk_index AS BIGINT) AS chunk_index, round(score, 6) AS score FROM ranked WHERE rank <= 10",
    "vec_topk_sources": f"WITH {_HITS} SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, source_document AS doc, page_number AS page, text AS snippet, round(score, 6) AS score FROM ranked WHERE rank <= 5",
    "vec_topk_one": f"""WITH idx AS MATERIALIZED (SELECT chunk_index, source_document, page_number, CAST(embedding AS DOUBLE[]) AS v FROM ({_INDEX}) WHERE len(embedding) = 384),
        q AS (SELECT v FROM idx WHERE list_max(v) > 0 OR list_min(v) < 0 ORDER BY chunk_index LIMIT 1),
        scored AS (SELECT b.chunk_index, CASE WHEN list_max(b.v) = 0 AND list_min(b.v) = 0 THEN 0.0 ELSE list_cosine_similarity(q.v, b.v) END AS score, b.source_document, b.page_number FROM q, idx b)
        SELECT chunk_index, round(score, 6) AS score, source_document, page_number FROM scored ORDER BY round(score, 9) DESC, chunk_index LIMIT 10""",
    "vec_self_retrieval": f"""WITH idx AS MATERIALIZED (SELECT chunk_index, CAST(embedding AS DOUBLE[]) AS v FROM ({_INDEX}) WHERE len(embedding) = 384 AND (list_max(embedding) > 0 OR list_min(embedding) < 0))
        SELECT CAST(a.chunk_index AS BIGINT) AS query_id, max(list_cosine_similarity(a.v, b.v)) >= 0.999 AS found FROM idx a, idx b WHERE a.chunk_index % 100 = 0 GROUP BY 1""",
    "vec_store_info": f"""SELECT count(*) FILTER (WHERE len(embedding) = 384) AS rows, count(*) FILTER (WHERE embedding IS NULL OR len(embedding) <> 384) AS skipped,
        CASE WHEN count(*) FILTER (WHERE len(embedding) = 384) > 0 THEN 384 ELSE 0 END AS dimension FROM ({_INDEX})""",
    "vec_label_topk": """WITH idx AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE len(embedding) = 64),
        scored AS (SELECT a.vec_id AS query_id, a.label AS query_label, b.vec_id, b.label, list_cosine_similarity(a.v, b.v) AS score FROM idx a, idx b WHERE a.vec_id % 100 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM scored)
        SELECT query_label, count(*) AS hits, count(*) FILTER (WHERE label = query_label) AS same_label FROM ranked WHERE rank <= 11 AND vec_id <> query_id GROUP BY 1""",
    "vec_bench_stats": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
        SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) FILTER (WHERE i = floor(0.5 * (n - 1))) AS p50,
               max(value) FILTER (WHERE i = floor(0.9 * (n - 1))) AS p90, max(value) FILTER (WHERE i = floor(0.99 * (n - 1))) AS p99 FROM r GROUP BY 1""",
}
