"""Queries of the answering family, over all questions and their sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answers as A
from ..operators.keyed import join_bounded, once_per_key
from ..session import table
from ..sources import readers, writers
from .text import _SOURCES


def sources(spark: SparkSession, d: str) -> DataFrame:
    """Passages that were returned for questions, each key once, normalized."""
    return A.normalize_passages(once_per_key(table(spark, d, "sources"), "source_id"))


def normalized(spark: SparkSession, d: str) -> DataFrame:
    """Every passage in the common shape."""
    return sources(spark, d).select("source_id", "question_id", "rank_no", "text", "source_document", "page_number", "score")


def rollup(spark: SparkSession, d: str) -> DataFrame:
    """Places and best score of each document for each question."""
    s = sources(spark, d).filter("question_id is not null").withColumn("_rank", F.struct("rank_no", "source_id"))
    return A.source_rollup(s, ["question_id"], "_rank").select("question_id", "source_document", F.md5("places").alias("places"), "top_score")


def known(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the cache and of the sources, with their state."""
    return A.known_documents(table(spark, d, "cache_entries"), table(spark, d, "sources").select(F.col("doc").alias("source_document")))


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Every request, with its passages: a question and when it was answered, also if that is null; questions never asked come once."""
    s = once_per_key(table(spark, d, "sources"), "source_id").filter("question_id is not null")
    s = A.normalize_passages(s.withColumn("_request", F.struct("question_id", "answered_at")))
    found = A.passages_by_question(s, "_request", "rank_no").select(F.col("_request.question_id").alias("id"), F.col("_request.answered_at").alias("answered_at"), "passages")
    q = once_per_key(table(spark, d, "qa_cases"), "id")
    asked = join_bounded(found, q, ["id"], F.col("answered_at"))
    never = q.join(found.select("id").distinct(), "id", "left_anti")
    asked = asked.unionByName(never, allowMissingColumns=True)
    return asked.withColumn("request", F.concat("id", F.lit("@"), F.coalesce(F.unix_micros("answered_at").cast("string"), F.lit(""))))


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """The prompt of every request."""
    return requests(spark, d).select("id", "answered_at", F.md5(A.prompt(F.col("question"), F.col("passages"))).alias("digest"), F.coalesce(F.size("passages"), F.lit(0)).alias("passages"))


def answered(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the stand-in model to every request."""
    return A.answer(requests(spark, d), "request").select("id", "answered_at", "answer", F.coalesce(F.size("sources"), F.lit(0)).alias("sources"))


def checked(spark: SparkSession, d: str) -> DataFrame:
    """Checks of the answers to all requests, by category."""
    return A.check_answers(A.answer(requests(spark, d), "request")).groupBy("category").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"))


def chats(spark: SparkSession, d: str) -> DataFrame:
    """The online path over all requests; a question with a digit 7 in its id fails to retrieve."""
    q = requests(spark, d).withColumn("retrieval_error", F.when(F.col("id").contains("7"), F.lit("timeout")))
    return A.chat(q, True, "request").select("id", "answered_at", F.md5("answer").alias("answer"), F.coalesce(F.size("sources"), F.lit(0)).alias("sources"))


def cache(spark: SparkSession, d: str) -> DataFrame:
    """Cache status of every document version in the chunks."""
    manifest = table(spark, d, "chunks").select("source_document", "source_fingerprint", "extraction_version").distinct()
    return readers.probe_cache(manifest, table(spark, d, "cache_entries").select("source_document", "source_fingerprint", "extraction_version", "page_count"))


def round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The index written as JSON lines and loaded by the lenient reader."""
    from ..session import shared_dir

    path = f"{shared_dir(spark)}/index-{spark.sparkContext.applicationId}.jsonl"
    writers.write_jsonl(once_per_key(table(spark, d, "document_chunks"), "chunk_index"), path)
    return readers.read_index(spark, path)[1]


_PASSAGE = "coalesce(nullif(snippet, ''), '') AS text, coalesce(nullif(doc, ''), 'Unknown') AS source_document, coalesce(page, 0) AS page_number, coalesce(score, 0.0) AS score"
_ALL = f"""p AS (SELECT question_id, rank_no, answered_at, {_PASSAGE} FROM {_SOURCES} WHERE question_id IS NOT NULL), n AS (SELECT question_id, answered_at, count(*) AS passages FROM p GROUP BY 1, 2),
    q AS (SELECT DISTINCT ON (id, answered_at) c.*, n.answered_at, coalesce(n.passages, 0) AS passages FROM qa_cases c LEFT JOIN n ON n.question_id = c.id)"""
_BLANK = f"regexp_replace(coalesce(question, ''), '^{X.SPACE}+|{X.SPACE}+$', '', 'g') = ''"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_ANSWER = f"CASE WHEN {_BLANK} THEN {_quoted(A.INVALID_QUESTION)} WHEN passages = 0 THEN {_quoted(A.INSUFFICIENT)} ELSE {_quoted(A.MOCK_ANSWER)} END"
_ADMITS = "(" + " OR ".join(f"contains(lower(answer), {_quoted(p)})" for p in A.INSUFFICIENT_PHRASES) + ")"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "rag_passages": normalized, "rag_source_rollup": rollup, "rag_known_documents": known, "rag_prompts": prompts, "rag_answers": answered, "rag_checks": checked, "rag_chat": chats,
    "src_cache_status": cache, "src_cache_stats": lambda spark, d: readers.cache_stats(cache(spark, d)), "src_index_load": round_trip,
}
SQL: dict[str, str] = {
    "rag_passages": f"SELECT source_id, question_id, rank_no, {_PASSAGE} FROM {_SOURCES}",
    "rag_source_rollup": f"""WITH s AS (SELECT question_id, rank_no, source_id, {_PASSAGE} FROM {_SOURCES} WHERE question_id IS NOT NULL)
        SELECT question_id, source_document, md5(string_agg('§' || page_number, ', ' ORDER BY rank_no, source_id)) AS places, max(score) AS top_score FROM s GROUP BY 1, 2""",
    "rag_known_documents": """WITH k AS (SELECT DISTINCT source_document FROM cache_entries WHERE source_document IS NOT NULL), r AS (SELECT DISTINCT doc AS source_document FROM sources WHERE doc IS NOT NULL),
        u AS (SELECT coalesce(k.source_document, r.source_document) AS source_document, CASE WHEN k.source_document IS NULL THEN 'unknown' WHEN r.source_document IS NULL THEN 'inactive' ELSE 'active' END AS state FROM k FULL JOIN r ON k.source_document = r.source_document)
        SELECT source_document, replace(regexp_replace(source_document, '(?i)\\.pdf$', ''), '_', ' ') AS label, state FROM u""",
    "rag_prompts": f"""WITH {_ALL}, b AS (SELECT question_id, answered_at, string_agg('[Source ' || i || ']' || chr(10) || 'Document: ' || source_document || chr(10) || 'Page: ' || page_number || chr(10) || 'Score: ' || score || chr(10) || 'Text: ' || text, chr(10) || chr(10) ORDER BY i) AS context
            FROM (SELECT *, row_number() OVER (PARTITION BY question_id, answered_at ORDER BY rank_no, text, source_document, page_number, score) AS i FROM p) GROUP BY 1, 2)
        SELECT id, q.answered_at, md5(regexp_replace('SYSTEM PROMPT:' || chr(10) || {_quoted(A.SYSTEM_PROMPT)} || chr(10) || chr(10) || 'USER QUESTION:' || chr(10) || coalesce(question, '') || chr(10) || chr(10) || 'RETRIEVED DOCUMENT CHUNKS:' || chr(10)
            || coalesce(context, {_quoted(A.NO_CHUNKS)}) || chr(10) || chr(10) || 'TASK:' || chr(10) || {_quoted(A.TASK)}, '^{X.SPACE}+|{X.SPACE}+$', '', 'g')) AS digest, CAST(passages AS INTEGER) AS passages FROM q LEFT JOIN b ON b.question_id = q.id AND b.answered_at IS NOT DISTINCT FROM q.answered_at""",
    "rag_answers": f"WITH {_ALL} SELECT id, answered_at, {_ANSWER} AS answer, CAST(CASE WHEN {_BLANK} THEN 0 ELSE passages END AS INTEGER) AS sources FROM q",
    "rag_checks": f"""WITH {_ALL}, a AS (SELECT *, {_ANSWER} AS answer, CASE WHEN {_BLANK} THEN 0 ELSE passages END AS n FROM q)
        SELECT category, count(*) AS total, count(*) FILTER (WHERE CASE WHEN category = 'empty_question' THEN contains(lower(answer), 'valid question') WHEN category IN ('insufficient_context', 'unrelated_question') THEN {_ADMITS}
            WHEN category IN ({", ".join(map(_quoted, A.CATEGORIES_WITH_SOURCES))}) THEN n > 0 ELSE true END) AS passed FROM a GROUP BY 1""",
    "rag_chat": f"""WITH {_ALL} SELECT id, answered_at, md5(CASE WHEN contains(id, '7') THEN 'Retrieval failed: timeout' WHEN passages = 0 THEN 'No relevant passages found for: "' || coalesce(question, '') || '".' ELSE {_ANSWER} END) AS answer,
        CAST(CASE WHEN contains(id, '7') THEN 0 ELSE passages END AS INTEGER) AS sources FROM q""",
    "src_cache_status": """WITH m AS (SELECT DISTINCT source_document, source_fingerprint, extraction_version FROM chunks)
        SELECT m.*, CASE WHEN c.source_fingerprint IS NULL THEN 'miss' WHEN c.page_count IS NOT NULL AND c.source_document = m.source_document THEN 'hit' ELSE 'invalid' END AS cache_status
        FROM m LEFT JOIN cache_entries c ON c.extraction_version = m.extraction_version AND c.source_fingerprint = m.source_fingerprint""",
    "src_cache_stats": """WITH m AS (SELECT DISTINCT source_document, source_fingerprint, extraction_version FROM chunks),
        s AS (SELECT CASE WHEN c.page_count IS NOT NULL AND c.source_document = m.source_document THEN 1 ELSE 0 END AS hit FROM m LEFT JOIN cache_entries c ON c.extraction_version = m.extraction_version AND c.source_fingerprint = m.source_fingerprint)
        SELECT count(*) FILTER (WHERE hit = 1) AS hits, count(*) FILTER (WHERE hit = 0) AS misses FROM s""",
    "src_index_load": """WITH c AS (SELECT DISTINCT ON (chunk_index) * FROM document_chunks WHERE chunk_index IS NOT NULL)
        SELECT count(*) FILTER (WHERE text IS NOT NULL AND source_document IS NOT NULL AND page_number IS NOT NULL AND len(embedding) = 384) AS loaded,
               count(*) FILTER (WHERE NOT coalesce(text IS NOT NULL AND source_document IS NOT NULL AND page_number IS NOT NULL AND len(embedding) = 384, false)) AS skipped FROM c""",
}
