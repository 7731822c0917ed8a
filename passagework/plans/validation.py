"""Queries of the validation family, over all chunk records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import validation as V
from ..operators.keyed import once_per_key
from ..session import table
from .text import _CHUNKS, CONTROL, REVISION_SQL, interleaved_sql, normalize_sql


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunk records, each key once, in the newest delivery."""
    return once_per_key(table(spark, d, "chunks"), "chunk_index", "generated_at")


def records(spark: SparkSession, d: str) -> DataFrame:
    """Every record's errors, warnings and reason to drop."""
    rows = V.judged(chunks(spark, d))
    return rows.select("chunk_index", F.array_join("validation_errors", "; ").alias("errors"), F.array_join("validation_warnings", "; ").alias("warnings"), "drop_reason", F.md5("text").alias("digest"), "section_title")


def summary(spark: SparkSession, d: str) -> DataFrame:
    """The summary as plain columns."""
    s = V.validate(chunks(spark, d)).summary
    return s.select("input_records", "validated_records", "dropped_records", "hard_errors", "warnings", F.size("global_errors").alias("global_errors"), "exit_code")


def overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Words that each chunk shares with its neighbours in the document, by the fold the viewer shows."""
    rows = chunks(spark, d).select("chunk_index", "source_document", "text")
    return V.neighbour_overlaps(rows).select("chunk_index", "source_document", "total_words", "overlap_previous", "overlap_next")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Per document: records, pages, identities, and lengths."""
    return chunks(spark, d).groupBy("source_document").agg(
        F.count("*").alias("records"), F.count_distinct("page_number").alias("pages"), F.count_distinct("chunk_id").alias("ids"), F.max(F.length("text")).alias("longest"),
        F.sum(F.when(F.length("text") > 900, 1).otherwise(0)).alias("over_900"),
    )


def page_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sorted distinct pages with their bounds, and block types in order of first use, with the heading a path implies."""
    pages = F.array_sort(F.array_distinct("page_numbers"))
    types = F.array_distinct(F.coalesce("block_types", F.array().cast("array<string>")))
    headed = F.when((F.size("section_path") > 0) & ~F.array_contains(types, "heading"), F.concat(F.array(F.lit("heading")), types)).otherwise(types)
    return chunks(spark, d).select(
        "chunk_index", F.array_join(F.transform(pages, lambda p: p.cast("string")), ",").alias("pages"), F.array_min("page_numbers").alias("first_page"), F.array_max("page_numbers").alias("last_page"), F.array_join(headed, ",").alias("types")
    )


_JUDGED = rf"""
    c AS MATERIALIZED (SELECT *, coalesce(text, '') AS raw, {normalize_sql('text')} AS clean, coalesce({REVISION_SQL}, false) AS coded, coalesce(block_types = ['heading'], false) AS heading FROM {_CHUNKS}),
    n AS (SELECT raw, count(*) AS same FROM c GROUP BY 1), i AS (SELECT chunk_id, count(*) AS same_id FROM c GROUP BY 1),
    f AS (SELECT clean AS kept, min(chunk_index) AS first FROM c WHERE NOT (coded AND heading) GROUP BY 1),
    j AS (SELECT c.*, n.same, i.same_id, f.first,
        list_filter([CASE WHEN clean = '' THEN 'empty text' END, CASE WHEN length(clean) > 1000 THEN 'text length exceeds 1000' END, CASE WHEN page_start > page_end THEN 'page_start is greater than page_end' END,
            CASE WHEN chunking_version = 'semantic-v1' THEN 'missing semantic fields: embedding_max_tokens, embedding_text' END, CASE WHEN chunking_version = 'semantic-v1' THEN 'empty embedding_text' END,
            CASE WHEN i.same_id > 1 THEN 'chunk_id is not unique' END], lambda x: x IS NOT NULL) AS errors,
        list_filter([CASE WHEN regexp_matches(raw, '{CONTROL}') THEN 'control_characters_removed' END, CASE WHEN regexp_matches(raw, '[A-Za-z]-\s*\n\s*[a-z]') THEN 'hyphenated_line_breaks_fixed' END,
            CASE WHEN n.same > 1 THEN 'duplicate_text' END, CASE WHEN coded THEN 'revision_code_section_title' END, CASE WHEN heading THEN 'heading_only' END,
            CASE WHEN length(clean) - length(replace(clean, '|', '')) > 20 THEN 'pipe_heavy' END, CASE WHEN {interleaved_sql('clean')} THEN 'likely_column_interleaved' END,
            CASE WHEN len(page_numbers) > 0 AND (list_min(page_numbers) <> page_start OR list_max(page_numbers) <> page_end) THEN 'page_range_mismatch' END], lambda x: x IS NOT NULL) AS warnings,
        CASE WHEN n.same > 1 AND f.first < chunk_index THEN 'duplicate_text' WHEN heading AND coded THEN 'revision_code_heading_only' END AS drop_reason
        FROM c JOIN n USING (raw) JOIN i ON i.chunk_id IS NOT DISTINCT FROM c.chunk_id LEFT JOIN f ON f.kept = c.raw)
"""
_WORDS = r"list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '" + X.SPACE + r"+', ' ', 'g')), ' '), lambda x: x <> '')"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "val_records": records,
    "val_summary": summary,
    "val_warning_counts": lambda spark, d: V.warning_counts(V.judged(chunks(spark, d))),
    "val_contiguous": lambda spark, d: V.contiguous(chunks(spark, d)),
    "val_oversized": lambda spark, d: V.oversized(chunks(spark, d), 256),
    "win_overlaps": overlaps,
    "win_renumber": lambda spark, d: V.renumber(chunks(spark, d).select("source_document", F.col("chunk_index").alias("local_index")), "source_document", "local_index").select("source_document", "local_index", "chunk_index"),
    "agg_corpus": corpus,
    "agg_page_sets": page_sets,
}
SQL: dict[str, str] = {
    "val_records": f"WITH {_JUDGED} SELECT chunk_index, array_to_string(errors, '; ') AS errors, array_to_string(warnings, '; ') AS warnings, drop_reason, md5(clean) AS digest, CASE WHEN NOT coded THEN section_title END AS section_title FROM j",
    "val_summary": f"""WITH {_JUDGED}, s AS (SELECT count(*) AS input_records, count(*) FILTER (WHERE drop_reason IS NULL) AS validated_records, count(*) FILTER (WHERE drop_reason IS NOT NULL) AS dropped_records,
            CAST(coalesce(sum(len(errors)) FILTER (WHERE drop_reason IS NULL), 0) AS BIGINT) AS e, CAST(coalesce(sum(len(warnings)) FILTER (WHERE drop_reason IS NULL), 0) AS BIGINT) AS warnings,
            CASE WHEN count(DISTINCT chunk_index) = count(*) AND min(chunk_index) = 0 AND max(chunk_index) = count(*) - 1 THEN 0 ELSE 1 END AS g FROM j)
        SELECT input_records, validated_records, dropped_records, e + g AS hard_errors, warnings, CAST(g AS INTEGER) AS global_errors, CAST(CASE WHEN e + g > 0 THEN 1 WHEN warnings > 0 THEN 2 ELSE 0 END AS INTEGER) AS exit_code FROM s""",
    "val_warning_counts": f"WITH {_JUDGED}, w AS (SELECT unnest(warnings) AS warning FROM j WHERE drop_reason IS NULL) SELECT warning, count(*) AS records FROM w GROUP BY 1",
    "val_contiguous": f"SELECT count(*) = 0 OR (count(DISTINCT chunk_index) = count(*) AND min(chunk_index) = 0 AND max(chunk_index) = count(*) - 1) AS contiguous FROM {_CHUNKS}",
    "val_oversized": f"""WITH o AS (SELECT chunk_index, token_count FROM {_CHUNKS} WHERE token_count > 256), f AS (SELECT * FROM o ORDER BY chunk_index LIMIT 5)
        SELECT (SELECT count(*) FROM o) AS oversized, coalesce(string_agg('chunk ' || chunk_index || ' has ' || token_count, ', ' ORDER BY chunk_index), '') AS message FROM f""",
    "win_overlaps": f"""WITH w AS (SELECT chunk_index, source_document, {_WORDS} AS words FROM {_CHUNKS}),
        l AS (SELECT *, coalesce(lag(words) OVER (PARTITION BY source_document ORDER BY chunk_index), []) AS before FROM w),
        o AS (SELECT chunk_index, source_document, CAST(len(words) AS INTEGER) AS total_words,
              CAST(coalesce(list_max(list_filter(range(1, least(len(before), len(words)) + 1), lambda k: before[-k:] = words[1:k])), 0) AS INTEGER) AS overlap_previous FROM l)
        SELECT *, coalesce(lead(overlap_previous) OVER (PARTITION BY source_document ORDER BY chunk_index), 0) AS overlap_next FROM o""",
    "win_renumber": f"SELECT source_document, chunk_index AS local_index, row_number() OVER (ORDER BY source_document NULLS FIRST, chunk_index) - 1 AS chunk_index FROM {_CHUNKS}",
    "agg_corpus": f"""SELECT source_document, count(*) AS records, count(DISTINCT page_number) AS pages, count(DISTINCT chunk_id) AS ids, CAST(max(length(text)) AS INTEGER) AS longest, CAST(count(*) FILTER (WHERE length(text) > 900) AS BIGINT) AS over_900 FROM {_CHUNKS} GROUP BY 1""",
    "agg_page_sets": f"""WITH c AS (SELECT *, list_filter(coalesce(block_types, []), lambda x, i: list_position(coalesce(block_types, []), x) = i) AS types FROM {_CHUNKS})
        SELECT chunk_index, array_to_string(list_transform(list_sort(list_distinct(page_numbers)), lambda p: CAST(p AS VARCHAR)), ',') AS pages, list_min(page_numbers) AS first_page, list_max(page_numbers) AS last_page,
        array_to_string(CASE WHEN len(section_path) > 0 AND NOT list_contains(types, 'heading') THEN list_concat(['heading'], types) ELSE types END, ',') AS types FROM c""",
}
