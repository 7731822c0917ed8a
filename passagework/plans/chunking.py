"""Queries of the chunking family, over all documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking as C
from ..operators import layout as L
from ..operators.keyed import once_per_key
from ..session import table
from .layout import _LINES, lines
from .text import _SENTENCES, full_lines_sql


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their paragraphs as typed blocks, ten to a page."""
    docs = once_per_key(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    parts = F.filter(F.transform(F.split(X.text_or_empty(F.col("text")), r"\n[ \t]*\n"), X.strip), lambda p: p != "")
    none = F.lit(None).cast("double")

    def block(p: F.Column, i: F.Column) -> F.Column:
        table_like = F.regexp_replace(p, r"[^|\t]", "").rlike(".{4,}")
        return F.struct(
            p.alias("text"), (F.floor(i / 10) + 1).cast("int").alias("page_number"), F.lit(None).cast("array<double>").alias("bbox"),
            L.block_type(p, table_like, none, none, F.lit(False)).alias("block_type"), none.alias("font_size"), F.lit(False).alias("is_bold"),
        )

    return docs.select(F.col("doc_id").cast("string").alias("source_document"), F.sha2(X.text_or_empty(F.col("text")), 256).alias("source_fingerprint"), F.transform(parts, block).alias("blocks"))


def semantic(spark: SparkSession, d: str) -> DataFrame:
    """Semantic chunks of all documents."""
    return C.chunk_semantic(documents(spark, d)).select("source_document", "chunk_index", "chunk_id", F.length("text").alias("chars"), "section_title", F.array_join("block_types", ",").alias("block_types"), "page_start", "page_end", "overlap_with_previous_chars")


def layout(spark: SparkSession, d: str) -> DataFrame:
    """Layout chunks of all documents."""
    return C.chunk_layout(documents(spark, d)).select("source_document", "chunk_index", "chunk_id", F.length("text").alias("chars"), "section_title", F.array_join("block_types", ",").alias("block_types"), "page_start", "page_end")


def windows(spark: SparkSession, d: str) -> DataFrame:
    """Character windows of all documents."""
    docs = once_per_key(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return C.chunk_windows(docs, "doc_id").select("doc_id", "chunk_index", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def groups(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents grouped by the greedy fold in the JVM."""
    per = lines(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.length("text").alias("n")))).alias("l"))
    numbered = per.select("doc_id", F.explode(F.arrays_zip(F.transform("l", lambda x: x["n"]).alias("n"), C.greedy_groups(F.transform("l", lambda x: x["n"])).alias("g"))).alias("u"))
    return numbered.groupBy("doc_id", F.col("u.g").alias("group_no")).agg(F.count("*").alias("units"), F.sum("u.n").alias("chars"))


def sentence_overlap(spark: SparkSession, d: str) -> DataFrame:
    """The last sentence of every document that is short enough to be repeated."""
    docs = once_per_key(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", X.at(X.split_sentences(F.col("text")), -1).alias("tail")).filter(F.length("tail") <= C.OVERLAP)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "chk_semantic": semantic, "chk_layout": layout, "chk_windows": windows, "chk_groups": groups, "chk_sentence_overlap": sentence_overlap,
}
SQL: dict[str, str] = {
    "chk_groups": f"""WITH RECURSIVE {_LINES}, o AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, length(text) AS n FROM lines),
        f AS (SELECT doc_id, i, n, 0 AS g, n AS size FROM o WHERE i = 1
              UNION ALL SELECT o.doc_id, o.i, o.n, CASE WHEN f.size + 2 + o.n <= 900 AND f.size < 700 THEN f.g ELSE f.g + 1 END, CASE WHEN f.size + 2 + o.n <= 900 AND f.size < 700 THEN f.size + 2 + o.n ELSE o.n END
              FROM f JOIN o ON o.doc_id = f.doc_id AND o.i = f.i + 1)
        SELECT doc_id, CAST(g AS INTEGER) AS group_no, count(*) AS units, CAST(sum(n) AS BIGINT) AS chars FROM f GROUP BY 1, 2""",
    # after cleaning words and single separators alternate, so tokens of odd places are words; a step goes from a window to the next
    "chk_windows": f"""WITH RECURSIVE c AS (SELECT doc_id, array_to_string({full_lines_sql("replace(coalesce(text, ''), chr(7), ' ')")}, chr(10)) AS t FROM documents),
        k AS (SELECT doc_id, regexp_extract_all(t, '[ \\n]|[^ \\n]+') AS tokens FROM c WHERE t <> ''),
        u AS (SELECT doc_id, unnest(tokens) AS x, generate_subscripts(tokens, 1) AS i FROM k),
        m AS (SELECT doc_id, i, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM u),
        d AS MATERIALIZED (SELECT doc_id, list(upto ORDER BY i) AS upto FROM m GROUP BY 1),
        w AS (SELECT doc_id, 1 AS n, 1 AS first, greatest(2, len(list_filter(upto, lambda x: x <= 1000)) + 1) AS stop FROM d
            UNION ALL
            SELECT doc_id, n, first, greatest(first + 1, len(list_filter(upto, lambda x: x <= before + 1000)) + 1) FROM
                (SELECT doc_id, n, first, upto, CASE WHEN first > 1 THEN upto[first - 1] ELSE 0 END AS before FROM
                    (SELECT doc_id, n, upto, back + CASE WHEN back % 2 = 0 THEN 1 ELSE 0 END AS first FROM
                        (SELECT w.doc_id, w.n + 1 AS n, d.upto, CASE WHEN b < w.stop THEN b ELSE w.stop END AS back
                         FROM w JOIN d ON d.doc_id = w.doc_id, LATERAL (SELECT greatest(w.first + 1, CASE WHEN d.upto[w.stop - 1] <= 100 THEN 1 ELSE len(list_filter(d.upto, lambda x: x < d.upto[w.stop - 1] - 100)) + 2 END) AS b)
                         WHERE w.stop <= len(d.upto))))),
        p AS (SELECT w.doc_id, n, rtrim(array_to_string(k.tokens[first : stop - 1], ''), ' ' || chr(10)) AS text FROM w JOIN k ON k.doc_id = w.doc_id),
        s AS (SELECT doc_id, n, unnest(range(0, length(text), 1000)) AS cut, text FROM p)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, cut) - 1 AS INTEGER) AS chunk_index, CAST(length(substr(text, cut + 1, 1000)) AS INTEGER) AS chars, md5(substr(text, cut + 1, 1000)) AS digest FROM s""",
    "chk_sentence_overlap": f"WITH s AS (SELECT doc_id, {_SENTENCES}[-1] AS tail FROM documents) SELECT doc_id, tail FROM s WHERE length(tail) <= 160",
}
