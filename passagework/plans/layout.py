"""Queries of the layout family. The tables hold no pages with boxes, so geometry is derived from positions of lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import layout as L
from ..operators.keyed import once_per_key
from ..session import table
from .text import _CHUNKS, collapse_sql, full_lines_sql, lines_sql, signature_sql
from .validation import chunks


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every document that isn't blank, collapsed, with its position."""
    docs = once_per_key(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("pos", "line")).select("doc_id", "pos", X.collapse(F.col("line")).alias("text")).filter("text <> ''")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a font size from their length and a page from their position."""
    return lines(spark, d).withColumn("font_size", 8 + (F.length("text") % 7) * 0.5).withColumn("page", F.floor(F.col("pos") / 20).cast("int"))


def _heading(t: str = "text") -> F.Column:
    none = F.lit(None).cast("double")
    return L.block_type(F.col(t), F.lit(False), none, none, F.lit(False)) == "heading"


def sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of documents with their blocks and characters."""
    return L.sections(lines(spark, d), "doc_id", "pos", _heading()).groupBy("doc_id", "section_id", "section_title").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


def block_types(spark: SparkSession, d: str) -> DataFrame:
    """Types of the lines by shape and font."""
    typed = _sized(spark, d).withColumn("type", L.block_type(F.col("text"), F.lit(False), F.col("font_size"), F.lit(9.0), F.lit(False)))
    return typed.groupBy("doc_id", "type").agg(F.count("*").alias("lines"))


def paths(spark: SparkSession, d: str) -> DataFrame:
    """How many lines stand under each path of headings."""
    none = F.lit(None).cast("double")
    level = L.heading_level(F.col("text"), none, F.array().cast("array<double>"), F.lit(False))
    leveled = lines(spark, d).withColumn("level", F.when(_heading(), level))
    return L.heading_paths(leveled, "doc_id", "pos", "level").groupBy("doc_id", F.array_join("path", " > ").alias("path")).agg(F.count("*").alias("lines"))


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs joined across line breaks."""
    return L.coalesce_paragraphs(lines(spark, d), ["doc_id"], "pos").select("doc_id", F.col("island").cast("int").alias("island"), F.md5("text").alias("digest"), "parts")


def running_lines(spark: SparkSession, d: str) -> DataFrame:
    """First and last lines that come back on the pages of a document."""
    c = chunks(spark, d)
    full = X.full_lines(F.col("text"))
    ends = c.filter(F.size(full) > 0).select("source_document", "page_number", F.explode(F.array(X.at(full, 1), X.at(full, -1))).alias("text"))
    return L.repeated_signatures(ends.filter("page_number is not null"), "source_document", "page_number", share=0.05)


def fonts(spark: SparkSession, d: str) -> DataFrame:
    """The body font of every document, and of every page, with the ranks of heading sizes."""
    sized = _sized(spark, d)
    ranks = L.font_ranks(sized.filter(_heading()), ["doc_id"]).select("doc_id", F.array_join(F.transform("ranks", lambda r: r.cast("string")), ",").alias("ranks"))
    pages = L.body_font(sized, ["doc_id", "page"], "pos").groupBy("doc_id").agg(F.sum("body_font").alias("page_fonts"))
    return L.body_font(sized, ["doc_id"], "pos").join(pages, "doc_id").join(ranks, "doc_id", "left")


def _boxes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Boxes of lines, and three regions for each document, from positions and ids."""
    x, y = (F.col("pos") * 37 % 400).cast("double"), (F.col("pos") * 53 % 700).cast("double")
    placed = lines(spark, d).withColumn("bbox", F.array(x, y, x + 20 + F.length("text") % 150, y + 10))
    docs = table(spark, d, "documents").select("doc_id").distinct().withColumn("region_index", F.explode(F.sequence(F.lit(0), F.lit(2))))
    i = F.col("doc_id") % 100 + F.col("region_index") * 90
    regions = docs.withColumn("bbox", F.array(i.cast("double"), (i * 2).cast("double"), (i + 150 + F.col("region_index") * 60).cast("double"), (i * 2 + 120).cast("double")))
    return placed, regions


def outside(spark: SparkSession, d: str) -> DataFrame:
    """Lines outside all regions."""
    placed, regions = _boxes(spark, d)
    return L.outside_tables(placed, regions.filter("region_index = 1"), ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(L.in_margin(F.col("bbox"), F.lit(700.0))).alias("in_margin"))


def regions(spark: SparkSession, d: str) -> DataFrame:
    """The smallest region of each line."""
    placed, boxes = _boxes(spark, d)
    return L.smallest_region(placed, boxes, ["doc_id"], ["doc_id", "pos"]).groupBy("doc_id", "region_index").agg(F.count("*").alias("lines"))


def reading(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of every page of twenty lines set in two columns, in reading order."""
    n = F.col("pos") % 20
    x = F.when(n < 10, 50.0).otherwise(320.0)
    placed = lines(spark, d).withColumn("page", F.floor(F.col("pos") / 20).cast("int")).withColumn("bbox", F.array(x, n % 10 * 30.0, x + 200, n % 10 * 30.0 + 10))
    parts = placed.select("doc_id", "page", "text", "bbox", F.lit(10.0).alias("font_size"), F.lit(False).alias("is_bold"), F.lit(False).alias("is_table"), F.lit(None).cast("int").alias("region"), F.col("pos").cast("int").alias("source_block"), F.lit(612.0).alias("width"))
    return L.order_pages(parts, ["doc_id", "page"]).select("doc_id", "page", "reading_order", F.md5("text").alias("digest"))


_LINES = f"""lines AS MATERIALIZED (SELECT doc_id, pos, text FROM (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS pos, {collapse_sql('unnest(l)')} AS text
    FROM (SELECT doc_id, {lines_sql('text')} AS l FROM documents)) WHERE text <> '')"""


def _heading_sql(t: str) -> str:
    listed = rf"regexp_matches({t} || ' ', '{X.LIST_MARKER}')"
    shaped = f"((upper({t}) = {t} AND lower({t}) <> {t}) OR regexp_matches({t}, '{X.SECTION_NUMBER}') OR ends_with({t}, ':'))"
    return f"(NOT {listed} AND length({t}) <= 160 AND {shaped} AND NOT regexp_matches({t}, '[.?!]$'))"


_SIZED = "sized AS (SELECT *, 8 + (length(text) % 7) * 0.5 AS font_size, CAST(floor(pos / 20) AS INTEGER) AS page FROM lines)"
_NUMBER = rf"regexp_extract(text, '{X.NUMBERED_HEADING}', 1)"
_BOXED = """boxed AS (SELECT *, pos * 37 % 400 AS x0, pos * 53 % 700 AS y0, pos * 37 % 400 + 20 + length(text) % 150 AS x1, pos * 53 % 700 + 10 AS y1 FROM lines),
    regions AS (SELECT *, i AS a0, i * 2 AS b0, i + 150 + region_index * 60 AS a1, i * 2 + 120 AS b1 FROM (SELECT doc_id, region_index, doc_id % 100 + region_index * 90 AS i FROM documents, range(3) r(region_index))),
    hits AS (SELECT b.doc_id, b.pos, r.region_index, (a1 - a0) * (b1 - b0) AS area FROM boxed b JOIN regions r ON r.doc_id = b.doc_id AND (
        ((x0 + x1) / 2 BETWEEN a0 - 5 AND a1 + 5 AND (y0 + y1) / 2 BETWEEN b0 - 5 AND b1 + 5)
        OR greatest(0, least(x1, a1) - greatest(x0, a0)) * greatest(0, least(y1, b1) - greatest(y0, b0)) >= 0.5 * (x1 - x0) * (y1 - y0)))"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "lay_sections": sections, "lay_block_types": block_types, "lay_heading_paths": paths, "lay_paragraphs": paragraphs, "lay_running_lines": running_lines,
    "lay_fonts": fonts, "lay_outside_tables": outside, "lay_smallest_region": regions, "lay_reading_order": reading,
}
SQL: dict[str, str] = {
    "lay_sections": f"""WITH {_LINES}, s AS (SELECT *, {_heading_sql('text')} AS h FROM lines),
        t AS (SELECT *, sum(h::INTEGER) OVER w AS section_id, last_value(CASE WHEN h THEN text END IGNORE NULLS) OVER w AS section_title FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
        SELECT doc_id, CAST(section_id AS BIGINT) AS section_id, section_title, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars FROM t GROUP BY ALL""",
    "lay_block_types": f"""WITH {_LINES}, {_SIZED}, t AS (SELECT doc_id, CASE WHEN regexp_matches(text || ' ', '{X.LIST_MARKER}') THEN 'list'
            WHEN {_heading_sql('text')} OR (length(text) <= 160 AND font_size >= 9.0 * 1.18 AND NOT regexp_matches(text, '[.?!]$')) THEN 'heading' ELSE 'paragraph' END AS type FROM sized)
        SELECT doc_id, type, count(*) AS lines FROM t GROUP BY ALL""",
    "lay_heading_paths": f"""WITH {_LINES}, h AS (SELECT *, CASE WHEN {_heading_sql('text')} THEN CASE WHEN {_NUMBER} <> '' THEN least(4, length({_NUMBER}) - length(replace({_NUMBER}, '.', '')) + 1)
            WHEN regexp_matches(text, '{X.LETTERED_HEADING}') THEN 3 ELSE 1 END END AS level FROM lines),
        w AS (SELECT doc_id, {", ".join(f"max(CASE WHEN level = {n} THEN pos END) OVER w AS p{n}, last_value(CASE WHEN level = {n} THEN text END IGNORE NULLS) OVER w AS t{n}" for n in (1, 2, 3, 4))}
            FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
        SELECT doc_id, concat_ws(' > ', t1, CASE WHEN p2 > coalesce(p1, -1) THEN t2 END, CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN t3 END,
            CASE WHEN p4 > greatest(coalesce(p1, -1), coalesce(p2, -1), coalesce(p3, -1)) THEN t4 END) AS path, count(*) AS lines FROM w GROUP BY ALL""",
    "lay_paragraphs": f"""WITH {_LINES}, l AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM lines),
        b AS (SELECT *, CASE WHEN before IS NULL OR (regexp_matches(right(before, 1), '[.!?;:)”"]') AND NOT regexp_matches(text, '^\\p{{Ll}}')) THEN 1 ELSE 0 END AS fresh FROM l),
        i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM b)
        SELECT doc_id, CAST(island AS INTEGER) AS island, md5(string_agg(text, ' ' ORDER BY pos)) AS digest, count(*) AS parts FROM i GROUP BY doc_id, island""",
    "lay_running_lines": f"""WITH f AS (SELECT source_document, page_number, {full_lines_sql('text')} AS l FROM {_CHUNKS} WHERE page_number IS NOT NULL),
        e AS (SELECT source_document, page_number, unnest([l[1], l[-1]]) AS text FROM f WHERE len(l) > 0), p AS (SELECT source_document, count(DISTINCT page_number) AS total FROM e GROUP BY 1),
        s AS (SELECT source_document, {signature_sql('text')} AS signature, page_number FROM e WHERE length(text) <= 200)
        SELECT s.source_document, signature, count(DISTINCT page_number) AS pages FROM s JOIN p ON p.source_document = s.source_document WHERE signature <> '' AND total >= 2
        GROUP BY s.source_document, signature, total HAVING count(DISTINCT page_number) >= greatest(2, ceil(total * 0.05))""",
    "lay_fonts": f"""WITH {_LINES}, {_SIZED}, w AS (SELECT doc_id, font_size, sum(length(text)) AS w, min(pos) AS f FROM sized GROUP BY 1, 2), p AS (SELECT doc_id, page, font_size, sum(length(text)) AS w, min(pos) AS f FROM sized GROUP BY 1, 2, 3),
        b AS (SELECT doc_id, font_size AS body_font FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, f) = 1),
        g AS (SELECT doc_id, sum(font_size) AS page_fonts FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY w DESC, f) = 1) GROUP BY 1),
        r AS (SELECT doc_id, string_agg(CAST(CAST(font_size AS DOUBLE) AS VARCHAR), ',' ORDER BY font_size DESC) AS ranks FROM (SELECT DISTINCT doc_id, font_size FROM sized WHERE {_heading_sql('text')}) GROUP BY 1)
        SELECT b.doc_id, CAST(body_font AS DOUBLE) AS body_font, CAST(page_fonts AS DOUBLE) AS page_fonts, ranks FROM b JOIN g USING (doc_id) LEFT JOIN r USING (doc_id)""",
    "lay_outside_tables": f"""WITH {_LINES}, {_BOXED} SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE y1 <= 70 OR y0 >= 630) AS in_margin FROM boxed b
        WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = b.doc_id AND h.pos = b.pos AND h.region_index = 1) GROUP BY 1""",
    "lay_smallest_region": f"""WITH {_LINES}, {_BOXED}, s AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY area, region_index) = 1)
        SELECT b.doc_id, CAST(s.region_index AS INTEGER) AS region_index, count(*) AS lines FROM boxed b LEFT JOIN s ON s.doc_id = b.doc_id AND s.pos = b.pos GROUP BY ALL""",
    "lay_reading_order": f"""WITH {_LINES}, p AS (SELECT doc_id, CAST(floor(pos / 20) AS INTEGER) AS page, pos % 20 >= 10 AS aside, pos % 10 AS row_no, md5(text) AS digest FROM lines),
        c AS (SELECT *, count(*) FILTER (WHERE NOT aside) OVER w >= 3 AND count(*) FILTER (WHERE aside) OVER w >= 3 AS columns FROM p WINDOW w AS (PARTITION BY doc_id, page))
        SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN columns THEN aside ELSE false END, row_no, aside) - 1 AS INTEGER) AS reading_order, digest FROM c""",
}
