"""Queries of the text function family, over whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.keyed import once_per_key
from ..session import table


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return once_per_key(table(spark, d, "documents").select("doc_id", "text", "title", "source"), "doc_id")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return once_per_key(table(spark, d, "chunks"), "chunk_index", "generated_at")


def cleaning(spark: SparkSession, d: str) -> DataFrame:
    """All four cleanings of every document, as digests."""
    t = F.col("text")
    forms = {"cleaned": X.clean_text(t), "extracted": X.clean_extracted_text(t), "validated": X.normalize_text(t), "joined": X.normalize_semantic_text(t), "lined": X.normalize_semantic_text(t, True)}
    return _documents(spark, d).select("doc_id", *[F.md5(v).alias(k) for k, v in forms.items()])


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of every document: number, longest, and a digest of all."""
    return _documents(spark, d).withColumn("s", X.split_sentences(F.col("text"))).select(
        "doc_id", F.size("s").alias("sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).alias("longest"), F.md5(F.array_join("s", "\n")).alias("digest")
    )


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    """Words between white space, for every chunk."""
    return _chunks(spark, d).select("chunk_index", F.size(X.split_words(F.col("text"))).alias("words"))


def hard_split(spark: SparkSession, d: str) -> DataFrame:
    """Slices of 1000 characters of every document."""
    return _documents(spark, d).select("doc_id", F.posexplode(X.hard_split(F.col("text"), 1000)).alias("part", "slice")).select("doc_id", "part", F.length("slice").alias("chars"), F.md5("slice").alias("digest"))


def signatures(spark: SparkSession, d: str) -> DataFrame:
    """Signatures that are shared by titles and first lines."""
    first = X.at(X.lines(F.col("text")), 1)
    return _documents(spark, d).select(X.signature(first).alias("signature")).filter("signature <> ''").groupBy("signature").agg(F.count("*").alias("documents"))


def ids(spark: SparkSession, d: str) -> DataFrame:
    """Stable identities of chunks, by page and by section."""
    c = _chunks(spark, d)
    start = [F.col("source_fingerprint"), F.col("source_document"), F.col("chunk_index")]
    pages = F.array_join(F.transform("page_numbers", lambda p: p.cast("string")), ",")
    return c.select(
        "chunk_index", X.identity(*start, pages, F.col("section_title"), F.col("text")).alias("layout_id"),
        X.identity(*start, F.array_join("section_path", " > "), F.col("text")).alias("semantic_id"),
    )


def shown(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as shown under their heading and as embedded with their path of headings."""
    display = X.display_text(X.at("section_path", -1), F.lit(None).cast("string"), F.array(X.text_or_empty(F.col("text"))))
    c = _chunks(spark, d).withColumn("shown", F.when(F.size("section_path") > 0, display).otherwise(X.strip(X.text_or_empty(F.col("text")))))
    return c.select("chunk_index", F.md5("shown").alias("shown"), F.md5(X.embedding_text(F.col("section_path"), F.col("shown"))).alias("embedded"))


def markdown(spark: SparkSession, d: str) -> DataFrame:
    """Comma-separated and tabbed tables of chunks as Markdown."""
    rows = F.transform(X.lines(F.col("text")), lambda r: F.split(r, "\t"))
    return _chunks(spark, d).filter(F.col("text").contains("\t")).select("chunk_index", F.md5(X.markdown_table(rows)).alias("markdown"))


def intents(spark: SparkSession, d: str) -> DataFrame:
    """The topic of every question."""
    return table(spark, d, "qa_cases").select("id", X.intent(F.col("question")).alias("topic"))


def citations(spark: SparkSession, d: str) -> DataFrame:
    """Every source as its card shows it."""
    s = once_per_key(table(spark, d, "sources"), "source_id")
    return s.select("source_id", X.citation_label(F.coalesce("doc", F.lit("Unknown")), F.lit(None).cast("string"), F.col("page")).alias("label"), X.score_percent(F.col("score")).alias("percent"), X.preview(F.col("snippet")).alias("preview"))


def summaries(spark: SparkSession, d: str) -> DataFrame:
    """Values of chunk metadata in the viewer's short form."""
    c = _chunks(spark, d)
    kinds = dict(c.dtypes)
    names = ("page_numbers", "section_path", "section_title", "source_fingerprint", "token_count", "text")
    return c.select("chunk_index", *[X.summarize(F.col(n), kinds[n]).alias(n) for n in names if n != "text"], X.summarize(F.col("text"), "string").alias("text"))


def tabular(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that look tabular, whose title is a revision code, or that seem to mix columns."""
    c = _chunks(spark, d)
    return c.select("chunk_index", X.looks_tabular(F.col("text")).alias("tabular"), X.is_revision_code_section(F.col("section_title")).alias("revision_title"), X.likely_interleaved(X.normalize_text(F.col("text"))).alias("interleaved"))


SPACE, BREAK, CONTROL = X.SPACE, X.BREAK, X.CONTROL
_CHUNKS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_index ORDER BY generated_at DESC) AS _n FROM chunks WHERE chunk_index IS NOT NULL) WHERE _n = 1)"
_SOURCES = "(SELECT DISTINCT ON (source_id) * FROM sources WHERE source_id IS NOT NULL)"


def collapse_sql(t: str) -> str:
    """SQL of :func:`functions.text.collapse`."""
    return f"trim(regexp_replace({t}, '{SPACE}+', ' ', 'g'))"


def lines_sql(t: str) -> str:
    """SQL of :func:`functions.text.lines`."""
    return f"string_split(regexp_replace(coalesce({t}, ''), '{BREAK}', chr(10), 'g'), chr(10))"


def full_lines_sql(t: str) -> str:
    """SQL of :func:`functions.text.full_lines`."""
    return f"list_filter(list_transform({lines_sql(t)}, lambda x: {collapse_sql('x')}), lambda x: x <> '')"


def normalize_sql(t: str) -> str:
    """SQL of :func:`functions.text.normalize_text`; the letter before the hyphen is captured, as there is no look-behind."""
    controls = f"regexp_replace(coalesce({t}, ''), '{CONTROL}', ' ', 'g')"
    closed = rf"regexp_replace(regexp_replace({controls}, '([A-Za-z])-\s*\n\s*([a-z])', '\1\2', 'g'), '([A-Za-z])-\s*\n\s*([a-z])', '\1\2', 'g')"
    tidy = rf"regexp_replace(regexp_replace(x, '[ \t]{{2,}}', ' ', 'g'), '^{SPACE}+|{SPACE}+$', '', 'g')"
    return f"array_to_string(list_filter(list_transform({lines_sql(closed)}, lambda x: {tidy}), lambda x: x <> ''), chr(10))"


def semantic_sql(t: str, sep: str) -> str:
    """SQL of :func:`functions.text.normalize_semantic_text`."""
    soft = f"replace(coalesce({t}, ''), chr(173), '')"
    closed = rf"regexp_replace(regexp_replace({soft}, '([A-Za-z])-\n([a-z])', '\1\2', 'g'), '([A-Za-z])-\n([a-z])', '\1\2', 'g')"
    return f"array_to_string({full_lines_sql(closed)}, {sep})"


_SENTENCES = rf"""list_filter(list_transform(string_split(regexp_replace(regexp_replace({collapse_sql("coalesce(text, '')")}, '([.!?]) (["“”‘’(\[]*[A-Z0-9])', '\1' || chr(1) || '\2', 'g'),
    '([.!?]) (["“”‘’(\[]*[A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"""
_EXTRACTED = "array_to_string(" + full_lines_sql(f"regexp_replace(coalesce({{t}}, ''), '{CONTROL}', ' ', 'g')") + ", chr(10))"


def extracted_sql(t: str) -> str:
    """SQL of :func:`functions.text.clean_extracted_text`."""
    return _EXTRACTED.replace("{t}", t)


def signature_sql(t: str) -> str:
    """SQL of :func:`functions.text.signature`."""
    low = f"regexp_replace(lower({extracted_sql(t)}), '\\p{{Nd}}+', '#', 'g')"
    bare = f"regexp_replace(regexp_replace({low}, '^{SPACE}*#{SPACE}+', ''), '{SPACE}+#{SPACE}*$', '')"
    return collapse_sql(f"regexp_replace({bare}, '[^\\p{{L}}\\p{{N}}\\p{{M}}_ \\n]', ' ', 'g')")


_INTENT = "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(question, '')), '{'|'.join(k)}') THEN '{t}'" for t, k in X.INTENTS) + " ELSE 'default' END"
_TITLE_LINES = f"list_filter(list_transform({lines_sql('section_title')}, lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda x: x <> '')"
REVISION_SQL = rf"""(len({_TITLE_LINES}) > 0 AND (len(list_filter({_TITLE_LINES}, lambda x: regexp_matches(x, '{X.REVISION_LINE}'))) > 0 OR
    (regexp_matches(array_to_string({_TITLE_LINES}, ' '), '^[A-Z0-9.\-\s/]+$')
     AND length(regexp_replace(array_to_string({_TITLE_LINES}, ' '), '[^\p{{Nd}}]', '', 'g')) >= length(regexp_replace(array_to_string({_TITLE_LINES}, ' '), '[^\p{{L}}]', '', 'g'))
     AND length(regexp_replace(array_to_string({_TITLE_LINES}, ' '), '[^\p{{Nd}}.\-/ ]', '', 'g')) >= greatest(6.0, 0.6 * length(array_to_string({_TITLE_LINES}, ' '))))))"""


def interleaved_sql(t: str) -> str:
    """SQL of :func:`functions.text.likely_interleaved` without known fragments."""
    c = collapse_sql(t)
    return rf"""({c} <> '' AND NOT regexp_matches(left({c}, 80), '^[A-Z][a-z]+(?:\s+[a-z]+){{0,3}}\s+[a-z]+\b') AND (length({c}) - length(replace({c}, '. ', ''))) / 2 >= 4
        AND len(list_filter(string_split({c}, ','), lambda p: len(list_filter(string_split(trim(p), ' '), lambda w: w <> '')) <= 3)) >= 5)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "txt_cleaning": cleaning, "txt_sentences": sentences, "txt_word_counts": word_counts, "txt_hard_split": hard_split, "txt_signatures": signatures,
    "txt_chunk_ids": ids, "txt_shown": shown, "txt_markdown": markdown, "txt_intents": intents, "txt_citations": citations, "txt_summaries": summaries, "txt_predicates": tabular,
}
SQL: dict[str, str] = {
    "txt_cleaning": f"""SELECT doc_id, md5(array_to_string({full_lines_sql("replace(coalesce(text, ''), chr(7), ' ')")}, chr(10))) AS cleaned, md5({extracted_sql('text')}) AS extracted,
        md5({normalize_sql('text')}) AS validated, md5({semantic_sql('text', "' '")}) AS joined, md5({semantic_sql('text', 'chr(10)')}) AS lined FROM documents""",
    "txt_sentences": f"""WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents)
        SELECT doc_id, CAST(len(s) AS INTEGER) AS sentences, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS INTEGER) AS longest, md5(array_to_string(s, chr(10))) AS digest FROM s""",
    "txt_word_counts": f"SELECT chunk_index, CAST(len(list_filter(string_split({collapse_sql(chr(99)+'oalesce(text, '+chr(39)*2+')')}, ' '), lambda x: x <> '')) AS INTEGER) AS words FROM {_CHUNKS}",
    "txt_hard_split": """WITH p AS (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS part FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, CAST(part AS INTEGER) AS part, CAST(length(substr(text, part * 1000 + 1, 1000)) AS INTEGER) AS chars, md5(substr(text, part * 1000 + 1, 1000)) AS digest FROM p""",
    "txt_signatures": f"""WITH s AS (SELECT {signature_sql(f"{lines_sql('text')}[1]")} AS signature FROM documents) SELECT signature, count(*) AS documents FROM s WHERE signature <> '' GROUP BY 1""",
    "txt_chunk_ids": f"""WITH c AS (SELECT chunk_index, concat_ws(chr(0), coalesce(source_fingerprint, ''), coalesce(source_document, ''), CAST(chunk_index AS VARCHAR)) AS s,
            coalesce(array_to_string(list_transform(page_numbers, lambda p: CAST(p AS VARCHAR)), ','), '') AS pages, coalesce(section_title, '') AS title, coalesce(array_to_string(section_path, ' > '), '') AS path, coalesce(text, '') AS text FROM {_CHUNKS})
        SELECT chunk_index, left(sha256(concat_ws(chr(0), s, pages, title, text)), 24) AS layout_id, left(sha256(concat_ws(chr(0), s, path, text)), 24) AS semantic_id FROM c""",
    "txt_shown": f"""WITH c AS (SELECT chunk_index, section_path, coalesce(text, '') AS text, regexp_replace(CASE WHEN len(section_path) > 0 THEN array_to_string(list_filter([coalesce(section_path[-1], ''), coalesce(text, '')], lambda x: x <> ''), chr(10) || chr(10)) ELSE coalesce(text, '') END, '^{SPACE}+|{SPACE}+$', '', 'g') AS shown FROM {_CHUNKS}),
        b AS (SELECT *, CASE WHEN shown = section_path[-1] THEN '' WHEN starts_with(shown, section_path[-1] || chr(10) || chr(10)) THEN substr(shown, length(section_path[-1]) + 3) ELSE shown END AS body FROM c)
        SELECT chunk_index, md5(shown) AS shown, md5(CASE WHEN coalesce(len(section_path), 0) = 0 THEN shown ELSE regexp_replace(array_to_string(section_path, ' > ') || chr(10) || chr(10) || body, '^{SPACE}+|{SPACE}+$', '', 'g') END) AS embedded FROM b""",
    "txt_markdown": f"""WITH r AS (SELECT chunk_index, list_filter(list_transform(list_transform({lines_sql('text')}, lambda l: string_split(l, chr(9))), lambda cells: list_transform(cells, lambda c: replace(replace({extracted_sql('c')}, chr(10), ' '), '|', '\\|'))), lambda cells: len(list_filter(cells, lambda c: c <> '')) > 0) AS rows
            FROM {_CHUNKS} WHERE contains(text, chr(9))),
        m AS (SELECT chunk_index, rows, list_transform(rows, lambda x: '| ' || array_to_string(x, ' | ') || ' |') AS shown, '| ' || array_to_string(list_transform(rows[1], lambda x: '---'), ' | ') || ' |' AS rule,
              len(rows) >= 2 AND len(list_filter(rows[1], lambda c: c <> '')) >= greatest(1, ceil(len(rows[1]) / 2.0)) AND coalesce(list_max(list_transform(list_filter(rows[1], lambda c: c <> ''), lambda c: length(c))), 0) <= 100 AS headed FROM r)
        SELECT chunk_index, md5(CASE WHEN coalesce(len(rows), 0) = 0 THEN '' WHEN headed THEN array_to_string(list_concat(list_concat(shown[1:1], [rule]), shown[2:]), chr(10)) ELSE array_to_string(shown, chr(10)) END) AS markdown FROM m""",
    "txt_intents": f"SELECT id, {_INTENT} AS topic FROM qa_cases",
    "txt_citations": f"""SELECT source_id, coalesce(doc, 'Unknown') || CASE WHEN coalesce(page, 0) <> 0 THEN ' §' || CAST(page AS VARCHAR) ELSE '' END AS label, CAST(floor(score * 100 + 0.5) AS INTEGER) AS percent,
        CASE WHEN length(snippet) > 120 THEN left(snippet, 120) || '…' ELSE snippet END AS preview FROM {_SOURCES}""",
    "txt_summaries": f"""SELECT chunk_index, 'number[' || len(page_numbers) || ']' AS page_numbers, 'array[' || len(section_path) || ']' AS section_path, CASE WHEN length(section_title) > 120 THEN 'string[' || length(section_title) || ']' ELSE section_title END AS section_title,
        CASE WHEN length(source_fingerprint) > 120 THEN 'string[' || length(source_fingerprint) || ']' ELSE source_fingerprint END AS source_fingerprint, CAST(token_count AS VARCHAR) AS token_count, CASE WHEN length(text) > 120 THEN 'string[' || length(text) || ']' ELSE text END AS text FROM {_CHUNKS}""",
    "txt_predicates": f"""WITH c AS (SELECT chunk_index, section_title, coalesce(text, '') AS text, {full_lines_sql('text')} AS full_lines, {normalize_sql('text')} AS norm FROM {_CHUNKS})
        SELECT chunk_index, len(full_lines) >= 8 AND len(list_filter(full_lines, lambda x: regexp_matches(x, '{X.NUMERIC_LINE}'))) >= len(full_lines) * 0.45 AND length(text) - length(regexp_replace(text, '[%$|]', '', 'g')) >= 4 AS tabular,
        coalesce({REVISION_SQL}, false) AS revision_title, {interleaved_sql('norm')} AS interleaved FROM c""",
}
