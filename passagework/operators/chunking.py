"""Chunks of documents: packed layout sections, character windows, and sentence-safe semantic chunks.

What a block is, under which headings it stands and which blocks are one unit is found by column
expressions and windows (:mod:`.layout`, :mod:`..functions.text`). The packers that follow are greedy
folds whose next start depends on the last cut, which no relational operator expresses; they run on
Arrow columns, a document at a time. Lengths are code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from . import layout as L

#: Versions and default limits.
EXTRACTION_VERSION, CHUNKING_VERSION = "layout-v2", "semantic-v1"
LAYOUT_MAX, LAYOUT_OVERLAP = 1000, 100
TARGET, MAX, OVERLAP, TABLE_MAX = 700, 900, 160, 480

_SENTENCE = re.compile(r'(?<=[.!?])\s+(?=["“”‘’(\[]*[A-Z0-9])')
_WORD = re.compile(r"\S+")


# ---------------------------------------------------------------- text


def collapsed_lines(text: str | None, join: str = "\n") -> str:
    """The lines that aren't blank, each collapsed."""
    full = (" ".join(line.split()) for line in (text or "").replace("\x07", " ").splitlines())
    return join.join(line for line in full if line)


def sentences(text: str) -> list[str]:
    """The text's sentences."""
    return [s for s in map(str.strip, _SENTENCE.split(" ".join(text.split()))) if s]


def pack(parts: list[str], most: int, joint: str) -> list[str]:
    """Parts joined in order as long as they fit."""
    out: list[str] = []
    for part in parts:
        if out and len(out[-1]) + len(joint) + len(part) <= most:
            out[-1] += joint + part
        else:
            out.append(part)
    return out


def split_words(text: str, most: int) -> list[str]:
    """Words packed up to ``most`` characters; a longer word is cut. No part is longer than ``most``."""
    most = max(1, most)
    pieces = [w[i : i + most] for w in text.split() for i in range(0, len(w), most)]
    return pack(pieces, most, " ")


def split_semantic(text: str, most: int) -> list[str]:
    """Sentences packed up to ``most`` characters; a longer sentence is cut by words."""
    if len(text) <= most:
        return [text] if text else []
    parts = [p for s in sentences(text) for p in ([s] if len(s) <= most else split_words(s, most))]
    return pack(parts, most, " ")


def split_windows(text: str | None, most: int = LAYOUT_MAX, overlap: int = LAYOUT_OVERLAP) -> list[str]:
    """Windows of whole words up to ``most`` characters; the next starts up to ``overlap`` characters back.

    A word longer than ``most`` is a window by itself and is sliced. The next start is always
    later than the last, so any overlap ends. ``most`` must be positive.
    """
    if most <= 0:
        raise ValueError("most must be positive")
    clean = collapsed_lines(text)
    spans = [m.span() for m in _WORD.finditer(clean)]
    if not spans:
        return []
    starts, ends = zip(*spans, strict=True)
    out: list[str] = []
    first = 0
    while True:
        last = max(first, bisect_right(ends, starts[first] + most) - 1)
        window = clean[starts[first] : ends[last]]
        out += [window] if len(window) <= most else [window[i : i + most] for i in range(0, len(window), most)]
        if last + 1 == len(spans):
            return out
        # the blank after the last word belongs to the window if there is room for it
        reach = ends[last] + (ends[last] + 1 - starts[first] <= most)
        first = min(max(bisect_left(starts, reach - overlap), first + 1), last + 1)


def split_table(text: str, most: int, overlap: int = LAYOUT_OVERLAP) -> list[str]:
    """Rows of a table packed up to ``most`` characters; a longer row is cut by :func:`split_windows`."""
    out: list[str] = []
    for row in (r for r in text.split("\n") if r.strip()):
        if len(row) > most:
            out += ["", *split_windows(row, most, overlap), ""]
        elif out and out[-1] and len(out[-1]) + 1 + len(row) <= most:
            out[-1] += "\n" + row
        else:
            out.append(row)
    return [p for p in out if p]


def split_headed_table(text: str, most: int) -> list[str]:
    """A table in parts of up to ``most`` characters.

    Rows of bars have a header, with its rule if there is one, which all parts repeat; other tables
    have none. A header that leaves no room is not repeated; rows longer than the room are cut by sentences and words.
    """
    rows = [r for r in map(str.strip, text.split("\n")) if r]
    if len(text) <= most:
        return ["\n".join(rows)] if rows else []
    lead = 0
    if rows and rows[0][0] == "|":
        lead = 2 if len(rows) > 1 and re.fullmatch(r"[\s|:-]+", rows[1]) and "-" in rows[1] else 1
    header = "\n".join(rows[:lead])
    if lead and (len(rows) == lead or most - len(header) - 1 < 1):
        lead, header = 0, ""
    room = most - len(header) - (1 if header else 0)
    body = pack([p for r in rows[lead:] for p in ([r] if len(r) <= room else split_semantic(r, room))], room, "\n")
    return [f"{header}\n{part}" if header else part for part in body]


# ---------------------------------------------------------------- DataFrames

BLOCK = "struct<text:string,page_number:int,bbox:array<double>,block_type:string,font_size:double,is_bold:boolean,metadata:struct<layout_type:string,layout_region:string,reading_order:int>>"
_PLACE = "struct<page_number:int,bbox:array<double>,layout_type:string,layout_region:string,reading_order:int>"
_KEY = ["source_document", "source_fingerprint"]
_SEMANTIC = (
    "source_document", "chunk_index", "chunk_id", "text", "embedding_text", "page_number", "page_start", "page_end", "page_numbers", "section_title", "section_path", "block_types",
    "semantic_unit_types", "source_bboxes", "overlap_with_previous_chars", "source_fingerprint", "extraction_version", "chunking_version",
)
_LAYOUT = (
    "source_document", "chunk_index", "chunk_id", "text", "page_number", "page_start", "page_end", "page_numbers", "section_title", "block_types", "source_fingerprint", "extraction_version",
)


def _blocks(documents: DataFrame) -> DataFrame:
    """Every block with text, with its place in its document; blocks without ``metadata`` get its defaults. A document given twice comes once."""
    once = documents.select(*[F.coalesce(k, F.lit("")).alias(k) for k in _KEY], "blocks").groupBy(*_KEY).agg(F.first("blocks", ignorenulls=True).alias("blocks"))
    fields = documents.schema["blocks"].dataType.elementType.fieldNames()
    rows = once.select(*_KEY, F.posexplode("blocks").alias("at", "b")).filter(X.strip(X.text_or_empty(F.col("b.text"))) != "")
    known = documents.schema["blocks"].dataType.elementType["metadata"].dataType.fieldNames() if "metadata" in fields and isinstance(documents.schema["blocks"].dataType.elementType["metadata"].dataType, T.StructType) else []

    def meta(name: str, kind: str, default: object) -> Column:
        return F.coalesce(F.col(f"b.metadata.{name}") if name in known else F.lit(None).cast(kind), F.lit(default).cast(kind)).alias(name)

    plain = [F.col(f"b.{n}").alias(n) if n in fields else F.lit(None).cast(k).alias(n) for n, k in (("text", "string"), ("page_number", "int"), ("bbox", "array<double>"), ("block_type", "string"), ("font_size", "double"), ("is_bold", "boolean"))]
    return rows.select(*_KEY, "at", *plain, meta("layout_type", "string", "text"), meta("layout_region", "string", "page"), meta("reading_order", "int", None))


def semantic_units(documents: DataFrame) -> DataFrame:
    """``(source_document, source_fingerprint, unit, path, kind, text, places)``: the semantic units of documents, not yet cut.

    Structural headings are no units but the path that units stand under; a heading that isn't
    structural is a paragraph, and a paragraph of figures is a table. Neighbouring paragraphs of one
    path are one unit where the first doesn't end or the second starts in lower case. All windows
    run by document, so the blocks are shuffled once.
    """
    c, of = F.col, W.partitionBy(*_KEY)
    font = F.when(c("font_size") != 0, c("font_size"))
    rows = L.body_font_over(_blocks(documents), [*_KEY, "page_number"], "at", F.when(c("block_type") == "paragraph", font))
    titled = c("block_type") == "heading"
    rows = rows.withColumn("_ranks", F.sort_array(F.collect_set(F.when(titled, F.bround("font_size", 1))).over(of), asc=False))
    # a column of its own, and under a condition, so that only headings are looked at, and once
    rows = rows.withColumn("_heads", F.when(titled, L.structural_heading(c("text"), c("font_size"), c("body_font"))).otherwise(F.lit(False)))
    heads = c("_heads")
    rows = rows.withColumn("_level", F.when(heads, L.heading_level(c("text"), c("font_size"), c("_ranks"), c("is_bold")))).withColumn("_title", F.when(heads, X.normalize_semantic_text(c("text"))))
    rows = L.heading_paths(rows, _KEY, "at", "_level", "_title").filter(c("_level").isNull())
    kind = F.when(titled, "paragraph").otherwise(c("block_type"))
    rows = rows.withColumn("kind", F.when(F.when(kind == "paragraph", X.looks_tabular(c("text"))).otherwise(F.lit(False)), "table").otherwise(kind))
    lined = c("kind").isin("list", "table")
    rows = rows.withColumn("text", F.when(lined, X.normalize_semantic_text(c("text"), True)).otherwise(X.normalize_semantic_text(c("text")))).filter("text <> ''")
    rows = L.islands(rows.withColumn("_paragraph", c("kind") == "paragraph"), _KEY, "at", same=("path",), only="_paragraph")
    places = F.array_sort(F.collect_list(F.struct("at", "text", F.struct("page_number", "bbox", "layout_type", "layout_region", "reading_order").alias("place"))))
    return (
        rows.groupBy(*_KEY, F.col("island").alias("unit")).agg(F.first("path").alias("path"), F.first("kind").alias("kind"), places.alias("_p"))
        .select(*_KEY, "unit", "path", "kind", F.array_join(F.transform("_p", lambda p: p["text"]), " ").alias("text"), F.transform("_p", lambda p: p["place"]).alias("places"))
    )


def group_units(units: list[dict], target: int = TARGET, most: int = MAX) -> list[list[dict]]:
    """Units in groups of one path: a group closes before it would exceed ``most`` or once it has ``target`` characters."""
    groups: list[list[dict]] = []
    size = 0
    for unit in units:
        own = len(unit["text"])
        if groups and groups[-1][0]["path"] == unit["path"] and size + 2 + own <= most and size < target:
            groups[-1].append(unit)
            size += 2 + own
        else:
            groups.append([unit])
            size = own + (len(unit["path"][-1]) + 2 if unit["path"] else 0)
    return groups


def pack_units(units: list[dict], target: int = TARGET, most: int = MAX, overlap: int = OVERLAP, table_max: int = TABLE_MAX) -> list[dict]:
    """A document's units (text, path, kind, places) as chunks; each may repeat the last sentence of the one before, if the path is the same."""
    cut = []
    for unit in units:
        path = tuple(unit["path"])
        room = max(20, most - (len(path[-1]) + 2 if path else 0))
        parts = split_headed_table(unit["text"], min(table_max, room)) if unit["kind"] == "table" else split_semantic(unit["text"], room)
        cut += [{**unit, "path": path, "text": p} for p in parts]
    chunks = []
    for before, group in pairwise([None, *group_units(cut, target, most)]):
        path = group[0]["path"]
        body = "\n\n".join(u["text"] for u in group)
        leaf = path[-1] + "\n\n" if path else ""
        again = ""
        if before and before[0]["path"] == path:
            tail = (sentences(before[-1]["text"]) or [""])[-1]
            if tail and len(tail) <= overlap and len(leaf) + len(tail) + 2 + len(body) <= most:
                again, body = tail, f"{tail}\n\n{body}"
        types = list(dict.fromkeys(u["kind"] for u in group))
        places = {(p["page_number"], *(p["bbox"] or ())): p for u in group for p in u["places"]}
        chunks.append({
            "text": leaf + body, "embedding_text": f"{' > '.join(path)}\n\n{body}" if path else body, "section_path": list(path), "section_title": path[-1] if path else None,
            "block_types": ["heading", *types] if path and "heading" not in types else types, "semantic_unit_types": types, "page_numbers": sorted({p["page_number"] for p in places.values() if p["page_number"] is not None}),
            "source_bboxes": [p for p in places.values() if p["bbox"]], "overlap_with_previous_chars": len(again),
        })
    return chunks


def _numbered(chunks: DataFrame, columns: tuple[str, ...], *identity: Column) -> DataFrame:
    """Packed chunks with their pages' bounds, identities and versions, all by column expressions."""
    named = chunks.withColumns({
        "page_number": X.at("page_numbers", 1), "page_start": X.at("page_numbers", 1), "page_end": X.at("page_numbers", -1), "extraction_version": F.lit(EXTRACTION_VERSION), "chunking_version": F.lit(CHUNKING_VERSION),
        "chunk_id": X.identity(F.col("source_fingerprint"), F.col("source_document"), F.col("chunk_index"), *identity, F.col("text")),
    })
    return named.select(*columns)


def chunk_semantic(documents: DataFrame, target: int = TARGET, most: int = MAX, overlap: int = OVERLAP, table_max: int = TABLE_MAX) -> DataFrame:
    """Semantic chunks of documents given as rows ``(source_document, source_fingerprint, blocks)``.

    ``blocks`` is an array of structs in reading order (see ``BLOCK``; fonts, boxes and metadata may be
    lacking). Chunks count from 0 within a document; see :func:`.validation.renumber` for numbers over all. Null or
    empty blocks give no chunk, and a heading that nothing follows gives none. Null names and
    fingerprints count as ''; a document given twice comes once.
    """
    if not 0 < target <= most:
        raise ValueError("target must be positive and at most the maximum")
    units = semantic_units(documents).groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("unit", "path", "kind", "text", "places"))).alias("units"))
    names = ("text", "embedding_text", "page_numbers", "section_title", "section_path", "block_types", "semantic_unit_types", "source_bboxes", "overlap_with_previous_chars")
    schema = (
        "source_document string, source_fingerprint string, chunk_index int, text string, embedding_text string, page_numbers array<int>, section_title string, section_path array<string>, "
        f"block_types array<string>, semantic_unit_types array<string>, source_bboxes array<{_PLACE}>, overlap_with_previous_chars int"
    )
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, units in enumerate(batch.column("units")):
                chunks = pack_units(units.as_py(), target, most, overlap, table_max)
                if chunks:
                    n = len(chunks)
                    key = [pa.array([batch.column(k)[i].as_py()] * n, pa.string()) for k in _KEY]
                    own = [pa.array([x[name] for x in chunks], arrow.field(name).type) for name in names]
                    yield pa.RecordBatch.from_arrays([*key, pa.array(range(n), pa.int32()), *own], [*_KEY, "chunk_index", *names])

    return _numbered(units.mapInArrow(run, schema), _SEMANTIC, F.array_join("section_path", " > "))


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))


def pack_sections(texts: list[str], types: list[str | None], most: int = LAYOUT_MAX, overlap: int = LAYOUT_OVERLAP) -> list[tuple[str, str | None, int, int]]:
    """``(text, title, first, stop)`` of chunks that don't cross sections; ``first`` to ``stop`` are the blocks of a chunk.

    A heading starts a section. Blocks are packed in order; an oversized one is split by itself, a
    table by rows, and nothing is packed across it.
    """
    out: list[tuple[str, str | None, int, int]] = []
    title: str | None = None
    start = size = 0

    def close(stop: int) -> None:
        nonlocal start, size
        if start < stop:
            out.append(("\n\n".join(texts[start:stop]), title, start, stop))
        start, size = stop, 0

    for i, (text, kind) in enumerate(zip(texts, types, strict=True)):
        if kind == "heading":
            close(i)
            title = text
        own = len(text)
        if size + own > most:
            close(i)
        if own > most:
            parts = split_table(text, most, overlap) if kind == "table" else split_windows(text, most, overlap)
            out += [(p, title, i, i + 1) for p in parts]
            start = i + 1
        else:
            size += own + 2
    close(len(texts))
    return out


def chunk_layout(documents: DataFrame, most: int = LAYOUT_MAX, overlap: int = LAYOUT_OVERLAP) -> DataFrame:
    """Layout chunks of documents given as for :func:`chunk_semantic`.

    If there is a column ``pages``, an array of structs of page_number and text, a document none of
    whose blocks has text is cut into windows of its pages' texts; such chunks have no identity,
    section, types or page bounds. Each document is one row and one unit of work; nothing is shuffled.
    """
    if most <= 0:
        raise ValueError("most must be positive")
    schema = "source_document string, source_fingerprint string, chunk_index int, text string, page_numbers array<int>, section_title string, block_types array<string>, plain_page int"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [_arrow(schema).field(n).type for n in names]
    paged = "pages" in documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("blocks")
            # columns of all blocks at once; a document is a range of them
            flat = blocks.flatten()
            text, kind, page = (flat.field(flat.type.get_field_index(n)).to_pylist() for n in ("text", "block_type", "page_number"))
            held = flat.is_valid().to_pylist()
            ends, at = [], 0
            for n in pa.compute.fill_null(pa.compute.list_value_length(blocks), 0).to_pylist():
                at += n
                ends.append(at)
            names_of, prints = batch.column("source_document").to_pylist(), batch.column("source_fingerprint").to_pylist()
            columns: list[list] = [[] for _ in names]
            for doc, (first, stop) in enumerate(pairwise([0, *ends])):
                own = [i for i in range(first, stop) if held[i] and text[i] and not text[i].isspace()]
                rows = pack_sections([text[i] for i in own], [kind[i] for i in own], most, overlap)
                made = [(t, sorted({page[i] for i in own[a:b] if page[i] is not None}), title, list(dict.fromkeys(kind[i] for i in own[a:b])), None) for t, title, a, b in rows]
                if not own and paged:
                    made = [(t, None, None, None, p["page_number"]) for p in batch.column("pages")[doc].as_py() or [] if p for t in split_windows(p["text"], most, overlap)]
                for n, row in enumerate(made):
                    for column, value in zip(columns, (names_of[doc] or "", prints[doc] or "", n, *row), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    chunks = documents.select(*_KEY, "blocks", *(["pages"] if paged else [])).mapInArrow(run, schema)
    pages = F.array_join(F.transform("page_numbers", lambda p: p.cast("string")), ",")
    numbered = _numbered(chunks, (*_LAYOUT, "plain_page"), pages, X.text_or_empty(F.col("section_title")))
    plain = F.col("plain_page").isNotNull()
    bare = {n: F.when(~plain, F.col(n)) for n in ("chunk_id", "source_fingerprint", "extraction_version")}
    return numbered.withColumns({"page_number": F.coalesce("plain_page", "page_number"), **bare}).drop("plain_page")


def chunk_windows(texts: DataFrame, key: str, text: str = "text", most: int = LAYOUT_MAX, overlap: int = LAYOUT_OVERLAP) -> DataFrame:
    """``(key, chunk_index, text)``: plain texts in windows, for documents without blocks. Null and blank texts give none."""
    if most <= 0:
        raise ValueError("most must be positive")
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(at, i, w) for at, t in enumerate(batch.column(text).to_pylist()) for i, w in enumerate(split_windows(t, most, overlap))]
            at, i, w = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), pa.array(i, pa.int32()), pa.array(w, pa.string())], [key, "chunk_index", "text"])

    return texts.select(key, text).mapInArrow(run, f"{key} {kind}, chunk_index int, text string")


def greedy_groups(sizes: Column, target: int = TARGET, most: int = MAX) -> Column:
    """Group numbers of units by their sizes, in the JVM: the fold of :func:`group_units` on integers only.

    The state is the last group, its size and the numbers so far; the text itself is cut afterwards.
    """
    start = F.struct(F.lit(-1).alias("g"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, size: Column) -> Column:
        fits = (s["g"] >= 0) & (s["n"] + 2 + size <= most) & (s["n"] < target)
        g = F.when(fits, s["g"]).otherwise(s["g"] + 1)
        return F.struct(g.alias("g"), F.when(fits, s["n"] + 2 + size).otherwise(size).alias("n"), F.concat(s["out"], F.array(g)).alias("out"))

    return F.aggregate(sizes, start, step, lambda s: s["out"])
