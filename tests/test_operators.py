"""Vector search, validation, layout, joins and graphs on small tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework.operators import graph, keyed, layout, ordered, validation, vector

HIT = "chunk_index int, embedding array<float>"


def test_search_fixture(spark):
    index = spark.createDataFrame([(0, [0.1, 0.2, 0.0]), (1, [0.2, 0.1, 0.0]), (2, [0.0, 0.0, 0.0]), (3, [1.0]), (4, None)], HIT)
    hits = vector.search_one(index, [0.1, 0.2, 0.0], 3).collect()
    assert [(r.chunk_index, round(r.score, 6)) for r in hits] == [(0, 1.0), (1, 0.8), (2, 0.0)]
    batch = vector.search(index.filter("chunk_index = 0").withColumnRenamed("chunk_index", "query_id"), index, 3, 3).orderBy("rank").collect()
    assert [(r.chunk_index, round(r.score, 6)) for r in batch] == [(0, 1.0), (1, 0.8), (2, 0.0)]
    info = vector.store_info(index, 3).first()
    assert (info["rows"], info.skipped, info.dimension) == (3, 2, 3)


@pytest.mark.parametrize(("query", "k", "dim"), [([], 3, None), ([1.0, 2.0, 3.0], 0, None), ([1.0, 2.0, 3.0], -1, None), ([1.0], 3, 3)])
def test_invalid_searches_give_nothing(spark, query, k, dim):
    index = spark.createDataFrame([(0, [0.1, 0.2, 0.0])], HIT)
    assert vector.search_one(index, query, k, dim).count() == 0


def test_search_in_groups_equals_one_scan(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.integers(-2, 3, (300, 4)).astype(float).tolist()
    index = spark.createDataFrame(list(enumerate(x)), HIT)
    queries = index.filter("chunk_index % 10 = 0").withColumnRenamed("chunk_index", "query_id")
    whole = sorted(map(tuple, vector.search(queries, index, 7, 4).select("query_id", "rank", "chunk_index").collect()))
    monkeypatch.setattr(vector, "QUERIES_AT_ONCE", 8)
    assert sorted(map(tuple, vector.search(queries, index, 7, 4).select("query_id", "rank", "chunk_index").collect())) == whole
    assert len(whole) == 30 * 7
    empty = index.limit(0)
    assert vector.search(queries, empty, 7, 4).count() == 0


def test_latency_percentiles_take_the_lower_element(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    r = vector.latency_stats(df, "v").first()
    assert (r.n, r.mean, r.p50, r.p90, r.p99) == (10, 4.5, 4.0, 8.0, 8.0)


RECORD = "chunk_index int, chunk_id string, text string, section_title string, block_types array<string>, page_start int, page_end int, page_numbers array<int>, token_count int, embedding_max_tokens int, chunking_version string"


def judged(spark, rows):
    filled = [(*r, *[None] * (11 - len(r))) for r in rows]
    return {r.chunk_index: r for r in validation.judged(spark.createDataFrame(filled, RECORD)).collect()}


def sequential(raws, cleans):
    """The rule as a fold over records, for comparison."""
    kept, dropped = set(), set()
    for i, (raw, clean) in enumerate(zip(raws, cleans, strict=True)):
        if raws.count(raw) > 1 and raw in kept:
            dropped.add(i)
        else:
            kept.add(clean)
    return dropped


def test_duplicates_are_dropped_as_by_the_fold(spark):
    rng = random.Random(5)
    for _ in range(3):
        raws = [rng.choice(["a b", "a  b", " a b", "c", "c ", "d"]) for _ in range(40)]
        got = judged(spark, [(i, str(i), t) for i, t in enumerate(raws)])
        cleans = [got[i].text for i in range(40)]
        assert {i for i, r in got.items() if r.drop_reason == "duplicate_text"} == sequential(raws, cleans)


def test_rules(spark):
    got = judged(spark, [
        (0, "a", "x" * 1001), (1, "a", None), (2, None, "ok\x07", "1.734382", ["heading"]), (3, None, "t", "T", ["paragraph"], 3, 2, [2, 3]),
        (4, "e", "t1", None, None, 1, 2, [1, 3], 300, 256, "semantic-v1"), (5, "f", "a|" * 21),
    ])
    assert "text length exceeds 1000" in got[0].validation_errors and "chunk_id is not unique" in got[0].validation_errors
    assert "empty text" in got[1].validation_errors
    assert got[2].drop_reason == "revision_code_heading_only" and got[2].section_title is None
    assert got[2].validation_warnings == ["control_characters_removed", "revision_code_section_title", "heading_only"]
    assert "page_start is greater than page_end" in got[3].validation_errors and "chunk_id is not unique" in got[3].validation_errors
    assert "embedding input exceeds model token limit" in got[4].validation_errors and "page_range_mismatch" in got[4].validation_warnings
    assert got[5].validation_warnings == ["pipe_heavy"]
    missing = [e for e in got[0].validation_errors if e.startswith("missing fields: ")]
    assert missing == ["missing fields: extraction_version, page_number, source_document, source_fingerprint"]


def test_summary_of_nothing_and_of_gaps(spark):
    empty = validation.validate(spark.createDataFrame([], RECORD)).summary.first()
    assert (empty.input_records, empty.hard_errors, empty.exit_code, empty.global_errors) == (0, 0, 0, [])
    gap = validation.validate(spark.createDataFrame([(0, "a", "t", *[None] * 8), (2, "b", "u", *[None] * 8)], RECORD)).summary.first()
    assert gap.global_errors == ["chunk_index values are not contiguous"] and gap.exit_code == 1


def test_renumber_and_oversized(spark):
    df = spark.createDataFrame([("b", 0), ("a", 5), ("a", 2), (None, 1)], "d string, i int")
    assert {(r.d, r.i): r.n for r in validation.renumber(df, "d", "i", "n").collect()} == {(None, 1): 0, ("a", 2): 1, ("a", 5): 2, ("b", 0): 3}
    o = validation.oversized(spark.createDataFrame([(1, 300), (2, 10), (3, None)], "chunk_index int, token_count int"), 256).first()
    assert (o.oversized, o.message) == (1, "chunk 1 has 300")


def test_indexes_stand_in_the_order_of_lines(spark):
    def in_order(*rows):
        return validation.contiguous(spark.createDataFrame(rows, "chunk_index int, line long"), line="line").first()[0]

    assert in_order((0, 1), (1, 2), (2, 9)) and not in_order((0, 1), (2, 2), (1, 3)) and not in_order((1, 1), (2, 2))
    assert validation.contiguous(spark.createDataFrame([], "chunk_index int, line long"), line="line").first()[0]


def test_a_hot_document_is_parted(spark, monkeypatch):
    monkeypatch.setattr(ordered, "STRETCH", 10)
    rows = [(i, "hot" if i % 3 else f"d{i}", f"w{i} a w{i + 1}" if i % 2 else f"w{i} b w{i + 1}") for i in range(300)] + [(300, None, "w b"), (301, None, "b c")]
    df = spark.createDataFrame(rows, "chunk_index int, source_document string, text string")
    sizes = ordered.stretches(ordered.positions(df, ["source_document", "chunk_index"])).groupBy("_stretch").count().agg(F.max("count")).first()[0]
    assert sizes <= 12
    parts = ordered.positions(df, ["source_document", "chunk_index"], "n").orderBy("n").collect()
    assert [r.n for r in parts] == list(range(302)) and [(r.source_document or "", r.chunk_index) for r in parts] == sorted((s or "", i) for i, s, _ in rows)
    got = {r.chunk_index: (r.total_words, r.overlap_previous, r.overlap_next) for r in validation.neighbour_overlaps(df).collect()}
    assert len(got) == 302 and got[1] == (3, 0, 1) and got[2] == (3, 1, 0) and got[3] == (3, 0, 0) and got[300] == (2, 0, 1) and got[301] == (2, 1, 0)
    stats = {r.g: (r.n, r.p50, r.p90) for r in vector.latency_stats(spark.createDataFrame([("a", float(i)) for i in range(101)] + [(None, 3.0), ("b", None)], "g string, v double"), "v", "g").collect()}
    assert stats == {"a": (101, 50.0, 90.0), None: (1, 3.0, 3.0)}


def test_sections_and_paths(spark):
    blocks = spark.createDataFrame([("d", 0, "Intro", None), ("d", 1, "1 Fees", 1), ("d", 2, "detail", None), ("d", 3, "1.1 More", 2), ("d", 4, "x", None), ("d", 5, "2 End", 1), ("d", 6, "y", None)], "doc string, pos int, text string, level int")
    got = layout.sections(blocks, "doc", "pos", F.col("level").isNotNull()).orderBy("pos").collect()
    assert [(r.section_id, r.section_title) for r in got] == [(0, None), (1, "1 Fees"), (1, "1 Fees"), (2, "1.1 More"), (2, "1.1 More"), (3, "2 End"), (3, "2 End")]
    paths = {r.pos: r.path for r in layout.heading_paths(blocks, "doc", "pos", "level").collect()}
    assert paths[0] == [] and paths[4] == ["1 Fees", "1.1 More"] and paths[6] == ["2 End"]


def test_columns_are_read_one_after_the_other():
    left = [{"bbox": [50, 40 * i, 200, 40 * i + 10], "text": f"l{i}"} for i in range(6)]
    right = [{"bbox": [320, 40 * i + 3, 500, 40 * i + 13], "text": f"r{i}"} for i in range(6)]
    top = {"bbox": [50, -50, 500, -40], "text": "title"}
    mixed = [x for pair in zip(right, left, strict=True) for x in pair] + [top]
    assert [i["text"] for i in layout.reading_order(mixed)] == ["title", *(f"l{i}" for i in range(6)), *(f"r{i}" for i in range(6))]
    assert layout.reading_order([]) == []


def boxes(**places):
    return [{"text": t, "bbox": list(map(float, b))} for t, b in places.items()]


def read(items, width=612.0):
    return [i["text"] for i in layout.reading_order(items, width)]


def test_three_columns_and_a_bar_across_two():
    columns = [{"text": f"{c}{i}", "bbox": [x, 100.0 + 30 * i, x + 150, 110.0 + 30 * i]} for i in range(8) for c, x in (("a", 40.0), ("b", 220.0), ("c", 400.0))]
    assert read(columns) == [f"{c}{i}" for c in "abc" for i in range(8)]
    # the bar starts below b3's top, so b3 and a3 come before it
    bar = boxes(bar=(40, 195, 370, 205))
    assert read([c for c in columns if c["text"][0] != "c"] + bar) == [f"{c}{i}" for c in "ab" for i in range(4)] + ["bar"] + [f"{c}{i}" for c in "ab" for i in range(4, 8)]


def test_what_is_no_column():
    # three items are too few, a region narrower than a quarter of the page has no columns, and neither has a side of two items
    assert read(boxes(a=(0, 0, 100, 10), b=(300, 1, 400, 11), c=(0, 40, 100, 50))) == ["a", "b", "c"]
    narrow = [{"text": f"{c}{i}", "bbox": [x, 30.0 * i, x + 40, 30.0 * i + 10]} for i in range(4) for c, x in (("a", 0.0), ("b", 60.0))]
    assert read(narrow) == [f"{c}{i}" for i in range(4) for c in "ab"] and read(narrow, 200.0) == [f"{c}{i}" for c in "ab" for i in range(4)]
    few = [{"text": f"a{i}", "bbox": [0.0, 30.0 * i, 200.0, 30.0 * i + 10]} for i in range(4)] + boxes(b0=(300, 1, 500, 11), b1=(300, 31, 500, 41))
    assert read(few) == ["a0", "b0", "a1", "b1", "a2", "a3"]
    # a composite counts as its lines
    assert read([*few[:4], few[4] | {"weight": 3}]) == ["a0", "a1", "a2", "a3", "b0"]


def test_a_row_holds_what_starts_within_its_first_item():
    assert read(boxes(a=(0, 0, 10, 5), c=(0, 4.5, 10, 9), b=(20, 3, 30, 8))) == ["a", "b", "c"]


def test_lines_merge_into_blocks():
    lines = [{"bbox": [50, y, 200, y + 10], "text": t, "is_table": False} for y, t in ((0, "a"), (12, "b"), (60, "c"))]
    assert [b["text"] for b in layout.merge_lines(lines)] == ["a\nb", "c"]


def test_pages_in_order(spark):
    rows = [("d", 1, f"{side}{i}", [x, 40.0 * i, x + 150, 40.0 * i + 10], 10.0, False, False, None, i) for i in range(5) for side, x in (("r", 320.0), ("l", 50.0))]
    df = spark.createDataFrame(rows, "doc string, page int, text string, bbox array<double>, font_size double, is_bold boolean, is_table boolean, region int, source_block int")
    got = layout.order_pages(df, ["doc", "page"]).orderBy("reading_order").collect()
    assert [r.text for r in got] == [f"l{i}" for i in range(5)] + [f"r{i}" for i in range(5)]


def test_tables_footers_and_headings(spark):
    cell = lambda rows: F.array(*[F.array(*[F.lit(c) for c in r]) for r in rows])
    one = spark.range(1)
    good = [["Fee", "Cost"], ["wire", "10"], ["check", "5"], ["card", "0"]]
    assert one.select(layout.valid_table(cell(good), F.lit(0.3)), layout.valid_table(cell(good[:2]), F.lit(0.2))).first() == (True, False)
    assert one.select(layout.is_header_footer(F.lit("Page 3 of 9"), F.lit(True), F.lit(None)), layout.is_header_footer(F.lit("Page 3 of 9"), F.lit(False), F.lit(None)), layout.is_header_footer(F.lit(" "), F.lit(False), F.lit(None))).first() == (True, False, True)
    none, no = F.lit(None).cast("double"), F.lit(False)
    kinds = one.select(layout.block_type(F.lit("Title Case"), no, F.lit(24.0), F.lit(10.0), no), layout.block_type(F.lit("- a\n- b"), no, none, none, no), layout.block_type(F.lit("A sentence."), no, F.lit(24.0), F.lit(10.0), no), layout.block_type(F.lit(None).cast("string"), no, none, none, no))
    assert tuple(kinds.first()) == ("heading", "list", "paragraph", "paragraph")


def test_spans_make_lines(spark):
    spans = spark.createDataFrame([(1, 0, "ab", 9.0, "X-Bold", 0), (1, 1, "cd", 11.0, "X", 0), (2, 0, "z", 9.0, "X", 16), (3, 0, "q", 9.0, None, None)], "line int, span_index int, text string, size double, font string, flags int")
    got = {r.line: (r.text, r.font_size, r.is_bold) for r in layout.lines_of_spans(spans, ["line"]).collect()}
    assert got == {1: ("abcd", 11.0, True), 2: ("z", 9.0, True), 3: ("q", 9.0, False)}


def components(edges):
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 140)]
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + chain + [(7, 7)] + [(500, i) for i in range(501, 560)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == components(edges)
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keyed(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1), (None, "d", 1)], "k int, v string, t int")
    assert sorted(map(tuple, keyed.once_per_key(df, "k", "t").collect())) == [(1, "b", 2), (2, "c", 1)]
    wide = spark.createDataFrame([(i, "x" * 1000) for i in range(50)], "k int, w string")
    assert keyed.fits_broadcast(wide) and keyed.fits_broadcast(wide.select("k"), 50)
    monkeypatch.setattr(keyed, "BROADCAST_BYTES", 20_000)
    assert not keyed.fits_broadcast(wide) and keyed.fits_broadcast(wide.select("k"), 50)
    monkeypatch.setattr(keyed, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, keyed.once_per_key(df, "k", "t").collect())) == [(1, "b", 2), (2, "c", 1)]
    hot = spark.range(1000).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id")
    right = spark.createDataFrame([(1, "x"), (5, "y")], "k int, w string")
    assert keyed.join_bounded(hot, right, ["k"], F.col("id")).count() == 334
    assert keyed.join_bounded(hot, right.select("k"), ["k"], F.col("id"), "left_semi").count() == 334
    assert keyed.join_bounded(hot, right, ["k"], F.col("id"), "left").count() == 1000
    for spread in (None, F.col("id")):
        assert [keyed.semi_or_anti(hot, right.select("k"), ["k"], how, spread=spread).count() for how in ("left_semi", "left_anti")] == [334, 666]
