"""Chunking: stated cases and properties on random texts."""

from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from passagework.operators import chunking as C
from passagework.plans import chunking as P


def block(text, kind="paragraph", page=1, size=10.0, bold=False):
    return {"text": text, "block_type": kind, "page_number": page, "font_size": size, "is_bold": bold, "bbox": [0.0, 0.0, 1.0, 1.0], "metadata": None}


def documents(spark, *lists, **columns):
    names = ["text", "page_number", "bbox", "block_type", "font_size", "is_bold", "metadata"]
    rows = [(f"d{i:03}", "f", [tuple(x[n] for n in names) for x in blocks]) for i, blocks in enumerate(lists)]
    return spark.createDataFrame(rows, f"source_document string, source_fingerprint string, blocks array<{C.BLOCK}>")


def semantic(spark, *lists, **limits):
    """Chunks of several documents, by document."""
    out = [[] for _ in lists]
    for r in C.chunk_semantic(documents(spark, *lists), **limits).orderBy("source_document", "chunk_index").collect():
        out[int(r.source_document[1:])].append(r)
    return out


def test_sections_bound_layout_chunks(spark):
    got = C.chunk_layout(documents(spark, [block("Fees", "heading"), block("Fee detail"), block("Risks", "heading"), block("Risk detail")], [])).orderBy("chunk_index").collect()
    assert [(c["section_title"], c["page_numbers"]) for c in got] == [("Fees", [1]), ("Risks", [1])]
    assert got[0]["block_types"] == ["heading", "paragraph"] and got[0]["extraction_version"] == "layout-v2"


def test_large_blocks_are_split_alone():
    texts, kinds = ["a" * 30, "\n".join("| row |" * 3 for _ in range(5)), "b"], ["paragraph", "table", "paragraph"]
    got = C.pack_sections(texts, kinds, 50, 10)
    assert all(len(t) <= 50 for t, *_ in got) and len(got) > 3
    assert [(a, b) for _, _, a, b in got] == [(0, 1), *[(1, 2)] * (len(got) - 2), (2, 3)] and C.pack_sections([], []) == []


def test_documents_without_blocks_fall_back_to_their_pages(spark):
    df = spark.createDataFrame([("d1", "f", [], [(3, "one two three four"), (4, None)]), ("d2", "f", [("Body.", 1, "paragraph")], [(1, "Body.")]), ("d3", None, None, None)],
                               "source_document string, source_fingerprint string, blocks array<struct<text:string,page_number:int,block_type:string>>, pages array<struct<page_number:int,text:string>>")
    got = C.chunk_layout(df, 7, 0).orderBy("source_document", "chunk_index").collect()
    assert [(r.source_document, r.text, r.page_number) for r in got] == [("d1", "one two", 3), ("d1", "three", 3), ("d1", "four", 3), ("d2", "Body.", 1)]
    assert got[0].chunk_id is None and got[0].section_title is None and got[0].page_numbers is None and got[3].chunk_id


def test_windows():
    assert [len(w) for w in C.split_windows("x" * 1200, 1000, 100)] == [1000, 200]
    assert C.split_windows("one two three four", 7, 0) == ["one two", "three", "four"]
    assert C.split_windows("", 10) == C.split_windows(None, 10) == []
    with pytest.raises(ValueError):
        C.split_windows("a", 0)


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n\t", max_size=300), st.integers(1, 40), st.integers(0, 60))
def test_windows_end_fit_and_lose_nothing(text, most, overlap):
    got = C.split_windows(text, most, overlap)
    assert all(len(w) <= most for w in got)
    # every word is covered in order
    letters, at = "".join(text.split()), 0
    for w in got:
        own = "".join(w.split())
        start = max(0, at - overlap - len(own))
        found = next((i for i in range(at, start - 1, -1) if letters.startswith(own, i)), None)
        assert found is not None
        at = max(at, found + len(own))
    assert at == len(letters)


def test_long_word_after_overlap_terminates():
    text = " ".join(["word"] * 12) + " " + "z" * 950
    assert "".join(C.split_windows(text, 1000, 100)).count("z") >= 950


def test_words_and_sentences():
    assert C.split_words("ab " + "x" * 25, 10) == ["ab", "x" * 10, "x" * 10, "x" * 5]
    parts = C.split_semantic("First one is here. Second one is here. Third one is here.", 40)
    assert parts == ["First one is here. Second one is here.", "Third one is here."]


def test_headed_tables_repeat_their_header():
    text = "| Fee | Cost |\n| --- | --- |\n| wire | 10 |\n| check | 20 |\n| card | 30 |"
    parts = C.split_headed_table(text, 60)
    assert len(parts) > 1 and all(p.startswith("| Fee | Cost |\n| --- | --- |\n") and len(p) <= 60 for p in parts)
    assert all(len(p) <= 20 for p in C.split_headed_table("| " + "h" * 50 + " |\n| row |", 20))
    # rows without bars have no header
    assert C.split_headed_table("wire 10\ncheck 20\ncard 30", 17) == ["wire 10\ncheck 20", "card 30"]


def test_semantic_heading_and_fragments(spark):
    fragment = [block("this long bold fragment is no heading at all because it has so many words and no end", "heading", bold=True), block("and it goes on in lower case.")]
    bullet = [block("• bullet", "heading", bold=True), block("- a", "list")]
    got, joined, listed, alone, nothing = semantic(spark, [block("Margin", "heading", size=18.0, bold=True), block("Interest accrues daily.")], fragment, bullet, [block("Alone", "heading")], [])
    assert len(got) == 1 and got[0]["section_path"] == ["Margin"] and got[0]["text"] == "Margin\n\nInterest accrues daily."
    assert got[0]["embedding_text"] == "Margin\n\nInterest accrues daily." and got[0]["block_types"] == ["heading", "paragraph"]
    assert len(joined) == 1 and joined[0]["section_path"] == [] and "end and it" in joined[0]["text"]
    # types are those of units: a heading that isn't structural is a paragraph
    assert joined[0]["block_types"] == joined[0]["semantic_unit_types"] == ["paragraph"]
    assert listed[0]["section_path"] == [] and alone == nothing == []


def test_levels_follow_the_sizes_of_all_headings(spark):
    # the largest size is that of a heading that isn't structural, and takes the first rank
    blocks = [block("this heading is no heading at all since it is long and goes on and on and on. Really so", "heading", size=8.0), block("Fees", "heading", size=18.0), block("Body text.", size=30.0), block("Wire fees", "heading", size=14.0), block("More text.", size=30.0), block("Risks", "heading", size=18.0), block("Last text.", size=30.0)]
    got = semantic(spark, blocks)[0]
    assert [c["section_path"] for c in got] == [[], ["Fees"], ["Fees", "Wire fees"], ["Risks"]]


def test_semantic_chunks_are_sentence_safe(spark):
    text = "The first sentence is short. The second one is short too. The third ends it."
    got = semantic(spark, [block(text)], target=45, most=60, overlap=25)[0]
    assert len(got) > 1 and all(len(c["text"]) <= 60 and c["text"].endswith(".") for c in got)
    with pytest.raises(ValueError):
        C.chunk_semantic(documents(spark, []), 10, 5)


def test_semantic_tables_and_places(spark):
    table = "| Fee | Cost |\n| --- | --- |\n| wire | 10 |\n| check | 20 |\n| card | 30 |"
    blocks = [block("Costs", "heading", size=18.0), block(table, "table", page=2)]
    blocks[1] |= {"bbox": [1.0, 2.0, 3.0, 4.0], "metadata": ("table", "region-1", 7)}
    got = semantic(spark, blocks, target=45, most=70)[0]
    assert len(got) > 1 and all("| Fee | Cost |" in c["text"] and c["block_types"] == ["heading", "table"] for c in got)
    assert got[0]["source_bboxes"][0].asDict() == {"page_number": 2, "bbox": [1.0, 2.0, 3.0, 4.0], "layout_type": "table", "layout_region": "region-1", "reading_order": 7}
    plain = semantic(spark, [block("Body.")])[0][0]["source_bboxes"][0]
    assert (plain.layout_type, plain.layout_region, plain.reading_order) == ("text", "page", None)


def test_semantic_limits_hold_on_random_documents(spark):
    rng = random.Random(9)
    lists = []
    for _ in range(40):
        blocks = []
        for _ in range(rng.randrange(1, 12)):
            words = " ".join("".join(rng.choices("abcdef", k=rng.randrange(1, 12))) for _ in range(rng.randrange(1, 60)))
            blocks.append(block(words.capitalize() + rng.choice([".", "", "!"]), rng.choice(["paragraph", "paragraph", "heading", "list", "table"]), rng.randrange(1, 4)))
        lists.append(blocks)
    for blocks, got in zip(lists, semantic(spark, *lists, target=120, most=200, overlap=60, table_max=100), strict=True):
        assert all(len(c["text"]) <= 200 for c in got if len(c["section_title"] or "") <= 178)
        words = sorted(w for b in blocks if b["block_type"] != "heading" for w in b["text"].split())
        shown = " ".join(c["text"] for c in got)
        assert all(w in shown for w in words if len(w) <= 100)


def identity(*parts):
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()[:24]


def test_queries_number_chunks_and_identities(spark):
    kind = "array<struct<text:string,page_number:int,bbox:array<double>,block_type:string,font_size:double,is_bold:boolean>>"
    df = spark.createDataFrame([("d1", "f", [("Fees", 1, None, "heading", 18.0, True), ("Body text.", 1, None, "paragraph", 10.0, False)]), ("d2", None, []), ("d3", None, None)], f"source_document string, source_fingerprint string, blocks {kind}")
    # a document given twice comes once
    chunks, layout = C.chunk_semantic(df.union(df)).collect(), C.chunk_layout(df).collect()
    assert [(r.source_document, r.chunk_index, r.page_start) for r in chunks] == [("d1", 0, 1)] == [(r.source_document, r.chunk_index, r.page_start) for r in layout]
    assert chunks[0].chunk_id == identity("f", "d1", "0", "Fees", "Fees\n\nBody text.") and layout[0].chunk_id == identity("f", "d1", "0", "1", "Fees", "Fees\n\nBody text.")
    assert C.chunk_semantic(df.limit(0)).count() == C.chunk_layout(df.limit(0)).count() == 0


def test_columns_group_like_python(spark):
    rng = random.Random(2)
    sizes = [rng.randrange(1, 500) for _ in range(60)]
    plain = C.group_units([{"text": "x" * n, "path": ()} for n in sizes])
    want = [g for g, group in enumerate(plain) for _ in group]
    df = spark.createDataFrame([(sizes,), ([],)], "s array<int>")
    assert [r[0] for r in df.select(C.greedy_groups(df.s)).collect()] == [want, []]


def test_whole_documents(spark):
    got = P.windows(spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) and got.chars.max() <= 1000
