"""The page pipeline, requests and the command line."""

from __future__ import annotations

import io
import json

import pytest
from pyspark.sql import functions as F

from passagework import cli
from passagework.functions import text as X
from passagework.operators import layout
from passagework.sources import readers, writers


def test_pages_to_blocks(spark):
    rows, tables = [], []
    for page in (1, 2, 3):
        rows.append(("d", page, f"Annual report {page}", [50.0, 5.0, 200.0, 15.0], 8.0, False, 0))
        rows.append(("d", page, "Fees", [50.0, 100.0, 100.0, 118.0], 18.0, False, 1))
        rows += [("d", page, f"Body line {n} of page {page}.", [50.0, 130.0 + 12 * n, 300.0, 140.0 + 12 * n], 10.0, False, 2) for n in range(3)]
        rows.append(("d", page, "cell text", [60.0, 310.0, 120.0, 320.0], 10.0, False, 3))
        rows.append(("d", page, "boxed note", [60.0, 510.0, 120.0, 520.0], 10.0, False, 4))
        tables.append(("d", page, 0, [50.0, 300.0, 300.0, 400.0], [["Fee", "Cost"], ["wire", "10"], ["check", "5"], ["card", "1"]]))
        tables.append(("d", page, 1, [50.0, 500.0, 500.0, 700.0], [["boxed note"]]))
    lines = spark.createDataFrame(rows, "doc string, page_number int, text string, bbox array<double>, font_size double, is_bold boolean, source_block int")
    found = spark.createDataFrame(tables, "doc string, page_number int, table_index int, bbox array<double>, cells array<array<string>>")
    pages = spark.createDataFrame([("d", p, 600.0, 800.0) for p in (1, 2, 3)], "doc string, page_number int, width double, height double")
    got = layout.page_blocks(lines, found, pages).orderBy("page_number", "reading_order").collect()
    assert [(r.block_type, r.text.split("\n")[0]) for r in got if r.page_number == 1] == [("heading", "Fees"), ("paragraph", "Body line 0 of page 1."), ("table", "| Fee | Cost |"), ("paragraph", "boxed note")]
    assert not any("Annual report" in r.text or "cell text" in r.text for r in got)
    assert layout.page_blocks(lines.limit(0), found.limit(0), pages.limit(0)).count() == 0


def test_requests(spark):
    values = ["", None, "{x", '{"top_k": 3}', '{"embedding": ["a"]}', '{"embedding": [1, 2]}', '{"embedding": [1, 2, 3], "top_k": 1.5}', '{"embedding": [1, 2, 3]}', '{"embedding": [1, 2, 3], "top_k": 7}']
    got = readers.parse_requests(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, value string"), 3).orderBy("i").collect()
    assert [r.error for r in got] == ["empty", "empty", "invalid JSON", "no embedding", "no embedding", "wrong dimension", "invalid top_k", None, None]
    assert [r.top_k for r in got[-2:]] == [5, 7]


def test_highlight(spark):
    df = spark.createDataFrame([("a <b> c d", 1, 2)], "t string, n int, m int")
    assert df.select(X.highlight(F.col("t"), F.col("n"), F.col("m"))).first()[0] == "<mark>a</mark> &lt;b&gt; <mark>c</mark> <mark>d</mark>"


def test_documents_and_arrays(spark, tmp_path):
    assert readers.read_document(spark, str(tmp_path / "no.json")) is None
    (tmp_path / "a.json").write_text('{\n "documents": 3\n}')
    assert readers.read_document(spark, str(tmp_path / "a.json")) == {"documents": 3}
    (tmp_path / "q.json").write_text('[\n{"id": "QA-1", "question": "x"},\n{"id": "QA-2"}\n]')
    assert readers.read_array(spark, str(tmp_path / "q.json"), "id string, question string").count() == 2


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    index = tmp_path / "index.jsonl"
    index.write_text("\n".join(json.dumps({"chunk_index": i, "text": f"t{i}", "source_document": "d", "page_number": i, "embedding": v}) for i, v in enumerate(([0.1, 0.2, 0.0], [0.2, 0.1, 0.0]))))
    run = lambda text, *args: (monkeypatch.setattr("sys.stdin", io.StringIO(text)), cli.main([*args, "--embedding-dim", "3"], spark))[1]
    assert run('{"embedding": [0.1, 0.2, 0.0], "top_k": 1}', "search", str(index)) == 0
    assert json.loads(capsys.readouterr().out)[0]["text"] == "t0"
    assert run("", "search", str(index)) == 2 and run('{"embedding": [1, 2, 3]}', "search", str(tmp_path / "none")) == 1
    assert run("", "health", str(index)) == 0 and run("", "health", str(tmp_path / "none")) == 1
    capsys.readouterr()
    records = tmp_path / "records.jsonl"
    records.write_text('{"chunk_index": 0, "text": "same"}\n{"chunk_index": 1, "text": "same"}\n')
    assert run("", "validate", str(records), "--json") == 1
    summary = json.loads(capsys.readouterr().out)
    assert (summary["input_records"], summary["dropped_records"]) == (2, 1)


def test_validation_of_files_in_their_order(spark, tmp_path, capsys):
    record = dict.fromkeys(("block_types", "chunk_id", "extraction_version", "page_end", "page_number", "page_numbers", "page_start", "section_title", "source_document", "source_fingerprint"))
    for name, order in (("good", [0, 1, 2]), ("turned", [0, 2, 1])):
        (tmp_path / name).write_text("\n\n".join(json.dumps({**record, "chunk_index": i, "chunk_id": str(i), "text": f"Text {i}."}) for i in order) + "\n")
    assert cli.main(["validate", str(tmp_path / "good")], spark) == 0
    assert cli.main(["validate", str(tmp_path / "turned")], spark) == 1 and "not contiguous" in capsys.readouterr().out
    assert cli.main(["validate", str(tmp_path / "turned"), "--index-order"], spark) == 0
    for i in (1, 0, 2):
        (tmp_path / "many").mkdir(exist_ok=True)
        (tmp_path / "many" / f"f{i}.jsonl").write_text("".join(f'{{"chunk_index": {i * 10 + k}}}\n' for k in range(3 + 40 * i)))
    rows = readers.read_numbered(spark, str(tmp_path / "many"), "chunk_index int").orderBy("_line_number").collect()
    assert [r._line_number for r in rows] == list(range(1, 130)) and [r.chunk_index for r in rows] == [i * 10 + k for i in range(3) for k in range(3 + 40 * i)]


def test_nested_records(spark):
    rows = [("d", 1, 1, "Fees", 0, "Fees", 100.0, 200.0), ("d", 1, 2, "Wire.", 0, "Fees", 100.0, 200.0), ("d", 2, 3, "", 0, "Fees", 90.0, 80.0), ("d", 2, 4, "More.", 1, None, 90.0, 80.0)]
    blocks = spark.createDataFrame(rows, "doc string, page_number int, reading_order int, text string, section_id int, section_title string, width double, height double")
    pages = writers.nested_pages(blocks).orderBy("page_number").collect()
    assert [(p.page_number, p.width, p.text, [b.text for b in p.blocks]) for p in pages] == [(1, 100.0, "Fees\n\nWire.", ["Fees", "Wire."]), (2, 90.0, "More.", ["", "More."])]
    sections = writers.nested_sections(blocks).orderBy("section_id").collect()
    assert [(s.title, s.level, s.page_numbers, len(s.blocks)) for s in sections] == [("Fees", 1, [1, 2], 3), (None, 1, [2], 1)]


def test_chunk_command(spark, tmp_path):
    source = tmp_path / "documents.jsonl"
    source.write_text("\n".join(json.dumps({"source_document": d, "source_fingerprint": "f", "blocks": [{"text": "Some text here.", "page_number": 1, "block_type": "paragraph"}]}) for d in ("b", "a")))
    assert cli.main(["chunk", str(source), "--out", str(tmp_path / "out")], spark) == 0
    rows = [json.loads(x) for p in (tmp_path / "out" / "semantic.jsonl").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted((r["source_document"], r["chunk_index"]) for r in rows) == [("a", 0), ("b", 1)]
    assert readers.read_document(spark, str(tmp_path / "out" / "stats.json"))["semantic_chunks"] == 2


@pytest.mark.parametrize("name", ["vec_topk_sources"])
def test_entry(spark, name):
    import __spark_entry__ as entry

    assert name in entry.queries() and entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
