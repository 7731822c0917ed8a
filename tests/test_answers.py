"""Answers, sources and sinks, the cache, and the stream."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from passagework.operators import answers as A
from passagework.sources import readers, writers
from passagework.streaming.questions import answer_stream

PASSAGES = "array<struct<rank:int,text:string,source_document:string,page_number:int,score:double>>"


def asked(spark, rows):
    return spark.createDataFrame(rows, f"id string, category string, question string, passages {PASSAGES}")


ONE = [(1, "t", "d.pdf", 3, 0.9)]


def test_answers_and_checks(spark):
    q = asked(spark, [("a", "fees", "What fee?", ONE), ("b", "empty_question", "  ", ONE), ("c", "unrelated_question", "Weather?", []), ("d", "insufficient_context", "x", None), ("e", "prompt_injection", None, None)])
    got = {r.id: r for r in A.check_answers(A.answer(q)).collect()}
    assert got["a"].answer == A.MOCK_ANSWER and len(got["a"].sources) == 1
    assert got["b"].answer == A.INVALID_QUESTION and got["b"].sources == []
    assert got["c"].answer == got["d"].answer == A.INSUFFICIENT
    assert all(r.passed for r in got.values()) and "has_sources" in got["a"].checks and "handles_unrelated" in got["c"].checks


def failing():
    """A maker of a model that fails; local functions travel to workers by value."""

    def model(_):
        raise RuntimeError("no key")

    return lambda: model


def test_failing_and_silent_models(spark):
    q = asked(spark, [("a", "fees", "What fee?", ONE)])
    assert A.answer(q, make=failing()).first().answer == "Answer generation failed: no key"
    assert A.answer(q, make=lambda: lambda _: "  ").first().answer == A.INSUFFICIENT


def test_chat_takes_the_first_condition(spark):
    q = asked(spark, [("a", "fees", "What fee?", ONE), ("b", "fees", "none?", []), ("c", "fees", " ", ONE), ("d", "fees", "bad", ONE)]).withColumn("retrieval_error", F.when(F.col("id") == "d", "timeout"))
    got = {r.id: (r.answer, len(r.sources or [])) for r in A.chat(q, True).collect()}
    assert got == {"a": (A.MOCK_ANSWER, 1), "b": ('No relevant passages found for: "none?".', 0), "c": (A.INVALID_QUESTION, 1), "d": ("Retrieval failed: timeout", 0)}
    assert A.chat(q, False).first().answer.startswith("Vector retrieval is unavailable")


def test_prompt_layout(spark):
    q = asked(spark, [("a", "fees", "What fee?", ONE), ("b", "fees", "x", [])])
    got = {r.id: r.p for r in q.select("id", A.prompt(F.col("question"), F.col("passages"), "S").alias("p")).collect()}
    assert got["a"] == f"SYSTEM PROMPT:\nS\n\nUSER QUESTION:\nWhat fee?\n\nRETRIEVED DOCUMENT CHUNKS:\n[Source 1]\nDocument: d.pdf\nPage: 3\nScore: 0.9\nText: t\n\nTASK:\n{A.TASK}"
    assert A.NO_CHUNKS in got["b"]


def test_normalization_prefers_filled_names(spark):
    df = spark.createDataFrame([("", "snip", None, "d", None, 4, None), ("t", "s", "sd", "d", 0, 4, 0.5), (None, None, None, None, None, None, None)], "text string, snippet string, source_document string, doc string, page_number int, page int, score double")
    assert [tuple(r) for r in A.normalize_passages(df).collect()] == [("snip", "d", 4, 0.0), ("t", "sd", 0, 0.5), ("", "Unknown", 0, 0.0)]


def test_embedding(spark):
    df = spark.createDataFrame([(0, "a b", None), (1, "x", "a b"), (2, None, None)], "chunk_index int, text string, embedding_text string")
    got = {r.chunk_index: r for r in A.add_embeddings(df).collect()}
    assert got[0].embedding == got[1].embedding and got[0].token_count == 2 and len(got[2].embedding) == 384 and got[0].embedding_max_tokens == 256
    with pytest.raises(Exception, match="exceeds the model's limit"):
        A.add_embeddings(df, limit=1).collect()
    assert A.health(df) == "ok" and A.health(None) == A.health(df.limit(0)) == "degraded"


def test_tokens_by_a_tokenizer_file(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no tokenizer file")
    df = spark.createDataFrame([(0, "unbelievably long-winded"), (1, None)], "chunk_index int, text string")
    got = {r.chunk_index: r.token_count for r in A.add_embeddings(df, make_counter=A.file_counter(path, 2)).collect()}
    assert got[0] > 2 + 2 and got[1] == 2


def test_json_lines(spark, tmp_path):
    path = tmp_path / "index.jsonl"
    good = {"chunk_index": 0, "text": "t", "source_document": "d", "page_number": 1, "embedding": [0.1, 0.2, 0.3], "extra": 1}
    lines = [json.dumps(good), "", "   ", "{broken", json.dumps(good | {"page_number": None}), json.dumps(good | {"text": 7}), json.dumps(good | {"chunk_index": 1.5}), json.dumps(good | {"embedding": [1.0]}), json.dumps({"chunk_index": 2})]
    path.write_text("\n".join(lines))
    rows, counts = readers.read_index(spark, str(path), 3)
    assert [r.chunk_index for r in rows.collect()] == [0] and tuple(counts.first()) == (1, 6)
    strict = tmp_path / "strict.jsonl"
    strict.write_text('{"a": 1, "b": null}\n\n{"a": 2}\n')
    got = readers.read_numbered(spark, str(strict), "a int, b string").orderBy("_line_number").collect()
    assert [(r._line_number, sorted(r._fields), r.a) for r in got] == [(1, ["a", "b"], 1), (3, ["a"], 2)]
    with pytest.raises(Exception):  # noqa: B017
        readers.read_records(spark, str(path), readers.INDEX_SCHEMA).collect()
    assert readers.read_records(spark, str(tmp_path / "none"), "a int").count() == 0


def test_sinks_replace_as_a_whole(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", None)], "a int, b string, c string")
    for _ in range(2):
        writers.write_jsonl(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert json.loads(text) == {"a": 1, "b": "é", "c": None}
    stages = writers.Stages()
    with stages.stage("read"):
        pass
    writers.write_json(spark, stages.document({"documents": 1}, {"hits": 0, "misses": 1}, "2024-01-01T00:00:00+00:00"), str(tmp_path / "stats.json"))
    assert json.loads((tmp_path / "stats.json").read_text())["timings_seconds"]["read"] >= 0
    hits = spark.createDataFrame([("q", 2, 0.5, "b", "d", 1), ("q", 1, 0.9, "a", "d", 1)], "q string, rank int, score double, text string, source_document string, page_number int")
    assert [h["text"] for h in json.loads(writers.hits_json(hits, "q").first().results)] == ["a", "b"]


def one_page():
    """A maker of an extractor that takes a file for one page of text."""

    def extract(content):
        return [{"page_number": 1, "width": 1.0, "height": 1.0, "blocks": [{"text": content.decode(), "page_number": None, "bbox": None, "block_type": None, "font_size": None, "is_bold": None}]}]

    return lambda: extract


def test_cache(spark, tmp_path):
    folder, cache = tmp_path / "in", tmp_path / "cache"
    folder.mkdir()
    (folder / "b.pdf").write_bytes(b"two")
    (folder / "a.pdf").write_bytes(b"one")
    (folder / "c.txt").write_bytes(b"no")
    assert [r.name for r in readers.find_files(spark, str(folder)).collect()] == ["a.pdf", "b.pdf"]
    pages, probed = readers.load_or_extract(spark, str(folder), str(cache), "v1", one_page())
    assert pages.count() == 2 and tuple(readers.cache_stats(probed).first()) == (0, 2)
    pages, probed = readers.load_or_extract(spark, str(folder), str(cache), "v1", failing())
    assert pages.count() == 2 and tuple(readers.cache_stats(probed).first()) == (2, 0)
    flat = readers.flatten_pages(pages.selectExpr("source_document", "explode(pages) as p").select("source_document", "p.*"), ("source_document",))
    assert sorted((r.source_document, r.text, r.page_number, r.block_type) for r in flat.collect()) == [("a.pdf", "one", 1, "paragraph"), ("b.pdf", "two", 1, "paragraph")]
    manifest = spark.createDataFrame([("a", "f", "v"), ("b", "g", "v"), ("c", "h", "v")], "source_document string, source_fingerprint string, extraction_version string")
    entries = spark.createDataFrame([("a", "f", "v", 2), ("x", "g", "v", 2)], "source_document string, source_fingerprint string, extraction_version string, page_count int")
    assert {r.source_document: r.cache_status for r in readers.probe_cache(manifest, entries).collect()} == {"a": "hit", "b": "invalid", "c": "miss"}


def test_every_request_is_answered(spark, tmp_path):
    from passagework.plans import answers as plans

    at = ["2026-01-01 00:00:00", "2026-01-02 00:00:00", None]
    rows = [(n, "q1", n % 2, "d.pdf", 1, f"text {n}", 0.5, at[n // 2]) for n in range(6)] + [(6, None, 1, "d.pdf", 1, "x", 0.5, at[0]), (0, "q1", 0, "d.pdf", 1, "text 0", 0.5, at[0])]
    schema = "source_id long, question_id string, rank_no int, doc string, page int, snippet string, score double, answered_at string"
    spark.createDataFrame(rows, schema).withColumn("answered_at", F.col("answered_at").cast("timestamp")).write.parquet(f"{tmp_path}/sources.parquet")
    spark.createDataFrame([("q1", "fees", "What fee?", ""), ("q2", "fees", "Never asked?", "")], "id string, category string, question string, expected_behavior string").write.parquet(f"{tmp_path}/qa_cases.parquet")
    got = [(r.id, str(r.answered_at), r.passages) for r in plans.QUERIES["rag_prompts"](spark, str(tmp_path)).collect()]
    assert sorted(got) == [("q1", "2026-01-01 00:00:00", 2), ("q1", "2026-01-02 00:00:00", 2), ("q1", "None", 2), ("q2", "None", 0)]
    for name in ("rag_answers", "rag_chat"):
        assert sorted(r.sources for r in plans.QUERIES[name](spark, str(tmp_path)).collect()) == [0, 2, 2, 2]
    assert [r.total for r in plans.QUERIES["rag_checks"](spark, str(tmp_path)).collect()] == [4]


def test_rollups(spark):
    s = spark.createDataFrame([("q", "d", None, 4, 0.5, 2), ("q", "d", "§1", 3, 0.9, 1)], "q string, source_document string, section string, page_number int, score double, rank int")
    assert tuple(A.source_rollup(s, ["q"], "rank").first()) == ("q", "d", "§1, §4", 0.9)
    known = spark.createDataFrame([("a.pdf",), ("b",)], "source_document string")
    seen = spark.createDataFrame([("b",), ("c_d.PDF",), (None,)], "source_document string")
    assert {tuple(r) for r in A.known_documents(known, seen).collect()} == {("a.pdf", "a", "inactive"), ("b", "b", "active"), ("c_d.PDF", "c d", "unknown")}


def test_stream(spark, tmp_path):
    folder = tmp_path / "questions"
    spark.createDataFrame([(1, "what fee"), (2, "")], "id long, question string").write.parquet(str(folder))
    vectors = A.hashing_embedder(16)
    index = spark.createDataFrame([(0, "fees are low", "d", 1, vectors(["what fee"])[0])], "chunk_index int, text string, source_document string, page_number int, embedding array<float>")
    out: list = []
    query = answer_stream(spark.readStream.schema("id long, question string").parquet(str(folder)), index, lambda df, n: out.extend(df.collect()), str(tmp_path / "checkpoint"), dim=16)
    query.processAllAvailable()
    query.stop()
    assert {r.id: r.answer for r in out} == {1: A.MOCK_ANSWER, 2: A.INVALID_QUESTION}
