"""Chat, health, the viewer's tables and guarded runs."""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.request

import pytest

from passagework import service

HITS = [{"score": "0.9", "text": "A fee.", "source_document": "d.pdf", "page_number": 3.0}]
SOURCES = [{"doc": "d.pdf", "page": 3, "snippet": "A fee.", "score": 0.9}]


def fails(*_):
    raise RuntimeError("down")


def test_chat_takes_the_first_condition():
    ready = service.Searcher(lambda v, k: HITS[:k])
    chat = service.Chat(ready, reply=lambda q, h: "Grounded.")
    assert chat.chat({"query": "fees?"}) == (200, {"answer": "Grounded.", "sources": SOURCES})
    assert chat.health() == (200, {"status": "ok"})
    for body in ({}, None, [], {"query": 3}):
        assert chat.chat(body)[0] == 422
    assert chat.chat({"query": " "})[1] == {"answer": "Please enter a valid question.", "sources": SOURCES}
    gone = service.Chat(service.Searcher(lambda v, k: HITS, lambda: False))
    assert gone.chat({"query": "x"})[1] == {"answer": "Vector retrieval is unavailable: the index is missing.", "sources": []} and gone.health()[1] == {"status": "degraded"}
    assert service.Chat(ready, embed=fails).chat({"query": "x"})[1] == {"answer": "Retrieval failed: down", "sources": []}
    assert service.Chat(service.Searcher(lambda v, k: None)).chat({"query": "x"})[1]["answer"].startswith("No relevant passages found")
    assert service.Chat(ready, reply=fails).chat({"query": "x"})[1] == {"answer": "Answer generation failed: down", "sources": SOURCES}
    assert "enough information" in service.Chat(ready, reply=lambda q, h: " ").chat({"query": "x"})[1]["answer"]


@pytest.mark.parametrize(("run", "kind"), [(fails, "failed"), (lambda v, k: {"a": 1}, "invalid"), (lambda v, k: [1], "invalid"), (lambda v, k: time.sleep(1), "timeout")])
def test_kinds_of_search_errors(run, kind):
    with pytest.raises(service.SearchError) as e:
        service.Searcher(run, seconds=0.2)([0.1])
    assert e.value.kind == kind
    with pytest.raises(service.SearchError, match="isn't there"):
        service.Searcher(run, lambda: False)([0.1])


def test_the_first_available_searcher_is_asked():
    one, two = service.Searcher(fails, lambda: False), service.Searcher(lambda v, k: HITS)
    assert service.first_available(one, two)([0.1]) == HITS
    assert not service.first_available(one).available()


def test_index_and_viewer(spark):
    index = spark.createDataFrame([(0, "a b c", "d", 1, [1.0, 0.0]), (1, "c d", "d", 2, [0.0, 1.0])], "chunk_index int, text string, source_document string, page_number int, embedding array<float>")
    search = service.index_searcher(lambda: index, 2)
    assert search([0.0, 1.0], 1) == [{"score": 1.0, "text": "c d", "source_document": "d", "page_number": 2}]
    assert not service.index_searcher(lambda: None).available()
    viewer = service.Viewer({"layout": index}.get, lambda: {"documents": 1})
    status, body = viewer.get("/api/chunks")
    assert status == 200 and [(r["chunk_index"], r["overlap_previous"], r["overlap_next"]) for r in body["records"]] == [(0, 0, 1), (1, 1, 0)]
    assert body["ingestion"] == {"documents": 1} and body["records"][1]["marked_text"] == "<mark>c</mark> d"
    assert viewer.get("/api/semantic-chunks")[1]["records"] == [] and viewer.get("/x")[0] == 404
    both = service.Viewer(lambda name: index).get("/api/validated-chunks")[1]
    assert both["summary"]["input_records"] == 2 and len(both["records"]) == 2


def test_runs_exclude_each_other_over_http():
    started, end = threading.Event(), threading.Event()

    def run():
        started.set()
        end.wait(20)
        return "done"

    server = service.serve(service.Chat(service.Searcher(lambda v, k: HITS)), service.Viewer(lambda name: None, run=run))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"

    def call(path, data=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(at + path, data), timeout=20) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    first: list = []
    thread = threading.Thread(target=lambda: first.append(call("/api/run", b"")))
    thread.start()
    assert started.wait(20) and call("/api/run", b"")[0] == 409
    end.set()
    thread.join(20)
    assert first == [(200, {"output": "done", "ingestion": None})]
    assert call("/health") == (200, {"status": "ok"}) and call("/chat", b"{bad")[0] == 422 and call("/chat", b'{"query": "x"}')[1]["sources"] == SOURCES
    assert call("/nothing")[0] == 404 and service.Viewer(lambda name: None, run=fails).post("/api/run")[0] == 500
    server.shutdown()
