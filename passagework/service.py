"""Thin services over the operators: chat and health, a viewer of chunk tables, and a guarded pipeline run.

Requests are answered by plain functions of a path and a body, which the handler of the standard
library's server only wraps, so that any web framework can do the same.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as X
from .operators import answers, validation, vector

#: Passages of an answer, seconds a search may take, and records that one viewer response may have.
TOP_K, SEARCH_SECONDS, MOST_RECORDS = 5, 30.0, 50_000


class SearchError(Exception):
    """A search that gave no result; ``kind`` is ``missing``, ``timeout``, ``failed`` or ``invalid``."""

    def __init__(self, kind: str, message: str) -> None:
        super().__init__(message)
        self.kind = kind


@dataclass
class Searcher:
    """A search behind a time limit. ``run`` gets a vector and k and gives a list of hits (dicts)."""

    run: Callable[[list[float], int], Any]
    available: Callable[[], bool] = lambda: True
    seconds: float = SEARCH_SECONDS

    def __call__(self, query: list[float], k: int = TOP_K) -> list[dict]:
        """The hits; null is none."""
        if not self.available():
            raise SearchError("missing", "the index isn't there")
        pool = ThreadPoolExecutor(1)
        try:
            hits = pool.submit(self.run, query, k).result(self.seconds)
        except Late as e:
            raise SearchError("timeout", "the search timed out") from e
        except Exception as e:
            raise SearchError("failed", f"the search failed: {e}") from e
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
        if hits is None:
            return []
        if not isinstance(hits, list) or not all(isinstance(h, dict) for h in hits):
            raise SearchError("invalid", "the search gave no list of hits")
        return hits


def first_available(*searchers: Searcher) -> Searcher:
    """The first searcher whose index is there, looked up at each call; without any the last one reports it."""

    def run(query: list[float], k: int) -> list[dict]:
        return next((s for s in searchers if s.available()), searchers[-1])(query, k)

    return Searcher(run, lambda: any(s.available() for s in searchers), max(s.seconds for s in searchers))


def index_searcher(index: Callable[[], DataFrame | None], dim: int = 384, seconds: float = SEARCH_SECONDS) -> Searcher:
    """A searcher over an index table, which ``index`` gives if it is there."""

    def run(query: list[float], k: int) -> list[dict]:
        found = vector.search_one(index(), query, min(k, MOST_RECORDS), dim, keep=("text", "source_document", "page_number"))
        return [r.asDict() for r in found.drop("chunk_index").collect()]

    return Searcher(run, lambda: answers.health(index()) == "ok", seconds)


def to_source(hit: dict) -> dict:
    """A hit as a source: document, page as an integer, snippet, score as a float."""
    return {"doc": hit["source_document"], "page": int(hit["page_number"]), "snippet": hit["text"], "score": float(hit["score"])}


@dataclass
class Chat:
    """``POST /chat`` and ``GET /health``: the first condition that holds answers, always with status 200 but for a bad body."""

    search: Searcher
    embed: Callable[[str], list[float]] = field(default_factory=lambda: (lambda e: lambda text: e([text])[0])(answers.hashing_embedder()))
    reply: Callable[[str, list[dict]], str] = lambda question, hits: answers.MOCK_ANSWER
    index_name: str = "the index"

    def health(self) -> tuple[int, dict]:
        """``ok`` while the index is there."""
        return 200, {"status": "ok" if self.search.available() else "degraded"}

    def chat(self, body: Any) -> tuple[int, dict]:
        """The answer to ``{"query": ...}`` and its sources."""
        if not isinstance(body, dict) or not isinstance(body.get("query"), str):
            return 422, {"detail": "query must be a string"}
        question = body["query"]

        def said(answer: str, sources: list[dict] = []) -> tuple[int, dict]:  # noqa: B006 - never changed
            return 200, {"answer": answer, "sources": sources}

        if not self.search.available():
            return said(f"Vector retrieval is unavailable: {self.index_name} is missing.")
        try:
            hits = self.search(self.embed(question), TOP_K)
            sources = [to_source(h) for h in hits]
        except Exception as e:  # noqa: BLE001 - any failure is an answer
            return said(f"Retrieval failed: {e}")
        if not sources:
            return said(f'No relevant passages found for: "{question}".')
        if not question.strip():
            return said(answers.INVALID_QUESTION, sources)
        try:
            text = self.reply(question, hits)
        except Exception as e:  # noqa: BLE001 - any failure is an answer
            return said(f"Answer generation failed: {e}", sources)
        return said((text or "").strip() or answers.INSUFFICIENT, sources)


class TooLarge(Exception):
    """A table that one response can't hold."""


@dataclass
class Viewer:
    """Chunk tables with their neighbours' overlaps, as kept or as validated, the last run's statistics, and a run that none can join.

    ``tables`` gives the chunk table of a name (``layout`` or ``semantic``), or None if there is none.
    """

    tables: Callable[[str], DataFrame | None]
    stats: Callable[[], dict | None] = lambda: None
    run: Callable[[], str] | None = None
    _running: threading.Lock = field(default_factory=threading.Lock)

    def get(self, path: str) -> tuple[int, dict]:
        """Status and body for a path."""
        if path == "/api/stats":
            return 200, {"ingestion": self.stats()}
        name = {"/api/chunks": "layout", "/api/layout-chunks": "layout", "/api/semantic-chunks": "semantic", "/api/validated-chunks": "semantic"}.get(path)
        if name is None:
            return 404, {"error": "not found"}
        table = self.tables(name)
        try:
            if path != "/api/validated-chunks":
                return 200, {"records": self.records(table), "ingestion": self.stats()}
            if table is None:
                return 200, {"records": [], "summary": None}
            judged = validation.validate(table)
            return 200, {"records": self.records(judged.kept), "summary": judged.summary.first().asDict(recursive=True)}
        except TooLarge:
            return 413, {"error": f"more than {MOST_RECORDS} records"}

    def records(self, table: DataFrame | None) -> list[dict]:
        """Records in order, with the words shared with their neighbours and marked by them; no vectors."""
        if table is None:
            return []
        shown = validation.neighbour_overlaps(table.drop("embedding"))
        marked = X.highlight(F.col("text"), F.col("overlap_previous"), F.col("overlap_next"))
        rows = shown.withColumn("marked_text", marked).orderBy("chunk_index").limit(MOST_RECORDS + 1).collect()
        if len(rows) > MOST_RECORDS:
            raise TooLarge
        return [r.asDict(recursive=True) for r in rows]

    def post(self, path: str) -> tuple[int, dict]:
        """Run the pipeline, unless it is running already."""
        if path != "/api/run" or self.run is None:
            return 404, {"error": "not found"}
        if not self._running.acquire(blocking=False):
            return 409, {"error": "Ingestion is already running"}
        try:
            return 200, {"output": self.run(), "ingestion": self.stats()}
        except Exception as e:  # noqa: BLE001 - the caller sees what failed
            return 500, {"output": str(e), "ingestion": self.stats()}
        finally:
            self._running.release()


def serve(chat: Chat | None = None, viewer: Viewer | None = None, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server for both, not yet started; call ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_: object) -> None:
            """Nothing is logged."""

        def answer(self, status: int, body: dict) -> None:
            """Send JSON."""
            data = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802 - the server's name for it
            """Health and tables."""
            if chat and self.path == "/health":
                self.answer(*chat.health())
            else:
                self.answer(*(viewer.get(self.path) if viewer else (404, {"error": "not found"})))

        def do_POST(self) -> None:  # noqa: N802 - the server's name for it
            """Chat and runs."""
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            if chat and self.path == "/chat":
                try:
                    body = json.loads(raw or b"null")
                except ValueError:
                    body = None
                self.answer(*chat.chat(body))
            else:
                self.answer(*(viewer.post(self.path) if viewer else (404, {"error": "not found"})))

    return ThreadingHTTPServer((host, port), Handler)
