"""Command line: python -m passagework.cli validate | search | chunk | health.

validate exits 1 with errors, 2 with warnings, else 0; search exits 2 for a bad request, 1 if
the index can't be loaded, else 0; health exits 1 if the index isn't usable.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .operators import answers, chunking, validation, vector
from .session import local_session
from .sources import readers, writers

#: Hits that a search prints at most.
MOST_HITS = 10_000
RECORDS = (
    "chunk_index int, chunk_id string, text string, source_document string, page_number int, page_start int, page_end int, page_numbers array<int>, section_title string, block_types array<string>, "
    "source_fingerprint string, extraction_version string, chunking_version string, embedding_text string, section_path array<string>, semantic_unit_types array<string>, token_count int, embedding_max_tokens int, embedding array<float>"
)


def validate(spark: SparkSession, args: argparse.Namespace) -> int:
    """Validate JSON lines; the summary goes to standard output."""
    records = readers.read_numbered(spark, args.path, RECORDS)
    summary = validation.validate(records, "chunk_index" if args.index_order else "_line_number", max_chars=args.max_chars, dim=args.embedding_dim).summary.first().asDict(recursive=True)
    print(json.dumps(summary) if args.json else "\n".join(f"{k.replace('_', ' ')}: {v}" for k, v in summary.items()))
    return summary["exit_code"]


def search(spark: SparkSession, args: argparse.Namespace) -> int:
    """Answer one request from standard input with a JSON array of hits."""
    request = readers.parse_requests(spark.createDataFrame([(sys.stdin.read(),)], "value string"), args.embedding_dim).first()
    if request.error:
        print(request.error, file=sys.stderr)
        return 2
    try:
        index, counts = readers.read_index(spark, args.path, args.embedding_dim)
        loaded = counts.first().loaded
    except Exception as e:  # noqa: BLE001 - any reason is the same to the caller
        print(f"the index can't be read: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    if not loaded:
        print("the index is empty", file=sys.stderr)
        return 1
    if request.top_k > MOST_HITS:
        print(f"top_k is above {MOST_HITS}", file=sys.stderr)
        return 2
    hits = vector.search_one(index, request.embedding, request.top_k, args.embedding_dim, keep=("text", "source_document", "page_number")).collect()
    print(json.dumps([{"score": h.score, "text": h.text, "source_document": h.source_document, "page_number": h.page_number} for h in hits], ensure_ascii=False))
    return 0


def chunk(spark: SparkSession, args: argparse.Namespace) -> int:
    """Chunk documents given as JSON lines of (source_document, source_fingerprint, blocks), both ways, numbered over all documents."""
    documents = readers.read_records(spark, args.path, f"source_document string, source_fingerprint string, blocks array<{chunking.BLOCK}>")
    stages = writers.Stages()
    counts = {}
    for name, make in (("layout", chunking.chunk_layout), ("semantic", chunking.chunk_semantic)):
        with stages.stage(name):
            rows = make(documents).withColumnRenamed("chunk_index", "local_index")
            writers.write_jsonl(validation.renumber(rows, "source_document", "local_index"), f"{args.out}/{name}.jsonl")
            counts[f"{name}_chunks"] = spark.read.text(f"{args.out}/{name}.jsonl").count()
    writers.write_json(spark, stages.document(counts, {}, args.generated_at), f"{args.out}/stats.json")
    return 0


def health(spark: SparkSession, args: argparse.Namespace) -> int:
    """Whether the index is there and not empty."""
    state = answers.health(readers.read_index(spark, args.path, args.embedding_dim)[0] if readers.exists(spark, args.path) else None)
    print(json.dumps({"status": state}))
    return 0 if state == "ok" else 1


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; returns its exit code."""
    parser = argparse.ArgumentParser(prog="passagework")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, run in (("validate", validate), ("search", search), ("chunk", chunk), ("health", health)):
        p = sub.add_parser(name, help=run.__doc__)
        p.add_argument("path")
        p.add_argument("--embedding-dim", type=int, default=384)
        p.set_defaults(run=run)
        if name == "validate":
            p.add_argument("--max-chars", type=int, default=1000)
            p.add_argument("--json", action="store_true")
            p.add_argument("--index-order", action="store_true", help="take the records in the order of chunk_index, whatever their lines are")
        if name == "chunk":
            p.add_argument("--out", required=True)
            p.add_argument("--generated-at", default="")
    args = parser.parse_args(argv)
    return args.run(spark or local_session("*"), args)


if __name__ == "__main__":
    sys.exit(main())
