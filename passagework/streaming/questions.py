"""An extension: questions that arrive as a stream, searched against a static index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import answers, vector


def answer_stream(questions: DataFrame, index: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, dim: int = 384, k: int = 5) -> StreamingQuery:
    """Start a query that embeds, searches and answers each micro-batch of ``(id, question)`` rows.

    The index stays a table: a batch of questions is bounded by the source's rate, so the batch
    search's way for few queries holds. ``sink`` gets each batch's answers with its number, which
    makes writes repeatable after a failure.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.dropDuplicates(["id"]).persist()
        asked = answers.add_embeddings(batch.selectExpr("id as chunk_index", "question as text"), lambda: answers.hashing_embedder(dim), limit=1 << 30)
        hits = vector.search(asked.selectExpr("chunk_index as query_id", "embedding"), index, k=k, dim=dim)
        texts = index.select("chunk_index", "text", "source_document", "page_number")
        found = answers.passages_by_question(answers.normalize_passages(hits.join(texts, "chunk_index")), "query_id", "rank")
        sink(answers.answer(batch.join(found, batch["id"] == found["query_id"], "left").drop("query_id")), number)
        batch.unpersist()

    return questions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
