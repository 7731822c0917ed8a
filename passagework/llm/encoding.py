"""Problem 7: token ids of a whole corpus by a public tokenizer."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.keyed import once_per_key
from ..session import table, write_shared
from . import lexicon

#: Where the vocabulary files lie; they are never copied into the repository.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters a worker encodes at once; bounds its memory whatever the batch holds.
CHARS_AT_ONCE = 1 << 20

_shipped: dict[tuple[str, str], str] = {}
_encoders: dict[str, lexicon.Encoder] = {}


def ship_lexicon(spark: SparkSession, vocabulary: str) -> str:
    """Compile the lexicon of a rank file once and give it to every executor; the file's name there."""
    key = (spark.sparkContext.applicationId, vocabulary)
    if key not in _shipped:
        ranks = lexicon.load_ranks(vocabulary)
        automaton = lexicon.build({w: lexicon.merge(w, ranks) for w in lexicon.frequent_words(ranks)})
        name = f"{os.path.basename(vocabulary)}.{uuid.uuid4().hex}.fst"
        spark.sparkContext.addFile(write_shared(spark, name, lexicon.dump(automaton)))
        spark.sparkContext.addFile(vocabulary)
        _shipped[key] = name
    return _shipped[key]


def encoder_of(name: str, vocabulary: str) -> lexicon.Encoder:
    """The worker's encoder, made once; its lexicon is mapped from the shipped file."""
    if name not in _encoders:
        ranks = lexicon.load_ranks(SparkFiles.get(os.path.basename(vocabulary)))
        _encoders[name] = lexicon.Encoder(lexicon.Lexicon(SparkFiles.get(name)), ranks)
    return _encoders[name]


def by_size(texts: list[str | None], most: int = CHARS_AT_ONCE) -> Iterator[slice]:
    """Slices of the list whose texts have at most ``most`` characters, or one text each."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > start and size + n > most:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


def encode(documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids)``: the token ids of every text, without special tokens.

    Words of the vocabulary are compiled into a minimal acyclic transducer that workers map into
    memory; any other pre-token is merged exactly by the ranks and remembered by the worker.
    Strings that look like special tokens are ordinary text. Null and empty texts give an empty
    array; repeated keys come once; rows with a null key are dropped; other columns are not read.
    One pass, no shuffle.
    """
    name = ship_lexicon(documents.sparkSession, vocabulary)
    rows = once_per_key(documents.select(key, text), key)
    schema = T.StructType([rows.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(name, vocabulary)
        for batch in batches:
            keys, texts = batch.column(key), batch.column(text).to_pylist()
            for part in by_size(texts):
                ids, counts = encoder.encode(texts[part])
                offsets = pa.array([0, *counts.cumsum().tolist()], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(part.start, part.stop - part.start), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], [key, "ids"]
                )

    return rows.select(key, text).mapInArrow(run, schema)


def token_counts(documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens)`` by the same encoder, without making the ids; null and empty texts have 0."""
    name = ship_lexicon(documents.sparkSession, vocabulary)
    rows = once_per_key(documents.select(key, text), key)
    schema = T.StructType([rows.schema[key], T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(name, vocabulary)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            n = [c for part in by_size(texts) for c in encoder.counts(texts[part]).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n, pa.int64())], [key, "n_tokens"])

    return rows.select(key, text).mapInArrow(run, schema)


def vocabulary_path() -> str:
    """The rank file of byte_bpe_50k."""
    return os.path.join(TOKENIZERS, VOCABULARY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p7_ids": lambda spark, d: encode(table(spark, d, "documents"), vocabulary_path()),
}
SQL: dict[str, str] = {}
