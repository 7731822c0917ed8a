"""Problem 5: statistics that tell prose from lists, tables and junk."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.keyed import once_per_key
from ..session import table
from .encoding import by_size
from .kinds import _END, clean, kinds
from .repetition import measure
from .words import words_of

#: The list of common words is fixed and small; more than this is another table by mistake.
MOST_COMMON_WORDS = 100_000
SHARES = ("prose_share", "list_share", "table_share", "junk_share")
REPEATED = ("line_share", "paragraph_share", "phrase_share")
STATISTICS = ("n_chars", "n_words", "mean_word_length", "symbol_ratio", "ended_line_share", "common_word_share", *SHARES, *REPEATED)


#: From these shares a text is filler: one phrase covers most of it, and hardly any word is a common one.
FILLER_PHRASE, FILLER_COMMON = 0.5, 0.05


def judge(stats: dict[str, float]) -> str:
    """The kind of a text from its statistics: combined rules over the shares of its characters, its words and its repetition.

    A kind other than prose needs the larger part. What is left as prose but has overlong words,
    next to no common words and many symbols is no prose either, nor is filler: words without any
    common ones among them, most of which belong to one phrase that is repeated. Prose that repeats
    itself has common words and stays prose.
    """
    other = max(SHARES[1:], key=lambda s: stats[s])
    if stats["prose_share"] * 2 < 1:
        return other.split("_")[0]
    rare = stats["common_word_share"] < FILLER_COMMON
    if stats["n_words"] and rare and stats["mean_word_length"] > 20 and stats["symbol_ratio"] > 0.15:
        return "junk"
    if rare and stats["phrase_share"] >= FILLER_PHRASE:
        return "junk"
    return "prose"


def statistics(text: str, common: frozenset[str]) -> dict[str, float]:
    """Statistics of one text but for its repetition."""
    sizes = {"text": 0, "list": 0, "table": 0, "junk": 0}
    solid = ended = 0
    for line, kind in kinds(text):
        if kind != "blank":
            sizes[kind] += len(line.strip())
            solid += 1
            ended += bool(_END.search(line.rstrip()[-6:]))
    total = sum(sizes.values()) or 1
    words = words_of(clean(text))
    dense = text.replace(" ", "").replace("\n", "")
    letters = sum(map(len, words))
    return {
        "n_chars": len(text), "n_words": len(words), "mean_word_length": letters / len(words) if words else 0.0,
        "symbol_ratio": max(0.0, 1 - letters / len(dense)) if dense else 0.0, "ended_line_share": ended / solid if solid else 0.0,
        "common_word_share": sum(w in common for w in words) / len(words) if words else 0.0,
        **dict(zip(SHARES, (sizes[k] / total for k in ("text", "list", "table", "junk")), strict=True)),
    }


def profile(chunks: DataFrame, common_words: DataFrame, key: str = "chunk_index", text: str = "text") -> DataFrame:
    """Each record once: ``key``, its ``kind`` and the statistics of its text.

    ``prose_share``, ``list_share``, ``table_share`` and ``junk_share`` are shares of characters by
    the kind of line (see :mod:`.kinds`); ``line_share`` and ``paragraph_share`` are shares of
    characters in repeated lines and paragraphs, ``phrase_share`` is the share of letters and digits
    that the dominant run of three words covers. Null and blank texts have a null kind and zeros.
    Rows with a null key are dropped; other columns are not read. One pass, no shuffle.
    """
    words = [r[0] for r in common_words.select("word").distinct().limit(MOST_COMMON_WORDS + 1).collect()]
    if len(words) > MOST_COMMON_WORDS:
        raise ValueError("the table of common words is too large to be one")
    common = frozenset(w.lower() for w in words if w)
    rows = once_per_key(chunks.select(key, text), key)
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, kind string, " + ", ".join(f"{s} {'long' if s.startswith('n_') else 'double'}" for s in STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column(text).to_pylist(), batch.column(key)
            for part in by_size(texts):
                repeated = measure(texts[part], every=True)
                found, judged = [], []
                for i, value in enumerate(texts[part]):
                    found.append(statistics(value or "", common) | {s: float(repeated[s][i]) for s in REPEATED})
                    judged.append(judge(found[-1]) if value and clean(value).strip() else None)
                columns = [pa.array(judged, pa.string())]
                columns += [pa.array([f[s] for f in found], pa.int64() if s.startswith("n_") else pa.float64()) for s in STATISTICS]
                yield pa.RecordBatch.from_arrays([keys.slice(part.start, part.stop - part.start), *columns], [key, "kind", *STATISTICS])

    return rows.select(key, text).mapInArrow(run, schema)


def _profile(spark: SparkSession, d: str) -> DataFrame:
    return profile(table(spark, d, "chunks"), table(spark, d, "common_words"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p5_found": lambda spark, d: _profile(spark, d).filter("kind <> 'prose'").selectExpr("cast(chunk_index as long) as chunk_index", "kind"),
    "p5_statistics": _profile,
}
SQL: dict[str, str] = {}
