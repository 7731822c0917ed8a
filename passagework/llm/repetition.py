"""Problem 9: repetition inside a single document, judged by weak supervision."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import once_per_key
from ..session import materialize, table
from .encoding import by_size
from .words import lengths_of, numbered, run_places, runs

#: Words of a run, words a text needs, and the repeated share of runs from which a text counts as repetitive.
RUN, LEAST_WORDS, LEAST_SHARE = 5, 30, 0.25
MEASURES = ("run_share", "triple_share", "word_share", "line_share", "paragraph_share", "sentence_share", "phrase_share")
#: Each rule's measure, and the values from which it votes "repetitive" and up to which it votes "not". The share that
#: defines the cases is none of them: it is computed for what the posterior keeps.
RULES = (("triple_share", 0.2, 0.08), ("word_share", 0.9, 0.5), ("line_share", 0.3, 0.05), ("paragraph_share", 0.3, 0.0), ("sentence_share", 0.3, 0.05), ("phrase_share", 0.12, 0.03))
ABSTAIN = -1
#: The posterior probability from which a text is kept. Low, since a text that is kept for nothing is only counted exactly.
LEAST_POSTERIOR = 0.05
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_PARAGRAPH = re.compile(r"\n\s*\n")


def repeated_share(parts: list[str], least: int = 1) -> float:
    """Share of characters in parts that stood earlier; null for fewer than ``least`` parts, 0 for no part."""
    parts = [p for p in map(str.strip, parts) if p]
    if len(parts) < least:
        return float("nan")
    total = sum(map(len, parts))
    return 1 - sum(map(len, set(parts))) / total if parts else 0.0


def measure(texts: list[str | None], every: bool = False) -> dict[str, np.ndarray]:
    """The measures of each text; NaN where a text is too short for one, unless ``every`` text is to have them."""
    words, counts = numbered(texts)
    out = {"n_words": counts}
    enough = counts >= (1 if every else LEAST_WORDS)
    empty = 0.0 if every else np.nan
    for n, name in ((RUN, "run_share"), (1, "word_share"), (3, "triple_share")):
        hashes, per_text = runs(words, counts, n)
        owner = np.repeat(np.arange(len(texts)), per_text)
        with np.errstate(over="ignore"):
            mixed = hashes * np.uint64(2 * 0x5851F42D4C957F2D % 2**64 + 1) + owner.astype(np.uint64) * np.uint64(0x14057B7EF767814F)
        order = np.argsort(mixed)
        ordered, owners = mixed[order], owner[order]
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        repeated = per_text - np.bincount(owners[new], minlength=len(texts))
        out[name] = np.where(enough, repeated / np.maximum(per_text, 1), empty)
        if name == "run_share":
            out["n_runs"], out["n_repeated"] = per_text, repeated
    out["phrase_share"] = np.where(enough, _dominant(texts, counts, np.flatnonzero(new), ordered, owners, order), empty)
    out["line_share"] = np.array([repeated_share((t or "").split("\n"), 0 if every else 4) for t in texts])
    out["paragraph_share"] = np.array([repeated_share(_PARAGRAPH.split(t or ""), 0 if every else 3) for t in texts])
    out["sentence_share"] = np.array([repeated_share(_SENTENCE.split(t or ""), 0 if every else 4) for t in texts])
    return out


def _dominant(texts: list[str | None], counts: np.ndarray, at: np.ndarray, ordered: np.ndarray, owners: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The share of each text's letters and digits that its commonest run of three words covers; 0 if none comes twice.

    ``ordered`` are the sorted runs, which start anew ``at`` the given places, with their texts and places.
    """
    out = np.zeros(len(texts))
    times = np.diff(np.append(at, len(ordered)))
    if not len(at) or times.max() < 2:
        return out
    lengths = lengths_of(texts)
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, owners[at], times)
    # of runs that are equally common the first in order; all of its occurrences
    best = at[(times == most[owners[at]]) & (times > 1)]
    best = best[np.unique(owners[best], return_index=True)[1]]
    size = most[owners[best]]
    inside = np.repeat(best - (np.cumsum(size) - size), size) + np.arange(size.sum())
    first = run_places(counts, 3)[order[inside]]
    covered = np.zeros(len(lengths), bool)
    for k in range(3):
        covered[first + k] = True
    text_of = np.repeat(np.arange(len(texts)), counts)
    total = np.bincount(text_of, lengths, len(texts))
    return np.bincount(text_of, lengths * covered, len(texts)) / np.maximum(total, 1)


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 100, prior: float = 0.1) -> dict[tuple[int, ...], float]:
    """Posterior probability of "repetitive" for each pattern of votes, by expectation-maximisation.

    ``patterns`` has how often each pattern occurs in the corpus. Rules are taken to vote
    independently given the class; each rule's rate of a vote given each class, and the share
    of the class, are estimated. Abstaining counts neither for nor against. A pattern in which
    all abstain has the prior.
    """
    keys = list(patterns)
    if not keys:
        return {}
    votes, weight = np.array(keys), np.array([patterns[k] for k in keys], float)
    right = np.full((2, votes.shape[1]), 0.8)  # of class 0 voting 0, and of class 1 voting 1
    for _ in range(rounds):
        with np.errstate(divide="ignore"):
            score = np.log([1 - prior, prior])[:, None] + np.zeros((2, len(keys)))
        for c in (0, 1):
            score[c] += np.where(votes == c, np.log(right[c]), np.where(votes == ABSTAIN, 0, np.log(1 - right[c]))).sum(1)
        top = score.max(0)
        share = np.exp(score - top)
        posterior = share[1] / share.sum(0)
        prior = float(np.clip((weight * posterior).sum() / weight.sum(), 1e-4, 0.5))
        for c in (0, 1):
            w = (weight * (posterior if c else 1 - posterior))[:, None] * (votes != ABSTAIN)
            right[c] = np.clip(((w * (votes == c)).sum(0) + 4) / (w.sum(0) + 5), 0.5, 0.999)
    return {k: float(p) for k, p in zip(keys, posterior, strict=True)}


def score(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each record once: its measures, each rule's vote, and the posterior probability that it is repetitive.

    ``run_share`` is the share of runs of five words, by position, whose words stood in that order
    earlier in the text, ``triple_share`` that of runs of three and ``word_share`` that of single words; ``line_share``,
    ``paragraph_share`` and ``sentence_share`` are shares of characters in repeated parts;
    ``phrase_share`` is the share of the letters and digits that the commonest run of three words covers.
    A rule votes 1 or 0 on one measure or abstains (-1) between its limits or where the text is
    too short. The number of records with each pattern of votes, at most 3^6 rows, is all that
    the estimate needs; it comes from all records. Null and empty texts have null measures and
    only abstentions. Rows with a null key are dropped; other columns are not read.
    """
    spark = documents.sparkSession
    rows = once_per_key(documents.select(key, text), key)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_words long, n_runs long, n_repeated long, " + ", ".join(f"{m} double" for m in MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column(text).to_pylist(), batch.column(key)
            for part in by_size(texts):
                found = measure(texts[part])
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(part.start, part.stop - part.start), *(pa.array(found[c], pa.int64()) for c in ("n_words", "n_runs", "n_repeated")), *(pa.array(found[m], pa.float64(), from_pandas=True) for m in MEASURES)],
                    [key, "n_words", "n_runs", "n_repeated", *MEASURES],
                )

    measured = rows.select(key, text).mapInArrow(run, schema)
    votes = [F.when(F.col(m) >= yes, 1).when(F.col(m) <= no, 0).otherwise(ABSTAIN).alias(f"vote_{m}") for m, yes, no in RULES]
    voted = materialize(measured.select("*", *votes), "measures")
    names = [f"vote_{m}" for m, _, _ in RULES]
    patterns = {tuple(r[:-1]): r[-1] for r in voted.groupBy(*names).count().collect()}
    posterior = estimate(patterns)
    table_of = spark.createDataFrame([(*k, p) for k, p in posterior.items()], ", ".join(f"{n} int" for n in names) + ", posterior double")
    return voted.join(F.broadcast(table_of), names, "left").select(key, "n_words", "n_runs", "n_repeated", *MEASURES, *names, "posterior")


def repetitive(documents: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST_POSTERIOR) -> DataFrame:
    """The scores of records that the posterior keeps and whose repeated share, counted exactly, is at least ``LEAST_SHARE``."""
    kept = score(documents, key, text).filter(F.col("posterior") >= least)
    return kept.filter((F.col("n_words") >= LEAST_WORDS) & (F.col("n_repeated") >= LEAST_SHARE * F.col("n_runs")))


def found(spark: SparkSession, d: str) -> DataFrame:
    """p9_found: what the posterior keeps, by the exact share."""
    return repetitive(table(spark, d, "documents")).select(F.col("doc_id").cast("long").alias("doc_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p9_found": found,
    "p9_scores": lambda spark, d: score(table(spark, d, "documents")),
}
SQL: dict[str, str] = {
    "p9_found": r"""WITH w AS (SELECT DISTINCT ON (doc_id) doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        r AS (SELECT doc_id, list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) AS runs FROM w WHERE len(ws) >= 30)
        SELECT doc_id FROM r WHERE len(runs) - len(list_distinct(runs)) >= 0.25 * len(runs)""",
}


def brute_force(text: str | None) -> tuple[int, int, int]:
    """Words, runs and repeated runs of a text, the plain way; for tests."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    times = Counter(tuple(words[i : i + RUN]) for i in range(len(words) - RUN + 1))
    return len(words), sum(times.values()), sum(n - 1 for n in times.values())
