"""Words of texts as arrays of numbers, for measures and signatures on runs of words."""

from __future__ import annotations

import re

import numpy as np

#: A word is a run of letters and digits.
_FIND = re.compile(r"[^\W_]+").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)
MOST_REMEMBERED = 1_000_000


class WordNumbers(dict):
    """A 64-bit number for each word; the same word has the same number in every process."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > MOST_REMEMBERED:
            self.clear()
        number = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return number


_numbers = WordNumbers()


def words_of(text: str | None) -> list[str]:
    """The text's words, in lower case."""
    return _FIND(text.lower()) if text else []


def numbered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all words, one text after the other, and the number of each text's words."""
    known, out, counts = _numbers, [], []
    for text in texts:
        words = _FIND(text.lower()) if text else []
        out.extend([known[w] for w in words])
        counts.append(len(words))
    return np.array(out, np.uint64), np.array(counts, np.int64)


def lengths_of(texts: list[str | None]) -> np.ndarray:
    """The length of each word, in the order of :func:`numbered`."""
    return np.array([len(w) for text in texts if text for w in _FIND(text.lower())], np.int64)


def run_places(counts: np.ndarray, n: int) -> np.ndarray:
    """The place of the first word of each run of ``n`` words of one text, in the order of :func:`runs`."""
    per_text = np.maximum(counts - n + 1, 0)
    starts = np.cumsum(counts) - counts
    return np.arange(per_text.sum()) + np.repeat(starts - (np.cumsum(per_text) - per_text), per_text)


def runs(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each run of ``n`` consecutive words, and the number of each text's runs.

    The numbers of runs are 64-bit mixes of their words', in order.
    """
    per_text = np.maximum(counts - n + 1, 0)
    if not per_text.sum():
        return np.zeros(0, np.uint64), per_text
    total = len(words) - n + 1
    mixed = np.zeros(total, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            mixed = (mixed ^ words[k : k + total]) * _MIX
            mixed ^= mixed >> np.uint64(29)
    return mixed[run_places(counts, n)], per_text
