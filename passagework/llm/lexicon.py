"""A minimal acyclic transducer from words to token ids, memory-mapped, with exact merging beside it.

The automaton is built from sorted words by the incremental algorithm: states whose outgoing
edges are equal are one state, so prefixes and suffixes are shared. A word's number is the sum
of the skip counts along its path; the number indexes the list of its token ids.
"""

from __future__ import annotations

import base64
import os
from heapq import heapify, heappop, heappush

import numpy as np
import regex

#: The pre-token pattern of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens a worker remembers before it starts afresh.
MOST_REMEMBERED = 400_000
_PARTS = ("first", "labels", "targets", "skips", "final", "offsets", "ids")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file (one base64 token and its rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a pre-token: the adjacent pair of lowest rank, the leftmost first, is merged until none is left.

    Parts are linked by their positions and the pairs that can be merged wait in a heap, so that a
    run of n letters takes n log n steps. A pair whose parts have changed meanwhile is passed over.
    """
    n, rank_of = len(word), ranks.get
    stop = list(range(1, n + 1))  # where the part that starts here ends; 0 if none starts here any more
    before = list(range(-1, n))  # where the part before the one that starts here starts
    waiting = [(r, i) for i in range(n - 1) if (r := rank_of(word[i : i + 2])) is not None]
    heapify(waiting)
    while waiting:
        rank, i = heappop(waiting)
        middle = stop[i]
        if not middle or middle == n or rank_of(word[i : stop[middle]]) != rank:
            continue
        end = stop[i] = stop[middle]
        stop[middle] = 0
        before[end] = i
        if end < n and (r := rank_of(word[i : stop[end]])) is not None:
            heappush(waiting, (r, i))
        left = before[i]
        if left >= 0 and (r := rank_of(word[left:end])) is not None:
            heappush(waiting, (r, left))
    return [ranks[word[i:e]] for i, e in enumerate(stop) if e]


def frequent_words(ranks: dict[bytes, int]) -> list[bytes]:
    """Entries of the vocabulary that are whole pre-tokens: the words its makers found frequent."""
    whole = regex.compile(PATTERN)
    words = []
    for token in ranks:
        try:
            text = token.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if whole.fullmatch(text):
            words.append(token)
    return words


def build(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """The minimal automaton of ``words``, as flat arrays (see ``_PARTS``)."""
    edges: list[dict[int, int]] = [{}]
    final: list[bool] = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # (parent, label, child) of the last word, not yet minimal
    last = b""
    ordered = sorted(words)

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, label, child = path.pop()
            key = (final[child], *sorted(edges[child].items()))
            edges[parent][label] = register.setdefault(key, child)

    for word in ordered:
        common = len(os.path.commonprefix([word, last]))
        settle(common)
        state = path[-1][2] if path else 0
        for label in word[common:]:
            edges.append({})
            final.append(False)
            path.append((state, label, len(edges) - 1))
            edges[state][label] = state = len(edges) - 1
        final[state] = True
        last = word
    settle(0)

    number, order, stack = {0: 0}, [0], [0]
    while stack:
        for child in (c for _, c in sorted(edges[stack.pop()].items())):
            if child not in number:
                number[child] = len(order)
                order.append(child)
                stack.append(child)
    below: dict[int, int] = {}

    def count(state: int) -> int:
        if state not in below:
            below[state] = int(final[state]) + sum(count(c) for c in edges[state].values())
        return below[state]

    first, labels, targets, skips = [0], [], [], []
    for state in order:
        before = int(final[state])
        for label, child in sorted(edges[state].items()):
            labels.append(label)
            targets.append(number[child])
            skips.append(before)
            before += count(child)
        first.append(len(labels))
    ids = [words[w] for w in ordered]
    return {
        "first": np.array(first, np.int32), "labels": np.array(labels, np.uint8), "targets": np.array(targets, np.int32),
        "skips": np.array(skips, np.int32), "final": np.array([final[s] for s in order], np.uint8),
        "offsets": np.cumsum([0, *map(len, ids)]).astype(np.int32), "ids": np.array([i for x in ids for i in x], np.int32),
    }


def dump(automaton: dict[str, np.ndarray]) -> bytes:
    """The arrays' lengths, then the arrays, each at a multiple of eight bytes."""
    parts = [np.array([automaton[p].nbytes for p in _PARTS], np.int64).tobytes()]
    for p in _PARTS:
        parts += [automaton[p].tobytes(), b"\0" * (-automaton[p].nbytes % 8)]
    return b"".join(parts)


class Lexicon:
    """The automaton, mapped into memory: all workers of a machine share its pages."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, np.uint8, "r")
        sizes, at = data[: 8 * len(_PARTS)].view(np.int64), 8 * len(_PARTS)
        for name, size in zip(_PARTS, sizes.tolist(), strict=True):
            kind = np.uint8 if name in ("labels", "final") else np.int32
            setattr(self, "_" + name, data[at : at + size].view(kind))
            at += size + -size % 8

    def __len__(self) -> int:
        return len(self._offsets) - 1

    def number(self, word: bytes) -> int:
        """The word's place among the sorted words, or -1."""
        state = place = 0
        first, labels = self._first, self._labels
        for label in word:
            low, high = int(first[state]), int(first[state + 1])
            at = low + int(np.searchsorted(labels[low:high], label))
            if at == high or labels[at] != label:
                return -1
            place += int(self._skips[at])
            state = int(self._targets[at])
        return place if self._final[state] else -1

    def ids(self, word: bytes) -> list[int] | None:
        """Its token ids, or None if it isn't in the lexicon."""
        at = self.number(word)
        return None if at < 0 else self._ids[self._offsets[at] : self._offsets[at + 1]].tolist()


class Encoder:
    """Token ids of texts: lexicon words through the automaton, all others by exact merges."""

    def __init__(self, lexicon: Lexicon, ranks: dict[bytes, int]) -> None:
        self.lexicon, self.ranks, self.find = lexicon, ranks, regex.compile(PATTERN).findall
        self._forget()

    def _forget(self) -> None:
        encoder = self

        class Codes(dict):
            def __missing__(self, word: str) -> int:
                code = self[word] = len(encoder._lengths)
                raw = word.encode("utf-8", "surrogatepass")
                ids = encoder.lexicon.ids(raw)
                ids = merge(raw, encoder.ranks) if ids is None else ids
                encoder._lengths.append(len(ids))
                encoder._flat.extend(ids)
                return code

        self._codes, self._lengths, self._flat, self._table = Codes(), [], [], None

    def codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all pre-tokens, one text after the other, and the number of each text's pre-tokens."""
        if len(self._codes) > MOST_REMEMBERED:
            self._forget()
        known, out, counts = self._codes, [], []
        for text in texts:
            words = self.find(text) if text else []
            out.extend([known[w] for w in words])
            counts.append(len(words))
        if self._table is None or len(self._table[0]) != len(self._lengths):
            lengths = np.array(self._lengths, np.int64)
            self._table = (lengths, np.cumsum(lengths) - lengths, np.array(self._flat, np.int32))
        return np.array(out, np.int64), np.array(counts, np.int64)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """The number of tokens of each text."""
        codes, words = self.codes(texts)
        total = np.concatenate([[0], np.cumsum(self._table[0][codes] if len(codes) else [])]).astype(np.int64)
        ends = np.cumsum(words)
        return total[ends] - total[ends - words]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, one after the other, and the number of each text's tokens."""
        codes, words = self.codes(texts)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        lengths, starts, flat = self._table
        each = lengths[codes]
        total = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.arange(total[-1]) + np.repeat(starts[codes] - total[:-1], each)]
        ends = np.cumsum(words)
        return ids, total[ends] - total[ends - words]
