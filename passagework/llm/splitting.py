"""Problem 6: oversized items cut into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: Characters of a piece with its title, tokens of a piece, characters repeated from the piece before.
MOST_CHARS, MOST_TOKENS, OVERLAP = 900, 256, 160
LEVELS = ("paragraph", "line", "sentence", "word")
_TRIM = " \t\r\n"
_SOLID = re.compile(r"[^ \t\r\n]")
#: What lies between two units of a level; a unit ends where the match starts.
_BETWEEN = {
    "paragraph": re.compile(r"\n(?:[ \t]*\n)+"),
    "line": re.compile(r"\n"),
    "sentence": re.compile(r"\n|(?<=[.!?])[ \t]+"),
    "word": re.compile(r"[ \t\r\n]+"),
}


def room_of(text: Column, title: Column, tokens: Column, most: int = MOST_CHARS, most_tokens: int = MOST_TOKENS) -> Column:
    """Characters that a piece of the item may have."""
    titled = F.when(title.rlike(r"(?U)\S"), F.length(title) + 2).otherwise(0)
    by_tokens = F.when(tokens > most_tokens, F.floor(F.length(text).cast("long") * most_tokens / tokens).cast("int"))
    return F.greatest(F.lit(1), F.least(F.lit(most) - titled, F.coalesce(by_tokens, F.lit(most))))


def boundaries(text: str) -> dict[str, tuple[list[int], list[int]]]:
    """For each level the sorted offsets at which its units end and at which they start."""
    found = {}
    for level in LEVELS:
        gaps = [m.span() for m in _BETWEEN[level].finditer(text)]
        found[level] = [a for a, _ in gaps] + [len(text)], [0] + [b for _, b in gaps]
    return found


def level_of(text: str, room: int, offsets: dict[str, tuple[list[int], list[int]]]) -> str:
    """The first level at which every unit, trimmed, fits the room, by the offsets of its boundaries."""
    for level in LEVELS:
        ends, starts = offsets[level]
        # trimming is needed only where the untrimmed unit doesn't fit
        if all(b - a <= room or len(text[a:b].strip(_TRIM)) <= room for a, b in zip(starts, ends, strict=True)):
            return level
    return "hard"


def split(text: str, room: int, overlap: int = OVERLAP) -> tuple[str, list[tuple[int, int, int]]]:
    """The text's cut level and its pieces ``(start, end, repeated)``.

    The ends and starts of the units of all levels are sorted arrays of offsets, from which the cut
    level follows (:func:`level_of`). From a start, the last unit end within the room is found by
    binary search in the levels down to the cut level, coarse ones first if they fill half of the
    room; without any, the cut is hard. The next start steps back by at most ``overlap``
    characters, to the first unit start in that stretch, or exactly by ``overlap`` if there is none
    and the cut is hard. Pieces don't begin or end with blanks, are at most ``room`` long, and each
    ends further than the one before. Offsets only are moved, so the time is in proportion to the text.
    """
    offsets = boundaries(text)
    level = level_of(text, room, offsets)
    used = LEVELS[: LEVELS.index(level) + 1] if level in LEVELS else LEVELS
    ends = {x: offsets[x][0] for x in used}
    starts = sorted({s for x in LEVELS for s in offsets[x][1][1:]})
    overlap = min(overlap, room // 2)
    finish = len(text.rstrip(_TRIM))

    def solid(at: int) -> int:
        """The first place from ``at`` on that isn't blank."""
        found = _SOLID.search(text, at)
        return found.start() if found else len(text)

    pieces, start, done = [], solid(0), 0
    while done < finish:
        limit = min(start + room, finish)
        end = 0
        if limit == finish:
            end = finish
        else:
            for least in (max(done, start + room // 2), done):
                for x in used:
                    at = bisect_right(ends[x], limit) - 1
                    if at >= 0 and ends[x][at] > least and solid(done) < ends[x][at]:
                        end = ends[x][at]
                        break
                if end:
                    break
        end = end or limit
        end = start + len(text[start:end].rstrip(_TRIM))
        if end <= done:  # nothing but blanks follows within the limit
            start = done = solid(done)
            continue
        pieces.append((start, end, max(0, done - start) if pieces else 0))
        done = end
        after = solid(done)
        at = bisect_left(starts, done - overlap)
        back = starts[at] if at < len(starts) and starts[at] < done else (done - overlap if after == done else after)
        # the unit that follows must still fit behind what is repeated
        following = [ends[x][bisect_right(ends[x], after)] for x in used[-1:] if bisect_right(ends[x], after) < len(ends[x])]
        need = (following[0] if following and level in LEVELS else after + 1) - room
        start = max(back, start + 1)
        if start < need:
            at = bisect_left(starts, need)
            start = starts[at] if at < len(starts) and starts[at] <= after else after
        start = solid(start)
    return level, pieces


def pieces(items: DataFrame, key: str = "chunk_index", text: str = "text", title: str = "section_title", tokens: str = "token_count",
           most: int = MOST_CHARS, most_tokens: int = MOST_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """``(key, cut_level, piece, start, end, repeated, text)`` of every oversized item, once each.

    An item's room is ``most`` less its title and 2, and for more than ``most_tokens`` tokens also
    at most ``length * most_tokens / tokens``; it is oversized if its text is longer. Sizes are
    compared before any text leaves the JVM. Null texts, titles and token counts (and stale ones
    of 0) are no reason to be oversized; rows with a null key are dropped; a repeated key comes
    once; an empty table gives no rows. No title leaves less than one character of room.
    """
    room = room_of(F.col(text), F.col(title), F.col(tokens), most, most_tokens)
    large = items.filter(F.col(key).isNotNull()).select(key, text, room.alias("room")).filter(F.length(text) > F.col("room")).dropDuplicates([key])
    schema = f"{key} {items.schema[key].dataType.simpleString()}, cut_level string, piece int, start int, end int, repeated int, text string"

    kinds = {"cut_level": pa.string(), "piece": pa.int32(), "start": pa.int32(), "end": pa.int32(), "repeated": pa.int32(), "text": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for at, (value, space) in enumerate(zip(batch.column(text).to_pylist(), batch.column("room").to_pylist(), strict=True)):
                level, cuts = split(value, space, overlap)
                # a text of blanks only is one empty piece
                rows.extend((at, level, i, a, b, again, value[a:b]) for i, (a, b, again) in enumerate(cuts or [(0, 0, 0)]))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], kinds.values(), strict=True))], [key, *kinds]
            )

    return large.mapInArrow(run, schema)


def found(spark: SparkSession, d: str) -> DataFrame:
    """p6_found: every oversized record with its cut level."""
    return pieces(table(spark, d, "chunks")).filter("piece = 0").select(F.col("chunk_index").cast("long").alias("chunk_index"), "cut_level")


_ROOM = """greatest(1, least(900 - CASE WHEN section_title IS NOT NULL AND trim(section_title, ' ' || chr(9) || chr(10) || chr(13)) <> '' THEN length(section_title) + 2 ELSE 0 END,
    CASE WHEN token_count > 256 THEN CAST(floor(length(text) * 256.0 / token_count) AS INTEGER) ELSE 900 END))"""
_FITS = "coalesce(list_max(list_transform({parts}, lambda u: length(trim(u, ' ' || chr(9) || chr(10) || chr(13))))), 0) <= room"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p6_found": found,
    "p6_pieces": lambda spark, d: pieces(table(spark, d, "chunks")),
}
SQL: dict[str, str] = {
    "p6_found": f"""WITH once AS (SELECT DISTINCT chunk_index, text, {_ROOM} AS room FROM chunks WHERE chunk_index IS NOT NULL),
        large AS (SELECT * FROM once WHERE length(text) > room)
        SELECT CAST(chunk_index AS BIGINT) AS chunk_index, CASE
            WHEN {_FITS.format(parts=r"regexp_split_to_array(text, '\n([ \t]*\n)+')")} THEN 'paragraph'
            WHEN {_FITS.format(parts="string_split(text, chr(10))")} THEN 'line'
            WHEN {_FITS.format(parts=r"string_split(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10))")} THEN 'sentence'
            WHEN {_FITS.format(parts=r"regexp_split_to_array(text, '[ \t\r\n]+')")} THEN 'word' ELSE 'hard' END AS cut_level
        FROM large""",
}
