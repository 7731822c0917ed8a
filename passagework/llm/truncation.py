"""Problem 4: texts cut off by field limits, found by their ends and by longer copies elsewhere."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import join_bounded, once_per_key
from ..session import materialize, table
from .kinds import _DETERMINERS, _MARK, VERBS, clean, has_verb, kinds
from .lines import normal_form

#: Blocks, parted by blank lines, in which the kind of the last line shows: its own, and those that a series of items can run through.
NEAR_BLOCKS = 3
#: Characters of sorted units in a partition on average, and characters that a map task packs at once.
PART_CHARS, PACKED_AT_ONCE = 32 << 20, 16 << 20
#: Units for each partition, and in all at most, on whose first characters the ranges of the partitions are fitted; every unit is in the join.
FIT_EACH, FIT_ON, FIT_CHARS = 64, 200_000, 96
#: Distinct records of a source in which a last line must stand to be a page line.
PAGE_LINE_RECORDS = 4
#: Words after which no line, title or item ends, in four languages.
UNFINISHED = frozenset(
    "a an the each every any some this that these those its his her their our your my no of to in on at by for from with without into onto than as "
    "and or but nor if unless until when whenever where because since while although though whether who whom whose which is are was were be been may can cannot could might must "
    "shall should will would has have does not is need ought usually normally more less upon against between within under over about per via "
    "el la los las un una unos unas del de al y o que en con sin por para su sus lo se si cuando mientras aunque ha han es son puede debe "
    "der die das den dem des ein eine einen einem einer eines und oder mit ohne von zu zum zur im am auf für bei wenn weil dass ist sind wird "
    "le les des du une et ou qui dans avec sans pour par sur si lorsque est sont".split()
)
_OMITTED = re.compile(r"\s*(?:(?:…|\.{3,}|\[(?:…|\.{3}|cut|truncated|more)\]|\((?:…|\.{3})\)|�|»)\s*)+$")
_ENDED = re.compile(r"[.!?][\"”’'»)\]]*$|[\"”»]$|[.!?]\s*[—–-]$")
_SENTENCE = re.compile(r"[.!?][\"”’'»)\]]*\s+")
_UNIT = re.compile(r"\n|(?<=[.!?])[\"”’'»)\]]*[ \t]+")
_SIGNS = str.maketrans(dict.fromkeys('.,;:!?()[]"“”«»|·—–', " "))
#: The last word, if it is one by itself and no part of a sign such as "n/a".
_LETTERS = re.compile(r"""(?<![^\s,;:|(\["'“‘«¿¡•])[^\W\d_]+(?:['’-][^\W\d_]+)*$""")


def examine(text: str | None) -> tuple[str, str, str, str]:
    """What the end of a text looks like: ``(state, line, tail, word)``.

    ``state`` is ``whole``; ``marked``, if a mark of omission stands for the rest; ``running``,
    if a sentence of running text has no end; or ``open``, if the last line can also be a title,
    an item or a page line. A ``whole`` item or table row that ends in a word has its ``word`` too:
    it is complete without a stop, unless it stops inside a word. ``line`` is the last line, ``tail`` what follows the last end of a
    sentence in it, and ``word`` the last word if the text ends in one.
    """
    bare = (text or "").rstrip()
    end = clean(bare[-60:]).rstrip()
    if end and not _OMITTED.search(end) and _ENDED.search(end[-8:]):
        return "whole", "", "", ""
    # what stands before the last blocks doesn't bear on the kind of the last line
    lines = bare.split("\n")
    first, blocks = len(lines), 0
    while first and blocks < NEAR_BLOCKS:
        first -= 1
        blocks += first == 0 or bool(lines[first].strip() and not lines[first - 1].strip())
    body = clean("\n".join(lines[first:])).rstrip()
    mark = _OMITTED.search(body)
    bare = body[: mark.start()] if mark else body
    if not bare.strip() or (not mark and _ENDED.search(bare[-8:])):
        return "whole", "", "", ""
    by_line = kinds(bare)
    while by_line and by_line[-1][1] == "blank":
        by_line.pop()
    line, kind = by_line[-1]
    line = line.strip()
    if kind == "junk":
        return "whole", line, "", ""
    word = _LETTERS.search(line)
    word = word[0] if word else ""
    if kind == "table":
        return "whole", line, line, word
    if mark and (kind == "text" or not _MARK.match(line)):
        return "marked", line, line, word
    if _ENDED.search(line):
        return "whole", line, "", ""
    before = by_line[-2] if len(by_line) > 1 else ("", "blank")
    tail = _SENTENCE.split(line)[-1]
    if kind == "list":
        return ("whole" if _MARK.match(line) or line.endswith(";") or re.search(r"\([a-z]{1,5}\)\s", line) else "open"), line, tail, word
    if tail != line:
        return "running", line, tail, word
    wrapped = before[1] == "text" and not _ENDED.search(before[0].strip()) and (line[0].islower() or before[0].rstrip().endswith((",", "-")) or len(before[0]) > 45 and before[0].strip().split()[-1].lower() in UNFINISHED)
    if wrapped:
        return "running", line, tail, word
    words = line.lower().split()
    verb = has_verb(words) and not line.endswith(":")
    return ("running" if verb and len(words) > 3 else "open"), line, tail, word


def unfinished(line: str, word: str) -> bool:
    """Whether nothing can end after the last word, as it isn't a noun after a determiner ("in the will")."""
    low = word.lower()
    if low not in UNFINISHED:
        return False
    before = line.lower().split()[-2:-1]
    return not (low in VERBS and before and before[0] in _DETERMINERS)


def _examined(values: DataFrame) -> DataFrame:
    """Ends that need a second look, and beside them the words of all texts, from one pass.

    Rows with a ``state`` are values; rows without one count the texts in which a word stands
    between blanks and signs, or, without a word, the characters of the texts. The last word of a
    text counts only if the text has an end.
    """
    schema = "origin string, record_id long, source string, state string, line string, tail string, word string, unfinished long, n long"
    names = [f.split()[0] for f in schema.split(", ")]

    def rows_of(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in ("record_id", "unfinished", "n") else pa.string()) for n, c in zip(names, columns, strict=True)], names)

    def counted(seen: Counter[str | None]) -> pa.RecordBatch:
        nothing = [None] * len(seen)
        return rows_of([nothing, nothing, nothing, nothing, nothing, nothing, list(seen), nothing, list(seen.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str | None] = Counter()
        for batch in batches:
            rows = []
            for origin, record, source, text in zip(*(batch.column(c).to_pylist() for c in ("origin", "record_id", "source", "text")), strict=True):
                if not text:
                    continue
                seen[None] += len(text)
                words = text.lower().translate(_SIGNS).split()
                ended = _ENDED.search(text[-60:].rstrip()[-8:])
                seen.update(set(words if ended else words[:-1]))
                state, line, tail, word = examine(text)
                if state == "whole" and word:
                    state = "item"
                if state != "whole":
                    rows.append((origin, record, source, state, line, tail, word, int(unfinished(line, word)), 1))
            if rows:
                yield rows_of(list(zip(*rows, strict=True)))
            if len(seen) > 200_000:
                yield counted(seen)
                seen.clear()
        yield counted(seen)

    return values.select("origin", "record_id", "source", "text").mapInArrow(run, schema)


def units_of(text: str) -> list[str]:
    """Every line, cut into sentences."""
    return [u for u in _UNIT.split(clean(text)) if u]


def prefix_counts(units: list[str], times: list[int], tail: str) -> tuple[int, int, int]:
    """``(longer, equal, inside)`` of a tail among sorted distinct units that come so many times.

    ``equal`` counts units that are the tail, but for blanks; ``longer`` is 1 if some unit goes on
    with more than digits and blanks, ``inside`` if some unit goes on with a letter. The units that
    start with the tail are one stretch, in which those with equal next characters are passed at once.
    """
    at, end = bisect_left(units, tail), bisect_left(units, tail + "\U0010ffff")
    equal = longer = inside = 0
    while at < end:
        rest = units[at][len(tail) :]
        if not rest.strip():
            equal += times[at]
            at += 1
        elif rest[0].isdigit() or rest[0].isspace():
            # a longer number is no longer copy
            if not longer and any(not (c.isdigit() or c.isspace()) for c in rest):
                longer = 1
            if longer and not rest[0].isspace():
                at = bisect_left(units, tail + chr(ord(rest[0]) + 1), at, end)
            elif longer:
                # only what is equal but for blanks is still of interest
                word = len(rest) - len(rest.lstrip())
                at = bisect_left(units, tail + rest[:word] + "\U0010ffff", at, end)
            else:
                at += 1
        else:
            longer = 1
            inside |= rest[0].isalpha()
            at = bisect_left(units, tail + chr(ord(rest[0]) + 1), at, end)
    return longer, equal, inside


def _sorted_copies(texts: DataFrame, tails: DataFrame, chars: int) -> DataFrame:
    """``(tail, longer, equal, inside)``: the self-join by prefix, by sorting.

    Units of all texts are sorted: those that a tail is a prefix of follow it. The ranges of the
    partitions are fitted on a bounded sample of units, so that they are about even whatever the
    units start with. A map task sorts its units, counts equal ones, and packs those of a partition
    in one row, so that a line which stands in a third of all records moves once for each task. A
    tail goes to every partition that its stretch of units touches, and what those found is added up.
    Nothing is broadcast but the bounds of the ranges.
    """
    spark = texts.sparkSession

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [u[:FIT_CHARS] for t in batch.column("text").to_pylist() for u in units_of(t)]
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.string())], ["unit"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART_CHARS))
    every = max(1, chars // (min(FIT_ON, FIT_EACH * parts) * FIT_CHARS))
    some = texts.filter(F.pmod(F.xxhash64("chunk_index"), F.lit(every)) == 0).select("text")
    values = sorted(set(some.mapInArrow(sampled, "unit string").limit(FIT_ON).toArrow().column("unit").to_pylist()))
    bounds = sorted({values[i * len(values) // parts] for i in range(1, parts)}) if values else []
    parts = len(bounds) + 1

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            units = sorted(seen)
            cuts = [0, *(bisect_left(units, b) for b in bounds), len(units)]
            rows = [(p, "\n".join(units[i:j]), [seen[u] for u in units[i:j]]) for p, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if i < j]
            seen.clear()
            a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.string()), pa.array(c, pa.list_(pa.int32())), pa.nulls(len(rows), pa.string())], ["part", "units", "times", "tail"])

        size = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(units_of(text))
                size += len(text)
                if size > PACKED_AT_ONCE:
                    yield flush()
                    size = 0
        yield flush()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, t) for t in batch.column("tail").to_pylist() for p in range(bisect_right(bounds, t), bisect_right(bounds, t + "\U0010ffff") + 1)]
            a, b = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.nulls(len(a), pa.string()), pa.nulls(len(a), pa.list_(pa.int32())), pa.array(b, pa.string())], ["part", "units", "times", "tail"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        asked: list[str] = []
        for batch in batches:
            for units, times, tail in zip(*(batch.column(c).to_pylist() for c in ("units", "times", "tail")), strict=True):
                if tail is None:
                    for unit, n in zip(units.split("\n"), times, strict=True):
                        seen[unit] += n
                else:
                    asked.append(tail)
        units = sorted(seen)
        times = [seen[u] for u in units]
        rows = [(t, *prefix_counts(units, times, t)) for t in asked]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["tail", "longer", "equal", "inside"])

    kind = "part int, units string, times array<int>, tail string"
    both = texts.select("text").mapInArrow(packed, kind).unionByName(tails.select("tail").mapInArrow(placed, kind))
    counts = both.repartitionById(parts, "part").mapInArrow(joined, "tail string, longer long, equal long, inside long")
    return counts.groupBy("tail").agg(*[F.sum(c).alias(c) for c in ("longer", "equal", "inside")])


def find(chunks: DataFrame, snippets: DataFrame) -> DataFrame:
    """``(origin, record_id, source, cause, copied)`` of every value that was cut off.

    ``chunks`` has chunk_index, text and source_document; ``snippets`` has source_id, snippet and
    doc. The end of each value that isn't plainly whole is examined (:func:`examine`) and goes
    through the self-join by prefix: every line and sentence of the chunks is sorted, with the
    tails of the values, and so it shows which tails are strict prefixes of longer copies elsewhere
    and which are whole lines elsewhere (:func:`_sorted_copies`). Then

    * a mark of omission shows a cut value;
    * a last line that stands in several records of the same source is a page line and whole;
    * a tail that has longer copies and is nowhere a whole line is cut; an item or a table row only
      if it stops inside a word, that is, if its longer copies go on with a letter;
    * running text without an end is cut, also without a copy, and so is what ends in a word after
      which nothing can end;
    * what is a whole line elsewhere and has no longer copy is whole;
    * else a value is cut whose last word stands nowhere else in the corpus as a whole word.

    ``cause`` names what decided; ``copied`` tells whether a longer copy was found.
    Each key comes once; null, empty and blank values, null keys and junk give nothing; a null
    source is a source of its own. Page lines, words and copies are counted over all records.
    """
    texts = once_per_key(chunks.select("chunk_index", "text", "source_document"), "chunk_index").filter(F.col("text").isNotNull())
    values = texts.select(F.lit("chunks").alias("origin"), F.col("chunk_index").cast("long").alias("record_id"), F.coalesce("source_document", F.lit("")).alias("source"), "text").unionByName(
        once_per_key(snippets.select("source_id", "snippet", "doc"), "source_id").filter(F.col("snippet").isNotNull())
        .select(F.lit("sources").alias("origin"), F.col("source_id").cast("long").alias("record_id"), F.coalesce("doc", F.lit("")).alias("source"), F.col("snippet").alias("text"))
    )
    examined = materialize(_examined(values), "ends")
    ends = examined.filter(F.col("state").isNotNull()).withColumn("_form", F.xxhash64(normal_form(F.col("line"))))

    doubtful = ends.filter("state <> 'marked'").select("source", "_form").distinct()
    lines = texts.select("chunk_index", F.coalesce("source_document", F.lit("")).alias("source"), F.explode(F.split("text", "\n")).alias("_line"))
    lines = lines.filter(F.col("_line").rlike(r"\p{L}")).select("chunk_index", "source", F.xxhash64(normal_form(F.col("_line"))).alias("_form"))
    pages = (
        join_bounded(lines, doubtful, ["source", "_form"], F.col("chunk_index"), "left_semi").distinct()
        .groupBy("source", "_form").count().filter(F.col("count") >= PAGE_LINE_RECORDS).select("source", "_form", F.lit(True).alias("_page"))
    )
    pages = materialize(pages, "pages")

    # a page line is settled; all other ends are joined with the corpus
    paged = join_bounded(ends, pages, ["source", "_form"], F.col("record_id"), "left")
    paged = materialize(paged, "paged")
    tails = paged.filter((F.col("tail") != "") & (F.col("_page").isNull() | (F.col("state") == "marked"))).select("tail").distinct()
    chars = examined.filter("state is null and word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    copies = materialize(_sorted_copies(texts, tails, chars), "copies")
    known = examined.filter(F.col("state").isNull()).groupBy("word").agg(F.sum("n").alias("seen")).filter("seen >= 2")
    last = paged.filter("state in ('open', 'item')").select(F.lower("word").alias("_word")).distinct()
    known = materialize(known.join(last, known["word"] == last["_word"], "left_semi").select(F.col("word").alias("_word"), F.lit(True).alias("_known")), "known")

    judged = join_bounded(paged.withColumn("_word", F.lower("word")), copies, ["tail"], F.col("record_id"), "left")
    judged = join_bounded(judged, known, ["_word"], F.col("record_id"), "left")
    longer, inside = F.coalesce("longer", F.lit(0)), F.coalesce("inside", F.lit(0))
    equal = F.coalesce("equal", F.lit(0)) - F.when(F.col("origin") == "chunks", 1).otherwise(0)
    cause = (
        F.when(F.col("state") == "marked", "mark")
        .when(F.col("_page"), None)
        .when((F.when(F.col("state") == "item", inside).otherwise(longer) > 0) & (equal <= 0), "longer copy")
        .when(F.col("state") == "running", "sentence")
        .when(F.col("unfinished") > 0, "unfinished")
        .when((equal > 0) & (longer == 0), None)
        .when(F.col("_known").isNull() & (F.col("word") != "") & (F.col("word") == F.lower("word")), "unknown word")
    )
    return judged.withColumn("cause", cause).filter(F.col("cause").isNotNull()).select("origin", "record_id", "source", "cause", (longer > 0).alias("copied"))


def report(chunks: DataFrame, snippets: DataFrame) -> DataFrame:
    """``(source_document, values, cut, share)``: how often the values of each source are cut off.

    Values are distinct keys with a text that isn't null; a null source is reported as ''.
    """
    cut = find(chunks, snippets).groupBy("source").agg(F.count("*").alias("cut"))
    totals = (
        chunks.filter("text is not null and chunk_index is not null").select(F.coalesce("source_document", F.lit("")).alias("source"), F.lit("c").alias("o"), F.col("chunk_index").cast("long").alias("id"))
        .unionByName(snippets.filter("snippet is not null and source_id is not null").select(F.coalesce("doc", F.lit("")).alias("source"), F.lit("s").alias("o"), F.col("source_id").cast("long").alias("id")))
        .distinct().groupBy("source").agg(F.count("*").alias("values"))
    )
    return totals.join(cut, "source", "left").select(
        F.col("source").alias("source_document"), "values", F.coalesce("cut", F.lit(0)).alias("cut"), (F.coalesce("cut", F.lit(0)) / F.col("values")).alias("share")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p4_found": lambda spark, d: find(table(spark, d, "chunks"), table(spark, d, "sources")).select("origin", "record_id"),
    "p4_report": lambda spark, d: report(table(spark, d, "chunks"), table(spark, d, "sources")),
}
SQL: dict[str, str] = {}
