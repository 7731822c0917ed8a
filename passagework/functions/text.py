"""Text functions as column expressions: everything here stays in the JVM.

White space and line breaks are those of Unicode text processing in Python, given as explicit
classes, since the engine's own classes are narrower. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, line breaks, and control characters that extraction leaves behind.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BREAK = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
BREAKS = r"\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}"
BLANKS = r"[\t\x1f\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
#: End of a sentence, hyphenated breaks, list markers, numbered and lettered headings, codes.
SENTENCE_BOUNDARY = rf'(?<=[.!?]){SPACE}+(?=["“”‘’(\[]*[A-Z0-9])'
HYPHENATED = r"(?<=[A-Za-z])-\s*\n\s*(?=[a-z])"
HYPHEN_BREAK = r"(?<=[A-Za-z])-\n(?=[a-z])"
LIST_MARKER = rf"^{SPACE}*(?:[-*\x{{2022}}]|\(?[a-zA-Z0-9]{{1,3}}[.)]){SPACE}+"
SECTION_NUMBER = rf"^{SPACE}*(?:\d+(?:\.\d+)*|[IVXLC]+)[.)]?{SPACE}+[^\s]"
NUMBERED_HEADING = rf"^(\d+(?:\.\d+)*)[.)]?{SPACE}+"
LETTERED_HEADING = rf"^[A-Z][.)]{SPACE}+"
REVISION_CODE = r"^(?:[A-Z]{2,}-[A-Z0-9-]+-\d+|\d{3,}(?:\.\d+)+|\d{4})$"
REVISION_LINE = r"^(?:\d{3,}(?:\.\d+)+|[A-Z]{2}-[A-Z0-9-]+-\d+|\d{4}|1\.\d+)$"
PAGE_NUMBER = r"(?i)^(?:page\s+)?\d+(?:\s+(?:of|/)\s+\d+)?$"
NUMERIC_LINE = r"(?:[$€£¥%]|\d)"


def at(array: Column | str, index: Column | int) -> Column:
    """The element at a place counted from 1, or from the end if negative; null if there is none."""
    return F.try_element_at(array, index if isinstance(index, Column) else F.lit(index))


def text_or_empty(text: Column) -> Column:
    """Null as ''."""
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    """Each run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text_or_empty(text), f"{SPACE}+", " "))


def lines(text: Column) -> Column:
    """The lines of a text."""
    return F.split(text_or_empty(text), BREAK)


def full_lines(text: Column) -> Column:
    """The lines that aren't blank, each collapsed."""
    return F.filter(F.transform(lines(text), collapse), lambda x: x != "")


def lined(text: Column) -> Column:
    """The lines that aren't blank, each collapsed, joined by line feeds: :func:`full_lines` as one text.

    Two replacements, each in time proportional to the text, in place of a lambda for every line:
    blanks first, so that a run that has a break is short when it becomes one.
    """
    flat = F.regexp_replace(text_or_empty(text), f"{BLANKS}+", " ")
    return F.btrim(F.regexp_replace(flat, f" ?[{BREAKS}][ {BREAKS}]*", "\n"), F.lit(" \n"))


def line_count(text: Column) -> Column:
    """The number of lines of a text made by :func:`lined`."""
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)


def clean_text(text: Column) -> Column:
    """Bell characters as blanks, collapsed lines, no blank lines."""
    return lined(F.translate(text_or_empty(text), "\x07", " "))


def clean_extracted_text(text: Column) -> Column:
    """As :func:`clean_text` for every control character."""
    return lined(F.regexp_replace(text_or_empty(text), CONTROL, " "))


def normalize_text(text: Column) -> Column:
    """For validation: control characters as blanks, hyphenated breaks closed, runs of blanks and tabs as one, no blank lines."""
    closed = F.regexp_replace(F.regexp_replace(text_or_empty(text), CONTROL, " "), HYPHENATED, "")
    tidy = F.transform(lines(closed), lambda x: strip(F.regexp_replace(x, r"[ \t]{2,}", " ")))
    return F.array_join(F.filter(tidy, lambda x: x != ""), "\n")


def normalize_semantic_text(text: Column, preserve_lines: bool = False) -> Column:
    """For chunks: no soft hyphens, hyphenated breaks closed, lines collapsed and joined."""
    closed = F.regexp_replace(F.translate(text_or_empty(text), "\xad", ""), HYPHEN_BREAK, "")
    return lined(closed) if preserve_lines else collapse(closed)


def split_sentences(text: Column) -> Column:
    """Sentences of the collapsed text; none for a blank one."""
    return F.filter(F.transform(F.split(collapse(text), SENTENCE_BOUNDARY), lambda x: F.trim(x)), lambda x: x != "")


def split_words(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(text_or_empty(text), f"{SPACE}+"), lambda x: x != "")


def hard_split(text: Column, size: int) -> Column:
    """Slices of a fixed number of characters."""
    if size <= 0:
        raise ValueError("size must be positive")
    value = text_or_empty(text)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(value) / size).cast("int") - 1))
    return F.filter(F.transform(starts, lambda i: F.substr(value, i * size + 1, F.lit(size))), lambda x: x != "")


def signature(text: Column) -> Column:
    """What a running header or footer has in common on all pages: numbers at the ends and signs dropped."""
    low = F.regexp_replace(F.lower(clean_extracted_text(text)), r"\p{Nd}+", "#")
    bare = F.regexp_replace(F.regexp_replace(low, rf"^{SPACE}*#{SPACE}+", ""), rf"{SPACE}+#{SPACE}*$", "")
    return collapse(F.regexp_replace(bare, r"[^\p{L}\p{N}\p{M}_ \n]", " "))


def format_cell(cell: Column) -> Column:
    """A table cell on one line, with bars escaped."""
    return F.replace(F.replace(clean_extracted_text(cell), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))


def normalized_cell(cell: Column) -> Column:
    """A cell for comparison: lower case, collapsed."""
    return collapse(F.lower(clean_extracted_text(cell)))


def looks_like_header(rows: Column) -> Column:
    """Whether the first of two or more rows has enough filled cells, none longer than 100 characters."""
    filled = F.filter(at(rows, 1), lambda c: c != "")
    return (F.size(rows) >= 2) & (F.size(filled) >= F.greatest(F.lit(1), F.ceil(F.size(at(rows, 1)) / 2))) & (
        F.coalesce(F.array_max(F.transform(filled, F.length)), F.lit(0)) <= 100
    )


def markdown_table(rows: Column) -> Column:
    """Rows of cells as a Markdown table; empty rows are dropped, a header gets its rule."""
    tidy = F.filter(F.transform(rows, lambda r: F.transform(r, format_cell)), lambda r: F.exists(r, lambda c: c != ""))
    shown = F.transform(tidy, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(at(tidy, 1), lambda _: F.lit("---")), " | "), F.lit(" |"))
    ruled = F.when(looks_like_header(tidy), F.concat(F.slice(shown, 1, 1), F.array(rule), F.slice(shown, 2, F.greatest(F.size(shown) - 1, F.lit(0))))).otherwise(shown)
    return F.when(F.coalesce(F.size(tidy), F.lit(0)) <= 0, F.lit("")).otherwise(F.array_join(ruled, "\n"))


def identity(*parts: Column) -> Column:
    """The first 24 hexadecimal digits of the SHA-256 of the parts, joined by NUL; nulls count as ''."""
    return F.substring(F.sha2(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 24)


def is_upper(text: Column) -> Column:
    """Whether the text has letters, none of them lower case."""
    return (F.upper(text) == text) & (F.lower(text) != text)


def is_revision_heading(text: Column) -> Column:
    """Whether some line is a revision code and nothing else."""
    return F.exists(lines(text), lambda x: strip(x).rlike(REVISION_CODE))


def is_revision_code_section(title: Column) -> Column:
    """Whether a title is a revision code or consists of codes."""
    full = F.filter(F.transform(lines(title), strip), lambda x: x != "")
    compact = F.array_join(full, " ")
    digits = F.length(F.regexp_replace(compact, r"[^\p{Nd}]", ""))
    letters = F.length(F.regexp_replace(compact, r"[^\p{L}]", ""))
    separators = F.length(F.regexp_replace(compact, r"[^.\-/ ]", ""))
    coded = compact.rlike(r"^[A-Z0-9.\-\s/]+$") & (digits >= letters) & (digits + separators >= F.greatest(F.lit(6.0), F.length(compact) * 0.6))
    return F.coalesce((F.size(full) > 0) & (F.exists(full, lambda x: x.rlike(REVISION_LINE)) | coded), F.lit(False))


def looks_tabular(text: Column) -> Column:
    """Whether at least 8 lines, 45 % of them with figures, and 4 signs make a text a table."""
    value, full = text_or_empty(text), lined(text)
    marks = F.length(value) - F.length(F.regexp_replace(value, r"[%$|]", ""))
    numeric = F.size(F.filter(F.split(full, "\n"), lambda x: x.rlike(NUMERIC_LINE)))
    # lines are looked at only where there are signs enough
    return F.when(marks < 4, False).when(line_count(full) < 8, False).otherwise(numeric >= line_count(full) * 0.45)


def likely_interleaved(text: Column, fragments: tuple[str, ...] = ()) -> Column:
    """Whether a text seems to mix columns: it has a known fragment, or starts within a sentence, then jumps."""
    compact = collapse(text)
    known = F.lit(False)
    for fragment in fragments:
        known = known | F.contains(F.lower(compact), F.lit(fragment))
    starts = F.substring(compact, 1, 80).rlike(r"^[A-Z][a-z]+(?:\s+[a-z]+){0,3}\s+[a-z]+\b")
    breaks = (F.length(compact) - F.length(F.replace(compact, F.lit(". "), F.lit("")))) / 2
    short = F.size(F.filter(F.split(compact, ","), lambda p: F.size(split_words(p)) <= 3))
    return (compact != "") & (known | (~starts & (breaks >= 4) & (short >= 5)))


def display_text(leaf: Column, overlap: Column, units: Column) -> Column:
    """A chunk as shown: the heading, what is repeated, and the units, parted by empty lines."""
    return strip(F.array_join(F.filter(F.concat(F.array(text_or_empty(leaf), text_or_empty(overlap)), units), lambda x: x != ""), "\n\n"))


def embedding_text(path: Column, shown: Column) -> Column:
    """A chunk as embedded: the path of headings, and the text without its own heading."""
    leaf = at(path, -1)
    body = F.when(shown == leaf, F.lit("")).when(F.startswith(shown, F.concat(leaf, F.lit("\n\n"))), F.substr(shown, F.length(leaf) + 3)).otherwise(shown)
    return F.when(F.coalesce(F.size(path), F.lit(0)) <= 0, shown).otherwise(strip(F.concat(F.array_join(path, " > "), F.lit("\n\n"), body)))


def common_overlap(previous: Column, current: Column) -> Column:
    """The greatest number of words that end ``previous`` and start ``current`` (arrays of words)."""
    most = F.least(F.size(previous), F.size(current))
    first = at(current, 1)
    # the costly comparison of slices is made only where the first word agrees
    fits = F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda k: (at(previous, -k) == first) & (F.slice(previous, -k, k) == F.slice(current, F.lit(1), k)))
    return F.when(most <= 0, F.lit(0)).otherwise(F.coalesce(F.array_max(fits), F.lit(0)))


def highlight(text: Column, first: Column, last: Column, mark: str = "mark") -> Column:
    """The text's words with the ``first`` and ``last`` so many in marks; signs of markup are escaped."""
    escaped = F.replace(F.replace(F.replace(text_or_empty(text), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    words = split_words(escaped)
    return F.array_join(F.transform(words, lambda w, i: F.when((i < first) | (i >= F.size(words) - last), F.concat(F.lit(f"<{mark}>"), w, F.lit(f"</{mark}>"))).otherwise(w)), " ")


#: Keyword rules of the routing of questions, in order.
INTENTS = (
    ("fees", ("fee", "cost", "charge", "brokerage account")), ("ira", ("ira", "59", "withdraw", "early")),
    ("rmd", ("rmd", "required minimum", "distribution")), ("transfer", ("transfer", "how long", "fund")),
    ("beneficiary", ("beneficiar",)), ("margin", ("margin",)),
)


def intent(question: Column) -> Column:
    """The first topic one of whose keywords is in the question, else ``default``."""
    low = F.lower(text_or_empty(question))
    out = F
    for topic, keywords in INTENTS:
        out = out.when(low.rlike("|".join(keywords)), F.lit(topic))
    return out.otherwise(F.lit("default"))


def preview(text: Column, most: int = 120) -> Column:
    """The first characters of a long text, with a mark of omission."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def citation_label(document: Column, section: Column, page: Column) -> Column:
    """The document with its section, else its page if that is not 0."""
    place = F.when(text_or_empty(section) != "", F.concat(F.lit(" "), section)).when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit(" §"), page.cast("string"))).otherwise(F.lit(""))
    return F.concat(document, place)


def score_percent(score: Column) -> Column:
    """The score as a whole percentage, halves rounded up."""
    return F.floor(score * 100 + 0.5).cast("int")


def summarize(value: Column, kind: str) -> Column:
    """A short form for viewers: sizes of arrays and long strings, else the value; ``kind`` is its Spark type."""
    if kind.startswith("array"):
        name = "number" if kind[6:-1] in ("int", "bigint", "float", "double", "smallint", "tinyint") else "array"
        return F.concat(F.lit(f"{name}["), F.size(value).cast("string"), F.lit("]"))
    if kind.startswith(("struct", "map")):
        return F.lit("object")
    text = value.cast("string")
    return F.when(F.length(text) > 120, F.concat(F.lit("string["), F.length(text).cast("string"), F.lit("]"))).otherwise(text) if kind == "string" else text
