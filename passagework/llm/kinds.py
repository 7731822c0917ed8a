"""Kinds of lines: prose, list item, table row or junk."""

from __future__ import annotations

import re

#: Letters that make a word pronounceable.
_VOWELS = frozenset("aeiouyáéíóúüàèìòùâêîôûäöåæœøãõ")
#: Finite verbs that items and titles do without, in four languages.
VERBS = frozenset(
    "is are was were be been has have had does do did can cannot could may might must shall should will would need goes costs "
    "es son está están ha han puede pueden debe deben podrá deberá suele quiere tiene "
    "ist sind war hat haben kann können darf muss müssen soll sollte wird werden "
    "est sont était ont peut peuvent doit doivent devrait sera".split()
)
#: Words after which a word of ``VERBS`` is a noun.
_DETERMINERS = frozenset("a an the his her their its this that my your our each every any un una el la su ein eine der die das le la les un une sa son leur".split())
_CORE = re.compile(r"[\"“”„‘’'«(\[¿¡*_—–•☐-]*(.*?)[\"“”‘’'»)\].,;:!?…*_—–-]*")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-/&.][^\W\d_]+){0,4}\.?")
_NUMBER = re.compile(r"[$€£+-]?\d{1,3}(?:[.,]?\d{3})*(?:[.,]\d{1,4})?(?:[%$€£]|st|nd|rd|th)?|\d{1,4}(?:[/.:-]\d{1,4}){1,2}|n/a")
_MARK = re.compile(r"\s*(?:[•◦▪▸‣·●○■□☐☑✓*–—+-]|(?:\(?(?:\d{1,3}|[ivxlc]{1,6}|[a-zA-Z])[.)])|\[[ xX]?\])\s+\S")
_DECIMAL = re.compile(r"\s*\d{1,3}\.\d")
_INLINE = re.compile(r"(?:^|[\s;,])\((?:[ivxlc]{1,6}|[a-z]|\d{1,2})\)\s")
_LEADERS = re.compile(r"\S\s?(?:\.{4,}|(?:\. ){4,}|_{4,})\s*\S+\s*$")
_GAP = re.compile(r"(?<=\S) {2,}(?=\S)")
_CSV = re.compile(r"(?<=\S),(?=\S)")
_RULE = re.compile(r"[\s|:+=-]{3,}")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_FILL = re.compile(r"\.{4,}|_{4,}|\t|(?:\. ){4,}")
_CELL = re.compile(r",[$\d]|\d%?,")
_BLANKS = re.compile("[\x00-\x08\x0b-\x1f\x7f\xa0\u2000-\u200a\u202f\u3000]")
_END = re.compile(r"[.!?…][\"”’'»)\]]*\s*(?:[—–-]\s*)?$")
#: What items don't have: an end of a sentence inside, and signs that part the fields of page lines.
_PAGE = re.compile(r"[.!?]\s|[·©–—|]")
MOST_REMEMBERED = 500_000


class _Tokens(dict):
    """Whether a token is a word or a number that a reader can use."""

    def __missing__(self, token: str) -> bool:
        if len(self) > MOST_REMEMBERED:
            self.clear()
        core = _CORE.fullmatch(token)[1] if len(token) <= 40 else ""
        if _WORD.fullmatch(core):
            lower = core.lower()
            # one case, or capitals only at the start of parts; some vowel
            plain = core.islower() or core.isupper() or core.istitle() or core[1:].islower() or "-" in core or "'" in core or "’" in core
            good = plain and not _VOWELS.isdisjoint(lower) and (core.isascii() or sum(c.isascii() for c in core) * 2 >= len(core) or not _mixed(core))
        else:
            good = bool(_NUMBER.fullmatch(core)) or (not core and len(token) <= 2)
        self[token] = good
        return good


def _mixed(core: str) -> bool:
    """Whether letters of different alphabets stand in one word."""
    blocks = {ord(c) >> 8 for c in core.lower() if not c.isascii()}
    return len(blocks) > 1 or (any(c.isascii() for c in core) and not blocks <= {0, 1})


_tokens = _Tokens()


def usable(line: str) -> float:
    """Share of the line's characters, without blanks, in words and numbers; 0 if it has no word."""
    known, good, total = _tokens, 0, 0
    for token in line.split():
        n = len(token)
        total += n
        if known[token]:
            good += n
    return good / total if good and line.upper() != line.lower() else 0.0


def clean(text: str) -> str:
    """The text without soft hyphens; control characters and no-break blanks become blanks."""
    return _BLANKS.sub(" ", text.replace("\xad", "").replace("\r\n", "\n"))


def line_kind(line: str) -> str:
    """``blank``, ``table``, ``list``, ``junk`` or ``text`` for one line by itself."""
    bare = line.strip()
    if not bare:
        return "blank"
    bars = bare.count("|")
    if bars and bars + bare.count(" | ") >= 2 and (_RULE.fullmatch(bare) or usable(bare.replace("|", " ")) >= 0.6):
        return "table"
    if ("\t" in bare or (("...." in bare or "____" in bare or ". . . ." in bare) and _LEADERS.search(bare))) and usable(_FILL.sub(" ", bare)) >= 0.6:
        return "table"
    share = usable(bare)
    if "  " in bare:
        # columns are set apart by wide gaps of unequal width; a page line may have all its blanks doubled
        widths = {len(g) for g in _GAP.findall(bare)}
        if widths and max(widths) > 2 and share >= 0.6:
            return "table"
    if "," in bare:
        commas = len(_CSV.findall(bare))
        if commas and commas >= bare.count(", ") and (commas >= 2 or _CELL.search(bare)) and usable(_CSV.sub(" ", bare)) >= 0.6:
            return "table"
    if share < 0.6 or ("<" in bare and len(_TAG.sub("", bare)) < 0.5 * len(bare)):
        return "junk"
    if _MARK.match(bare) and not _DECIMAL.match(bare) and not (bare[0] in "—–-" and bare[-1] in "—–-"):
        return "list"
    if "(" in bare and len(_INLINE.findall(bare)) >= 2:
        return "list"
    return "text"


def has_verb(words: list[str]) -> bool:
    """Whether a finite verb is among the lower-case words; what follows a determiner is a noun ("the will")."""
    if VERBS.isdisjoint(words):
        return False
    return any(w in VERBS and (i == 0 or words[i - 1] not in _DETERMINERS) for i, w in enumerate(words))


def item_like(line: str) -> bool:
    """Whether an unmarked line can be an item: it starts like one, has no end mark and no finite verb."""
    bare = line.strip()
    if not bare or len(bare) > 130 or not (bare[0].isupper() or bare[0].isdigit()) or bare[-1] in ".!?…" or _END.search(bare) or _PAGE.search(bare):
        return False
    return not has_verb(bare.lower().split())


def kinds(text: str) -> list[tuple[str, str]]:
    """Each line with its kind in context: ``blank``, ``table``, ``list``, ``junk`` or ``text``.

    Two or more unmarked item-like lines in a row are items, unless the line after them starts
    in lower case, as hard-wrapped prose does; so is an unended line among them that has a verb,
    and a line that carries on an item is part of it.
    """
    lines = clean(text).split("\n")
    out = [line_kind(x) for x in lines]
    solid = [i for i, k in enumerate(out) if k != "blank"]
    start = 0
    while start < len(solid):
        stop = start
        while stop < len(solid) and out[solid[stop]] == "text" and item_like(lines[solid[stop]]):
            stop += 1
        if stop - start >= 2 and not (stop < len(solid) and lines[solid[stop]].strip()[:1].islower()):
            for i in solid[start:stop]:
                out[i] = "list"
        start = max(stop, start + 1)
    for before, i, after in zip(solid, solid[1:], [*solid[2:], None], strict=False):
        # an imperative item may have a subordinate clause with a verb
        if out[i] == "text" and out[before] == "list" and (after is None or out[after] == "list") and lines[i].strip()[0].isupper() and len(lines[i]) <= 130 and not _END.search(lines[i]) and not _PAGE.search(lines[i]) and not _MARK.match(lines[before]):
            out[i] = "list"
        if out[i] == "text" and out[before] == "list" and i == before + 1 and lines[i].strip()[:1].islower() and not lines[before].rstrip().endswith((".", ";")):
            out[i] = "list"
    return list(zip(lines, out, strict=True))


def main_kind(text: str) -> tuple[str, dict[str, float]]:
    """The kind of the larger part of the text's characters, ``prose`` or the largest other kind, with the shares."""
    sizes = {"text": 0, "list": 0, "table": 0, "junk": 0}
    for line, kind in kinds(text):
        if kind != "blank":
            sizes[kind] += len(line.strip())
    total = sum(sizes.values())
    shares = {k: v / total if total else 0.0 for k, v in sizes.items()}
    other = max(("list", "table", "junk"), key=lambda k: sizes[k])
    return (other if total and sizes["text"] * 2 < total else "prose"), shares
