"""Problem 1: lines that come back in document after document of one source."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import join_bounded, once_per_key, semi_or_anti
from ..session import materialize, table

#: Tokens at which a template tree branches, after the number of tokens; a leaf holds what agrees in them.
DEPTH = 3
#: Share of equal tokens from which lines of a leaf are the same line; at 1 only digits may differ, and equal forms are counted.
SIMILARITY = 1.0
#: Share of equal tokens from which a line joins a template of its leaf, where lines are the same at a similarity of 1.
LEARNING = 0.7
#: A line is excessive in at least this many documents of its source ...
LEAST_DOCUMENTS = 10
#: ... and in at least this share of them.
LEAST_SHARE = 0.02
#: Forms a worker remembers before its trees start afresh; merging joins what that parts.
MOST_FORMS = 500_000
#: Templates of a leaf up to which they are compared one by one, beyond that as an array; rows of a batch of templates.
FEW, BATCH = 8, 20_000
#: A slot for a run of digits, and one for any token.
NUMBER, ANY = "0", "*"
_DIGITS, _SIGNS = re.compile(r"\d+"), re.compile(r"(?:[^\w\n]|_)+")


def normal_form(line: Column) -> Column:
    """The line's tokens, with a wildcard slot ``0`` for each run of digits."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\p{Nd}+", "0"), r"[^\p{L}\p{N}]+", " "))


def forms_of(text: str) -> list[str]:
    """The normal form of each line; see :func:`normal_form`."""
    return [line.strip() for line in _SIGNS.sub(" ", _DIGITS.sub(NUMBER, text.lower())).split("\n")]


def _number(*parts: str) -> int:
    """A 64-bit number for some strings, the same in every process."""
    return xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


class Template:
    """A template of a leaf: its slots, its number, the lines that joined it, and what it was merged into."""

    __slots__ = ("slots", "number", "lines", "into")

    def __init__(self, slots: list[str], number: int) -> None:
        self.slots, self.number, self.lines = slots, number, 0
        self.into: Template | None = None

    def last(self) -> Template:
        """The template that this one is part of."""
        template = self
        while template.into is not None:
            template = template.into
        return template


def _coded(tokens: list[str]) -> list[int]:
    """A number for each token beyond those on the way to the leaf, below 0 for a wildcard; other tokens may have the same."""
    return [-1 if x == ANY else hash(x) & 0x7FFFFFFF for x in tokens[DEPTH:]]


class Leaf:
    """The templates of a leaf; where there are more than ``FEW``, the numbers of their slots are compared slot by slot, all templates at once."""

    __slots__ = ("templates", "_grid", "_known")

    def __init__(self) -> None:
        self.templates: list[Template] = []
        self._grid, self._known = None, 0

    def agreement(self, tokens: list[str]) -> np.ndarray:
        """For each template, the number of slots that agree with the tokens; a wildcard on either side agrees."""
        n = len(self.templates)
        if n <= FEW:
            return np.array([sum(a == b or a == ANY or b == ANY for a, b in zip(t.slots, tokens, strict=True)) for t in self.templates], np.int32)
        if self._grid is None or self._grid.shape[1] < n:
            grown = np.empty((len(tokens) - DEPTH, 2 * n), np.int32)
            if self._known:
                grown[:, : self._known] = self._grid[:, : self._known]
            self._grid = grown
        for i in range(self._known, n):
            self._grid[:, i] = _coded(self.templates[i].slots)
        self._known = n
        total = np.full(n, DEPTH, np.int32)
        for slots, x in zip(self._grid, _coded(tokens), strict=True):
            total += True if x < 0 else (slots[:n] == x) | (slots[:n] < 0)
        return total

    def learn(self, at: int, tokens: list[str]) -> Template:
        """The template at a place, with wildcards where the tokens differ."""
        template = self.templates[at]
        if template.slots != tokens:
            learned = [a if a == b else ANY for a, b in zip(template.slots, tokens, strict=True)]
            if learned != template.slots:
                template.slots = learned
                if at < self._known:
                    self._grid[:, at] = _coded(learned)
        return template

    def keep(self, templates: list[Template]) -> None:
        """Only these templates."""
        self.templates, self._grid, self._known = templates, None, 0


class TemplateTree:
    """A token tree of fixed depth: by the number of tokens, then by the first ``DEPTH`` of them, to leaves of templates.

    A line joins the template of its leaf that it has the most tokens in common with, if those are
    a share of at least ``similarity``; where they differ the template gets a wildcard slot. Else it
    is a template of its own. Slots of digits are wildcards from the start, also on the way to the leaf.
    """

    def __init__(self, similarity: float = SIMILARITY, numbers: Iterator[int] | None = None) -> None:
        self.similarity = similarity
        self.numbers = numbers or count()
        self.root: dict = {}
        self.size = 0

    def leaf(self, tokens: list[str]) -> Leaf:
        """The leaf of a line's tokens."""
        node = self.root.setdefault(len(tokens), {})
        for token in tokens[:DEPTH]:
            node = node.setdefault(token, {})
        found = node.get(None)
        if found is None:
            found = node[None] = Leaf()
        return found

    def _joined(self, leaf: Leaf, agreement: np.ndarray, tokens: list[str]) -> Template:
        if len(agreement) and agreement.max() / len(tokens) >= self.similarity:
            return leaf.learn(int(agreement.argmax()), tokens)
        template = Template(list(tokens), next(self.numbers))
        leaf.templates.append(template)
        self.size += 1
        return template

    def parse(self, tokens: list[str]) -> Template:
        """The template that the line joins."""
        leaf = self.leaf(tokens)
        return self._joined(leaf, leaf.agreement(tokens), tokens)

    def merge(self, slots: list[str]) -> Template:
        """The template that a template of another tree joins.

        All templates that could have a line in common with it become one, whatever the similarity: so all
        lines of one form are in one template in the end, even if trees learned different slots from them.
        """
        leaf = self.leaf(slots)
        agreement = leaf.agreement(slots)
        alike = np.flatnonzero(agreement == len(slots)).tolist()
        if len(alike) > 1:
            first = leaf.templates[alike[0]]
            for i in alike[1:]:
                leaf.learn(alike[0], leaf.templates[i].slots)
                leaf.templates[i].into = first
            leaf.keep([t for t in leaf.templates if t.into is None])
            self.size -= len(alike) - 1
            return leaf.learn(leaf.templates.index(first), slots)
        return self._joined(leaf, agreement, slots)

    def templates(self) -> Iterator[Template]:
        """All templates."""
        waiting = [self.root]
        while waiting:
            for key, node in waiting.pop().items():
                if key is None:
                    yield from node.templates
                else:
                    waiting.append(node)


def _parsed(chunks: DataFrame, key: str, source: str, text: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``(key, _source, line_no, _template, _form)`` of each line with a letter, and ``(_source, _template, _leaf, _slots, _n)``
    of each template of the tasks' trees with its number of lines, from one pass over the texts."""
    kind = chunks.schema[key].dataType.simpleString()
    names = [key, "_source", "line_no", "_template", "_form", "_leaf", "_slots", "_n"]
    schema = f"{key} {kind}, _source string, line_no long, _template long, _form long, _leaf long, _slots string, _n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # numbers of templates are those of this task, which no other task gives
        numbers = count(TaskContext.get().partitionId() << 40)
        trees: dict[str, TemplateTree] = {}
        known: dict[str, dict[str, tuple[Template, int]]] = {}
        held, typed = 0, pa.null()

        def learned() -> Iterator[pa.RecordBatch]:
            every = ((name, t) for name, tree in trees.items() for t in tree.templates())
            while part := list(islice(every, BATCH)):
                none = pa.nulls(len(part), pa.int64())
                leaves = [_number(name, str(len(t.slots)), *t.slots[:DEPTH]) for name, t in part]
                columns = [pa.array(c, k) for c, k in (([name for name, _ in part], pa.string()), ([t.number for _, t in part], pa.int64()),
                           (leaves, pa.int64()), ([" ".join(t.slots) for _, t in part], pa.string()), ([t.lines for _, t in part], pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), typed), columns[0], none, columns[1], none, *columns[2:]], names)

        for batch in batches:
            typed = batch.column(key).type
            at, sources, places, own, forms = [], [], [], [], []
            for i, (name, value) in enumerate(zip(batch.column("_source").to_pylist(), batch.column(text).to_pylist(), strict=True)):
                seen = known.setdefault(name, {})
                for n, form in enumerate(forms_of(value), 1):
                    found = seen.get(form)
                    if found is None:
                        if not any(map(str.isalpha, form)):
                            continue
                        tree = trees.get(name)
                        if tree is None:
                            tree = trees[name] = TemplateTree(similarity, numbers)
                        found = seen[form] = tree.parse(form.split(" ")), _number(form)
                        held += 1
                    found[0].lines += 1
                    at.append(i)
                    sources.append(name)
                    places.append(n)
                    own.append(found[0].number)
                    forms.append(found[1])
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(at, pa.int64())), pa.array(sources, pa.string()), *(pa.array(c, pa.int64()) for c in (places, own, forms)),
                 none, pa.nulls(len(at), pa.string()), none], names
            )
            if held > MOST_FORMS:
                yield from learned()
                trees.clear()
                known.clear()
                held = 0
        yield from learned()

    named = chunks.filter(F.col(text).isNotNull()).select(key, F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("_source"), text)
    both = materialize(named.mapInArrow(run, schema), "lines")
    return both.filter(F.col(key).isNotNull()).select(*names[:5]), both.filter("_slots IS NOT NULL").select("_source", "_template", "_leaf", "_slots", "_n")


def _merged(templates: DataFrame, similarity: float) -> DataFrame:
    """``(_source, _template, _n, _merged)``: the templates of all tasks' trees, merged leaf by leaf, the commonest first.

    A task gets whole leaves and holds the merged templates of one leaf at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, rows = None, TemplateTree(similarity), []

        def closed() -> pa.RecordBatch:
            # a merged template goes by the number of the first that came to it
            first: dict[int, int] = {}
            merged = [first.setdefault(t.last().number, number) for _, number, _, t in rows]
            out = [pa.array(c, k) for c, k in ((([r[0] for r in rows]), pa.string()), ([r[1] for r in rows], pa.int64()), ([r[2] for r in rows], pa.int64()), (merged, pa.int64()))]
            return pa.RecordBatch.from_arrays(out, ["_source", "_template", "_n", "_merged"])

        for batch in batches:
            for leaf, source, number, slots, n in zip(*(batch.column(c).to_pylist() for c in ("_leaf", "_source", "_template", "_slots", "_n")), strict=True):
                if (leaf, source) != now:
                    if rows:
                        yield closed()
                    now, tree, rows = (leaf, source), TemplateTree(similarity), []
                rows.append((source, number, n, tree.merge(slots.split(" "))))
        if rows:
            yield closed()

    sorted_ = templates.repartition("_leaf").sortWithinPartitions("_leaf", "_source", F.col("_n").desc(), "_slots", "_template")
    return materialize(sorted_.select("_leaf", "_source", "_template", "_slots", "_n").mapInArrow(run, "_source string, _template long, _n long, _merged long"), "merged")


def find(chunks: DataFrame, key: str = "chunk_index", source: str = "source_document", text: str = "text",
         least_documents: int = LEAST_DOCUMENTS, least_share: float = LEAST_SHARE, similarity: float = SIMILARITY) -> DataFrame:
    """``(key, line_no)`` of every line repeated excessively within its source; lines count from 1.

    Every task parses its lines into templates by a token tree of fixed depth for each source
    (:class:`TemplateTree`), which learn wildcard slots, and the trees of all tasks are merged leaf by leaf,
    but for leaves that have too few lines in all trees together. Digits are always wildcard slots. Lines of the
    merged templates whose count reaches the limits, and no others, go on to an exact count of distinct documents,
    since a record may come twice. At a ``similarity`` of 1 trees learn at ``LEARNING``, and it is the normal forms in
    such a template that are counted: all lines of a form are in one merged template, so a form that reaches the limits
    is in one that does. Below 1 trees learn at that similarity and templates are counted, so lines that differ in
    some tokens are the same. A source's share is taken of all its distinct documents, those with null text included.

    What is counted is combined before it is shuffled, and lines are joined by :func:`join_bounded`, so
    neither a source nor a line with a third of all rows ends up in one task. The null source is a
    source of its own; null and empty texts and lines without a letter give nothing; rows with a null
    key are dropped; other columns are not read.
    """
    rows = chunks.select(key, source, text).filter(F.col(key).isNotNull())
    learning = LEARNING if similarity >= 1 else similarity
    lines, templates = _parsed(rows, key, source, text, learning)
    sizes = (
        rows.select(key, F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("_source")).distinct()
        .groupBy("_source").agg(F.count("*").alias("_all"))
        .withColumn("_least", F.greatest(F.lit(least_documents).cast("double"), F.col("_all") * least_share - 1e-9)).drop("_all")
    )

    def reaching(counted: DataFrame, by: str) -> DataFrame:
        n = counted.groupBy("_source", by).agg(F.sum("_n").alias("_all")).filter(F.col("_all") >= least_documents)
        return n.join(sizes, "_source").filter("_all >= _least").select(by)

    # a leaf with too few lines has no template that reaches the limits; leaves and templates are numbered apart for each source
    leaves = materialize(reaching(templates, "_leaf"), "leaves")
    merged = _merged(semi_or_anti(templates, leaves, ["_leaf"], "left_semi", spread=F.col("_template")), learning)
    exact = similarity >= 1
    heavy = semi_or_anti(merged, reaching(merged, "_merged"), ["_merged"], "left_semi", spread=F.col("_template"))
    heavy = materialize(heavy.select("_template", *([] if exact else ["_merged"])), "templates")
    hits = join_bounded(lines, heavy, ["_template"], F.col(key)).select(key, "line_no", "_source", F.col("_form" if exact else "_merged").alias("_same"))
    hits, node = materialize(hits, "hits"), ["_source", "_same"]
    counted = hits.select(*node, key).distinct().groupBy(*node).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least_documents)
    covering = materialize(counted.join(sizes, "_source").filter("_n >= _least").select(*node), "covering")
    return join_bounded(hits, covering, node, F.col(key)).select(key, "line_no").distinct()


def remove(chunks: DataFrame, key: str = "chunk_index", source: str = "source_document", text: str = "text", **limits: float) -> DataFrame:
    """Each record once, as ``(key, source, text, n_removed)``, without its excessive lines.

    Null text stays null, and a text all of whose lines go becomes empty.
    """
    found = find(chunks, key, source, text, **limits).groupBy(key).agg(F.collect_set("line_no").alias("_gone"))
    once = once_per_key(chunks.select(key, source, text), key)
    kept = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains("_gone", (i + 1).cast("long")))
    return once.join(found, key, "left").select(
        key, source,
        F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text),
        F.coalesce(F.size("_gone"), F.lit(0)).alias("n_removed"),
    )


def found(spark: SparkSession, d: str) -> DataFrame:
    """p1_found: every line to be removed."""
    return find(table(spark, d, "chunks")).select(F.col("chunk_index").cast("long").alias("chunk_index"), "line_no")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": found,
    "p1_cleaned": lambda spark, d: remove(table(spark, d, "chunks")),
}
_FORM = "trim(regexp_replace(regexp_replace(lower(line), '\\p{Nd}+', '0', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
_CASES = f"""
    once AS (SELECT DISTINCT chunk_index, source_document, text FROM chunks WHERE chunk_index IS NOT NULL),
    parts AS (SELECT chunk_index, coalesce(source_document, '') AS s, unnest(string_split(text, chr(10))) AS line,
                     generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM once WHERE text IS NOT NULL),
    forms AS (SELECT chunk_index, s, line_no, {_FORM} AS form FROM parts),
    lettered AS (SELECT * FROM forms WHERE regexp_matches(form, '\\p{{L}}')),
    sizes AS (SELECT coalesce(source_document, '') AS s, count(DISTINCT chunk_index) AS total FROM once GROUP BY 1),
    often AS (SELECT l.s, l.form FROM lettered l JOIN sizes z ON z.s = l.s GROUP BY l.s, l.form, z.total
              HAVING count(DISTINCT chunk_index) >= 10 AND count(DISTINCT chunk_index) >= 0.02 * z.total),
    cases AS (SELECT DISTINCT l.chunk_index, l.line_no FROM lettered l JOIN often o ON o.s = l.s AND o.form = l.form)
"""
SQL: dict[str, str] = {
    "p1_found": f"WITH {_CASES} SELECT CAST(chunk_index AS BIGINT) AS chunk_index, CAST(line_no AS BIGINT) AS line_no FROM cases",
    "p1_cleaned": f"""WITH {_CASES},
        kept AS (SELECT p.chunk_index, string_agg(p.line, chr(10) ORDER BY p.line_no) FILTER (WHERE c.line_no IS NULL) AS text,
                        CAST(count(c.line_no) AS INTEGER) AS n_removed
                 FROM parts p LEFT JOIN cases c ON c.chunk_index = p.chunk_index AND c.line_no = p.line_no GROUP BY p.chunk_index)
        SELECT o.chunk_index, o.source_document, CASE WHEN o.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
               coalesce(k.n_removed, 0) AS n_removed
        FROM once o LEFT JOIN kept k ON k.chunk_index = o.chunk_index""",
}
