"""Problems 1, 4, 5, 6 and 9 on small tables: stated cases, brute force, and odd rows."""

from __future__ import annotations

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from passagework.llm import kinds, lines, quality, repetition, splitting, truncation

CHUNKS = "chunk_index int, text string, source_document string, section_title string, token_count int, id string, source string, _line string"


def chunks(spark, rows):
    """Rows of (chunk_index, text, source, title, tokens), with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, *[None] * (5 - len(r)), "x", "y", "z") for r in rows], CHUNKS)


# ---------------------------------------------------------------- 1


def brute_lines(rows):
    form = lambda t: re.sub(r"[\W_]+", " ", re.sub(r"\d+", "0", t.lower())).strip()
    once = {r[0]: r for r in rows if r[0] is not None}
    total, where = defaultdict(set), defaultdict(set)
    for i, r in once.items():
        total[r[2]].add(i)
        for line in (r[1] or "").split("\n"):
            if re.search(r"[^\W\d_]", line):
                where[r[2], form(line)].add(i)
    often = {k for k, v in where.items() if len(v) >= 10 and len(v) >= 0.02 * len(total[k[0]])}
    return {(i, n) for i, r in once.items() for n, line in enumerate((r[1] or "").split("\n"), 1) if r[1] and (r[2], form(line)) in often and re.search(r"[^\W\d_]", line)}


def test_lines_equal_brute_force(spark):
    rng = random.Random(1)
    footers = ["Page {} of 9", "© {} Someone. ALL rights", "Tell us", "{}", "----"]
    rows = []
    for i in range(600):
        source = rng.choice(["a", "a", "b", None])
        text = "\n".join([f"body {rng.random()} words", *(rng.choice(footers[: 3 if source == "a" else 5]).format(rng.randrange(99)) for _ in range(rng.randrange(3)))])
        rows.append((i, rng.choice([text, text, text, None, "", "  "]), source))
    rows += rows[:40] + [(None, "Tell us", "a")]
    got = [tuple(r) for r in lines.find(chunks(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_lines(rows) and got
    cleaned = {r.chunk_index: r for r in lines.remove(chunks(spark, rows)).collect()}
    assert len(cleaned) == 600 and sum(r.n_removed for r in cleaned.values()) == len(got)
    assert cleaned[next(r[0] for r in rows if r[1] is None)].text is None


def test_trees_learn_slots_and_are_merged(spark):
    tree = lines.TemplateTree(0.7)
    one, two = (tree.parse(f"share this page with {who} · save to {where}".replace("· ", "").split(" ")) for who, where in (("anna", "kelso"), ("bert", "mavel")))
    assert one is two and one.slots == ["share", "this", "page", "with", "*", "save", "to", "*"]
    # another length, another start, and too little in common are other templates
    assert len({id(tree.parse(t.split(" "))) for t in ("share this page with anna save to", "send this page with anna save to kelso", "share this page now or never my friend")} | {id(one)}) == 4
    assert tree.size == len(list(tree.templates())) == 4
    exact = lines.TemplateTree()
    assert exact.parse(["a", "0"]) is exact.parse(["a", "0"]) is not exact.parse(["a", "b"])

    # every line differs by a name: exact trees find nothing, trees with slots find them all, whatever task and batch they are in
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    rows = [(i, f"Share this page with your friend N{'x' * (i % 7)}q{'y' * i} · Save to M{'z' * i}\n{'k' * i}a {'m' * i}b {'n' * i}c stands here", "a") for i in range(40)]
    try:
        assert lines.find(chunks(spark, rows)).count() == 0
        got = {tuple(r) for r in lines.find(chunks(spark, rows).repartition(5), similarity=0.7).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(i, 1) for i in range(40)}


def test_merging_brings_all_lines_of_a_form_together():
    # two trees learned different slots from a line that both have, and a third template lies between
    for order in (["a b c * e f g h", "a b c x e * g y", "a b c d e f g h"], ["a b c d e * z h", "a b c d * f z h", "a b c q e f z *", "a b c q w f z h"]):
        for turned in (order, order[::-1]):
            tree = lines.TemplateTree(0.99)
            own = [tree.merge(slots.split(" ")) for slots in turned]
            for one, a in zip(turned, own, strict=True):
                for two, b in zip(turned, own, strict=True):
                    common = all(x == y or "*" in (x, y) for x, y in zip(one.split(), two.split(), strict=True))
                    assert a.last() is b.last() or not common
                assert all(x in (y, "*") for x, y in zip(a.last().slots, one.split(), strict=True))
            assert tree.size == len(list(tree.templates())) == len({id(t.last()) for t in own})

    # a leaf compares many templates at once as it does few
    rng = random.Random(3)
    drawn = [["a", "b", "c", *(rng.choice("*defgh") for _ in range(6))] for _ in range(400)]
    tree, leaf = lines.TemplateTree(1.0), lines.Leaf()
    for i, slots in enumerate(drawn):
        leaf.templates.append(lines.Template(list(slots), i))
        want = [sum(a == b or "*" in (a, b) for a, b in zip(t.slots, drawn[-1 - i], strict=True)) for t in leaf.templates]
        assert leaf.agreement(drawn[-1 - i]).tolist() == want
        leaf.learn(rng.randrange(len(leaf.templates)), slots)
    groups = [tree.merge(slots) for slots in drawn]
    for i, a in enumerate(drawn):
        for j, b in enumerate(drawn):
            assert groups[i].last() is groups[j].last() or not all(x == y or "*" in (x, y) for x, y in zip(a, b, strict=True))


def test_merged_templates_decide_what_is_counted(spark, monkeypatch):
    # in each of five tasks the footer comes three times, beside lines that differ from it in other words
    notes = ["for the whole of this month", "as of the date shown here", "in the form that was sent"]
    rows = [(i, f"Fees of the bank stand {notes[0]}\nFees of the bank {'abcdefghijklmno'[i]} {notes[i % 5 % 3]}\nBody {'x' * i} alone", "a") for i in range(15)]
    seen, merged = [], lines._merged

    def spy(templates, similarity, parted=False):
        seen.append([tuple(r) for r in templates.collect()])
        if parted:
            return templates.select("_source", "_template", "_n", F.col("_template").alias("_merged"))
        return merged(templates, similarity)

    table = chunks(spark, rows).repartitionByRange(5, "chunk_index")
    monkeypatch.setattr(lines, "_merged", spy)
    assert {tuple(r) for r in lines.find(table).collect()} == brute_lines(rows) == {(i, 1) for i in range(15)}
    slots = {r[3] for r in seen[0]}
    assert any("*" in s.split() for s in slots) and len(seen[0]) >= 5 and sum(r[4] for r in seen[0]) < 45
    # without merging no template of a task reaches ten lines
    monkeypatch.setattr(lines, "_merged", lambda t, s: spy(t, s, parted=True))
    assert lines.find(table).count() == 0


def test_forms_are_counted_whole_however_trees_learn(spark, monkeypatch):
    # lines of two leaves whose forms differ in a word or more, so that tasks learn different slots from them
    rng = random.Random(8)
    rows = []
    for i in range(500):
        text = "\n".join(f"See page {rng.randrange(99)} {rng.choice(['of', 'in'])} {rng.choice('aaabcdef')} for {rng.choice('pppqrstu')} and {rng.choice('vvvwxyz')}" for _ in range(2))
        rows.append((i, text, rng.choice(["a", "b", None])))
    rows += rows[:30]
    # a worker whose trees start afresh after every batch gives more templates of a form
    for batch, most in ((10_000, lines.MOST_FORMS), (9, 3)):
        monkeypatch.setattr(lines, "MOST_FORMS", most)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = {tuple(r) for r in lines.find(chunks(spark, rows).repartition(7)).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == brute_lines(rows) and 0 < len(got) < 1000


def test_lines_of_nothing(spark):
    empty = chunks(spark, [(0, "x", "a")]).limit(0)
    assert lines.find(empty).count() == lines.remove(empty).count() == 0


# ---------------------------------------------------------------- 4


def test_ends():
    cases = {
        "The owner may sign. The bank can ref": "running", "The owner may sign.": "whole", "He said “no.”": "whole", "Fees for the account": "open", "The owner may sign the…": "marked", "The owner can ask [...]": "marked",
        "• a copy of the form": "whole", "| a | 1 |\n| b | 2": "whole", "a\t1\t2\nfee\t3\t4": "whole", "": "whole", None: "whole", " \n": "whole", "xkcd qwrt zxcv bnmp": "whole", "line one of the text that is\nwrapped over to the nex": "running",
        "(i) a form; (ii) two copies; (iii) the original": "whole", "What happens?": "whole", "The fee is due;": "running",
    }
    assert {t: truncation.examine(t)[0] for t in cases} == cases


def test_last_words():
    cases = {"| wire | $3 | n/a |\n| check | $4 | n/a": "", "Fee,Cost\nwire,$4,varies": "varies", "a\tb\tc\nwire\t1\tn/a": "", "The owner’s half-": "", "The joint owner’s": "owner’s", "• power-of-attorney": "power-of-attorney", "He said “no": "no", "The fee is 3a": ""}
    assert {t: truncation.examine(t)[3] for t in cases} == cases
    # a verb after a determiner is a noun
    assert [truncation.unfinished(t, t.split()[-1]) for t in ("what is named in the will", "the owner will", "a copy of the", "the form")] == [False, True, True, False]
    assert truncation.examine("The party named in the will")[0] == "open" and truncation.examine("The party named here will")[0] == "running"


def test_sorted_prefix_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(truncation, "PART_CHARS", 400)
    rng = random.Random(11)
    parts = ["the fee", "the fees", "a 12", "a 123", "a 12 x", "zeta", "Été", "the", "12"]
    texts = ["\n".join(" ".join(rng.choices(parts, k=rng.randrange(1, 4))) + rng.choice(["", "", ".", " "]) for _ in range(rng.randrange(1, 5))) for _ in range(200)] + ["same line"] * 60
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_index int, text string").repartition(3)
    tails = sorted({u[:n] for t in texts[:60] for u in truncation.units_of(t) for n in (1, 3, 7, len(u)) if u[:n]} | {"nowhere", "same"})
    got = {r.tail: (min(r.longer, 1), r.equal, min(r.inside, 1)) for r in truncation._sorted_copies(df, spark.createDataFrame([(t,) for t in tails], "tail string"), sum(map(len, texts))).collect()}
    units = [u for t in texts for u in truncation.units_of(t)]
    for tail in tails:
        rests = [u[len(tail):] for u in units if u.startswith(tail)]
        want = int(any(re.search(r"[^\d\s]", r) for r in rests)), sum(not r.strip() for r in rests), int(any(r[:1].isalpha() for r in rests))
        assert got[tail] == want, tail


def test_corpus_decides_open_ends(spark):
    page = "Office of Anymore records"
    rows = [(i, f"The bank may sign form {i}.\n{page}", "d") for i in range(6)]
    rows += [(10, "The remaining dividend\nelection goes out with fees.", "d"), (11, "Opening paragraph ends here.\n\nThe remaining divid", "d"), (12, "Account opening fees", "d"), (13, "The bank may not.\n\nIn rare cases, the", "d"), (12, "Account opening fees", "d")]
    rows += [(14, "The remaining dividend election goes to the desk with fees and all fees paid.", "e"), (15, None, None), (None, "The bank may", "d")]
    snippets = spark.createDataFrame([(1, "The remaining dividend elec", None), (2, None, "d"), (3, "", "d"), (4, "The bank may sign…", "d"), (4, "The bank may sign…", "d")], "source_id long, snippet string, doc string")
    got = {(r.origin, r.record_id): r.cause for r in truncation.find(chunks(spark, rows), snippets).collect()}
    assert got == {("chunks", 11): "longer copy", ("chunks", 13): "unfinished", ("sources", 1): "longer copy", ("sources", 4): "mark"}
    report = {r.source_document: (r["values"], r.cut) for r in truncation.report(chunks(spark, rows), snippets).collect()}
    assert report == {"d": (12, 3), "e": (1, 0), "": (1, 1)}
    assert truncation.find(chunks(spark, rows).limit(0), snippets.limit(0)).count() == 0


def test_item_wrapped_over_many_lines():
    text = "- a copy of the form that\n" + "\n".join(f"goes on over line {i} and" for i in range(8)) + "\nends here with the form"
    assert truncation.examine(text)[0] != "running"


def test_items_that_stop_inside_a_word(spark):
    rows = [(i, f"The bank may ask for a copy of the form and the balance in case {i}.", "d") for i in range(3)]
    rows += [(10, "Needed:\n- the original recurring account\n- a copy of the form in case", "d"), (11, "Needed:\n- a copy\n- the origin", "d"), (12, "Needed:\n- a form\n- a copy of the bala", "d"), (13, "Needed:\n- the form\n- the balance of", "d"), (14, "Needed:\n- the form\n- a copy of the form", "d")]
    got = {r.record_id for r in truncation.find(chunks(spark, rows), spark.createDataFrame([], "source_id long, snippet string, doc string")).collect()}
    assert got == {11, 12, 13}


# ---------------------------------------------------------------- 5

KINDS = {
    "The owner may sign the form. The bank can refuse it within 9 days.": "prose", "- one\n- two form\n- three": "list", "Proof of age\nA copy of the form\nNotice (joint), 3 days": "list",
    "| a | b |\n| --- | --- |\n| fee | $1 |": "table", "Fee,Cost\nwire,$10.00\ncheck,$2.00": "table", "wire ........ $10\ncheck ........ $5": "table", "wire   $10     5%\ncheck  $5      1%": "table",
    "(cid:12)(cid:99) (cid:1)": "junk", "a3f0 99bc 01de ffff": "junk", "%45%9A%FF+%00&%12": "junk", "1.73\n2024\nAB-C1D-22": "junk", "<td class='x'></td><b id='y'></b>": "junk", "xkcd qwrt zxcv bnmp": "junk",
    "El titular debe firmar el aviso, si falta una firma.": "prose", "(i) a form; (ii) two copies; (iii) the original": "list", "Hard wrapped prose that goes\non over several lines and then\nends.": "prose",
}


def test_kinds():
    assert {t: kinds.main_kind(t)[0] for t in KINDS} == KINDS


def test_repetition_tells_filler_from_prose():
    filler = ". ".join(["Zorba vante kulpo"] * 12) + "."
    unlike = ". ".join(f"Zorb{a}a vant{b}e kulp{a}{b}o" for a in "bdfg" for b in "klm") + "."
    prose = ". ".join(["The owner may sign the form"] * 12) + "."
    common = frozenset({"the", "may"})

    def kind(text):
        return quality.judge(quality.statistics(text, common) | {s: float(v[0]) for s, v in repetition.measure([text], every=True).items() if s in quality.REPEATED})

    # without the coverage of the dominant phrase the first were prose, as the second is
    assert (kind(filler), kind(unlike), kind(prose)) == ("junk", "prose", "prose")


def test_shares_of_short_texts():
    got = repetition.measure(["a b c\na b c", "x", None, "one two one two one two three"], every=True)
    assert got["line_share"].tolist() == [0.5, 0, 0, 0] and got["phrase_share"].round(3).tolist() == [1, 0, 0, round(15 / 23, 3)]
    assert not any(map(float, got["paragraph_share"])) and repetition.measure(["a b c"])["line_share"][0] != repetition.measure(["a b c"])["line_share"][0]


def test_statistics(spark):
    texts = [*KINDS, None, "", " \n\t", "x" * 50_000]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s"), (None, "a", "s")]
    common = spark.createDataFrame([("en", "the"), ("en", None), ("es", "el"), ("en", "the")], "lang string, word string")
    got = {r.chunk_index: r for r in quality.profile(chunks(spark, rows), common).collect()}
    assert len(got) == len(texts) and [got[i].kind for i in range(len(KINDS))] == list(KINDS.values())
    assert [got[len(KINDS) + i].kind for i in range(4)] == [None, None, None, "junk"]
    first = got[0]
    assert first.n_words == 14 and first.ended_line_share == 1.0 and round(first.common_word_share, 3) == round(3 / 14, 3) and first.prose_share == 1.0
    assert quality.profile(chunks(spark, rows).limit(0), common.limit(0)).count() == 0


# ---------------------------------------------------------------- 6


def test_split_keeps_its_promises():
    rng = random.Random(4)
    for _ in range(400):
        parts = ["".join(rng.choices("ab.!? \n\t", [5, 5, 1, 1, 1, 3, 1, 1], k=rng.randrange(1, 80))) for _ in range(rng.randrange(1, 6))]
        text, room = rng.choice(["\n\n", " ", "\n"]).join(parts), rng.randrange(1, 60)
        level, cuts = splitting.split(text, room, rng.choice([0, 5, 30]))
        done = 0
        for n, (start, end, repeated) in enumerate(cuts):
            assert 0 < end - start <= room and repeated == (max(0, done - start) if n else 0) and end > done
            assert not text[done:start].strip(" \t\r\n") and text[start] not in " \t\r\n" and text[end - 1] not in " \t\r\n"
            if level != "hard":
                assert end == len(text) or any(m.start() == end for x in splitting.LEVELS for m in splitting._BETWEEN[x].finditer(text)) or not text[end:].strip(" \t\r\n")
            done = end
        assert not text[done:].strip(" \t\r\n")


def test_cut_levels(spark):
    p = "x " * 200
    texts = {f"{p}\n \n{p}\n\n{p}": "paragraph", f"{p}\n{p}\n{p}": "line", f"{p[:-1]}. {p}. {p}": "sentence", p * 3: "word", "y" * 1000: "hard", "short": None, "z" * 901: "hard"}
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    rows += [(20, "a b " * 225, "s", "Title"), (21, "a b " * 225, "s", " "), (22, "a b " * 100, "s", None, 1000), (23, "a b " * 100, "s", None, 0), (24, None, "s", "t", 999), (25, "c" * 10, "s", "t" * 2000), (0, next(iter(texts)), "s"), (None, "q" * 2000, "s")]
    got = {r.chunk_index: r.cut_level for r in splitting.pieces(chunks(spark, rows)).filter("piece = 0").collect()}
    assert got == {i: k for i, k in enumerate(texts.values()) if k} | {20: "word", 22: "word", 25: "hard"}
    assert splitting.pieces(chunks(spark, rows).limit(0)).count() == 0


# ---------------------------------------------------------------- 9


def test_repetition_equals_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        part = " ".join(rng.choice(["alpha", "beta", "GAMMA", "Été", "x9", "don't"]) + rng.choice(["", ",", ".", "\n"]) for _ in range(rng.randrange(2, 40)))
        rows.append((i, rng.choice([part, f"{part} {part}", f"{part}\n" * 3, None, "", "  "])))
    rows += rows[:5] + [(400, "spam " * 20_000), (None, "a " * 100)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, posterior int")
    got = {r.doc_id: r for r in repetition.score(df).collect()}
    assert len(got) == 301
    for i, text in dict(rows).items():
        if i is not None:
            assert (got[i].n_words, got[i].n_runs, got[i].n_repeated) == repetition.brute_force(text)
    assert got[400].posterior > 0.9 and got[400].run_share > 0.99
    assert repetition.score(df.limit(0)).count() == 0


def test_the_posterior_decides(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, ". ".join(" ".join(rng.sample(words, 8)) for _ in range(12)) + ".") for i in range(200)]
    rows += [(200 + i, (" ".join(rng.sample(words, 9)) + ".\n") * 8) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.posterior for r in repetition.repetitive(df).collect()}
    assert set(kept) == set(range(200, 240)) and min(kept.values()) > 0.5
    # what the posterior turns down isn't found, whatever its share is
    assert repetition.repetitive(df, least=1.1).count() == 0
    monkeypatch.setattr(repetition, "RULES", [(m, 2.0, no) for m, _, no in repetition.RULES])
    assert repetition.repetitive(df).count() < 40


def test_estimate_follows_the_majority():
    p = repetition.estimate({(1, 1, 1): 10, (0, 0, 0): 100, (1, -1, 1): 5, (-1, -1, -1): 7, (0, 0, 1): 6})
    assert p[1, 1, 1] > 0.9 and p[1, -1, 1] > 0.8 and p[0, 0, 0] < 0.1 and p[0, 0, 1] < 0.5
    assert repetition.estimate({}) == {}


def test_found_queries_have_their_columns(spark):
    d = "/root/testdata/sf0.001"
    assert lines.found(spark, d).columns == ["chunk_index", "line_no"]
    assert truncation.QUERIES["p4_found"](spark, d).columns == ["origin", "record_id"]
    assert dict(quality.QUERIES["p5_found"](spark, d).dtypes) == {"chunk_index": "bigint", "kind": "string"}
    assert dict(splitting.found(spark, d).dtypes) == {"chunk_index": "bigint", "cut_level": "string"}
    assert repetition.found(spark, d).columns == ["doc_id"]
    assert F is not None
