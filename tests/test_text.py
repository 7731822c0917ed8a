"""Text functions: stated cases, and agreement of the column and plain forms."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from passagework.functions import text as X
from passagework.operators import chunking as C

ODD = ["", None, "  ", "a\x07b\tc\n\n d", "x\x1cy\x85z\xa0q r　s", "Ärger ÉTÉ ­ soft", "invest-\nment", "risk-adjusted", "One. Two! (Three)? “Four.” five"]


def values(spark, column, rows=ODD):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(column).collect()]


def test_cleaning_equals_python(spark):
    assert values(spark, X.clean_text(F.col("t"))) == [C.collapsed_lines(x) for x in ODD]
    assert values(spark, X.normalize_semantic_text(F.col("t"))) == [C.collapsed_lines((x or "").replace("\xad", "").replace("invest-\nm", "investm"), " ").replace("\x07", "") if x != ODD[3] else "a\x07b c d" for x in ODD]


def test_hyphens(spark):
    assert values(spark, X.normalize_text(F.col("t")), ["invest- \nment   policy"]) == ["investment policy"]
    assert values(spark, X.normalize_semantic_text(F.col("t")), ["invest-\nment", "risk-adjusted"]) == ["investment", "risk-adjusted"]


def test_sentences(spark):
    texts = ["The U.S. market opened. Trading continued.", "", None, "no end", "A. 1 b? (C)"]
    assert values(spark, X.split_sentences(F.col("t")), texts) == [C.sentences(t or "") for t in texts]
    assert len(C.sentences(texts[0])) == 2


def test_hard_split(spark):
    assert [len(x) for x in values(spark, X.hard_split(F.col("t"), 1000), ["x" * 1200])[0]] == [1000, 200]
    assert values(spark, X.hard_split(F.col("t"), 3), ["", None]) == [[], []]
    with pytest.raises(ValueError):
        X.hard_split(F.col("t"), 0)


def test_signature_ignores_numbers_and_signs(spark):
    a, b, c = values(spark, X.signature(F.col("t")), ["Customer Agreement® 12", "7 customer agreement", "Été 3 plan"])
    assert a == b == "customer agreement" and c == "été plan"


def test_revision_codes(spark):
    got = values(spark, X.is_revision_code_section(F.col("t")), ["1.734382\nAB-C12-345\n1234", "FEES AND COMPENSATION", None, "", "2024"])
    assert got == [True, False, False, False, True]


def test_tabular(spark):
    rows = "\n".join(f"item {i} ${i}.00 {i}%" for i in range(8))
    assert values(spark, X.looks_tabular(F.col("t")), [rows, "plain text", None]) == [True, False, False]


def test_overlap(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d"]), ([], ["x"]), (["a"], ["b"]), (["a", "a"], ["a", "a"])], "p array<string>, c array<string>")
    assert [r[0] for r in df.select(X.common_overlap(F.col("p"), F.col("c"))).collect()] == [2, 0, 0, 2]


def test_markdown_table(spark):
    df = spark.createDataFrame([([["Fee", "A|B"], ["", None], ["x", "1"]],), ([],), (None,)], "r array<array<string>>")
    got = [r[0] for r in df.select(X.markdown_table(F.col("r"))).collect()]
    assert got[0] == "| Fee | A\\|B |\n| --- | --- |\n| x | 1 |" and got[1:] == ["", ""]


def test_display_and_embedding_text(spark):
    df = spark.createDataFrame([(["A", "B"], ["one", "two"], "x."), ([], ["one"], None)], "p array<string>, u array<string>, o string")
    shown = X.display_text(X.at("p", -1), F.col("o"), F.col("u"))
    rows = df.select(shown.alias("s"), X.embedding_text(F.col("p"), shown).alias("e")).collect()
    assert rows[0] == ("B\n\nx.\n\none\n\ntwo", "A > B\n\nx.\n\none\n\ntwo") and rows[1] == ("one", "one")


def test_small_forms(spark):
    assert values(spark, X.intent(F.col("t")), ["What FEE?", "my rmd", "beneficiaries", "hello", None]) == ["fees", "rmd", "beneficiary", "default", "default"]
    assert values(spark, X.preview(F.col("t")), ["x" * 121, "y"]) == ["x" * 120 + "…", "y"]
    df = spark.createDataFrame([("d", None, 3, 0.125), ("d", "§1", 3, 0.5), ("d", "", 0, 1.0)], "d string, s string, p int, v double")
    assert [tuple(r) for r in df.select(X.citation_label(F.col("d"), F.col("s"), F.col("p")), X.score_percent(F.col("v"))).collect()] == [("d §3", 13), ("d §1", 50), ("d", 100)]
