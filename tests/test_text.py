"""Text functions on hand-made cases, for both profiles."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.profiles import LATIN, SINHALA
from weftline.operators import quality as Q


def value(spark, column, **inputs):
    frame = spark.range(1).select(*(F.lit(v).alias(k) for k, v in inputs.items()))
    return frame.select(column.alias("x")).first()["x"]


def test_clean_text(spark):
    assert value(spark, T.clean_text(F.col("t")), t=" <b>A</b> see http://x.y/z?q www.a.b\tend\n") == "A see end"
    assert value(spark, T.clean_text(F.col("t")), t=None) == ""


def test_nfc_in_both_branches(spark):
    frame = spark.createDataFrame([("é",), ("plain",), (None,), ("ශ්",)], "t string")
    got = [r[0] for r in frame.select(T.nfc(F.col("t"))).collect()]
    assert got == ["é", "plain", None, unicodedata.normalize("NFC", "ශ්")]


def test_graphemes_of_sinhala(spark):
    # The virama joins the letter before it; vowel signs and the joiner stand alone; blanks go.
    got = value(spark, T.graphemes(F.col("t")), t="ශ්‍රී a")
    assert got == ["ශ්", "‍", "ර", "ී", "a"]


@pytest.mark.parametrize("text,want", [("Short. This sentence is long enough! And so is this one?  No", ["This sentence is long enough!", "And so is this one?"]), ("", []), ("no end but long enough", ["no end but long enough"])])
def test_sentences(spark, text, want):
    assert value(spark, T.sentences(F.col("t")), t=text) == want


@pytest.mark.parametrize("n,want", [(2, "other"), (3, "short"), (5, "short"), (6, "medium"), (7, "medium"), (8, "long"), (10, "long"), (11, "other")])
def test_bands(spark, n, want):
    assert value(spark, T.band(F.lit(n))) == want


def test_glue_border(spark):
    assert value(spark, T.word_glue(F.col("t"), SINHALA), t="අ" * 23) is None
    assert value(spark, T.word_glue(F.col("t"), SINHALA), t="අ" * 12 + "‍" + "ක" * 11) == "word_glue:" + "අ" * 12 + "‍" + "ක" * 11


def test_units_of_sinhala(spark):
    pairs = value(spark, T.number_units(F.col("t"), SINHALA), t="දශ ලක්ෂ 15,000 සහ 3.5 බිලියන")
    assert [(p.number, p.unit) for p in pairs] == [(15000, "මිලියන"), (4, "බිලියන")]
    wrong = T.unit_mismatch(T.number_units(F.lit("ලක්ෂ 476"), SINHALA), T.number_units(F.lit("මිලියන 476"), SINHALA))
    assert value(spark, wrong) == "unit_mismatch:476:ලක්ෂ"


@pytest.mark.parametrize(
    "title,content,want",
    [("", "x" * 400, "missing_field"), ("A fine title", "x" * 299, "content_too_short"), ("A fine title", "x" * 10001, "content_too_long"), ("Short", "x" * 300, "title_too_short"), ("t" * 201, "x" * 300, "title_too_long"),
     ("A fine title", "1" * 300, "content_not_in_script"), ("1234567890", "x" * 300, "title_not_in_script"), ("A fine title", "x" * 300, "ok"), ("A fine title", "x" * 10000, "ok"), ("A" * 10, "x" * 300, "ok"), (None, None, "missing_field")],
)
def test_article_reasons(spark, title, content, want):
    frame = spark.createDataFrame([(title, content)], "title string, content string")
    assert frame.select(Q.article_reason(F.col("title"), F.col("content"))).first()[0] == want


@pytest.mark.parametrize(
    "summary,want",
    [("", "empty"), (None, "empty"), ("bad � char here", "replacement_char"), ("# head", "markdown_header"), ("́x", "leading_combining_mark"), ("rewritten article says so", "meta_commentary:rewritten article"), ("too few words", "too_short"),
     ("w " * 60, "over_word_cap:60>45"), ("w " * 8, None), ("1. w w w w w w w w", None), ("w " * 7 + "77", "hallucinated_numbers:77"), ("w " * 7 + "20", None)],
)
def test_summary_reasons(spark, summary, want):
    frame = spark.createDataFrame([(summary, "w " * 100)], "s string, a string")
    assert frame.select(Q.summary_reason(F.col("s"), F.col("a"), "short", LATIN)).first()[0] == want


def test_versions_and_families(spark):
    frame = spark.createDataFrame([("grammar_v27",), ("style_v9.50",), ("plain",), ("mt5_small_v01",)], "n string")
    got = [tuple(r) for r in frame.select(T.version_of(F.col("n")), T.family_of(F.col("n"))).collect()]
    assert got == [(27.0, "grammar"), (9.5, "style"), (None, "custom"), (1.0, "mt5")]


def test_composite(spark):
    frame = spark.createDataFrame([("Category: Sports\nArticle: a\nb",), ("just text",)], "f string")
    assert [tuple(r) for r in frame.select(*Q.composite(F.col("f"))).collect()] == [("Sports", "a\nb"), ("General", "just text")]


def test_table_functions(spark):
    from weftline.functions.register import register

    register(spark)
    spark.createDataFrame([(1, "One is here now.  Two is there then.", "One was here now. Two is there"), (2, None, None), (3, "", "a")], "id int, a string, b string").createOrReplaceTempView("weftline_pairs")

    def rows(call):
        return [tuple(r) for r in spark.sql(f"SELECT d.id, r.* FROM weftline_pairs d, LATERAL {call} AS r ORDER BY 1, 2").collect()]

    assert rows("text_sentence_rows(d.a)") == [(1, 0, "One is here now."), (1, 1, "Two is there then.")]
    assert [r[2] for r in rows("text_word_rows(d.a)")] == "One is here now. Two is there then.".split()
    edits = spark.sql("SELECT d.id, r.* FROM weftline_pairs d, LATERAL text_edit_rows(d.a, d.b) AS r WHERE d.id <> 2 ORDER BY 1, 2").collect()
    assert [tuple(r) for r in edits] == [(1, 1, 2, ["is"], ["was"]), (1, 7, 8, ["then."], []), (3, 0, 0, [], ["a"])]
