"""What is costly is worked out once for a row: no filter or branch puts it into the plan a second time."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.profiles import LATIN
from weftline.plans import catalogue


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_issues_are_found_once(spark, sf_dir):
    plan = plan_of(catalogue.QUERIES["issue_counts"](spark, sf_dir))
    assert plan.count("ArrowEvalPython") == 1 and plan.count("```") == plan_of(catalogue.QUERIES["rewrite_issues"](spark, sf_dir)).count("```")


def test_blanks_and_letters_by_their_definition(spark):
    texts = ["", " ", "\t", "a b", "a  b\t\tc \t d", "\t\ta", "x\r\n\r\n\r\n y", "é1ü ß?", "日本 ab", "12"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    plain = T.trim_ws(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("t", F.lit("")), "\r\n", "\n"), r"[ \t]+", " "), r"\n{3,}", "\n\n"))

    def left(letters):
        return F.length(F.regexp_replace("t", f"[^{letters}]", ""))

    share = F.coalesce(F.try_divide(left(LATIN.block), left(f"{LATIN.block}A-Za-z")), F.lit(0.0))
    for r in df.select("t", T.style_text(F.col("t")).alias("a"), plain.alias("b"), T.letter_ratio(F.col("t")).alias("c"), share.alias("d")).collect():
        assert (r.a, r.c) == (r.b, r.d), r.t


def test_subsequences_are_found_without_strings(spark, sf_dir):
    assert "regexp_extract_all" not in plan_of(catalogue.QUERIES["rouge_l"](spark, sf_dir))


@pytest.mark.parametrize("whole", [0, 3, 2048])
def test_subsequences_in_a_band(whole, monkeypatch):
    from weftline.functions import metrics as M

    monkeypatch.setattr(M, "LCS_WHOLE", whole)
    rng = random.Random(3)
    for _ in range(150):
        k = rng.choice([2, 4, 30])
        x = [rng.randrange(k) for _ in range(rng.choice([0, 1, 5, 60, 250]))]
        y = [rng.randrange(k + 1) for _ in range(rng.choice([0, 1, 5, 60, 250]))] if rng.random() < 0.5 else [v for v in x if rng.random() > 0.1]
        for _ in range(rng.choice([0, 3, 90])):
            y.insert(rng.randrange(len(y) + 1), rng.randrange(k))
        row = [0] * (len(y) + 1)
        for a in x:
            before, row = row, [0]
            for j, b in enumerate(y):
                row.append(before[j] + 1 if a == b else max(before[j + 1], row[j]))
        assert M._lcs(x, y) == row[-1]


def test_subsequences_of_graphemes(spark):
    from weftline.functions import metrics as M

    texts = ["", "a b c", "b ẹ́ a\nc", "́a ́b", "ක් ක ම", "\U0001d11e a", None, "xyz" * 90]
    df = spark.createDataFrame([(x, y) for x in texts for y in texts], "a string, b string")
    g = df.select("*", *(F.coalesce(T.graphemes(F.col(c)), F.array().cast("array<string>")).alias(f"g{c}") for c in "ab"))
    for r in g.select(M.grapheme_lcs("a", "b").alias("found"), M.lcs_length("ga", "gb").alias("n"), F.size("ga").alias("na"), F.size("gb").alias("nb")).collect():
        assert r.found == [r.n, r.na, r.nb]
