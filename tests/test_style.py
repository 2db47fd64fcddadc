"""Style correctness against a plain version of its rule, and overlaps of n-grams against counters."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.functions import metrics as M
from weftline.functions import style as Y
from weftline.functions.profiles import LATIN

NUMBER = r"\d+(?:[.,]\d+)?"


def plain(original, rewritten):
    def normal(t):
        return re.sub(r"\s+", " ", re.sub("[​‌‍﻿]", "", t or "")).strip()

    o, r = normal(original), normal(rewritten)
    no, nr = Counter(re.findall(NUMBER, o)), Counter(re.findall(NUMBER, r))

    def tokens(t):
        return re.findall(rf"[{LATIN.block}]+|{NUMBER}", t)

    fo, fr = (Counter(w for w in tokens(t) if w not in LATIN.stopwords and (re.search(r"\d", w) or len(w) > 2)) for t in (o, r))

    def kept(a, b):
        return 100 * (a & b).total() / a.total() if a else 100.0

    extra = 100.0 if not nr else max(0.0, 100 - 200 * (nr - no).total() / nr.total())
    go, gr = (Counter(t[i : i + 3] for i in range(len(t) - 2)) for t in (o, r))
    norm = math.sqrt(sum(v * v for v in go.values())) * math.sqrt(sum(v * v for v in gr.values()))
    cosine = sum(go[g] * gr[g] for g in go) / norm if norm else 0.0
    x = len(r) / len(o) if o else None
    length = 0.0 if x is None else max(0.0, 100 - abs(x - 1) * (200 if 0.6 <= x <= 1.4 else 100))
    w = tokens(r)
    repeated = sum(w[i : i + 3] == w[i + 3 : i + 6] for i in range(len(w) - 5)) if len(w) >= 8 else 0
    quality = 0.0 if not r else 30.0 if len(r) < 100 or repeated >= 3 else 100.0
    numbers = 0.75 * kept(no, nr) + 0.25 * extra
    overall = 0.3 * numbers + 0.35 * kept(fo, fr) + 20 * cosine + 0.1 * length + 0.05 * quality
    return [round(v, 6) for v in (numbers, kept(fo, fr), 100 * cosine, length, quality, overall)], o == r, sorted(no - nr), sorted(nr - no), sorted(fo - fr)


LONG = "The budget of 2024 rose by 3.5 percent to 1,200 million, said the minister of finance on 3/4/2025 in the capital after the third reading. "
CASES = [
    (LONG, LONG), (LONG, LONG.replace("2024", "2023")), (LONG * 2, LONG), (LONG, LONG * 2), (LONG, LONG[:80]), (LONG, ""), ("", LONG), (None, None), (LONG, None),
    ("5 and 5 and 6.50", "5 and 6.5 and 7 and 7"), ("no numbers here at all", "no numbers 12 here"), ("x", "x"), ("ab", "abc"), (LONG, "one two three " * 30), (LONG, "​" + LONG.replace(" ", "\t ")),
    (LONG, LONG[: int(len(LONG) * 0.6)]), (LONG, LONG + LONG[: int(len(LONG) * 0.4)]), ("çà été 12", "ÇA été 12"),
]


def test_style_scores(spark):
    df = spark.createDataFrame([(k, o, r) for k, (o, r) in enumerate(CASES)], "id int, original string, rewritten string").withColumn("overall", F.lit("clash"))
    got = {r.id: r for r in Y.with_style_scores(df, "original", "rewritten").collect()}
    for k, (o, r) in enumerate(CASES):
        row = got[k]
        scores = [round(row[c], 6) for c in ("numbers", "facts", "content_similarity", "length", "quality", "overall")]
        assert (scores, row.verbatim, row.missing_numbers, row.extra_numbers, row.missing_facts) == plain(o, r), (o, r)


def test_length_slope_and_tiers(spark):
    df = spark.range(1).select(*(Y.length_score(F.lit("x" * 100), F.lit("x" * n)).alias(str(n)) for n in (100, 90, 141, 59, 201, 0)), *(Y.tier(F.lit(s)).alias(f"t{s}") for s in (90, 89, 70, 60, 59)))
    row = df.first()
    assert [round(row[k], 6) for k in range(6)] == [100.0, 80.0, 59.0, 59.0, 0.0, 0.0]
    assert list(row)[6:] == ["excellent", "good", "acceptable", "needs improvement", "poor"]


@pytest.mark.parametrize("at_once", [1, 50, 1 << 20])
def test_overlaps_count_occurrences(spark, monkeypatch, at_once):
    monkeypatch.setattr(M, "GRAMS_AT_ONCE", at_once)
    r = random.Random(at_once)
    rows = [(k, [r.choice("abcé") for _ in range(r.randrange(12))], [r.choice("abcé") for _ in range(r.randrange(12))]) for k in range(80)] + [(80, None, ["a"]), (81, [], []), (82, ["a"] * 3000, ["a"] * 2000)]
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>").repartition(3)
    got = {x.id: x for x in M.overlaps(df, "a", "b", {"1": 1, "3": 3, "2": 2}).collect()}
    for k, a, b in rows:
        for n in (1, 2, 3):
            ga, gb = (Counter(tuple(t[i : i + n]) for i in range(len(t or []) - n + 1)) for t in (a or [], b or []))
            assert (got[k][f"common_{n}"], got[k][f"a_{n}"], got[k][f"b_{n}"]) == ((ga & gb).total(), ga.total(), gb.total())


def test_plan_of_overlaps_has_no_exchange(spark):
    df = spark.createDataFrame([(1, ["a"], ["b"])], "id int, a array<string>, b array<string>")
    plan = M.overlaps(df, "a", "b", {"1": 1, "4": 4})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_char_cosine_of_short_texts(spark):
    df = spark.createDataFrame([(1, "ab", "ab"), (2, "ab", "abc"), (3, "", "abc"), (4, None, None), (5, "😀😀😀😀", "😀😀😀x"), (6, "ab", "ab\0")], "id int, a string, b string")
    got = {r.id: (round(r.x, 6), round(r.y, 6)) for r in df.select("id", M.char_cosine(3, True)("a", "b").alias("x"), M.char_cosine(3, False)("a", "b").alias("y")).collect()}
    assert got == {1: (1.0, 0.0), 2: (0.0, 0.0), 3: (0.0, 0.0), 4: (0.0, 0.0), 5: (round(2 / math.sqrt(8), 6), round(2 / math.sqrt(8), 6)), 6: (0.0, 0.0)}
