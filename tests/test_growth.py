"""Jobs whose cost grew faster than their tables: the work stays in its row, and results are those of a plain walk."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import summarize as Z
from weftline.plans import catalogue


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_similar_sentences_stay_in_their_row(spark, sf_dir):
    plan = plan_of(catalogue.QUERIES["sentence_pairs"](spark, sf_dir))
    assert "Join" not in plan and "Aggregate" not in plan and "Window" not in plan and "RepartitionByExpression [doc_id" not in plan


@pytest.mark.parametrize("at_once", [1, 50, 1 << 21])
def test_similar_sentences_by_brute_force(at_once, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(Z, "PAIRS_AT_ONCE", at_once)
    rng = random.Random(8)
    rows = [[[rng.choice("abcdefghijklmnop") for _ in range(rng.choice([0, 1, 3, 6]))] for _ in range(rng.choice([0, 1, 2, 30]))] for _ in range(25)]
    got = [[(p["i"], p["j"], p["cosine"]) for p in r] for r in Z.similar_sentences(0.6).func(pa.array(rows, pa.list_(pa.list_(pa.string())))).to_pylist()]
    for row, pairs in zip(rows, got, strict=True):
        bags = [Counter(s) for s in row]
        norms = [math.sqrt(sum(c * c for c in b.values())) for b in bags]
        found = {}
        for i in range(len(row)):
            for j in range(i + 1, len(row)):
                dot = sum(c * bags[j][w] for w, c in bags[i].items())
                if dot and dot / (norms[i] * norms[j]) >= 0.6:
                    found[i, j] = dot / (norms[i] * norms[j])
        assert {(i, j): np.float64(c) for i, j, c in pairs} == found and len(pairs) == len(found)


def test_graphemes_become_no_strings(spark, sf_dir):
    for name in ("gleu", "rouge_graphemes"):
        assert "regexp_extract_all" not in plan_of(catalogue.QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("at_once", [1, 1 << 20])
def test_grapheme_overlaps_by_brute_force(spark, at_once, monkeypatch):
    import pyarrow as pa

    from weftline.functions import metrics as M
    from weftline.functions import text as T

    monkeypatch.setattr(M, "GRAMS_AT_ONCE", at_once)
    rng = random.Random(9)
    letters = ["a", "b", "c", " ", " ", "́", "ẹ́", "\U0001d11e", "ක්", "\n", " ́"]
    rows = [tuple("".join(rng.choice(letters[: rng.choice([2, 11])]) for _ in range(rng.choice([0, 1, 4, 40]))) for _ in range(2)) for _ in range(120)] + [(None, "ab"), ("", ""), ("́", "́a")]
    # Very many different characters: four of them and a row do not fit into 64 bits.
    many = "".join(map(chr, rng.sample(range(0x4E00, 0x9FFF), 15000))) + "".join(map(chr, rng.sample(range(0x20000, 0x2A6DF), 20000)))
    rows.append((many, many[7:] + many[:9]))
    frame = spark.createDataFrame(rows, "a string, b string")
    split = frame.select(F.coalesce(T.graphemes(F.col("a")), F.array().cast("array<string>")).alias("a"), F.coalesce(T.graphemes(F.col("b")), F.array().cast("array<string>")).alias("b")).collect()
    got = M.grapheme_common((1, 2, 3, 4)).func(pa.array([a for a, _ in rows], pa.string()), pa.array([b for _, b in rows], pa.string())).to_pylist()
    for r, found in zip(split, got, strict=True):
        grams = [[Counter(zip(*(x[k:] for k in range(n)))) for x in (r.a, r.b)] for n in (1, 2, 3, 4)]
        assert found == [*(sum((x & y).values()) for x, y in grams), len(r.a), len(r.b)]


def test_ends_are_trimmed_as_the_pattern_does(spark):
    from weftline.functions import text as T

    rng = random.Random(10)
    rows = [("".join(rng.choice([*T.BLANKS, "a", "é", "​", "."]) for _ in range(rng.choice([0, 1, 2, 6, 12]))),) for _ in range(2000)] + [(None,)] + [(f"a{chr(c)}b{chr(c)}",) for c in range(1, 0x3100)]
    d = spark.createDataFrame(rows, "t string")
    trimmed, split = F.regexp_replace("t", f"^[{T.WS}]+|[{T.WS}]+$", ""), F.filter(F.split("t", f"[{T.WS}]+"), lambda w: w != "")
    assert d.where(~trimmed.eqNullSafe(T.trim_ws(F.col("t"))) | ~split.eqNullSafe(T.words(F.col("t")))).count() == 0


def test_units_are_searched_once(spark, sf_dir):
    from weftline.functions import text as T

    d = spark.createDataFrame([("1,250.5 million and crore . 12, 3 x, ten  lakh 4 thousand 2.5billion",)], "t string").select(T.number_units(F.col("t")).alias("u"))
    assert plan_of(d).count("regexp_extract_all") == 1
    assert [r.number for r in d.first().u] == [1250, 12, 4, 2]


def test_sums_join_no_row_to_its_edits(spark, sf_dir):
    from weftline.operators import corrections as C
    from weftline.plans import correction_queries as Q

    rows = Q.tasks(spark, sf_dir)
    sums = C.sums_with_unseen(rows, F.col("id") % 3 == 0, "category")
    plan = plan_of(sums)
    assert "LeftOuter" not in plan and "source" not in plan
    e = C.with_edits(rows)
    taught = e.where("id % 3 = 0").select(F.explode("gold_pairs").alias("p")).select("p.old", "p.new")
    before = C.partial_sums(C.mark_unseen(e, taught), ["category"])
    names = sorted(before.columns)
    assert sorted(map(tuple, sums.select(names).collect()), key=repr) == sorted(map(tuple, before.select(names).collect()), key=repr)


def test_pages_of_a_range_are_cleaned_once_by_all_tasks(spark, tmp_path, monkeypatch):
    from weftline.streaming import crawl as W

    from weftline.plans import stream_queries as V

    plans, keep = [], V.stored
    monkeypatch.setattr(V, "stored", lambda df, tag: plans.append(plan_of(df)) or keep(df, tag))
    monkeypatch.setattr(W, "crawl", lambda spark, folder, fetch, **how: fetch(0, how["end"]).selectExpr("id", "0 AS batch", "true AS alive", "words"))
    spark.createDataFrame([(k, "u", "<p>" + "word " * k + "</p>") for k in range(30)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    rows = catalogue.QUERIES["incremental_crawl"](spark, str(tmp_path)).collect()
    assert {(r.id, r.words) for r in rows} == {(3 * k + k % 2, k) for k in range(10, 30)}
    assert plans and all("Repartition" in p and p.count("<[^>]+>") == 1 for p in plans)
