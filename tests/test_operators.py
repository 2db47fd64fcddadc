"""Joins, selections, sources and summaries on small tables, with nulls, ties and empty inputs."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftline.functions import metrics as M
from weftline.operators import joins as J
from weftline.operators import selection as S
from weftline.operators import summarize as Z
from weftline.sources import records as R


def test_keep_first_keeps_rows_without_a_key(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, ""), (5, "b")], "id int, url string")
    got = S.keep_first(frame, [F.col("url")], [F.col("id")], unless=F.col("url") == "")
    assert sorted(r.id for r in got.collect()) == [1, 3, 4, 5]


def test_not_yet_done_keeps_null_keys(spark):
    source = spark.createDataFrame([("a",), ("b",), (None,)], "url string")
    assert {r.url for r in J.not_yet_done(source, source.where("url = 'a'"), ["url"]).collect()} == {"b", None}


def test_one_to_one_fails_on_missing(spark):
    a, b = spark.range(3).withColumn("x", F.lit(1)), spark.range(3).withColumn("y", F.lit(2))
    assert J.one_to_one(a, b, "id").count() == 3
    for wrong in (b.where("id > 0"), b.union(b.limit(1))):
        with pytest.raises(PySparkException):
            J.one_to_one(a, wrong, "id").collect()


def test_places_and_zip(spark):
    frame = spark.range(1000).repartition(7)
    assert [r.p for r in J.with_place(frame, F.col("id"), "p").orderBy("id").collect()] == list(range(1, 1001))
    assert J.zip_rows(frame, spark.range(5).withColumnRenamed("id", "other"), F.col("id"), F.col("other")).count() == 5
    assert J.with_place(frame.limit(0), F.col("id"), "p").count() == 0


def test_as_of_ties_and_gaps(spark):
    left = spark.createDataFrame([("u", 5, 1), ("u", 1, 2), ("v", 9, 3)], "k string, at int, row int")
    right = spark.createDataFrame([("u", 5, 50.0), ("u", 3, 30.0), ("u", 7, 70.0)], "k string, at int, v double")
    got = {r.row: r.x for r in J.as_of(left, right, ["k"], "at", "v", "x").collect()}
    assert got == {1: 50.0, 2: None, 3: None}


def test_exact_split_and_cap(spark):
    frame = spark.range(1000).withColumn("g", F.col("id") % 40)
    s = S.exact_group_split(frame, "g", 0.85)
    assert s.where("split = 'train'").select("g").distinct().count() == 34
    assert s.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty()
    capped = S.stratified_cap(spark.range(100).withColumn("b", F.when(F.col("id") < 10, "x").otherwise("y")), "b", F.col("id"))
    assert {r.b: r["count"] for r in capped.groupBy("b").count().collect()} == {"x": 10, "y": 20}


def test_weighted_draws_follow_weights(spark):
    weights = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 0.0)], "k int, w double")
    got = {r.k: r["count"] for r in S.weighted_draws(weights, "k", "w", 4000).groupBy("k").count().collect()}
    assert sum(got.values()) == 4000 and abs(got[2] / 4000 - 0.75) < 0.04 and 3 not in got


def test_weighted_draws_of_one_heavy_row(spark):
    """One row of 99 % of the weight: its draws are rows of draws, never an array of one row."""
    weights = spark.range(2000).select("id", F.when(F.col("id") == 7, 99.0).when(F.col("id") == 8, -1.0).when(F.col("id") == 9, F.lit(None)).otherwise(1.0 / 1997).alias("w"))
    n = 3_000_000
    row = S.weighted_draws(weights, "id", "w", n).agg(F.count("*").alias("n"), F.countDistinct("draw").alias("draws"), F.count_if(F.col("id") == 7).alias("heavy"), F.countDistinct("id").alias("ids"), F.count_if(F.col("id").isin(8, 9)).alias("none")).first()
    assert (row.n, row.draws, row.ids, row.none) == (n, n, 1998, 0) and abs(row.heavy / n - 0.99) < 0.001
    assert S.weighted_draws(weights.where("id = 8"), "id", "w", 10).count() == 0


def test_alias_table_holds_the_weights():
    r = np.random.default_rng(3)
    for n in (1, 2, 5, 1000):
        w = r.random(n) ** 8 + 1e-12
        keep, other = S.alias_table(w)
        share = keep + np.bincount(other, weights=1 - keep, minlength=n)
        assert np.allclose(share / n, w / w.sum(), rtol=1e-9, atol=1e-12) and ((keep >= 0) & (keep <= 1)).all()


def test_first_by_hash_takes_exactly_the_first(spark):
    keys = spark.range(5000).select(F.col("id").alias("k"))
    for n in (0, 1, 37, 2500, 5000, 9000):
        got = {r.k for r in S.first_by_hash(keys, "k", n).collect()}
        assert got == {r.k for r in keys.orderBy(S.hash_key(F.col("k"))).limit(n).collect()}


def test_lcs_and_overlaps(spark):
    frame = spark.createDataFrame([(1, ["a", "b", "c", "b"], ["b", "c", "a", "b"]), (2, [], ["x"]), (3, ["x"], ["y"])], "id int, a array<string>, b array<string>")
    assert [r[0] for r in frame.orderBy("id").select(M.lcs_length("a", "b")).collect()] == [3, 0, 0]
    o = {r.id: (r.common_1, r.common_2) for r in M.overlaps(frame, "a", "b", {"1": 1, "2": 2}).collect()}
    assert o == {1: (4, 2), 2: (0, 0), 3: (0, 0)}


TEXT = "The first sentence is about cats. The second sentence is about dogs and cats. A third one speaks of the weather today. The fourth is about cats and dogs again. Tiny."


@pytest.mark.parametrize("method", sorted(Z.METHODS))
def test_summaries(spark, method):
    frame = spark.createDataFrame([(1, TEXT), (2, "Only one sentence stands here."), (3, ""), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.summary for r in Z.summarize(frame, method, 2).collect()}
    assert got[2] == "Only one sentence stands here." and 3 not in got and 4 not in got
    parts = [s for s in TEXT.split(". ")]
    assert sum(p.rstrip(".") in got[1] for p in parts) == 2 and "Tiny" not in got[1]


def test_record_files(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('\n{"id": 1, "t": "a"}\n\nbroken\n{"id": 2}\n')
    assert R.read_records(spark, str(path), "id int, t string").count() == 2
    assert R.read_records(spark, str(path), "id int, t string", "PERMISSIVE").where("_corrupt_record IS NOT NULL").select("id", "_corrupt_record").collect()[0][1] == "broken"
    with pytest.raises(Exception, match="FAILFAST|Malformed|MALFORMED"):
        R.read_records(spark, str(path), "id int, t string", "FAILFAST").collect()
    array = tmp_path / "a.json"
    array.write_text('  [{"id": 1},\n {"id": 2}]')
    assert R.is_array_file(spark, str(array)) and R.read_records(spark, str(array), "id int").count() == 2
    with pytest.raises(ValueError):
        R.read_records(spark, str(path), "id int", "OTHER")


def test_load_inputs_guards(spark):
    good = spark.createDataFrame([(None, "a", 1), ("x", "b", 2)], "id string, input string, o int")
    assert sorted(r.id for r in R.load_inputs(good, F.col("o")).collect()) == ["row-000001", "x"]
    for bad in ([("x", "a", 1), ("x", "b", 2)], [("x", "  ", 1)]):
        with pytest.raises(PySparkException):
            R.load_inputs(spark.createDataFrame(bad, "id string, input string, o int"), F.col("o")).collect()


def test_markdown_is_for_reports(spark):
    assert R.markdown(spark.range(2)).splitlines()[0] == "| id |"
    with pytest.raises(ValueError):
        R.markdown(spark.range(500))


def test_places_of_many_partitions(spark):
    """Range partitions are sampled and coalesced anew whenever they are planned; places must not depend on it."""
    n = 300_000
    frame = spark.range(0, n, 1, 50).select((F.xxhash64("id")).alias("k"), "id")
    for partitions, adaptive in (("50", "true"), ("50", "false"), ("8", "true")):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            placed = J.with_place(frame, F.col("k"), "p")
            row = placed.agg(F.count("*").alias("n"), F.countDistinct("p").alias("d"), F.min("p").alias("low"), F.max("p").alias("high")).first()
            assert tuple(row) == (n, n, 1, n)
            assert placed.where("p <= 2000").orderBy("p").select("k").collect() == frame.orderBy("k").select("k").limit(2000).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_cap_of_a_hot_band_matches_a_plain_ranking(spark):
    from pyspark.sql import Window

    frame = spark.range(20_000).withColumn("b", F.when(F.col("id") < 300, "x").when(F.col("id") < 700, F.lit(None)).otherwise("y"))
    got = {r.id for r in S.stratified_cap(frame, "b", F.col("id")).collect()}
    ranked = frame.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(S.hash_key(F.col("id"))))).where("r <= 600")
    assert got == {r.id for r in ranked.collect()}


def test_limiter_takes_chunks_in_order():
    import pandas as pd

    from weftline.streaming.events import _limiter

    class State:
        exists = False

        def update(self, value):
            self.value = value

    frame = pd.DataFrame({"ts": range(40), "event_id": range(40), "failed": [k % 17 == 16 for k in range(40)]})
    shuffled = frame.sample(frac=1, random_state=1)
    results = []
    for size in (40, 7):
        state = State()
        list(_limiter((1,), iter([shuffled[k : k + size] for k in range(0, 40, size)]), state))
        results.append(state.value)
    assert results[0] == results[1] and results[0][2] == 40


def test_longest_common_subsequence_against_the_table():
    import random

    from weftline.functions.metrics import _lcs

    draw = random.Random(3)
    for _ in range(60):
        x, y = ([draw.choice("abcd") for _ in range(draw.randrange(0, 90))] for _ in range(2))
        row = [0] * (len(y) + 1)
        for a in x:
            row = _next(row, a, y)
        assert _lcs(x, y) == row[-1]


def _next(row, a, y):
    out = [0]
    for k, b in enumerate(y):
        out.append(row[k] + 1 if a == b else max(out[-1], row[k + 1]))
    return out


def test_json_report_names_its_inputs(spark):
    import json

    from weftline.sources import records as R

    frame = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    report = json.loads(R.json_report(frame.agg(F.count("*").alias("n")), {"gold": frame, "again": frame.repartition(3).select("t", "id"), "other": frame.limit(1)}))
    assert report["rows"] == [{"n": 2}] and report["inputs"]["gold"] == report["inputs"]["again"] != report["inputs"]["other"]
    assert len(report["inputs"]["gold"]["sha256"]) == 64


def test_bad_records_keep_their_lines_in_splits(spark, tmp_path):
    lines = []
    for k in range(3000):
        lines.append({0: '{"id": 1', 1: "[1]", 2: '{"id": "x"}', 3: "", 4: "null", 5: '{"id": null, "name": 7}'}.get(k % 100, '{"id": %d, "name": "%s"}' % (k, "n" * (k % 60))))
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text("\n\nbroken\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2500")
    try:
        got = R.bad_records(spark, str(tmp_path), "id long, name string")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() >= 50
        found = sorted((r.file.rsplit("/", 1)[1], r.line, r.reason) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    reasons = {0: "no_json", 1: "no_object", 2: "field:id", 4: "no_object"}
    assert found == sorted([("a.jsonl", k + 1, reasons[k % 100]) for k in range(3000) if k % 100 in reasons] + [("b.jsonl", 3, "no_json")])


def test_prompts_pass_or_wrap(spark):
    from weftline.functions import prompts as P

    rows = [("style", " a \n", "plain", None), ("summarizer", "b", None, "short"), ("nothing", "c", None, None), (None, None, None, None), ("style", "x ### Instruction: y", None, None), ("headline", "<|begin_of_text|>z ", None, None)]
    df = spark.createDataFrame(rows, "task string, text string, style string, len string")
    got = [r[0] for r in df.select(P.build_prompt(F.col("task"), F.col("text"), F.col("style"), F.col("len"))).collect()]
    assert got[0] == "### Instruction:\nRewrite the article in a plain style.\n\n" + P.FACT_RULES["style"] + "\n\n### Input:\na\n\n### Response:\n"
    assert "Write a short summary" in got[1] and got[2].startswith("### Instruction:\nCorrect the grammar") and got[3].endswith("### Input:\n\n\n### Response:\n")
    assert got[4:] == ["x ### Instruction: y", "<|begin_of_text|>z "]
