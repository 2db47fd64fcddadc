"""Edit scripts, candidates and scores on hand-made cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import edits as E
from weftline.operators import corrections as C

SOURCE = "The quick brown fox jumps over the lazy dog near the river bank today 12 times"


def script(*operations):
    return json.dumps([dict(zip("seon", o)) for o in operations])


CASES = [
    ("KEEP", "KEEP", []),
    (script((4, 9, "quick", "quiet")), "APPLIED", []),
    (script((4, 4, "", "very ")), "APPLIED", []),
    (script((4, 10, "quick ", "")), "APPLIED", []),
    ("{", "INVALID", None),
    ("[]", "INVALID", ["script_must_be_KEEP_or_nonempty_list"]),
    ("{}", "INVALID", ["script_must_be_KEEP_or_nonempty_list"]),
    (script((True, 9, "quick", "x")), "INVALID", ["offset_type"]),
    (script((4, 9, "quick", 5)), "INVALID", ["text_type"]),
    (script((4, 900, "quick", "x")), "INVALID", ["offset_range"]),
    (script((4, 9, "quick", "x"), (8, 10, "k ", "y")), "INVALID", ["operations_overlap_or_share_start"]),
    (script((4, 9, "quack", "x")), "INVALID", ["old_text_mismatch"]),
    (script((4, 9, "quick", "quick")), "INVALID", ["no_op"]),
    ('[{"s":1,"e":2,"o":"h"}]', "INVALID", ["operation_schema"]),
    (script(*[(0, 0, "", "x")] * 33), "INVALID", ["too_many_operations"]),
    (script((70, 72, "12", "13")), "REJECTED", ["number_mutation"]),
    (script((4, 9, "quick", "qu‍ick")), "REJECTED", ["latin_span_mutation", "unicode_format_control_mutation"]),
]


@pytest.mark.parametrize("text,status,reasons", CASES)
def test_apply(spark, text, status, reasons):
    frame = spark.createDataFrame([(SOURCE, text)], "source string, script string")
    row = C.apply_scripts(frame).first()
    if status == "APPLIED":  # Latin words are protected, so any change of one is refused unless the text has another script
        assert row.status == "REJECTED" and row.reasons == ["latin_span_mutation"] and row.text == SOURCE
    else:
        assert row.status == status and row.text == SOURCE and (reasons is None or row.reasons == reasons)


def test_round_trip_in_another_script(spark):
    pairs = [("ගෙදර යනව මම අද", "ගෙදර යනවා මම අද"), ("අපි ගෙදර යමු", "අපි ගෙදර යමු"), ("එක දෙක තුන හතර පහ", "එක දෙක හතර පහ")]
    frame = spark.createDataFrame(pairs, "source string, target string").withColumn("script", E.make_script("source", "target"))
    for r in C.apply_scripts(frame).collect():
        assert r.status == ("KEEP" if r.source == r.target else "APPLIED") and r.text == r.target


def test_unfinished_and_loops(spark):
    loop = "එක දෙක තුන හතර " * 3
    frame = spark.createDataFrame([("එක දෙක තුන හතර පහ හය හත අට නවය දහය එක දෙක තුන", loop), (loop, loop + "x"), ("a", None), ("a", "a")], "source string, candidate string")
    got = [(r.status, r.reasons) for r in C.validate_candidates(frame, finished=F.lit(False)).collect()]
    assert got[0][0] == "REJECTED" and "repetition_loop" in got[0][1] and "generation_cap_or_missing_eos" in got[0][1]
    assert "repetition_loop" not in got[1][1] and got[2] == ("INVALID", ["empty_candidate"]) and got[3] == ("KEEP", [])


@pytest.mark.parametrize(
    "source,target,error",
    [("a b c", "a x c", None), ("a b b", "a b x", "replacement_source_span_not_unique"), ("a b", "a b c", "replacement_format_does_not_support_insert_or_delete"), ("a b", "a b", None)],
)
def test_replacements(spark, source, target, error):
    frame = spark.createDataFrame([(source, target)], "s string, t string").withColumn("c", E.word_edits(F.split("s", " +"), F.split("t", " +"))).withColumn("r", E.make_replacements("s", "t", "c"))
    row = frame.withColumn("back", E.replacements_to_script("s", F.coalesce("r.script", F.lit("KEEP")))).first()
    assert row.r.error == error and row.back.error is None


def test_replacement_lines(spark):
    frame = spark.createDataFrame([("one  two three four", "one  two 3 four five".replace(" five", "")), ("a b c d", "a x y d")], "s string, t string")
    made = frame.withColumn("c", E.word_edits(F.split("s", " +"), F.split("t", " +"))).withColumn("r", E.make_replacements("s", "t", "c"))
    got = made.withColumn("back", E.replacements_to_script("s", "r.script")).collect()
    assert [r.r.script for r in got] == ["REPLACE ||| three ||| 3", "REPLACE ||| b c ||| x y"]
    assert [json.loads(r.back.script) for r in got] == [[{"s": 9, "e": 14, "o": "three", "n": "3"}], [{"s": 2, "e": 5, "o": "b c", "n": "x y"}]]


@pytest.mark.parametrize(
    "script_text,error",
    [("", "replacement_operation_count"), ("REPLACE ||| a", "replacement_line_schema"), ("REPLACE ||| a ||| a", "replacement_empty_or_no_op"), ("REPLACE ||| b ||| x", "replacement_source_span_not_unique"),
     ("REPLACE ||| a b ||| x\nREPLACE ||| a ||| y", "replacement_operations_overlap"), (" KEEP ", None), ("REPLACE ||| a ||| x\rREPLACE ||| c ||| y", None)],
)
def test_replacement_errors(spark, script_text, error):
    frame = spark.createDataFrame([("a b b c", script_text)], "s string, x string")
    assert frame.select(E.replacements_to_script("s", "x").alias("r")).first().r.error == error


def test_metrics_by_hand(spark):
    rows = [("1", "c", "d1", "a b c", "a x c", "a x c"), ("2", "c", "d1", "a b c", "a x c", "a b c"), ("3", "c", "d2", "a b", "a b", "a z"), ("4", "c", "d2", "a b", "a b", "a b")]
    frame = spark.createDataFrame(rows, "id string, category string, document string, source string, target string, prediction string")
    e = C.with_edits(frame).withColumn("unseen", F.col("gold"))
    m = C.metrics(C.partial_sums(e, ["category"]), ["category"]).first()
    assert (m.n, m.n_changed, m.n_clean, m.s_gold, m.s_made) == (4, 2, 2, 2, 2)
    assert (m.exact_match, m.change_needed_exact, m.clean_preservation, m.edit_precision, m.edit_recall) == (0.5, 0.5, 0.5, 0.5, 0.5)
    assert m.undercorrection_rate == 0.5 and m.wrong_correction_rate == 0.0
    for r in C.bootstrap(e, samples=50).collect():
        assert 0 <= r.low <= r.high <= 1


def test_split_shares_no_pair(spark):
    rows = [(str(k), f"w{k % 40} same b{k}", f"x{k % 40} same b{k}" if k % 3 else f"w{k % 40} same b{k}") for k in range(120)]
    frame = spark.createDataFrame(rows, "id string, source string, target string").withColumns({"prediction": F.col("source"), "category": F.lit("c"), "document": F.col("id")})
    e = C.with_edits(frame)
    s = C.pair_disjoint_split(e, most_uses=3).join(e, "id")
    pairs = {k: {str(p) for r in s.where(F.col("split") == k).collect() for p in r.gold_pairs} for k in ("dev", "train")}
    assert pairs["dev"] and not pairs["dev"] & pairs["train"]


def test_empty_tables(spark):
    frame = spark.createDataFrame([], "id string, category string, document string, source string, target string, prediction string")
    e = C.with_edits(frame).withColumn("unseen", F.col("gold"))
    assert C.metrics(C.partial_sums(e, ["category"]), ["category"]).count() == 0
    assert C.apply_scripts(frame.withColumn("script", F.lit("KEEP"))).count() == 0


def test_consensus_and_divergence_against_plain_ratios(spark):
    import difflib
    import random

    draw = random.Random(5)
    texts = [["".join(draw.choice("ab c") for _ in range(draw.randint(0, 30))) for _ in range(4)] for _ in range(40)]

    def alike(a, b):
        return difflib.SequenceMatcher(None, a, b).ratio()

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t array<string>")
    got = rows.select("id", E.pick_consensus("t").alias("chosen"), E.style_divergence(F.col("t")[0], F.col("t")[1]).alias("far")).orderBy("id").collect()
    for r, t in zip(got, texts, strict=True):
        support = [sum(alike(a, b) for b in t) for a in t]
        assert support[t.index(r.chosen)] == pytest.approx(max(support))
        assert r.far == pytest.approx(100 * (1 - alike(t[0], t[1])))


@pytest.mark.parametrize("n", [1, 2, 100, 4096, 4097, 13_000])
def test_drawn_counts_are_a_multinomial(n):
    """Each sample draws n documents in all, and a document's count has mean 1 and variance 1 - 1/n."""
    parts = [C.drawn_counts(n, 200, 7, leaf) for leaf in range(-(-n // C.LEAF))]
    counts = np.concatenate(parts, axis=1)
    assert counts.shape == (200, n) and (counts.sum(axis=1) == n).all() and (counts >= 0).all()
    if n >= 100:
        assert abs(counts.var() - (1 - 1 / n)) < 0.05 and abs(np.corrcoef(counts[:, 0], counts[:, n // 2])[0, 1]) < 0.3


def test_bootstrap_agrees_with_explicit_draws(spark):
    """Intervals of a ratio of sums over 5,000 documents: by the tree of ranges, and by 1,000 explicit samples."""
    r = np.random.default_rng(1)
    part, whole = r.integers(0, 20, 5000), r.integers(20, 60, 5000)
    rows = spark.createDataFrame([(k + 1, int(a), int(b)) for k, (a, b) in enumerate(zip(part, whole, strict=True))], "place long, a long, b long").repartition(7)
    sums = C.resampled_sums(rows, ["a", "b"], 5000, 1000, 42).toPandas()
    picks = r.integers(0, 5000, (1000, 5000))
    direct = part[picks].sum(axis=1) / whole[picks].sum(axis=1)
    got = np.percentile(sums["a"] / sums["b"], [2.5, 97.5])
    want = np.percentile(direct, [2.5, 97.5])
    assert len(sums) == 1000 and np.abs(got - want).max() < 0.1 * (want[1] - want[0])


def test_checks_as_rows_agree_with_the_parser(spark):
    """check_operations() finds the first error that the row-at-a-time parser finds."""
    ok = {"s": 0, "e": 3, "o": "The", "n": "A"}
    cases = [
        [], [ok], [ok, {"s": 3, "e": 3, "o": "", "n": "!"}], [ok, ok], [ok, {**ok, "s": 2}], [{**ok, "o": "the"}], [{**ok, "n": "The"}], [{**ok, "e": 99_999}], [{**ok, "s": -1}], [{**ok, "s": 5}], [{**ok, "s": True}],
        [{**ok, "e": 3.0}], [{**ok, "n": None}], [{**ok, "n": ["A"]}], [{"s": 0}], [7], [{**ok, "x": {"a": 1}}], [ok] * 33, {"s": 0}, "KEEP", [ok, {"s": 4, "e": 9, "o": "quick", "n": "slow"}, {**ok, "s": 9}, 5],
    ]
    scripts = [json.dumps(c) for c in cases] + ["KEEP", " KEEP\n", "", "[", "nothing"]
    rows = [(k, SOURCE, x) for k, x in enumerate(scripts)] + [(900, None, json.dumps([ok])), (901, SOURCE, None)]
    got = {r.id: r for r in E.check_operations(spark.createDataFrame(rows, "id int, source string, script string"), "id", "source", "script").collect()}
    assert len(got) == len(rows)
    for k, source, x in rows:
        operations, error = E._parse(source or "", x or "")
        assert (got[k].error or "").split(":")[0] == (error or "").split(":")[0], (x, got[k], error)
        assert error or got[k].operations == len(operations)
