"""Corrections are judged once a row, and alignments are made once; results are those of the plain way."""

import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.functions import edits as E
from weftline.functions import text as T
from weftline.operators import corrections as C
from weftline.plans import catalogue


@pytest.mark.parametrize("name", ["edit_scripts", "candidate_validation"])
def test_reasons_are_found_once(spark, sf_dir, name):
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("quoted_span_mutation") == 1 and "Join" not in plan


def test_raw_and_safe_as_aligned_apart(spark):
    a = "The cat sat on the mat with 12 \"old\" dogs near www.site.org and x@y.org today"
    texts = [a, a.replace("cat", "dog"), a.replace("12", "13"), a.lower(), "", None, "  ", a + " " + a, a.replace('"old"', "old"), f" {a}\n", a.replace("www.site.org", "WWW.site.org")]
    rows = spark.createDataFrame([(k, "c", "d", a, t or "", c) for k, (t, c) in enumerate((t, c) for t in texts[:4] for c in texts)], "id long, category string, document string, source string, target string, candidate string")
    v = C.validate_candidates(rows).localCheckpoint()
    columns = ["id", "prediction", "gold", "made", "exact", "changed", "clean_preserved", "undercorrected", "wrong_corrected", "made_spans", "gold_pairs", "number_mutation", "protected_mutation"]
    got = C.raw_and_safe(rows.drop("document"))
    for kind, c in (("raw", "candidate"), ("safe", "text")):
        apart = C.with_edits(v.select("id", "category", "document", "source", "target", F.coalesce(c, F.lit("")).alias("prediction"))).join(v.select("id", "status", "reasons"), "id")
        one, other = (sorted(map(tuple, df.select(*columns, "status", "reasons").collect()), key=repr) for df in (got.where(F.col("kind") == kind), apart))
        assert one == other and len(one) == 44


def test_scripts_are_judged_as_before(spark):
    rows = [("aaa bbb", "KEEP"), ("aaa bbb", "["), ("aaa bbb", '[{"s":0,"e":3,"o":"aaa","n":"aab"}]'), ("say 'a' 5", '[{"s":8,"e":9,"o":"5","n":"6"}]')]
    got = [(r.status, r.reasons, r.text, r.operation_count) for r in C.apply_scripts(spark.createDataFrame(rows, "source string, script string")).collect()]
    assert got[0] == ("KEEP", [], "aaa bbb", 0) and got[1][0] == "INVALID" and got[1][1][0].startswith("invalid_json") and got[1][2:] == ("aaa bbb", 0)
    assert got[2] == ("REJECTED", ["latin_span_mutation"], "aaa bbb", 1) and got[3] == ("REJECTED", ["number_mutation"], "say 'a' 5", 1)


def test_spans_by_their_patterns(spark):
    rng = random.Random(4)
    parts = ["a", "B", " ", "'", '"', "“", "”", "«", "»", "@", ".", "x.y", "http://", "HTTPS://", "WwW.", "é", "\n"]
    texts = [tuple("".join(rng.choice(parts) for _ in range(rng.choice([0, 3, 12]))) for _ in range(2)) for _ in range(300)]
    df = spark.createDataFrame(texts, "a string, b string")
    none = E.safety_reasons(F.col("a"), F.col("b"), F.lit(1.0), F.lit(True), F.lit(False))
    plain = {name: ~T.same_multiset(T.all_matches(F.col("a"), p), T.all_matches(F.col("b"), p)) for name, p in (("quoted_span_mutation", T.QUOTED), ("url_or_email_mutation", T.URL_OR_MAIL))}
    for r in df.select(none.alias("reasons"), *(c.alias(name) for name, c in plain.items())).collect():
        assert all((name in r.reasons) == r[name] for name in plain)


def test_loops_by_a_plain_count():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("ab" if k % 2 else "abcdefgh") for _ in range(rng.choice([0, 3, 11, 12, 14, 40]))) for k in range(300)]
    wanted = [len(w) >= 12 and max(Counter(zip(w, w[1:], w[2:], w[3:])).values()) >= 3 for w in map(str.split, texts)]
    assert E.loops.func(pd.Series(texts)).tolist() == wanted and any(wanted) and not all(wanted)


def test_a_known_stretch_is_not_widened_again(monkeypatch):
    """A text of changes far apart: each stretch between them is widened to both sides a few times, not once for each size of blocks."""
    import difflib

    rng = random.Random(2)
    a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(240))
    b = "".join(c.upper() if k % 30 == 29 else c for k, c in enumerate(a))
    calls, widened = [], E._ahead
    monkeypatch.setattr(E, "_ahead", lambda *x: calls.append(x) or widened(*x))
    assert E._longest(a, b, 0, 240, 0, 240) == (120, 120, 59) == tuple(difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match())
    assert len(calls) <= 4
