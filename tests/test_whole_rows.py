"""Work that stays in its row: no word becomes a row, and results are those of a plain walk through the text."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.functions import repeats as R
from weftline.functions import text as T
from weftline.plans import catalogue


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["ab", "cb", "b", "word", "other", "longer"]) for _ in range(rng.choice([0, 1, 3, 7, 12, 25, 60])))) for k in range(300)]
    return spark.createDataFrame([*rows, (999, None)], "doc_id long, text string")


def test_media_tags_before_a_last_line_break(spark):
    df = spark.createDataFrame([("Floods - Photos\n",), ("Floods, \n",), ("Floods - Photos",)], "t string")
    assert [r[0] for r in df.select(T.drop_trailing_tags(F.col("t"))).collect()] == ["Floods - Photos\n", "Floods, \n", "Floods"]


def test_script_of_categories_is_ascii(spark, tmp_path):
    spark.createDataFrame([(1, "en", "a b c é ü")], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.without_script for r in catalogue.QUERIES["category_evaluation"](spark, str(tmp_path)).collect()} == {1}


@pytest.mark.parametrize("name", ["word_repetition", "phrase_repetition", "phrase_repetition_3", "repetition_loop", "rewrite_issues"])
def test_repeats_stay_in_their_row(spark, sf_dir, name):
    plan = plan_of(catalogue.QUERIES[name](spark, sf_dir))
    assert "Generate" not in plan and "Join" not in plan and "Aggregate" not in plan


def test_repeats_by_a_plain_walk(texts):
    w = T.words(F.col("text"))
    got = texts.select("text", R.word_repeated(ignored=("word",))(w).alias("word"), R.phrase_repeated(4)(w).alias("four"), R.phrase_repeated(3)(w).alias("three"), R.most_of_a_run(4, 12)(w).alias("most")).collect()

    def phrase(w, n):
        keys = [(w[i][-1], *w[i + 1 : i + n - 1], w[i + n - 1][0]) for i in range(len(w) - n + 1)]
        return any(keys[i] == keys[j] and (j - i > n - 1 or (j - i == n - 1 and len(w[j]) > 1)) for i in range(len(keys)) for j in range(i + 1, len(keys)))

    for r in got:
        w = (r.text or "").split()
        assert r.word == (len(w) >= 20 and any(c >= 12 and len(x) > 3 and x != "word" for x, c in Counter(w).items()))
        assert (r.four, r.three) == (phrase(w, 4), phrase(w, 3))
        assert r.most == (max(Counter(zip(w, w[1:], w[2:], w[3:])).values()) if len(w) >= 12 else 0)


@pytest.mark.parametrize("name", ["word_positions", "tfidf_topn", "rake_topn", "yake_topn", "textrank_topn"])
def test_scores_stay_in_their_row(spark, sf_dir, name):
    plan = plan_of(catalogue.QUERIES[name](spark, sf_dir))
    assert "Join" not in plan and "Aggregate" not in plan and "Window" not in plan and "RepartitionByExpression [doc_id" not in plan


def test_sequences_are_found_without_a_join(spark, sf_dir):
    assert "Join" not in plan_of(catalogue.QUERIES["rouge_l"](spark, sf_dir))


def test_inputs_are_compared_by_digests_taken_before_the_join(spark, sf_dir):
    above, below = plan_of(catalogue.QUERIES["one_to_one_join"](spark, sf_dir)).split("Join FullOuter")
    assert "regexp_replace" not in above and "sha2" in below
