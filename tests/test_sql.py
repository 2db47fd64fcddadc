"""Registered aggregates and table functions, from SQL text."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import aggregates as A
from weftline.functions.register import register
from weftline.operators import summarize as Z

TEXTS = [
    (1, "The first sentence is about cats. The second sentence is about dogs and cats. A third one speaks of the weather today. The fourth is about cats and dogs again. Tiny."),
    (2, "Only one sentence stands here."), (3, ""), (4, None), (5, "Short. Bits. Only."),
    (6, "Prices rose in the north of the country. Prices fell in the south of it, they said. Nobody knows why prices moved at all. The minister will speak about prices. It rained in the north today."),
]


@pytest.fixture(scope="module")
def sql(spark):
    register(spark)
    spark.createDataFrame(TEXTS, "doc_id long, text string").createOrReplaceTempView("sql_texts")
    return spark


@pytest.mark.parametrize("method", sorted(Z.METHODS))
def test_summary_rows_are_those_of_the_operators(sql, method):
    want = {(r.doc_id, r.summary) for r in Z.summarize(sql.table("sql_texts"), method, 2).collect() if r.summary}
    got = sql.sql(f"SELECT * FROM summary_rows(TABLE(SELECT doc_id, text FROM sql_texts) PARTITION BY (doc_id), '{method}', 2)")
    assert {tuple(r) for r in got.collect()} == want and len(want) == 3


def test_an_unknown_method_means_textrank(sql):
    rows = [sql.sql(f"SELECT * FROM summary_rows(TABLE(SELECT doc_id, text FROM sql_texts) PARTITION BY (doc_id), '{m}', 2)").collect() for m in ("extractive_nosuch", "textrank")]
    assert sorted(rows[0]) == sorted(rows[1])
    assert sorted(map(tuple, Z.summarize(sql.table("sql_texts"), "nosuch", 2).collect())) == sorted(map(tuple, Z.summarize(sql.table("sql_texts"), "textrank", 2).collect()))


def test_parts_of_a_document_are_joined_in_order(sql):
    sql.createDataFrame([(1, 2, "Second part of it here."), (1, 1, "First part of it here."), (2, 1, None)], "doc_id long, k int, text string").createOrReplaceTempView("sql_parts")
    got = sql.sql("SELECT * FROM summary_rows(TABLE(SELECT doc_id, text, k FROM sql_parts) PARTITION BY (doc_id) ORDER BY (k), 'tfidf', 5)").collect()
    assert [tuple(r) for r in got] == [(1, "First part of it here. Second part of it here.")]


@pytest.mark.parametrize("call", ["TABLE(SELECT doc_id FROM sql_texts) PARTITION BY (doc_id), 'tfidf', 3", "TABLE(SELECT doc_id, text FROM sql_texts) PARTITION BY (doc_id), 'tfidf', 0"])
def test_wrong_arguments_fail_when_analysed(sql, call):
    with pytest.raises(Exception, match="summary_rows takes"):
        sql.sql(f"SELECT * FROM summary_rows({call})")


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_aggregates_do_not_depend_on_blocks(sql, block):
    rows = sql.range(500).select("id", (F.col("id") % 3).alias("g"), F.when(F.col("id") % 11 != 0, F.col("id") * F.col("id") % 97).alias("x"), F.concat(F.lit("text "), "id").alias("t"))
    rows.createOrReplaceTempView("sql_values")
    merged = "percentile_merge(p) AS p, fingerprint_merge(f) AS f, bootstrap_merge(b) AS b"
    got = sql.sql(f"""WITH parts AS (SELECT g, percentile_part(x) AS p, fingerprint_part(t) AS f, bootstrap_part(id, x, x + 1) AS b FROM sql_values GROUP BY g, id DIV {block}),
        halves AS (SELECT g, {merged} FROM (SELECT g, p, f, b, row_number() OVER (PARTITION BY g ORDER BY f) % 2 AS h FROM parts) GROUP BY g, h), whole AS (SELECT g, {merged} FROM halves GROUP BY g)
        SELECT g, percentile_final(p, 0.3D) AS q, fingerprint_final(f) AS f, bootstrap_final(b) AS ends FROM whole ORDER BY g""").collect()
    for r in got:
        x = [k * k % 97 for k in range(500) if k % 3 == r.g and k % 11]
        assert abs(r.q - np.percentile(x, 30)) < 1e-9
        ratio = sum(x) / sum(v + 1 for v in x)
        assert r.ends[0] < ratio < r.ends[1] and r.ends[1] - r.ends[0] < 0.02
    assert len({r.f for r in got}) == 3
    assert [r.f for r in got] == [r.f for r in sql.sql("SELECT g, fingerprint_final(fingerprint_part(t)) AS f FROM sql_values GROUP BY g ORDER BY g").collect()]


def test_aggregates_of_nothing(sql):
    r = sql.sql("SELECT percentile_final(percentile_part(CAST(NULL AS DOUBLE)), 0.5D) AS p, bootstrap_final(bootstrap_part(CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT))) AS b").first()
    assert r.p == 0.0 and r.b == [0.0, 0.0]


def test_draws_are_poisson():
    u = A.mix(np.arange(1, 400_001, dtype=np.uint64)) >> np.uint64(32)
    times = np.searchsorted(A.DRAWN, u, side="right")
    assert abs(times.mean() - 1) < 0.01 and abs(times.var() - 1) < 0.02
