import re

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_dedup import brute_near, docs, normal, prose


def test_stages_on_a_small_corpus(spark, tmp_path):
    rows = [(k, prose(k)) for k in range(40)] + [(50, prose(1)), (51, prose(2) + " more"), (52, "123 456"), (53, None), (54, prose(1) + " ")]
    frame = docs(spark, rows).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b"))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    now, kept = frame, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.dtypes == frame.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = sorted(r.doc_id for r in now.collect())
    lettered = [i for i, t in rows if t and re.search(r"[^\W\d_]", t)]
    assert kept["language_id"] == sorted(lettered)
    first = {}
    for i, t in sorted(rows):
        if i in lettered:
            first.setdefault(normal(t), i)
    assert kept["exact_dedup"] == sorted(first.values())
    classes = brute_near([(i, t) for i, t in rows if i in first.values()])
    assert kept["near_dedup"] == sorted(i for i, c in classes.items() if i == c)
    assert set(kept["mixing"]) <= set(kept["near_dedup"]) and max(kept["mixing"].count(i) for i in kept["mixing"]) <= 2
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in last.collect()) == kept["mixing"] and last.where("NOT lossless").isEmpty()


def test_stages_tell_rows_apart_without_doc_id(spark, tmp_path):
    rows = [(None, prose(1)), (None, prose(2)), (None, prose(2)), (1, prose(3)), (5, prose(3)), (5, prose(4)), (None, prose(4)), (7, prose(5)), (7, prose(5)), (8, prose(6)), (9, prose(6) + " more"), (9, prose(8)), (None, prose(8) + " more")]
    frame = docs(spark, rows)
    exact = corpus_pipeline.exact_copies(spark, frame, str(tmp_path))
    want = [rows[k] for k in (0, 1, 3, 5, 7, 9, 10, 11, 12)]
    assert sorted(((r.doc_id, r.text) for r in exact.collect()), key=repr) == sorted(want, key=repr)
    near = corpus_pipeline.near_copies(spark, exact, str(tmp_path))
    want = [rows[k] for k in (0, 1, 3, 5, 7, 9, 11)]
    assert sorted(((r.doc_id, r.text) for r in near.collect()), key=repr) == sorted(want, key=repr)
    mixed = corpus_pipeline.mixing(spark, near, str(tmp_path))
    assert mixed.dtypes == frame.dtypes
    # One source: each text once, and about half of them twice.
    assert {(r.doc_id, r.text) for r in mixed.collect()} == set(want) and len(want) < mixed.count() < 2 * len(want)
