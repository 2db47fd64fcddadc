import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_dedup import docs, prose
from weftline.llm import langid, pieces, pitman_yor
from weftline.llm.neighbours import nearest

VOCABULARY = [f"w{k}" for k in range(3000)]
TEXTS = [(1, "Hello  world ▁ x\n\n y 😀"), (2, ""), (3, None), (4, " "), (5, "a" * 20000), (6, "日本語\ttext\r\n\x00end"), (7, "same text"), (7, "same text"), (8, "same text")]


def test_pieces_are_lossless_and_reproducible(spark):
    frame = docs(spark, TEXTS + [(k + 20, prose(k)) for k in range(20)]).withColumn("body", F.lit("x"))
    one = {(r.doc_id, tuple(r.ids) if r.ids is not None else None) for r in pieces.encode(frame, ["doc_id"]).collect()}
    again = pieces.encode(frame.repartition(7), ["doc_id"])
    assert one == {(r.doc_id, tuple(r.ids) if r.ids is not None else None) for r in again.collect()}
    assert again.where("NOT lossless OR n_tokens <> coalesce(size(ids), 0)").isEmpty()
    back = {r.doc_id: r.text for r in pieces.decode(again, ["doc_id"]).collect()}
    assert back == dict(TEXTS) | {k + 20: prose(k) for k in range(20)}
    by_id = dict(one)
    assert by_id[3] is None and by_id[2] == () and by_id[7] != () and pieces.encode(docs(spark, []), ["doc_id"]).count() == 0


def test_pieces_differ_by_row_and_follow_the_lattice(spark):
    frame = docs(spark, [(k, "international") for k in range(400)])
    ids = [tuple(r.ids) for r in pieces.encode(frame, ["doc_id"]).collect()]
    assert 1 < len(set(ids)) < 400
    # Shares of segmentations follow the product of their pieces' weights.
    v = pieces.read_vocabulary()
    weight = {s: math.exp(sum(v.weight[i] for i in s)) for s in set(ids)}
    a, b = sorted(weight, key=weight.get)[-2:]
    share = ids.count(b) / (ids.count(a) + ids.count(b))
    assert abs(share - weight[b] / (weight[a] + weight[b])) < 0.12


def test_language_id_on_held_out_rows(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    r = langid.op10_language_id(spark, sf_dir).join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = r.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 30 and right / n >= 0.97


def test_language_id_defined_results(spark):
    texts = [(k, ("the and of " if k % 2 else "der und die ") * 5 + prose(k, 5)) for k in range(60)]
    labelled = docs(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))
    odd = docs(spark, [(100, None), (101, ""), (102, "123 !!"), (103, "the and of the"), (103, "der und die"), (104, "the " * 50000)]).withColumns({"norm": F.lit(1), "score": F.lit(2)})
    got = sorted((r.doc_id, r.lang_pred) for r in langid.identify(odd, labelled, ["doc_id"]).collect())
    assert got == [(100, "und"), (101, "und"), (102, "und"), (103, "de"), (103, "en"), (104, "en")]
    none = langid.identify(odd, labelled.limit(0), ["doc_id"]).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"] and langid.identify(odd.limit(0), labelled, ["doc_id"]).count() == 0


def test_language_id_learns_every_language(spark):
    names = [f"l{k:02d}" for k in range(30)]
    rows = [(k, " ".join(f"{'abcdefghijklmnopqrstuvwxyz'[(k % 30 * 7 + j * 3) % 26]}{'aeiou'[(k % 30 + j) % 5]}{k % 30 // 5}{'bcdfg'[k % 30 % 5]}" for j in range(12)), names[k % 30]) for k in range(240)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(frame, frame, ["doc_id", "lang"], most=60, landmarks=5).collect()  # 2 documents of each, fewer landmarks than languages
    assert {r.lang_pred for r in got} == set(names) and sum(r.lang_pred == r.lang for r in got) > 200
    assert all(r.margin >= 0 for r in got)


def test_keep_identified_keeps_rows_as_they_are(spark):
    frame = docs(spark, [(k, prose(k), ) for k in range(20)] + [(None, "the text"), (3, prose(3)), (50, "12"), (51, None)]).withColumns({"score": F.lit("x"), "norm": F.col("doc_id"), "lang_pred": F.lit(1)})
    kept = langid.keep_identified(frame)
    assert kept.dtypes == frame.dtypes
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.collect()) == sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in frame.collect() if r.doc_id not in (50, 51))


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w] + ["</s>"]


def test_pitman_yor_counts_and_held_out_gain(spark, sf_dir):
    got = {r.doc_id: r for r in pitman_yor.op9_pitman_yor(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows}
    counts = {}
    for r in rows:
        if not held[r.doc_id]:
            for w in tokens(r.text):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        g, t = got[r.doc_id], tokens(r.text)
        base = sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[r.doc_id], len(t), sum(w in counts for w in t), n)
        assert abs(g.base_score - base) < 1e-6
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_pitman_yor_scores_each_repeated_row(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "d e"), (2, None), (2, ""), (3, "a b c"), (None, "a b")]
    got = pitman_yor.score(docs(spark, rows), F.lit(True)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 3), (1, 3), (1, 4), (1, 4), (2, 1), (2, 1), (3, 4)]
    assert len({round(r.score, 9) for r in got if r.n_tokens == 4}) == 1 and {r.train_tokens for r in got} == {20}


def test_pitman_yor_shuffles_the_same_in_more_buckets(spark, monkeypatch):
    """What is shuffled follows the text, not documents times buckets; a larger corpus has more of both."""
    rng = random.Random(9)
    frame = docs(spark, [(k, " ".join(rng.choices(VOCABULARY, k=60))) for k in range(3000)]).coalesce(1)
    status = spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    moved = []
    for size in (1 << 18, 1 << 13):
        monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", size)
        before = written()
        assert pitman_yor.score(frame, F.lit(True)).agg(F.sum("n_tokens")).first()[0] == 3000 * 61
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        moved.append(written() - before)
    assert moved[1] < 1.5 * moved[0], moved


def test_pitman_yor_scores_do_not_depend_on_blocks_and_buckets(spark, monkeypatch):
    """Null ids, and whole blocks that occur twice, are scored row by row however the work is cut."""
    rng = random.Random(10)
    rows = [(None if k % 7 == 0 else k, " ".join(rng.choices(VOCABULARY[: rng.choice([3, 3000])], k=rng.choice([0, 1, 90])))) for k in range(120)]
    frame = docs(spark, rows).coalesce(1)
    found = []
    for block, piece, bucket in ((8 << 20, 2 << 20, 8 << 20), (1000, 300, 500), (1, 1, 1 << 20)):
        monkeypatch.setattr(pitman_yor, "BLOCK_BYTES", block)
        monkeypatch.setattr(pitman_yor, "PIECE_BYTES", piece)
        monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", bucket)
        got = pitman_yor.score(frame.union(frame), F.col("doc_id") % 2 == 1).collect()
        found.append(sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.score, round(r.base_score, 6)) for r in got))
    assert [r[:2] for r in found[0]] == sorted((-1 if k is None else k, len(tokens(t))) for k, t in rows * 2)
    assert found[0] == found[1] == found[2]


def test_pitman_yor_tells_of_answers_that_are_missing():
    """A block whose rows changed between two readings is an error, not a wrong sum."""
    import pyarrow as pa

    plan = pitman_yor.Plan(1, np.zeros(0, np.uint64), np.zeros(0, np.int64), 3.0, 5.0)
    batch = pa.record_batch([pa.array([1], pa.int64()), pa.array([2], pa.int64()), pa.array(["a b"]), pa.array([True])], names=["own", "doc_id", "text", "train"])
    own, pairs = next(pitman_yor._packer(plan)(iter([batch]))).to_pylist()
    assert own["bucket"] == -1 and pairs["bucket"] == 0 and own["block"] == pairs["block"]
    answer = pitman_yor._planes(np.zeros(2, np.int64), np.array([1, 1], np.uint32), np.ones(2, np.int64))
    short = pitman_yor._rows([-1, 0], [own["block"]] * 2, [own["data"], answer])
    with pytest.raises(RuntimeError, match="3 pairs and 2 answers"):
        list(pitman_yor._documents(plan)(iter([short])))


@pytest.mark.parametrize("customers,others,base", [(40, 5.0, 0.1), (5000, 50.0, 0.02), (200_000, 500.0, 0.3)])
def test_tables_of_a_restaurant_have_their_mean(customers, others, base):
    """The expected number of tables follows from a recursion, one customer at a time, whatever the number of customers."""
    d, mean = 0.75, 1.0
    for n in range(1, customers):
        fresh = (others + d * mean) * base
        mean += fresh / (n - d * mean + fresh)
    names = np.arange(400, dtype=np.uint64) * np.uint64(7919)
    t = pitman_yor.seat(np.full(400, customers), np.full(400, others), np.full(400, base), names, d)
    assert abs(t.mean() / mean - 1) < 0.05 and t.min() >= 1 and t.max() <= customers


def test_pitman_yor_probabilities_sum_to_one(spark):
    """Texts of one word each, over all words and an unknown one: the probabilities after the start of a text sum to 1."""
    words = [f"w{k % 17}" for k in range(300)]
    train = docs(spark, [(k, w) for k, w in enumerate(words)])
    ask = docs(spark, [(1000 + k, f"w{k}") for k in range(17)] + [(1017, ""), (1018, "unknown")])
    scored = pitman_yor.score(train.union(ask), F.col("doc_id") < 1000)
    s = {r.doc_id: 10**r.score for r in scored.where("doc_id >= 1000").collect()}
    end = s[1017]
    # p(word | start) = p(word, end) / p(end | word); all words were followed by the end alone, alike or nearly so.
    plan_total = sum(v for k, v in s.items() if k != 1017) + end
    assert 0.8 < plan_total <= 1.0


def test_pitman_yor_defined_results(spark):
    frame = docs(spark, [(1, None), (2, ""), (3, "Aé b"), (3, "c"), (4, "x " * 20000)]).withColumns({"train": F.lit("t"), "block": F.lit(1)})
    rows = pitman_yor.score(frame, F.lit(True)).collect()
    assert sorted(r.n_tokens for r in rows if r.doc_id == 3) == [2, 3]  # rows that repeat a doc_id are scored each
    got = {r.doc_id: r for r in rows}
    assert got[1].n_tokens == got[2].n_tokens == 1 and got[4].n_tokens == 20001
    assert all(math.isfinite(r.score) for r in got.values())
    nothing = pitman_yor.score(frame, F.lit(False)).collect()
    assert {r.n_known for r in nothing} == {0} and all(math.isfinite(r.score) for r in nothing)
    assert pitman_yor.score(frame.limit(0), F.lit(True)).count() == 0


def test_seating_bounds():
    c = np.array([0, 1, 2, 50, 5000, 100000])
    name = np.arange(6, dtype=np.uint64)
    t = pitman_yor.seat(c, np.full(6, 5.0), np.full(6, 0.01), name, 0.5)
    assert (t <= c).all() and (t[1:] >= 1).all() and t[0] == 0
    assert (pitman_yor.seat(c, np.full(6, 5.0), np.full(6, 0.01), name, 0.5) == t).all()


def vectors(spark, x, extra=()):
    rows = [(k, [float(v) for v in r], 0) for k, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(x, ids, q, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u[ids.index(q)]
    order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-round(s[i], 12), ids[i]))
    return [ids[i] for i in order[:k]]


def test_neighbours_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 24)).astype(np.float32) + 3 * rng.standard_normal((8, 24)).astype(np.float32)[rng.integers(0, 8, 1500)]
    frame = vectors(spark, x)
    got = nearest(frame, frame.where("vec_id % 50 = 0")).collect()
    ids, hit, total = list(range(len(x))), 0, 0
    for q in range(0, 1500, 50):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5] and q not in [r.vec_id for r in mine]
        hit += len(set(brute(x.astype(float), ids, q)) & {r.vec_id for r in mine})
        total += 5
    assert hit / total >= 0.9


def test_neighbours_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.standard_normal((60, 8)), np.tile(rng.standard_normal(8), (200, 1))]).astype(np.float32)
    bad = [(900, None, 0), (950, [0.0] * 8, 0), (901, [], 0), (902, [float("nan")] * 8, 0), (903, [float("inf")] + [1.0] * 7, 0), (904, [None] + [1.0] * 7, 0)]
    frame = vectors(spark, x, bad).withColumns({"node": F.lit(1), "score": F.lit("s")})
    got = nearest(frame, frame.where("vec_id % 50 = 0")).collect()
    assert {r.query_id for r in got} == {0, 50, 100, 150, 200, 250}
    for q in (100, 150):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in mine] == [60, 61, 62, 63, 64] and all(abs(r.score - 1) < 1e-9 for r in mine)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_neighbours_small_tables(spark, n):
    rng = np.random.default_rng(5)
    frame = vectors(spark, rng.standard_normal((n, 4)))
    assert nearest(frame, frame).count() == n * (n - 1)


def test_neighbours_leave_out_rows_without_an_identifier(spark):
    frame = spark.createDataFrame([(None, [1.0, 0.0]), (0, [1.0, 0.1]), (1, [0.0, 1.0]), (None, [1.0, 0.1])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.vec_id) for r in nearest(frame, frame.where("vec_id = 0 OR vec_id IS NULL")).collect()) == [(0, 1)]


def test_language_id_learns_a_language_of_few_lettered_rows(spark):
    rows = [(k, None if k % 500 else "zyx wvu tsr qpo", "rare", "s", 0) for k in range(4000)] + [(10_000 + k, "alpha beta gamma delta", "common", "s", 0) for k in range(50)]
    rows += [(None, "alpha beta gamma", "common", "s", 0)] * 20 + [(None, f"unnumbered lines {k} of one more", "third", "s", 0) for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = langid.identify(frame, frame, ["lang"]).where("lang_pred <> 'und'").groupBy("lang", "lang_pred").count().collect()
    assert sorted((r.lang, r.lang_pred, r["count"]) for r in got) == [("common", "common", 70), ("rare", "rare", 8), ("third", "third", 20)]
