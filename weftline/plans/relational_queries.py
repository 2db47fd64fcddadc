"""Queries over joins, ordered analytics, sampling, splits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins as J
from ..operators import selection as S
from ..operators import summarize as Z
from ..sources import records as R
from ._tables import dealt_docs, docs, literal, literal_sql, ngrams_sql, r6, sentences_sql, spread, table, tokens_sql, trim_sql, with_given, with_given_sql, words_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def canonical_url(c):
    """An address without scheme, query, fragment, leading www. or m., and closing slashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"^[a-z]+://(?:www\.|m\.)?|[?#].*$", ""), "/+$", "")


_URL = r"regexp_replace(regexp_replace(lower(coalesce(url, '')), '^[a-z]+://(?:www\.|m\.)?|[?#].*$', '', 'g'), '/+$', '', 'g')"


@query("url_dedup_keep_first", f"SELECT page_id, {_URL} AS canonical FROM pages QUALIFY {_URL} = '' OR row_number() OVER (PARTITION BY {_URL} ORDER BY page_id) = 1")
def url_dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each address; pages without one are all kept."""
    pages = table(spark, sf_dir, "pages").select("page_id", canonical_url(F.coalesce("url", F.lit(""))).alias("canonical"))
    return S.keep_first(pages, [F.col("canonical")], [F.col("page_id")], unless=F.col("canonical") == "")


@query("exact_text_dedup", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY nfc_normalize(text), lang ORDER BY doc_id) = 1")
def exact_text_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By text and category after NFC; rows meet by their hash, not their text."""
    d = docs(spark, sf_dir).select("doc_id", "lang", T.row_hash(T.nfc(F.col("text")), F.col("lang")).alias("h"))
    return S.keep_first(d, [F.col("h")], [F.col("doc_id")]).select("doc_id", "lang")


@query("dedup_counts", "SELECT lang, count(*) AS n, count(DISTINCT text) AS kept, count(*) - count(DISTINCT text) AS duplicates, count(*) FILTER (text = '') AS malformed FROM documents GROUP BY lang")
def dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3, A17."""
    d = docs(spark, sf_dir).select("lang", F.sha2("text", 256).alias("h"), (F.col("text") == "").alias("empty"))
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("h").alias("kept"), (F.count("*") - F.countDistinct("h")).alias("duplicates"), F.count_if("empty").alias("malformed"))


@query(
    "ranked_source_dedup",
    f"""
WITH s AS (SELECT doc_id, source, array_to_string(({sentences_sql("text")})[1:1], '') AS head, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS rank FROM documents)
SELECT doc_id, rank FROM s WHERE len({words_sql("head")}) >= 5 QUALIFY row_number() OVER (PARTITION BY head ORDER BY rank, doc_id) = 1""",
)
def ranked_source_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary rows, then supplements; only rows that pass the filter claim a key."""
    head = F.coalesce(F.get(T.sentences(F.col("text")), F.lit(0)), F.lit(""))
    d = docs(spark, sf_dir).select("doc_id", head.alias("head"))
    primary = d.where("doc_id % 2 = 0").withColumn("rank", F.lit(0))
    supplement = d.where("doc_id % 2 = 1").withColumn("rank", F.lit(1))
    both = primary.unionByName(supplement).where(T.word_count(F.col("head")) >= 5)
    return S.keep_first(both, [F.col("head")], [F.col("rank"), F.col("doc_id")]).select("doc_id", "rank")


@query("shard_modulo", "SELECT doc_id, CAST(doc_id % 5 AS INT) AS shard FROM documents WHERE doc_id % 5 = 2")
def shard_modulo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W13."""
    return S.shard(docs(spark, sf_dir), F.col("doc_id"), 5, 2).select("doc_id", F.pmod("doc_id", F.lit(5)).cast("int").alias("shard"))


_KEY = "sha256('42' || chr(0) || CAST(doc_id AS VARCHAR))"


@query("hash_sample", f"SELECT doc_id, lang FROM documents ORDER BY {_KEY} LIMIT 100")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 to L4: a sample of 100."""
    return S.hash_sample(docs(spark, sf_dir).select("doc_id", "lang"), F.col("doc_id"), 100)


@query("hash_shuffle", f"SELECT doc_id, row_number() OVER (ORDER BY {_KEY}) AS pos FROM documents")
def hash_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: every row with its place in a shuffled order."""
    return J.with_place(docs(spark, sf_dir, "doc_id"), S.hash_key(F.col("doc_id")), "pos").select("doc_id", "pos")


_UNIT = "('0x' || substr({}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query("group_split", f"SELECT page_id, CASE WHEN {_UNIT.format("sha256('42' || chr(0) || " + _URL + ")")} < 0.85 THEN 'train' ELSE 'dev' END AS split FROM pages")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of one address are on the same side."""
    pages = table(spark, sf_dir, "pages").select("page_id", canonical_url(F.coalesce("url", F.lit(""))).alias("canonical"))
    return S.hash_split(pages, F.col("canonical"), 0.85).select("page_id", "split")


@query(
    "exact_group_split",
    "WITH k AS (SELECT source, row_number() OVER (ORDER BY sha256('42' || chr(0) || source)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)) SELECT d.doc_id, CASE WHEN k.r <= floor(k.n * 0.85::DOUBLE) THEN 'train' ELSE 'dev' END AS split FROM documents d JOIN k USING (source)",
)
def exact_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L5, L6 with an exact share of the groups; sources are the groups."""
    return S.exact_group_split(docs(spark, sf_dir, "doc_id", "source"), "source", 0.85).select("doc_id", "split")


@query(
    "stratified_cap",
    f"WITH c AS (SELECT min(n) * 2 AS cap FROM (SELECT count(*) AS n FROM documents GROUP BY lang)) SELECT doc_id, lang FROM documents CROSS JOIN c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_KEY}) <= any_value(cap) OVER ()",
)
def stratified_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W11, L8."""
    return S.stratified_cap(docs(spark, sf_dir, "doc_id", "lang"), "lang", F.col("doc_id"))


@query("weighted_sampling")
def weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many draws as rows, weighted by the inverse frequency of the category."""
    d = docs(spark, sf_dir, "doc_id", "lang")
    counts = d.groupBy("lang").agg(F.count("*").alias("n"))
    n = d.count()
    weights = d.join(counts, "lang").select("doc_id", (1.0 / F.col("n")).alias("w"))
    drawn = S.weighted_draws(weights, "doc_id", "w", max(n, 1)).join(d, "doc_id")
    return drawn.groupBy("lang").agg(F.count("*").alias("drawn"), F.countDistinct("doc_id").alias("distinct_docs"))


@query(
    "accept_until_target",
    f"WITH p AS (SELECT doc_id, text, lang, row_number() OVER (PARTITION BY lang ORDER BY {_KEY}) AS r FROM documents), a AS (SELECT doc_id, lang, r FROM p WHERE r <= 60 AND length(text) >= 300) SELECT doc_id, lang FROM a QUALIFY row_number() OVER (PARTITION BY lang ORDER BY r) <= 20",
)
def accept_until_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of three times the target for each category; the first accepted rows fill it."""
    by = Window.partitionBy("lang").orderBy(S.hash_key(F.col("doc_id")))
    pool = docs(spark, sf_dir).withColumn("r", F.row_number().over(by)).where("r <= 60")
    good = pool.where(F.length("text") >= 300).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("r")))
    return good.where("k <= 20").select("doc_id", "lang")


@query("resume_anti_join", "SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label yet."""
    return J.not_yet_done(docs(spark, sf_dir, "doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("resume_two_keys", "SELECT o.o_orderkey, o.o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_suppkey % 1500 = o.o_custkey % 1500)")
def resume_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two keys."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").withColumns({"a": F.col("o_orderkey"), "b": F.col("o_custkey") % 1500})
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_suppkey") % 1500).alias("b"))
    return J.not_yet_done(o, done, ["a", "b"]).select("o_orderkey", "o_custkey")


@query(
    "fallback_lookup",
    """
WITH d AS (SELECT doc_id, text, doc_id % 900 AS k1, md5(text) AS k2 FROM documents), l AS (SELECT d.k1, d.k2, l.quality, l.doc_id FROM labels l JOIN d USING (doc_id)),
a AS (SELECT k1, arg_max(quality, doc_id) AS q FROM l GROUP BY k1), b AS (SELECT k2, arg_max(quality, doc_id) AS q FROM l GROUP BY k2)
SELECT d.doc_id, coalesce(a.q, b.q) AS quality FROM d LEFT JOIN a USING (k1) LEFT JOIN b USING (k2)""",
)
def fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By one key, else by another; of several rows the last counts."""
    d = docs(spark, sf_dir).select("doc_id", (F.col("doc_id") % 900).alias("k1"), F.md5("text").alias("k2"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").join(d, "doc_id")
    return J.lookup(d, labels, ["k1", "k2"], "quality", order=F.col("doc_id"), alias="q").select("doc_id", F.col("q").alias("quality"))


@query(
    "positional_zip",
    "WITH a AS (SELECT page_id, row_number() OVER (ORDER BY page_id) AS pos FROM pages), b AS (SELECT item_id, row_number() OVER (ORDER BY item_id DESC) AS pos FROM benchmark) SELECT pos, page_id, item_id FROM a JOIN b USING (pos)",
)
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5."""
    return J.zip_rows(table(spark, sf_dir, "pages").select("page_id"), table(spark, sf_dir, "benchmark").select("item_id"), F.col("page_id"), -F.col("item_id")).select("pos", "page_id", "item_id")


@query(
    "completeness_check",
    "WITH g AS (SELECT doc_id, count(*) AS g FROM documents GROUP BY 1), p AS (SELECT doc_id + 100 AS doc_id, count(*) AS p FROM labels GROUP BY 1) SELECT count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS matched, count(*) FILTER (p IS NULL) AS missing, count(*) FILTER (g IS NULL) AS unknown, count(*) FILTER (g > 1) AS repeated_gold, count(*) FILTER (p > 1) AS repeated_predictions FROM g FULL JOIN p USING (doc_id)",
)
def completeness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1."""
    return J.completeness(docs(spark, sf_dir, "doc_id"), table(spark, sf_dir, "labels").select((F.col("doc_id") + 100).alias("doc_id")), "doc_id")


@query("one_to_one_join", f"SELECT doc_id, len({words_sql('text')}) AS words FROM documents WHERE {trim_sql('text')} <> ''")
def one_to_one_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with predictions for them; the submitted inputs differ in white space, and every third one was not submitted."""
    gold = docs(spark, sf_dir, "doc_id", "text").where(T.trim_ws(F.col("text")) != "")
    sent = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit(" "), F.replace("text", F.lit(" "), F.lit("  "))))
    made = gold.select("doc_id", sent.alias("input"), T.word_count(F.col("text")).cast("long").alias("words"))
    return J.one_to_one(gold, made, "doc_id", ("text", "input")).select("doc_id", "words")


_WORD = r"[\p{L}\p{N}_]"


@query(
    "scored_numbers",
    rf"""WITH d AS (SELECT doc_id, concat(text, ' +5 and -3.2, 1/2 x9 7') AS a, CASE WHEN doc_id % 2 = 0 THEN concat('7 1/2 -3.2 ', text, ' +5') ELSE concat(text, ' +5 and -3.2, 1/2 x9 7 7') END AS b FROM documents),
side AS (SELECT doc_id, 0 AS s, a AS x FROM d UNION ALL SELECT doc_id, 1, b FROM d),
words AS (SELECT doc_id, s, unnest(regexp_extract_all(regexp_replace(x, '{_WORD}*\p{{L}}{_WORD}*|{_WORD}*_{_WORD}*', ' ', 'g'), '[+-]?(?:\p{{Nd}}[\p{{Nd}},.:/-]*\p{{Nd}}|\p{{Nd}})')) AS r FROM side),
c AS (SELECT doc_id, r, count(*) FILTER (s = 0) AS n, count(*) FILTER (s = 1) AS m FROM words GROUP BY doc_id, r)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS numbers, bool_and(n = m) AS kept FROM c GROUP BY doc_id""",
)
def scored_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as the scorer sees them, and whether a changed text holds the same ones equally often. Even documents have them in another order, odd ones one more."""
    b = "CASE WHEN doc_id % 2 = 0 THEN concat('7 1/2 -3.2 ', text, ' +5') ELSE concat(text, ' +5 and -3.2, 1/2 x9 7 7') END"
    d = docs(spark, sf_dir, "doc_id", "text").select("doc_id", F.concat("text", F.lit(" +5 and -3.2, 1/2 x9 7")).alias("a"), F.expr(b).alias("b"))
    n = d.select("doc_id", *(T.numbers(F.col(c), T.SCORED_NUMBER).alias(c) for c in "ab"))
    return n.select("doc_id", F.size("a").cast("long").alias("numbers"), T.same_multiset(F.col("a"), F.col("b")).alias("kept"))


@query(
    "corpus_report",
    """WITH r AS (SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang),
h AS (SELECT sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || '}') AS h FROM documents),
"""
    + "p AS (SELECT count(*) AS n, "
    + ", ".join(f"sum(('0x' || substr(h, {8 * k + 1}, 8))::BIGINT)::HUGEINT AS s{k}" for k in range(8))
    + " FROM h) SELECT lang, r.n, chars, sha256(concat_ws('|', p.n, "
    + ", ".join(f"s{k}" for k in range(8))
    + ")) AS input_sha FROM r, p",
)
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK6: a JSON report of the languages with the digest of its input, written to the shared folder and read again."""
    d = docs(spark, sf_dir, "doc_id", "lang", "n_chars")
    report = d.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    path = R.shared_path(spark, "report")
    spark.createDataFrame([(R.json_report(report, {"documents": d}),)], "value string").write.text(path)
    read = spark.read.option("multiLine", True).schema("inputs struct<documents: struct<sha256: string>>, rows array<struct<lang: string, n: long, chars: long>>").json(path)
    return read.select("inputs.documents.sha256", F.inline("rows")).select("lang", "n", "chars", F.col("sha256").alias("input_sha"))


@query(
    "as_of_last_value",
    """WITH e AS (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
SELECT o.o_orderkey, o.o_orderdate AS ts, e.value AS last_value FROM orders o ASOF LEFT JOIN e ON e.user_id = o.o_custkey AND e.ts <= o.o_orderdate + INTERVAL 10000 DAY""",
)
def as_of_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase event of each order's customer at or before a day."""
    shift = F.expr("INTERVAL 10000 DAYS")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderdate") + shift).alias("at"), "o_orderkey")
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("at")).agg(F.max_by("value", "event_id").alias("value"))
    found = J.as_of(o, e, ["user_id"], "at", "value", "last_value")
    return found.select("o_orderkey", (F.col("at") - shift).alias("ts"), "last_value")


_LOSS = [(s, None if s % 50 == 0 else 3.0 / (1 + s / 40), 3.2 / (1 + s / 45) + (0.02 * (s // 50) if s > 400 else 0.0) if s % 50 == 0 else None) for s in range(10, 801, 10)]


#: The given history is run -1; of the events each user's are a run, every tenth an evaluation.
_LOSS_ROWS = ["user_id", "event_id", "CASE WHEN event_id % 10 <> 0 THEN value END", "CASE WHEN event_id % 10 = 0 THEN value / 2 END"]
_GIVEN_LOSS = [(-1, *row) for row in _LOSS]


@query(
    "loss_verdict",
    f"""
WITH h AS (SELECT * FROM {with_given_sql("run step loss eval_loss", _GIVEN_LOSS, "events", _LOSS_ROWS)}),
e AS (SELECT run, step, eval_loss FROM h WHERE eval_loss IS NOT NULL), l AS (SELECT run, step, loss FROM h WHERE loss IS NOT NULL),
j AS (SELECT e.*, l.loss AS train_loss FROM e ASOF LEFT JOIN l ON e.run = l.run AND e.step >= l.step)
SELECT run, CAST(arg_min(step, (eval_loss, step)) AS BIGINT) AS best_step, round(min(eval_loss), 6) AS best_loss, round(arg_max(eval_loss - train_loss, step) FILTER (train_loss IS NOT NULL), 6) AS last_gap,
  CASE WHEN arg_min(step, (eval_loss, step)) < max(step) THEN 'past its best' ELSE 'still falling' END AS verdict FROM j GROUP BY run""",
)
def loss_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each evaluation with the last training loss of its run before it; each run's best step, and whether training went past it."""
    h = with_given(spark, sf_dir, "run step loss eval_loss", _GIVEN_LOSS, "events", _LOSS_ROWS)
    j = J.as_of(h.where("eval_loss IS NOT NULL").select("run", "step", "eval_loss"), h.where("loss IS NOT NULL").select("run", "step", "loss"), ["run"], "step", "loss", "train_loss")
    best = F.min_by("step", F.struct("eval_loss", "step"))
    gap = F.col("eval_loss") - F.col("train_loss")
    return j.groupBy("run").agg(
        best.cast("long").alias("best_step"), r6(F.min("eval_loss")).alias("best_loss"), r6(F.max_by(gap, F.when(gap.isNotNull(), F.col("step")))).alias("last_gap"),
        F.when(best < F.max("step"), "past its best").otherwise("still falling").alias("verdict"),
    )


@query(
    "leak_audit",
    f"""
WITH b AS (SELECT DISTINCT unnest({sentences_sql("text", 40)}) AS s FROM benchmark), d AS (SELECT DISTINCT lang, unnest({sentences_sql("text", 40)}) AS s FROM documents)
SELECT d.lang, count(*) AS shared, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM b), 6) AS pct_of_benchmark FROM d JOIN b USING (s) GROUP BY d.lang""",
)
def leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By category, distinct benchmark sentences that stand in documents too."""
    b = table(spark, sf_dir, "benchmark").select(F.explode(T.sentences(F.col("text"), 40)).alias("s")).distinct()
    d = docs(spark, sf_dir).select("lang", F.explode(T.sentences(F.col("text"), 40)).alias("s")).distinct()
    total = b.agg(F.count("*").alias("total"))
    return d.join(b, "s").groupBy("lang").agg(F.count("*").alias("shared")).crossJoin(F.broadcast(total)).select("lang", "shared", r6(100.0 * F.col("shared") / F.col("total")).alias("pct_of_benchmark"))  # one row


@query("dimension_cross_join", "SELECT b.band, d.lang, count(*) AS n FROM documents d CROSS JOIN (VALUES ('short'), ('medium'), ('long')) b(band) GROUP BY ALL")
def dimension_cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows times three given bands, as an array in each row."""
    bands = F.explode(F.array(*map(F.lit, ("short", "medium", "long"))))
    return docs(spark, sf_dir, "lang").select("lang", bands.alias("band")).groupBy("band", "lang").agg(F.count("*").alias("n"))


@query(
    "sentence_pairs",
    f"""
WITH s AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS i, unnest(s) AS x FROM (SELECT doc_id, {sentences_sql("text")} AS s FROM documents)),
t AS (SELECT doc_id, i, w, count(*) AS c FROM (SELECT doc_id, i, unnest({tokens_sql("lower(x)")}) AS w FROM s) GROUP BY ALL), n AS (SELECT doc_id, i, sqrt(sum(c * c)) AS n FROM t GROUP BY ALL),
p AS (SELECT a.doc_id, a.i, b.i AS j, sum(a.c * b.c) AS dot FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.w = b.w AND a.i < b.i GROUP BY ALL)
SELECT p.doc_id, CAST(p.i AS INT) AS i, CAST(p.j AS INT) AS j, round(p.dot / (x.n * y.n), 6) AS cosine FROM p JOIN n x ON x.doc_id = p.doc_id AND x.i = p.i JOIN n y ON y.doc_id = p.doc_id AND y.i = p.j WHERE p.dot / (x.n * y.n) >= 0.6""",
)
def sentence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document's sentences with a cosine of 0.6 or more."""
    d = spread(docs(spark, sf_dir, "doc_id", "text").where("doc_id IS NOT NULL"))
    s = d.select("doc_id", Z.similar_sentences(0.6)(Z.sentence_words(T.sentences(F.col("text")))).alias("pairs"))
    return s.select("doc_id", F.inline("pairs")).withColumn("cosine", r6(F.col("cosine")))


@query(
    "word_positions",
    f"""
WITH s AS (SELECT doc_id, generate_subscripts(s, 1) AS k, unnest(s) AS x FROM (SELECT doc_id, {sentences_sql("text")} AS s FROM documents)),
w AS (SELECT doc_id, k, generate_subscripts(t, 1) AS i, unnest(t) AS w FROM (SELECT doc_id, k, {tokens_sql("lower(x)")} AS t FROM s)),
p AS (SELECT doc_id, k, w, row_number() OVER (PARTITION BY doc_id ORDER BY k, i) - 1 AS pos, lag(w) OVER (PARTITION BY doc_id, k ORDER BY i) AS before, lead(w) OVER (PARTITION BY doc_id, k ORDER BY i) AS after FROM w)
SELECT doc_id, w AS word, count(*) AS n, list_sort(list(pos))[count(*) // 2 + 1] AS median_pos, count(DISTINCT before) AS left_words, count(DISTINCT after) AS right_words, count(DISTINCT k) AS n_sentences FROM p GROUP BY doc_id, w HAVING count(*) >= 5""",
)
def word_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a word in its document's running words, their upper median, and its neighbours."""
    s = spread(docs(spark, sf_dir, "doc_id", "text")).select("doc_id", Z.frequent_words(Z.sentence_words(T.sentences(F.col("text")))).alias("words"))
    return s.select("doc_id", F.inline("words"))


@query("rate_limit_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS calls FROM events")
def rate_limit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a key in the trailing 60 seconds, its own included."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").cast("double").alias("t"))
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-60, 0)
    return e.select("event_id", F.count("*").over(w).alias("calls"))


@query("category_counts", "SELECT lang, source, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS pct FROM documents GROUP BY lang, source")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19."""
    c = docs(spark, sf_dir, "lang", "source").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return c.select("lang", "source", "n", r6(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("lang"))).alias("pct"))


@query("balance_report", "SELECT count(*) AS total, count(*) FILTER (l.doc_id IS NULL) AS unchanged, round(count(*) FILTER (l.doc_id IS NULL)::DOUBLE / count(*), 6) AS share, count(*) FILTER (l.doc_id IS NULL)::DOUBLE / count(*) > 0.65 AS warn FROM documents d LEFT JOIN labels l USING (doc_id)")
def balance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    d = docs(spark, sf_dir, "doc_id").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    share = F.count_if(F.col("has").isNull()) / F.count("*")
    return d.agg(F.count("*").alias("total"), F.count_if(F.col("has").isNull()).alias("unchanged"), r6(share).alias("share"), (share > 0.65).alias("warn"))


@query(
    "corpus_fingerprint",
    """WITH b AS (SELECT lang, doc_id // 4096 AS b, count(*) AS n, sha256(string_agg(lang || chr(0) || sha256(text) || chr(1), '' ORDER BY doc_id)) AS h FROM documents GROUP BY ALL),
c AS (SELECT lang, b // 4096 AS c, sum(n) AS n, sha256(string_agg(h, '' ORDER BY b)) AS h FROM b GROUP BY ALL)
SELECT lang, CAST(sum(n) AS BIGINT) AS n, substr(sha256(string_agg(h, '' ORDER BY c)), 1, 16) AS fingerprint FROM c GROUP BY lang""",
)
def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent, by category, over the rows' own hashes: a tree of hashes over ranges of 4096 and 4096 * 4096 doc_ids, so that no
    task gathers a category's rows."""
    rows = docs(spark, sf_dir).select("lang", F.col("doc_id").alias("at"), F.lit(1).alias("n"), F.concat(F.col("lang"), F.lit("\0"), F.sha2("text", 256), F.lit("\1")).alias("h"))

    def level(parts: DataFrame, *by: str) -> DataFrame:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), "")
        return parts.groupBy("lang", *by).agg(F.sum("n").alias("n"), F.sha2(joined, 256).alias("h"))

    for _ in range(2):
        rows = level(rows.withColumn("up", F.floor(F.col("at") / 4096)), "up").withColumnRenamed("up", "at")
    return level(rows).select("lang", "n", F.substring("h", 1, 16).alias("fingerprint"))


@query("scalable_fingerprint")
def scalable_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15 independent of order, with partial aggregation: for corpora of any size."""
    h = F.xxhash64("doc_id", "lang", "text")
    return docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.hex(F.bit_xor(h)).alias("fingerprint"))


@query(
    "canary_counts",
    r"SELECT count(*) FILTER (regexp_matches(text, '\p{Nd}{4}')) AS years, count(*) FILTER (contains(text, '%%%')) AS noise, count(*) FILTER (list_sort(a) = list_sort(b) AND a <> b) AS permuted FROM (SELECT text, string_split(text, ' ') AS a, list_reverse(string_split(text, ' ')) AS b FROM documents)",
)
def canary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern counts, and pairs that differ in word order only."""
    a = F.split("text", " ")
    b = F.reverse(a)
    return docs(spark, sf_dir).agg(F.count_if(F.col("text").rlike(r"\p{Nd}{4}")).alias("years"), F.count_if(F.contains("text", F.lit("%%%"))).alias("noise"), F.count_if(T.same_multiset(a, b) & (a != b)).alias("permuted"))


@query("array_sets", "SELECT doc_id, CAST(len(list_intersect(list_distinct(a), list_distinct(b))) AS INT) AS common, CAST(len(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))) AS INT) AS only_a FROM (SELECT doc_id, w[1 : len(w) // 2] AS a, w[len(w) // 2 + 1 : len(w)] AS b FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))")
def array_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1, S2 on rows' arrays: the words of a text's first half and of its second half."""
    half = F.floor(F.size("w") / 2).cast("int")
    a, b = F.slice("w", F.lit(1), half), F.slice("w", half + 1, F.size("w"))
    return docs(spark, sf_dir).select("doc_id", F.split("text", " ").alias("w")).select("doc_id", F.size(F.array_intersect(a, b)).alias("common"), F.size(F.array_except(a, b)).alias("only_a"))


@query("table_sets", "SELECT 'both' AS part, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'only', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'any', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)")
def table_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1, S2, S6 on tables."""
    d, x = docs(spark, sf_dir, "doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    parts = {"both": d.intersect(x), "only": d.subtract(x), "any": d.union(x).distinct()}
    counts = [p.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, p in parts.items()]
    return counts[0].union(counts[1]).union(counts[2])


@query(
    "distinct_edits_overlap",
    f"WITH w AS (SELECT doc_id, {words_sql('text')} AS w FROM documents), g AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'dev' ELSE 'train' END AS split, unnest({ngrams_sql('w', 2)}) AS g FROM w), s AS (SELECT g, bool_or(split = 'train') AS t, bool_or(split = 'dev') AS d FROM g GROUP BY g) SELECT count(*) FILTER (t) AS train, count(*) FILTER (d) AS dev, count(*) FILTER (t AND d) AS shared FROM s",
)
def distinct_edits_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs in train and dev and how many both have; pairs of words that follow one another here."""
    w = dealt_docs(spark, sf_dir, "doc_id", "text").select("doc_id", T.words(F.col("text")).alias("w"))
    g = w.select((F.col("doc_id") % 10 == 0).alias("dev"), F.explode(T.ngrams(F.col("w"), 2)).alias("g"))
    s = g.groupBy("g").agg(F.bool_or(~F.col("dev")).alias("t"), F.bool_or("dev").alias("d"))
    return s.agg(F.count_if("t").alias("train"), F.count_if("d").alias("dev"), F.count_if(F.col("t") & F.col("d")).alias("shared"))


@query("throughput", "SELECT event_type, count(*) AS n, round(sum(value), 6) AS total, round(count(*) / nullif(sum(value), 0), 6) AS per_unit, round(avg(value) * 1000 / count(*), 6) AS batch_average FROM events GROUP BY event_type")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A26, A27, SNK7: rates that are null without a denominator."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.avg("value").alias("a"))
    return e.select("event_type", "n", r6(F.col("s")).alias("total"), r6(F.try_divide("n", "s")).alias("per_unit"), r6(F.col("a") * 1000 / F.col("n")).alias("batch_average"))


@query("percentiles", "SELECT lang, round(quantile_cont(length(text), 0.025), 6) AS low, round(quantile_cont(length(text), 0.5), 6) AS median, round(quantile_cont(length(text), 0.975), 6) AS high FROM documents GROUP BY lang")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact percentiles with linear interpolation."""
    x = F.length("text")
    return docs(spark, sf_dir).groupBy("lang").agg(*(r6(F.percentile(x, p)).alias(n) for n, p in (("low", 0.025), ("median", 0.5), ("high", 0.975))))


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY ALL")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain aggregation over a fact table."""
    p = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(p), 2).alias("sum_base"), F.round(F.sum(p * (1 - F.col("l_discount"))), 2).alias("sum_disc"), r6(F.avg("l_discount")).alias("avg_disc"), F.count("*").alias("n")
    )


@query("nation_revenue", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY n_name")
def nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star join."""
    n, c, o, li = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders", "lineitem"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("orders"))
