"""Queries over the extractive summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from ..functions.profiles import LATIN
from ..operators import summarize as Z
from ..sources.shared import stored
from ._tables import docs, ngrams_sql, r6, sentences_sql, table, tokens_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


_S = f"s AS (SELECT doc_id, len(s) AS total, generate_subscripts(s, 1) - 1 AS k, unnest(s) AS sentence FROM (SELECT doc_id, {sentences_sql('text')} AS s FROM documents))"
_PICK = """r AS (SELECT s.*, row_number() OVER (PARTITION BY s.doc_id ORDER BY round(coalesce(c.score, 0), 9) DESC, s.k) AS r FROM s LEFT JOIN c USING (doc_id, k))
SELECT doc_id, string_agg(sentence, ' ' ORDER BY k) AS summary FROM r WHERE r <= 3 OR total <= 3 GROUP BY doc_id"""

_TFIDF = f"""WITH {_S}, w AS (SELECT doc_id, k, total, unnest({tokens_sql("sentence")}) AS w FROM s),
d AS (SELECT doc_id, w, ln((any_value(total) + 1)::DOUBLE / (count(DISTINCT k) + 1)) + 1 AS idf FROM w GROUP BY ALL), c AS (SELECT doc_id, k, avg(idf) AS score FROM w JOIN d USING (doc_id, w) GROUP BY ALL), {_PICK}"""


@query("tfidf_topn", _TFIDF)
def tfidf_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1, F53, W5."""
    return Z.summarize(docs(spark, sf_dir), "tfidf")


@query(
    "rake_topn",
    f"""WITH {_S}, t AS (SELECT doc_id, generate_subscripts(t, 1) AS i, unnest(t) AS w FROM (SELECT doc_id, {tokens_sql("lower(text)")} AS t FROM documents)),
g AS (SELECT doc_id, w, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM t WHERE w NOT IN ({", ".join(f"'{w}'" for w in LATIN.stopwords)})), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n FROM g),
ws AS (SELECT doc_id, w, (sum(n - 1) + count(*))::DOUBLE / count(*) AS x FROM n GROUP BY ALL),
sw AS (SELECT doc_id, k, len(t) AS size, unnest(t) AS w FROM (SELECT doc_id, k, {tokens_sql("lower(sentence)")} AS t FROM s)),
c AS (SELECT doc_id, k, sum(x) / sqrt(any_value(size)) AS score FROM sw JOIN ws USING (doc_id, w) GROUP BY ALL), {_PICK}""",
)
def rake_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3."""
    return Z.summarize(docs(spark, sf_dir), "extractive_rake")


@query(
    "yake_topn",
    f"""WITH {_S}, sw AS (SELECT doc_id, k, total, len(t) AS size, generate_subscripts(t, 1) AS i, unnest(t) AS w FROM (SELECT doc_id, k, total, {tokens_sql("lower(sentence)")} AS t FROM s)),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, i) - 1 AS pos, lag(w) OVER (PARTITION BY doc_id, k ORDER BY i) AS l, lead(w) OVER (PARTITION BY doc_id, k ORDER BY i) AS r FROM sw),
f AS (SELECT doc_id, w, count(*) AS f, list_sort(list(pos))[count(*) // 2 + 1] AS median, count(DISTINCT l) AS dl, count(DISTINCT r) AS dr, count(DISTINCT k) AS ds, any_value(total) AS total FROM p GROUP BY doc_id, w),
st AS (SELECT doc_id, avg(f) AS mean, stddev_pop(f) AS std, max(f) AS most FROM f GROUP BY doc_id),
x AS (SELECT doc_id, w, ds, total, ln(median + 2.0::DOUBLE) AS pos, f / (mean + std + 1e-6) AS freq, 1 + (dl::DOUBLE / f + dr::DOUBLE / f) * (f::DOUBLE / most) AS rel FROM f JOIN st USING (doc_id)),
y AS (SELECT doc_id, w, 1 / ((rel * pos) / (1 + freq / rel + (ds::DOUBLE / total) / rel) + 1e-4) AS weight FROM x),
u AS (SELECT DISTINCT doc_id, k, w, size FROM sw), c AS (SELECT doc_id, k, sum(weight) / sqrt(any_value(size)) AS score FROM u JOIN y USING (doc_id, w) GROUP BY ALL), {_PICK}""",
)
def yake_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4, W7, W8."""
    return Z.summarize(docs(spark, sf_dir), "yake")


@query("textrank_topn")
def textrank_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal scores the earlier sentence."""
    return Z.summarize(docs(spark, sf_dir), "textrank")


@query("mmr_topn")
def mmr_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5."""
    return Z.summarize(docs(spark, sf_dir), "keybert")


def _summary_rows(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    from ..functions.register import register

    register(spark)
    docs(spark, sf_dir, "doc_id", "text").createOrReplaceTempView("weftline_texts")
    return spark.sql(f"SELECT doc_id, summary FROM summary_rows(TABLE(SELECT doc_id, text FROM weftline_texts) PARTITION BY (doc_id), '{method}', 3)")


@query("sql_summaries", _TFIDF)
def sql_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.11, T1: the rows of tfidf_topn from SQL text, by a table function over partitions."""
    return _summary_rows(spark, sf_dir, "tfidf")


@query("sql_summaries_yake", ORACLE_SQL["yake_topn"])
def sql_summaries_yake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.11, T4."""
    return _summary_rows(spark, sf_dir, "extractive_yake")


@query("sql_summaries_rake", ORACLE_SQL["rake_topn"])
def sql_summaries_rake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.11, T3."""
    return _summary_rows(spark, sf_dir, "extractive_rake")


def _with_first_line(d: DataFrame, method: str) -> DataFrame:
    """The words of each summary (a) and of its document's first line (b). The line goes along in the key, so that no text is joined
    again. Summaries and lines are written once: they are a small part of the texts, and Spark does not plan the overlaps' function over that of the scores."""
    keyed = d.select(F.struct("doc_id", F.split("text", "\n")[0].alias("line")).alias("key"), "text")
    return stored(Z.summarize(keyed, method, key="key"), "summaries").select("key.doc_id", T.words(F.col("summary")).alias("a"), T.words(F.col("key.line")).alias("b"))


@query("summary_evaluation", None)
def summary_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean ROUGE-1 and ROUGE-2 of each method's summaries against the first line, over words."""
    d = docs(spark, sf_dir)
    parts = []
    for method in Z.METHODS:
        p = _with_first_line(d, method)
        o = M.overlaps(p, "a", "b", {"1": 1, "2": 2})
        r = o.select(*(M.rouge_f1(F.col(f"common_{n}"), F.col(f"a_{n}"), F.col(f"b_{n}")).alias(f"rouge{n}") for n in (1, 2)))
        parts.append(r.agg(F.lit(method).alias("method"), F.count("*").alias("n"), *(F.round(F.avg(f"rouge{n}"), 4).alias(f"rouge{n}") for n in (1, 2))).select("method", "n", "rouge1", "rouge2"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


_GOLD_EVAL = f"""z AS ({_TFIDF.replace("WITH ", "WITH ", 1)}),
p AS (SELECT doc_id, list_filter(string_split_regex(summary, '\\s+'), lambda w: w <> '') AS a, list_filter(string_split_regex(string_split(text, chr(10))[1], '\\s+'), lambda w: w <> '') AS b FROM z JOIN documents USING (doc_id)),
g AS (SELECT doc_id, g, sum(x) AS x, sum(y) AS y FROM (SELECT doc_id, unnest({ngrams_sql("a", 1)}) AS g, 1 AS x, 0 AS y FROM p UNION ALL SELECT doc_id, unnest({ngrams_sql("b", 1)}), 0, 1 FROM p) GROUP BY ALL),
o AS (SELECT doc_id, coalesce(2.0::DOUBLE * sum(least(x, y)) / nullif(sum(x) + sum(y), 0), 0) AS r FROM g GROUP BY doc_id)"""


@query("tfidf_evaluation", f"WITH {_GOLD_EVAL} SELECT count(*) AS n, round(sum(r) / count(*), 4) AS rouge1 FROM p LEFT JOIN o USING (doc_id)")
def tfidf_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7 for one relational method, so that SQL can check it."""
    d = docs(spark, sf_dir)
    p = _with_first_line(d, "tfidf")
    o = M.overlaps(p, "a", "b", {"1": 1})
    return o.agg(F.count("*").alias("n"), F.round(F.avg(M.rouge_f1(F.col("common_1"), F.col("a_1"), F.col("b_1"))), 4).alias("rouge1"))


@query(
    "vector_mmr_pool",
    "WITH q AS (SELECT label, embedding FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1), s AS (SELECT e.label, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS c FROM embeddings e JOIN q USING (label)) SELECT label, vec_id, round(c, 6) AS cosine FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(c, 9) DESC, vec_id) <= 5",
)
def vector_mmr_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F52 on dense vectors: of each label the 5 nearest to its first vector."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    q = e.groupBy("label").agg(F.min_by("e", "vec_id").alias("q"))

    def dot(a: str, b: str):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    s = e.join(q, "label").select("label", "vec_id", (dot("e", "q") / (F.sqrt(dot("e", "e")) * F.sqrt(dot("q", "q")))).alias("c"))
    ranked = s.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.round("c", 9)), "vec_id")))
    return ranked.where("r <= 5").select("label", "vec_id", r6(F.col("c")).alias("cosine"))
