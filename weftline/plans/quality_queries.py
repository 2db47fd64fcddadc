"""Queries over the quality rules and the projections around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import repeats as R
from ..functions import text as T
from ..functions.profiles import LATIN
from ..operators import quality as Q
from ._tables import docs, literal, literal_sql, r6, sentences_sql, spread, table, trim_sql, with_given, with_given_sql, words_sql
from .text_queries import _phrase_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
B = LATIN.block


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def title_of(text):
    """The first line, up to 60 characters, stands in for a title."""
    return F.substring(F.split(text, "\n")[0], 1, 60)


TITLE_SQL = "substr(string_split(text, chr(10))[1], 1, 60)"


def _ratio_sql(x: str) -> str:
    return f"coalesce(length(regexp_replace({x}, '[^{B}]', '', 'g'))::DOUBLE / nullif(length({x}), 0), 0)"


_REASON_SQL = f"""CASE WHEN {TITLE_SQL} = '' OR text = '' THEN 'missing_field' WHEN length(text) < 300 THEN 'content_too_short' WHEN length(text) > 10000 THEN 'content_too_long'
  WHEN length({TITLE_SQL}) < 10 THEN 'title_too_short' WHEN length({TITLE_SQL}) > 200 THEN 'title_too_long' WHEN {_ratio_sql("text")} < 0.3 THEN 'content_not_in_script'
  WHEN {_ratio_sql(TITLE_SQL)} < 0.3 THEN 'title_not_in_script' ELSE 'ok' END"""


@query("preprocess_reasons", f"SELECT {_REASON_SQL} AS reason, lang, count(*) AS n, round(avg(length(text)), 6) AS mean_chars FROM documents GROUP BY ALL")
def preprocess_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by reason and language."""
    d = docs(spark, sf_dir).withColumn("reason", Q.article_reason(title_of(F.col("text")), F.col("text")))
    return d.groupBy("reason", "lang").agg(F.count("*").alias("n"), r6(F.avg(F.length("text"))).alias("mean_chars"))


@query("accepted_articles", f"SELECT doc_id, {TITLE_SQL} AS title, lang AS category FROM documents WHERE ({_REASON_SQL}) = 'ok'")
def accepted_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 as a filter, SRC7's projection."""
    d = docs(spark, sf_dir)
    return d.where(Q.article_reason(title_of(F.col("text")), F.col("text")) == "ok").select("doc_id", title_of(F.col("text")).alias("title"), F.col("lang").alias("category"))


@query(
    "headline_validity",
    f"""
SELECT doc_id, length(h) >= 5 AND regexp_matches(h, '[{B}]') AND len({words_sql("h")}) BETWEEN 3 AND 10 AND length(text) >= 50 AS valid
FROM (SELECT doc_id, text, {trim_sql("string_split(text, chr(10))[1]")} AS h FROM documents)""",
)
def headline_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5."""
    d = docs(spark, sf_dir).withColumn("h", T.trim_ws(F.split("text", "\n")[0]))
    valid = (F.length("h") >= 5) & T.has_script(F.col("h")) & (T.band(T.word_count(F.col("h"))) != "other") & (F.length("text") >= 50)
    return d.select("doc_id", valid.alias("valid"))


def summaries(d: DataFrame) -> DataFrame:
    """doc_id, text, short, medium, long: the first 1, 3 and 5 sentences stand in for summaries."""
    s = T.sentences(F.col("text"))
    return d.select("doc_id", "text", *(F.array_join(F.slice(s, 1, n), " ").alias(b) for b, n in (("short", 1), ("medium", 3), ("long", 5))))


SUMMARIES_SQL = f"SELECT doc_id, text, array_to_string(s[1:1], ' ') AS short, array_to_string(s[1:3], ' ') AS medium, array_to_string(s[1:5], ' ') AS long FROM (SELECT doc_id, text, {sentences_sql('text')} AS s FROM documents)"
_LONG_SUMMARIES = "SELECT doc_id, text, bucket, summary FROM (" + " UNION ALL ".join(f"SELECT doc_id, text, '{b}' AS bucket, {b} AS summary FROM s" for b in ("short", "medium", "long")) + ")"


@query("unpivot_lengths", f"WITH s AS ({SUMMARIES_SQL}), u AS ({_LONG_SUMMARIES}) SELECT doc_id, bucket, sha256(summary) AS summary_sha FROM u WHERE summary <> ''")
def unpivot_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P19."""
    u = summaries(docs(spark, sf_dir)).unpivot(["doc_id"], ["short", "medium", "long"], "bucket", "summary")
    return u.where("summary <> ''").select("doc_id", "bucket", F.sha2("summary", 256).alias("summary_sha"))


_UNIT = r"(?:[0-9][0-9,]*(?:\.[0-9]+)?)\s*(?:ten\s*lakh|thousand|lakh|million|crore|billion)|(?:ten\s*lakh|thousand|lakh|million|crore|billion)\s*\.?\s*(?:[0-9][0-9,]*(?:\.[0-9]+)?)"


def _bucket_sql(name: str, column: str) -> str:
    return f"CASE bucket WHEN 'short' THEN {column[0]} WHEN 'medium' THEN {column[1]} ELSE {column[2]} END"


_SUMMARY_REASON_SQL = rf"""
WITH s AS ({SUMMARIES_SQL}), u AS ({_LONG_SUMMARIES}),
c AS (SELECT doc_id, bucket, text, {trim_sql("regexp_replace(" + trim_sql("summary") + r", '(?i)^(?:[0-9]+[.)]|short:|medium:|long:)\s*', '')")} AS x FROM u),
m AS (SELECT *, len({words_sql("x")}) AS n, len({words_sql("text")}) AS m, CASE bucket WHEN 'short' THEN 0.04::DOUBLE WHEN 'medium' THEN 0.12 ELSE 0.22 END AS low,
  CASE bucket WHEN 'short' THEN 0.18::DOUBLE WHEN 'medium' THEN 0.32 ELSE 0.55 END AS high, CASE bucket WHEN 'short' THEN 45 WHEN 'medium' THEN 80 ELSE 130 END AS most FROM c),
k AS (SELECT *, greatest(most, CAST(floor(m * high + 15) AS BIGINT)) AS cap, CASE WHEN m > 0 THEN n::DOUBLE / m ELSE 0 END AS ratio,
  CASE WHEN m < 100 THEN least(0.85::DOUBLE, high + 0.25::DOUBLE * (1 - m::DOUBLE / 100)) ELSE high END AS bound,
  list_sort(list_filter(list_distinct(regexp_extract_all(x, '\p{{Nd}}+')), lambda y: NOT list_contains(regexp_extract_all(text, '\p{{Nd}}+'), y) AND y NOT IN ('10', '20', '35', '1', '2', '3'))) AS extra,
  regexp_extract(x, '[{B}0-9\x{{200c}}\x{{200d}}]{{24,}}') AS glue FROM m)
SELECT doc_id, bucket, CASE WHEN x = '' THEN 'empty' WHEN contains(x, chr(65533)) THEN 'replacement_char' WHEN starts_with(x, '#') OR contains(x, chr(10) || '#') THEN 'markdown_header'
  WHEN regexp_matches(x, '^\p{{M}}') THEN 'leading_combining_mark' WHEN contains(x, 'here is the rewritten') THEN 'meta_commentary:here is the rewritten' WHEN contains(x, 'rewritten article') THEN 'meta_commentary:rewritten article'
  WHEN n < 8 THEN 'too_short' WHEN n > cap THEN 'over_word_cap:' || n || '>' || cap WHEN ratio < low OR ratio > bound THEN 'ratio_out_of_band'
  WHEN len(extra) > 0 THEN 'hallucinated_numbers:' || array_to_string(extra[1:3], ',') WHEN glue <> '' THEN 'word_glue:' || substr(glue, 1, 40) END AS reason
FROM k"""


@query("summary_reasons", _SUMMARY_REASON_SQL)
def summary_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9, P10, P17. Summaries are parts of their articles here, so units never mismatch; given rows test those."""
    buckets = ("short", "medium", "long")
    reasons = Q.with_summary_reasons(summaries(spread(docs(spark, sf_dir, "doc_id", "text"))), buckets, "text")
    each = F.array(*(F.struct(F.lit(b).alias("bucket"), F.col(f"reason_{b}").alias("reason")) for b in buckets))
    return reasons.select("doc_id", F.inline(each))


@query(
    "summary_yield",
    f"SELECT bucket, count(*) AS n, count(*) FILTER (reason IS NULL) AS kept, round(100.0::DOUBLE * count(*) FILTER (reason IS NULL) / count(*), 6) AS kept_pct FROM ({_SUMMARY_REASON_SQL}) GROUP BY bucket",
)
def summary_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20."""
    good = F.count_if(F.col("reason").isNull())
    return summary_reasons(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("n"), good.alias("kept"), r6(100.0 * good / F.count("*")).alias("kept_pct"))


@query(
    "bucket_filter",
    f"""
WITH s AS ({SUMMARIES_SQL}), u AS ({_LONG_SUMMARIES}), c AS (SELECT * FROM (VALUES ('short', 0.04::DOUBLE, 0.18::DOUBLE, 70), ('medium', 0.12, 0.32, 120), ('long', 0.22, 0.55, 190)) v(bucket, low, high, cap)),
n AS (SELECT doc_id, bucket, len({words_sql("text")}) AS a, len({words_sql("summary")}) AS s FROM u)
SELECT doc_id, bucket, CAST(a AS INT) AS article_words, CAST(s AS INT) AS summary_words FROM n JOIN c USING (bucket) WHERE a >= 50 AND s BETWEEN 10 AND cap AND s::DOUBLE / a BETWEEN low AND high""",
)
def bucket_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11 with words as tokens; the bounds are a table."""
    u = summaries(docs(spark, sf_dir)).unpivot(["doc_id", "text"], ["short", "medium", "long"], "bucket", "summary")
    config = literal(spark, "bucket low high cap", [(b, float(x), float(y), n) for b, x, y, n in Q.TRAIN_BUCKETS])
    n = u.select("doc_id", "bucket", T.word_count(F.col("text")).alias("article_words"), T.word_count(F.col("summary")).alias("summary_words"))
    fits = (F.col("article_words") >= 50) & F.col("summary_words").between(10, F.col("cap")) & (F.col("summary_words") / F.col("article_words")).between(F.col("low"), F.col("high"))
    return n.join(F.broadcast(config), "bucket").where(fits).select("doc_id", "bucket", "article_words", "summary_words")  # three rows


@query(
    "legacy_filter",
    f"WITH s AS ({SUMMARIES_SQL}), n AS (SELECT doc_id, len({words_sql('text')}) AS a, len({words_sql('medium')}) AS m FROM s) SELECT count(*) AS n, count(*) FILTER (a >= 50 AND m BETWEEN 10 AND 150 AND m::DOUBLE / a BETWEEN 0.05 AND 0.5) AS kept FROM n",
)
def legacy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12."""
    s = summaries(docs(spark, sf_dir)).select(T.word_count(F.col("text")).alias("a"), T.word_count(F.col("medium")).alias("m"))
    # The ratio is read twice, so it is computed ahead of the conditions that would spare texts without words a division.
    ratio = F.try_divide("m", "a")
    return s.agg(F.count("*").alias("n"), F.count_if((F.col("a") >= 50) & F.col("m").between(10, 150) & ratio.between(0.05, 0.5)).alias("kept"))


@query(
    "find_defect",
    rf"WITH s AS ({SUMMARIES_SQL}) SELECT doc_id, CASE "
    + " ".join(rf"WHEN regexp_extract({b}, '[{B}0-9\x{{200c}}\x{{200d}}]{{24,}}') <> '' THEN '{b}:word_glue:' || substr(regexp_extract({b}, '[{B}0-9\x{{200c}}\x{{200d}}]{{24,}}'), 1, 40)" for b in ("short", "medium", "long"))
    + " END AS defect FROM s",
)
def find_defect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15."""
    s = summaries(docs(spark, sf_dir))
    return s.select("doc_id", Q.find_defect({b: F.col(b) for b in ("short", "medium", "long")}, F.col("text")).alias("defect"))


@query("page_acceptance", f"SELECT page_id, h <> '' AND body <> '' AND len({words_sql('body')}) >= 10 AS accepted FROM (SELECT page_id, {trim_sql("regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g')")} AS h, {trim_sql("regexp_replace(regexp_extract(html, '(?s)</h1>(.*?)</article>', 1), '<[^>]+>', ' ', 'g')")} AS body FROM pages)")
def page_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P16."""
    head = T.trim_ws(F.regexp_replace(F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", ""))
    body = T.trim_ws(F.regexp_replace(F.regexp_extract("html", "(?s)</h1>(.*?)</article>", 1), "<[^>]+>", " "))
    pages = table(spark, sf_dir, "pages").select("page_id", head.alias("h"), body.alias("body"))
    return pages.select("page_id", ((F.col("h") != "") & (F.col("body") != "") & (T.word_count(F.col("body")) >= 10)).alias("accepted"))


@query(
    "record_conversion",
    f"""
SELECT d.doc_id, d.lang AS style, CASE WHEN l.toxic = 1 THEN 'toxic' WHEN length({trim_sql("d.text")}) < 50 THEN 'too_short' WHEN d.lang NOT IN ('en', 'de', 'fr', 'es') THEN 'unknown_style' ELSE 'ok' END AS outcome
FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def record_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels play the tags for which a row is dropped."""
    d = docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    outcome = Q.first_reason((F.col("toxic") == 1, "toxic"), (F.length(T.trim_ws(F.col("text"))) < 50, "too_short"), (~F.col("lang").isin("en", "de", "fr", "es"), "unknown_style"), default="ok")
    return d.select("doc_id", F.col("lang").alias("style"), outcome.alias("outcome"))


_RESULTS = [
    (1, "ok", None, "text"),
    (2, "failed", None, "text"),
    (3, None, "timeout", "text"),
    (4, "ok", "", "  "),
    (5, None, None, None),
    (6, "FAILED", "", "x"),
]


_RESULT_ROWS = ["doc_id + 1000", "CASE doc_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'ok' END", "CASE WHEN doc_id % 9 = 0 THEN 'timeout' END", "CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE text END"]


@query(
    "failed_rows",
    f"SELECT id, coalesce(lower(status), '') = 'failed' OR coalesce(error, '') <> '' OR {trim_sql("coalesce(rewritten, '')")} = '' AS failed, CASE WHEN coalesce(error, '') <> '' THEN 'error' ELSE 'result' END AS branch FROM "
    + with_given_sql("id status error rewritten", _RESULTS, "documents", _RESULT_ROWS),
)
def failed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7, SNK4, on given rows and all documents."""
    t = with_given(spark, sf_dir, "id status error rewritten", _RESULTS, "documents", _RESULT_ROWS)
    bad = t.where("coalesce(error, '') <> ''").withColumn("branch", F.lit("error"))
    good = t.where("coalesce(error, '') = ''").withColumn("branch", F.lit("result"))
    return bad.union(good).select("id", Q.is_failed(F.col("status"), F.col("error"), F.col("rewritten")).alias("failed"), "branch")


@query(
    "composite_field",
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'General' ELSE lang END AS category, sha256(substr(text, 1, 2000)) AS body_sha FROM documents",
)
def composite_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build and parse 'Category: ...\\nArticle: ...'; every third row has no category."""
    built = F.concat(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("Category: "), F.col("lang"), F.lit("\n"))), F.lit("Article: "), F.substring("text", 1, 2000))
    category, body = Q.composite(F.col("field"))
    return docs(spark, sf_dir).select("doc_id", built.alias("field")).select("doc_id", category.alias("category"), F.sha2(body, 256).alias("body_sha"))


def _rewritten():
    """A rewrite that sometimes goes wrong: by doc_id half of the text, a heading, a code fence, a forced phrase, digits dropped, or the text."""
    c, k = F.col("text"), F.col("doc_id") % 7
    return (
        F.when(k == 1, F.substring("text", 1, 200))
        .when(k == 2, F.concat(F.lit("# "), c))
        .when(k == 3, F.concat(F.lit("```\n"), c, F.lit("\n```")))
        .when(k == 4, F.concat(F.lit("In conclusion "), c))
        .when(k == 5, F.regexp_replace(c, "[0-9]", ""))
        .when(k == 6, F.concat(c, F.lit(" "), c))
        .otherwise(c)
    )


def _found_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(docs(spark, sf_dir, "doc_id", "text")).select("doc_id", F.col("text").alias("original"), _rewritten().alias("text"))
    words = F.regexp_extract_all("text", F.lit(f"[{B}]+"), F.lit(0))
    flagged = d.withColumns({"word_repeat": R.word_repeated(ignored=LATIN.repetition_ignored)(words), "phrase_repeat": R.phrase_repeated(4)(T.words(F.col("text")))})
    return Q.with_rewrite_issues(flagged, "original", "text", "word_repeat", "phrase_repeat")


_REWRITE_SQL = """CASE doc_id % 7 WHEN 1 THEN substr(text, 1, 200) WHEN 2 THEN '# ' || text WHEN 3 THEN '```' || chr(10) || text || chr(10) || '```' WHEN 4 THEN 'In conclusion ' || text
  WHEN 5 THEN regexp_replace(text, '[0-9]', '', 'g') WHEN 6 THEN text || ' ' || text ELSE text END"""


def _style_sql(x: str) -> str:
    return trim_sql(rf"regexp_replace(regexp_replace(regexp_replace(replace({x}, chr(173), ''), '\r\n', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


_NUM = r"\p{Nd}+(?:[.,]\p{Nd}+)*"


@query(
    "rewrite_issues",
    rf"""
WITH documents_ AS (SELECT doc_id, text AS original, {_REWRITE_SQL} AS text FROM documents),
word AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[{B}]+')) AS w FROM documents_) GROUP BY ALL),
words AS (SELECT doc_id, sum(n) >= 20 AND bool_or(length(w) > 3 AND n >= 12 AND w NOT IN ('that', 'this', 'with', 'from')) AS word_repeat FROM word GROUP BY doc_id),
phrase AS ({_phrase_sql(4).replace("FROM documents d", "FROM documents_ d").replace("FROM documents)", "FROM documents_)")}),
x AS (SELECT d.doc_id, {_style_sql("original")} AS a, {_style_sql("text")} AS b, coalesce(word_repeat, false) AS word_repeat, phrase.repeated AS phrase_repeat FROM documents_ d LEFT JOIN words USING (doc_id) LEFT JOIN phrase USING (doc_id)),
i AS (SELECT doc_id, CASE WHEN b = '' THEN ['empty'] ELSE list_sort(list_filter([
  CASE WHEN length(b) < 50 THEN 'too_short' END, CASE WHEN length(b)::DOUBLE / greatest(length(a), 1) < 0.55 THEN 'too_short_relative_to_source' END, CASE WHEN length(b)::DOUBLE / greatest(length(a), 1) > 1.8 THEN 'too_long' END,
  CASE WHEN coalesce(length(regexp_replace(b, '[^{B}]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(b, '[^{B}A-Za-z]', '', 'g')), 0), 0) < 0.6 THEN 'low_script_ratio' END,
  CASE WHEN b = '' OR ends_with(b, '..') OR (NOT regexp_matches(b, '[.!?]$') AND length(a) > 500) OR (length(a) >= 500 AND length(b)::DOUBLE / length(a) < 0.55) THEN 'possible_truncation' END,
  CASE WHEN len(list_filter(list_distinct(regexp_extract_all(a, '{_NUM}')), lambda n: len(list_filter(regexp_extract_all(b, '{_NUM}'), lambda m: m = n)) < len(list_filter(regexp_extract_all(a, '{_NUM}'), lambda m: m = n)))) > 0 THEN 'missing_source_number' END,
  CASE WHEN word_repeat THEN 'word_repetition' END, CASE WHEN phrase_repeat THEN 'phrase_repetition' END, CASE WHEN contains(b, '```') THEN 'markdown_artifact' END, CASE WHEN starts_with(b, '#') THEN 'markdown_heading' END,
  CASE WHEN contains(lower(b), 'here is the rewritten') OR contains(lower(b), 'rewritten article') THEN 'meta_text' END,
  CASE WHEN contains(lower(b), 'in conclusion') OR contains(lower(b), 'it is important to note') OR contains(lower(b), 'as an ai') THEN 'forced_phrase' END], lambda r: r IS NOT NULL)) END AS issues FROM x)
SELECT doc_id, array_to_string(issues, ',') AS issues, len(list_filter(issues, lambda r: r NOT IN ('too_long', 'markdown_heading'))) > 0 AS serious FROM i""",
)
def rewrite_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13, F31, F32, F33, S5."""
    return _found_issues(spark, sf_dir).select("doc_id", F.array_join("issues", ",").alias("issues"), Q.is_serious(F.col("issues")).alias("serious"))


@query(
    "issue_counts",
    f"SELECT issue, count(*) AS n FROM (SELECT unnest(string_split(issues, ',')) AS issue FROM ({ORACLE_SQL['rewrite_issues']}) WHERE issues <> '') GROUP BY issue",
)
def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25."""
    # A filter on the issues, also the one that a plain explode brings, would find them a second time.
    each = _found_issues(spark, sf_dir).select(F.explode_outer("issues").alias("issue"))
    return each.where("issue IS NOT NULL").groupBy("issue").agg(F.count("*").alias("n"))


_ADAPTERS = [
    ("grammar_v25", "base"),
    ("grammar_v27", "base"),
    ("grammar_v27.2", "base"),
    ("headline_v20", "base"),
    ("style_v11", "base"),
    ("style_v9.50", "base"),
    ("mt5_small_v01", "mt5"),
    ("summarizer_v06", "base"),
    ("summarizer_v05", "base"),
    ("plain", "base"),
]
_REQUESTS = [(1, "grammar", None, None), (2, "headline", "grammar_v25", "short"), (3, "nothing", "nosuch", "LONG"), (4, "summarizer", "summarizer_v06", None), (5, "summarizer", "summarizer_v05", "long"), (6, "style", "style_v11", "giant")]
_VERSION = r"CASE WHEN regexp_extract(name, '_v(\d+)', 1) <> '' THEN CAST(regexp_extract(name, '_v(\d+)', 1) AS DOUBLE) + coalesce(CAST(nullif(regexp_extract(name, '_v\d+\.(\d+)', 1), '') AS DOUBLE), 0) / 100 END"
_FAMILY = "CASE WHEN starts_with(name, 'mt5') THEN 'mt5' WHEN starts_with(name, 'extractive') THEN 'extractive' WHEN starts_with(name, 'grammar') THEN 'grammar' WHEN starts_with(name, 'headline') THEN 'headline' WHEN starts_with(name, 'style') THEN 'style' WHEN starts_with(name, 'summarizer') THEN 'summarizer' ELSE 'custom' END"


#: A name for each language and source, so there are as many as sources.
_ADAPTER_NAMES = "concat(CASE lang WHEN 'en' THEN 'style' WHEN 'de' THEN 'grammar' WHEN 'fr' THEN 'headline' ELSE 'summarizer' END, '_v', substr(source, 4))"
_ADAPTERS_SQL = f"(SELECT name FROM {literal_sql('name kind', _ADAPTERS)} UNION SELECT {_ADAPTER_NAMES} FROM documents)"
_REQUEST_ROWS = [
    "doc_id + 1000", "CASE doc_id % 5 WHEN 0 THEN 'grammar' WHEN 1 THEN 'headline' WHEN 2 THEN 'style' WHEN 3 THEN 'summarizer' ELSE lang END",
    f"CASE WHEN doc_id % 4 = 0 THEN {_ADAPTER_NAMES} WHEN doc_id % 31 = 0 THEN 'nosuch' END", "CASE WHEN n_chars < 1000 THEN 'SHORT' WHEN n_chars < 4000 THEN 'medium' WHEN n_chars < 9000 THEN 'long' ELSE 'giant' END",
]


def _adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal(spark, "name kind", _ADAPTERS).select("name").union(docs(spark, sf_dir).selectExpr(f"{_ADAPTER_NAMES} AS name")).distinct()


@query(
    "latest_adapters",
    f"SELECT family, arg_max(name, version) AS latest, round(max(version), 6) AS version, array_to_string(list_sort(list_append(list(name), 'base')), ',') AS members FROM (SELECT name, {_FAMILY} AS family, {_VERSION} AS version FROM {_ADAPTERS_SQL}) GROUP BY family",
)
def latest_adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC10, F65, F66, A28, S7: given adapters, and one of each language and source."""
    t = _adapters(spark, sf_dir)
    a = t.select("name", T.family_of(F.col("name")).alias("family"), T.version_of(F.col("name")).alias("version"))
    members = F.array_join(F.sort_array(F.array_union(F.collect_list("name"), F.array(F.lit("base")))), ",")
    return a.groupBy("family").agg(F.max_by("name", "version").alias("latest"), r6(F.max("version")).alias("version"), members.alias("members"))


@query(
    "adapter_resolution",
    f"""
WITH a AS (SELECT name, {_FAMILY} AS family, {_VERSION} AS version FROM {_ADAPTERS_SQL}), d AS (SELECT family, arg_max(name, version) AS latest FROM a GROUP BY family),
r AS (SELECT *, CASE WHEN task IN ('grammar', 'headline', 'style', 'summarizer') THEN task ELSE 'grammar' END AS task_ FROM {with_given_sql("id task adapter len", _REQUESTS, "documents", _REQUEST_ROWS)}),
j AS (SELECT r.id, r.task_, r.adapter, r.len, coalesce(r.adapter, d.latest) AS resolved, x.family, x.version FROM r LEFT JOIN d ON d.family = r.task_ LEFT JOIN a x ON x.name = coalesce(r.adapter, d.latest))
SELECT id, task_ AS task, CASE WHEN family = task_ THEN resolved END AS resolved, CASE WHEN family IS NULL THEN 'unknown_adapter' WHEN family <> task_ THEN 'category_mismatch' END AS error,
  CASE WHEN version < 6 THEN NULL WHEN lower(len) IN ('short', 'medium', 'long') THEN lower(len) ELSE 'medium' END AS effective_length FROM j""",
)
def adapter_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given requests, and one of each document."""
    adapters = _adapters(spark, sf_dir).select("name", T.family_of(F.col("name")).alias("family"), T.version_of(F.col("name")).alias("version"))
    latest = adapters.groupBy("family").agg(F.max_by("name", "version").alias("latest"))
    r = with_given(spark, sf_dir, "id task adapter len", _REQUESTS, "documents", _REQUEST_ROWS).withColumn("task", F.when(F.col("task").isin("grammar", "headline", "style", "summarizer"), F.col("task")).otherwise("grammar"))
    j = r.join(latest.withColumnRenamed("family", "task"), "task", "left").withColumn("name", F.coalesce("adapter", "latest")).join(adapters, "name", "left")
    length = F.when(F.col("version") < 6, F.lit(None)).when(F.lower("len").isin("short", "medium", "long"), F.lower("len")).otherwise("medium")
    error = Q.first_reason((F.col("family").isNull(), "unknown_adapter"), (F.col("family") != F.col("task"), "category_mismatch"))
    return j.select("id", "task", F.when(F.col("family") == F.col("task"), F.col("name")).alias("resolved"), error.alias("error"), length.alias("effective_length"))


_STYLES = [("formal", "Formal"), ("editorial", "Editorial"), ("youth", "Youth")]


@query("style_names", f"SELECT s.id, s.label, d.n FROM {literal_sql('id label', _STYLES).replace('AS t(', 'AS s(')} LEFT JOIN (SELECT CASE lang WHEN 'en' THEN 'formal' WHEN 'de' THEN 'editorial' ELSE 'youth' END AS id, count(*) AS n FROM documents GROUP BY 1) d USING (id)")
def style_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20."""
    names = literal(spark, "id label", _STYLES)
    d = docs(spark, sf_dir).groupBy(F.when(F.col("lang") == "en", "formal").when(F.col("lang") == "de", "editorial").otherwise("youth").alias("id")).agg(F.count("*").alias("n"))
    return names.join(d, "id", "left").select("id", "label", "n")


@query("truncation_guard", f"SELECT count(*) AS n, count(*) FILTER (len({words_sql('text')}) > 5000) AS too_long, max(len({words_sql('text')})) AS longest FROM documents")
def truncation_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P23 as a report; operators.checks.require() raises."""
    n = T.word_count(F.col("text"))
    return docs(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(n > 5000).alias("too_long"), F.max(n).cast("long").alias("longest"))


@query("page_articles")
def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F60, SRC8, P16: headline, size and category of each page's article."""
    from ..functions.pages import article_of

    a = table(spark, sf_dir, "pages").select("page_id", article_of("html").alias("a")).select("page_id", "a.*")
    category = T.category(T.matcher_text(F.col("headline")), T.matcher_text(F.col("content")))
    accepted = (F.col("headline") != "") & (F.col("content") != "") & (T.word_count(F.col("content")) >= 10)
    return a.select("page_id", F.sha2("headline", 256).alias("headline_sha"), T.word_count(F.col("content")).alias("n_words"), category.alias("category"), accepted.alias("accepted"))
