"""Queries over streams and record files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.selection import hash_split
from ..sources import records as R
from ..sources.shared import shared_path, stored
from ..streaming import crawl as C
from ..streaming import events as V
from ..streaming import quota as Q
from ._tables import docs, r6, squeeze_sql, table, words_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def _ntz(c: str):
    return F.col(c).cast("timestamp_ntz").alias(c)


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.run_once(V.tumbling(V.read_events(spark, sf_dir)), "tumbling").select(_ntz("start"), "event_type", "n", r6(F.col("total")).alias("total"))


@query("stream_sliding", "SELECT b AS start, count(*) AS n FROM (SELECT unnest(list_transform(range(0, 4), lambda i: time_bucket(INTERVAL 15 MINUTE, ts) - CAST(i AS INT) * INTERVAL 15 MINUTE)) AS b FROM events) GROUP BY b")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.run_once(V.sliding(V.read_events(spark, sf_dir)), "sliding").select(_ntz("start"), "n")


@query(
    "stream_sessions",
    """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.run_once(V.sessions(V.read_events(spark, sf_dir)), "sessions").select("user_id", _ntz("start"), _ntz("end"), "n")


@query("stream_dedup", "SELECT count(DISTINCT event_id) AS kept FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event comes twice; each is kept once."""
    e = V.read_events(spark, sf_dir).select("event_id", "ts").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return V.run_once(V.first_of_each(e, ["event_id"]), "dedup", "append").agg(F.count("*").alias("kept"))


@query(
    "stream_adaptive_limits",
    """
WITH RECURSIVE e AS (SELECT user_id, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
step AS (
  SELECT DISTINCT user_id, 0::BIGINT AS k, 1.0::DOUBLE AS rate, 0 AS streak FROM e
  UNION ALL
  SELECT e.user_id, e.k, CASE WHEN failed THEN greatest(rate * 0.5, 0.01) WHEN streak = 14 THEN rate * 1.15 ELSE rate END, CASE WHEN failed OR streak = 14 THEN 0 ELSE streak + 1 END FROM step s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT user_id, round(arg_max(rate, k), 6) AS rate, CAST(arg_max(streak, k) AS BIGINT) AS streak, max(k) AS seen FROM step GROUP BY user_id""",
)
def stream_adaptive_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("event_type") == "error"
    return V.run_once(V.adaptive_limits(V.read_events(spark, sf_dir), failed), "limits", "update").select("user_id", r6(F.col("rate")).alias("rate"), "streak", "seen")


#: Calls of a user in these tables are hours apart, so the window is long. Two calls in 12 hours; an error rests the user for 6 hours.
_LIMIT, _WINDOW, _COOLDOWN = 2, 12 * 3600, 6 * 3600


@query(
    "stream_quota",
    f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS called, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
step AS (
  SELECT user_id, event_id, called, k, true AS allowed, called AS release, [called] AS calls, CASE WHEN failed THEN called + {_COOLDOWN}000000 ELSE 0 END AS until FROM e WHERE k = 1
  UNION ALL
  SELECT user_id, event_id, called, k, called >= free, greatest(called, free), CASE WHEN called >= free THEN list_append(live, called) ELSE live END, CASE WHEN called >= free AND failed THEN greatest(until, called + {_COOLDOWN}000000) ELSE until END
  FROM (SELECT *, greatest(until, CASE WHEN len(live) >= {_LIMIT} THEN live[1] + {_WINDOW}000000 ELSE 0 END) AS free
    FROM (SELECT e.*, s.until, list_filter(s.calls, lambda t: e.called - t < {_WINDOW}000000) AS live FROM step s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)))
SELECT CAST(user_id AS VARCHAR) AS key, event_id AS call, called, allowed, release FROM step""",
)
def stream_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.10, W14: each user's calls against a trailing quota with a cooldown."""
    decided = Q.quota(V.read_events(spark, sf_dir), F.col("user_id"), F.col("event_id"), F.col("event_type") == "error", limit=_LIMIT, window=_WINDOW, cooldown=_COOLDOWN)
    return V.run_once(decided, "quota", "update")


_LEAST_WORDS = 10
_PAGE_WORDS = words_sql(squeeze_sql(f"nfc_normalize(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), 'http[^{T.WS}]+|www\\.[^{T.WS}]+', ' ', 'g'))"))


@query(
    "incremental_crawl",
    f"""WITH live AS (SELECT 3 * page_id + page_id % 2 AS id, len({_PAGE_WORDS}) AS words FROM pages),
b AS (SELECT max(id) AS last, max(id) // 3 AS first_end, greatest(50, (max(id) + 11) // 12) AS step FROM live),
ids AS (SELECT unnest(range(0, last + 1)) AS id, first_end, step FROM b)
SELECT i.id, CASE WHEN i.id <= first_end THEN i.id // step ELSE first_end // step + 1 + (i.id - first_end - 1) // step END AS batch, l.id IS NOT NULL AS alive, l.words
FROM ids i LEFT JOIN live l ON l.id = i.id AND l.words >= {_LEAST_WORDS}""",
)
def incremental_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.10, SNK8: pages stand at about every third id. The crawl stops after a third of the ids, goes on from there to the last one, and is started once more with nothing
    left to ask."""
    pages = table(spark, sf_dir, "pages")
    address = F.col("page_id") * 3 + F.col("page_id") % 2
    last = pages.agg(F.max(address)).first()[0] or 0

    def fetch(low: int, high: int) -> DataFrame:
        # The pages of a range stand together in few files, so they are dealt before they are cleaned. Counts are written, since NFC reads its text four times and a
        # filter on the counts would clean the pages again.
        near = pages.where(F.col("page_id").between(low // 3 - 1, high // 3) & address.between(low, high)).select(address.alias("id"), "html")
        plain = near.repartition(spark.sparkContext.defaultParallelism).select("id", T.without_tags(F.col("html")).alias("text"))
        return stored(plain.select("id", T.word_count(T.squeeze(T.nfc(F.col("text")))).alias("words")), "found").where(F.col("words") >= _LEAST_WORDS)

    folder, step = shared_path(spark, "crawl"), max(50, (last + 11) // 12)
    for end in (last // 3, last, last):
        asked = C.crawl(spark, folder, fetch, end=end, step=step)
    return asked.select("id", F.col("batch").cast("long").alias("batch"), "alive", F.col("words").cast("long").alias("words"))


_RECORDS = "doc_id long, lang string, text string"


@query("json_scan_modes", "SELECT 'DROPMALFORMED' AS mode, count(*) AS n, count(DISTINCT lang) AS langs FROM documents UNION ALL SELECT 'PERMISSIVE', count(*) + 2, count(DISTINCT lang) FROM documents UNION ALL SELECT 'array', count(*), count(DISTINCT n_regionkey) FROM nation")
def json_scan_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1 to SRC4, SNK1, SNK2: documents written as JSON lines, two broken lines appended, and a small JSON array."""
    path, array = R.shared_path(spark, "records"), R.shared_path(spark, "array")
    R.write_records(docs(spark, sf_dir, "doc_id", "lang", "text"), path)
    R.write_records(spark.sql("SELECT * FROM VALUES ('{\"doc_id\": 1, \"lang'), ('not json') AS t(value)"), path, mode="append", fmt="text")
    few = table(spark, sf_dir, "nation").select(F.to_json(F.struct("n_nationkey", "n_regionkey")).alias("j"))  # a dimension of some rows
    R.write_records(few.groupBy().agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ",\n"), F.lit("]")).alias("value")), array, fmt="text")

    def count(df: DataFrame, mode: str, column: str) -> DataFrame:
        return df.agg(F.lit(mode).alias("mode"), F.count("*").alias("n"), F.countDistinct(column).alias("langs")).select("mode", "n", "langs")

    parts = [count(R.read_records(spark, path, _RECORDS, mode).select("doc_id", "lang"), mode, "lang") for mode in ("DROPMALFORMED", "PERMISSIVE")]
    return parts[0].union(parts[1]).union(count(R.read_records(spark, array, "n_nationkey long, n_regionkey long"), "array", "n_regionkey"))


@query("bad_record_lines", "SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'no_json' WHEN 1 THEN 'no_object' ELSE 'field:doc_id' END AS reason, true AS in_place FROM documents WHERE doc_id % 10 IN (0, 1, 2)")
def bad_record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC3, SRC4: documents as lines of JSON, in the order of doc_id and some broken, with the numbers of these. In each file line and doc_id must grow alike."""
    path = R.shared_path(spark, "lines")
    good = F.to_json(F.struct("doc_id", "lang", "text"))
    line = F.expr("""CASE doc_id % 10 WHEN 0 THEN concat('{"doc_id": ', doc_id) WHEN 1 THEN concat('[', doc_id, ']') WHEN 2 THEN concat('{"doc_id": "x', doc_id, '", "lang": null}') WHEN 3 THEN '  ' END""")
    ordered = docs(spark, sf_dir, "doc_id", "lang", "text").select("doc_id", F.coalesce(line, good).alias("value")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    R.write_records(ordered.select("value"), path, fmt="text")
    bad = R.bad_records(spark, path, _RECORDS).select("file", "line", "reason", F.regexp_extract("text", r"(\d+)", 1).cast("long").alias("doc_id"))
    ahead = bad.groupBy("file").agg((F.min(F.col("doc_id") - F.col("line")) == F.max(F.col("doc_id") - F.col("line"))).alias("in_place"))
    return bad.join(ahead, "file").select("doc_id", "reason", "in_place")


@query("row_range", "SELECT row_number() OVER (ORDER BY doc_id) AS pos, doc_id FROM documents QUALIFY pos BETWEEN 11 AND 20")
def row_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5: rows 11 to 20 of the files, by physical order."""
    return R.row_range(spark.read.parquet(f"{sf_dir}/documents.parquet"), 11, 20).select("pos", "doc_id")


@query("load_inputs", r"SELECT CASE WHEN item_id % 3 = 0 THEN printf('row-%06d', row_number() OVER (ORDER BY item_id)) ELSE CAST(item_id AS VARCHAR) END AS id, length(trim(nfc_normalize(text))) AS chars FROM benchmark")
def load_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC6; every third row has no id."""
    b = table(spark, sf_dir, "benchmark").select(F.when(F.col("item_id") % 3 != 0, F.col("item_id")).alias("id"), F.col("item_id").alias("o"), F.col("text").alias("input"))
    return R.load_inputs(b, F.col("o")).select("id", F.length("input").cast("long").alias("chars"))


@query("partitioned_sink", "SELECT lang AS category, count(*) AS n FROM documents GROUP BY lang")
def partitioned_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3: one folder for each category, in two appends, read back with its partition column."""
    path = R.shared_path(spark, "categories")
    d = docs(spark, sf_dir, "doc_id", "lang").withColumnRenamed("lang", "category")
    for half in (0, 1):
        R.write_records(d.where(F.pmod("doc_id", F.lit(2)) == half), path, mode="append", by="category")
    return spark.read.schema("doc_id long, category string").json(path).groupBy("category").agg(F.count("*").alias("n"))


_SPLIT = "CASE WHEN ('0x' || substr(sha256('42' || chr(0) || CAST(doc_id AS VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 0.95 THEN 'train' ELSE 'dev' END"


@query("split_membership", f"SELECT {_SPLIT} AS split, doc_id, sha256(lang || chr(0) || text) AS row_sha FROM documents")
def split_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5, L5."""
    d = hash_split(docs(spark, sf_dir), F.col("doc_id"), 0.95)
    return R.membership({s: d.where(F.col("split") == s) for s in ("train", "dev")}, "doc_id", T.row_hash(F.col("lang"), F.col("text")))


@query("count_guard", "SELECT count(*) AS a, count(*) AS b FROM documents")
def count_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC11."""
    return R.require_equal_counts(docs(spark, sf_dir, "doc_id"), docs(spark, sf_dir, "text"))


@query("run_manifest", "SELECT count(*) AS rows, round(sum(value), 6) AS seconds, round(count(*) / sum(value), 6) AS rows_per_second FROM events")
def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK7."""
    m = R.manifest(table(spark, sf_dir, "events"), F.col("value"))
    return m.select("rows", r6(F.col("seconds")).alias("seconds"), r6(F.col("rows_per_second")).alias("rows_per_second"))
