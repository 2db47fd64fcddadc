"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import repeats as R
from ..functions import text as T
from ..functions.profiles import LATIN, SINHALA, ScriptProfile
from ._tables import WS, docs, literal, literal_sql, ngrams_sql, r6, sentences_sql, spread, squeeze_sql, tokens_sql, trim_sql, with_given, with_given_sql, words_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
BLOCK = LATIN.block


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def _digest(df: DataFrame, key: str, **columns) -> DataFrame:
    """The key, and of each text column its length and SHA-256."""
    out = [F.col(key)]
    for name, c in columns.items():
        out += [F.length(c).alias(f"{name}_chars"), F.sha2(c, 256).alias(f"{name}_sha")]
    return df.select(*out)


def _digest_sql(key: str, source: str, **columns: str) -> str:
    """The same in SQL."""
    out = [key]
    for name, c in columns.items():
        out += [f"CAST(length({c}) AS INT) AS {name}_chars", f"sha256({c}) AS {name}_sha"]
    return f"SELECT {', '.join(out)} FROM {source}"


@query(
    "clean_text",
    _digest_sql("doc_id", "documents", clean=squeeze_sql(f"nfc_normalize(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), 'http[^{WS}]+|www\\.[^{WS}]+', ' ', 'g'))")),
)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F3."""
    return _digest(docs(spark, sf_dir), "doc_id", clean=T.clean_text(F.col("text")))


@query(
    "page_clean_text",
    _digest_sql("page_id", "pages", clean=squeeze_sql(f"nfc_normalize(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), 'http[^{WS}]+|www\\.[^{WS}]+', ' ', 'g'))")),
)
def page_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 on markup."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return _digest(pages, "page_id", clean=T.clean_text(F.col("html")))


@query(
    "normal_forms",
    _digest_sql(
        "doc_id",
        "documents",
        spaces=squeeze_sql("replace(text, chr(160), ' ')"),
        matcher=f"lower({squeeze_sql(f"regexp_replace(text, '[^{BLOCK}A-Za-z0-9{WS}]', ' ', 'g')")})",
        style=trim_sql(r"regexp_replace(regexp_replace(regexp_replace(replace(text, chr(173), ''), '\r\n', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"),
        scoring=squeeze_sql(r"regexp_replace(text, '[\x{200b}-\x{200d}\x{feff}]', '', 'g')"),
        joined=r"regexp_replace(regexp_replace(text, '\n{2,}', ' ', 'g'), '(^|[^.!?])\n', '\1 ', 'g')",
    ),
)
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2, F4, F5, F6, F7."""
    c = F.col("text")
    return _digest(docs(spark, sf_dir), "doc_id", spaces=T.clean_spaces(c), matcher=T.matcher_text(c), style=T.style_text(c), scoring=T.scoring_text(c), joined=T.join_lines(c))


@query(
    "script_ratio",
    f"""
SELECT doc_id, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^{BLOCK}]', '', 'g'))::DOUBLE / length(text) ELSE 0 END, 6) AS ratio_all,
  round(coalesce(length(regexp_replace(text, '[^{BLOCK}]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(text, '[^{BLOCK}A-Za-z]', '', 'g')), 0), 0), 6) AS ratio_letters,
  regexp_matches(text, '[{BLOCK}]') AS has_script FROM documents""",
)
def script_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2, P3, P4."""
    c = F.col("text")
    return docs(spark, sf_dir).select("doc_id", r6(T.script_ratio(c)).alias("ratio_all"), r6(T.letter_ratio(c)).alias("ratio_letters"), T.has_script(c).alias("has_script"))


@query(
    "length_band",
    f"""
WITH w AS (SELECT doc_id, unnest({sentences_sql("text")}) AS sentence FROM documents),
n AS (SELECT doc_id, len({words_sql("sentence")}) AS n FROM w)
SELECT doc_id, CASE WHEN n BETWEEN 3 AND 5 THEN 'short' WHEN n BETWEEN 6 AND 7 THEN 'medium' WHEN n BETWEEN 8 AND 10 THEN 'long' ELSE 'other' END AS band, count(*) AS n
FROM n GROUP BY ALL""",
)
def length_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences by length band."""
    s = docs(spark, sf_dir).select("doc_id", F.explode(T.sentences(F.col("text"))).alias("sentence"))
    return s.groupBy("doc_id", T.band(T.word_count(F.col("sentence"))).alias("band")).agg(F.count("*").alias("n"))


@query(
    "band_join",
    f"""
WITH n AS (SELECT doc_id, len({words_sql("string_split(text, chr(10))[1]")}) AS n FROM documents),
band AS (SELECT * FROM (VALUES ('short', 3, 5), ('medium', 6, 7), ('long', 8, 10)) b(band, low, high))
SELECT doc_id, CAST(n AS INT) AS n, band FROM n LEFT JOIN band ON n BETWEEN low AND high""",
)
def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bands as a table of three rows, joined by range."""
    bands = literal(spark, "band low high", [("short", 3, 5), ("medium", 6, 7), ("long", 8, 10)])
    n = docs(spark, sf_dir).select("doc_id", T.word_count(F.split("text", "\n")[0]).alias("n"))
    return n.join(F.broadcast(bands), F.col("n").between(F.col("low"), F.col("high")), "left").select("doc_id", "n", "band")  # three rows


@query(
    "token_counts",
    rf"""
SELECT doc_id, CAST(len({words_sql("text")}) AS INT) AS n_words, CAST(len({tokens_sql("text")}) AS INT) AS n_tokens,
  CAST(len(regexp_extract_all(text, '[{BLOCK}]+|[A-Za-z]+|\p{{Nd}}+')) AS INT) AS n_script_tokens,
  CAST(len(list_filter(regexp_extract_all(text, '(?s).\p{{M}}*'), lambda g: {trim_sql("g")} <> '')) AS INT) AS n_graphemes,
  CAST(length(text) AS INT) AS n_chars
FROM documents""",
)
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F17 to F21, F44."""
    c = F.col("text")
    return docs(spark, sf_dir).select(
        "doc_id", T.word_count(c).alias("n_words"), F.size(T.word_tokens(c)).alias("n_tokens"), F.size(T.script_tokens(c)).alias("n_script_tokens"), T.grapheme_count(c).alias("n_graphemes"), F.length(c).alias("n_chars")
    )


@query("sentence_split", f"SELECT doc_id, CAST(k - 1 AS INT) AS pos, s[k] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS k FROM (SELECT doc_id, {sentences_sql('text')} AS s FROM documents))")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F22 as a table."""
    return docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query(
    "important_tokens",
    rf"""
WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[{BLOCK}]+|[A-Za-z]+|\p{{Nd}}+'), lambda w: regexp_matches(w, '\p{{Nd}}') OR (w NOT IN ({", ".join(f"'{w}'" for w in LATIN.stopwords)}) AND length(w) > 2)) AS t FROM documents)
SELECT doc_id, CAST(len(t) AS INT) AS n, sha256(array_to_string(t, ' ')) AS tokens_sha FROM t""",
)
def important_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F23."""
    t = docs(spark, sf_dir).select("doc_id", T.important_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha"))


@query(
    "number_extraction",
    r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '\p{Nd}+(?:[.,]\p{Nd}+)*')) AS INT) AS grouped, CAST(len(regexp_extract_all(text, '\p{Nd}+(?:[.,]\p{Nd}+)?')) AS INT) AS simple,
  CAST(len(list_distinct(regexp_extract_all(text, '\p{Nd}+'))) AS INT) AS distinct_plain, array_to_string(list_sort(regexp_extract_all(text, '\p{Nd}+(?:[.,]\p{Nd}+)*')), ' ') AS sorted_numbers
FROM documents""",
)
def number_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F24."""
    c = F.col("text")
    return docs(spark, sf_dir).select(
        "doc_id",
        F.size(T.numbers(c)).alias("grouped"),
        F.size(T.numbers(c, T.NUMBER_SIMPLE)).alias("simple"),
        F.size(F.array_distinct(T.numbers(c, T.NUMBER_PLAIN))).alias("distinct_plain"),
        F.array_join(F.sort_array(T.numbers(c)), " ").alias("sorted_numbers"),
    )


_SPANS = {"latin": T.LATIN_RUN, "urls": T.URL_OR_MAIL, "quoted": T.QUOTED, "controls": r"\p{Cf}"}


@query(
    "protected_spans",
    "SELECT doc_id, " + ", ".join("CAST(len(regexp_extract_all(text, '{}')) AS INT) AS {}".format(p.replace("'", "''"), n) for n, p in _SPANS.items()) + " FROM documents",
)
def protected_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spans that an edit must not change."""
    return docs(spark, sf_dir).select("doc_id", *(F.size(T.all_matches(F.col("text"), p)).alias(n) for n, p in _SPANS.items()))


@query("span_mutation", "SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS INT) AS n_source, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 AS INT) AS n_lower, (length(text) - length(replace(text, 'the', ''))) <> (length(lower(text)) - length(replace(lower(text), 'the', ''))) AS mutated FROM documents")
def span_mutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a protected span's count in a text and in a changed copy."""
    a, b = T.span_count(F.col("text"), F.lit("the")), T.span_count(F.lower("text"), F.lit("the"))
    return docs(spark, sf_dir).select("doc_id", a.alias("n_source"), b.alias("n_lower"), (a != b).alias("mutated"))


@query(
    "word_glue",
    rf"SELECT doc_id, CASE WHEN g <> '' THEN 'word_glue:' || substr(g, 1, 40) END AS reason FROM (SELECT doc_id, regexp_extract(text, '[{BLOCK}0-9\x{{200c}}\x{{200d}}]{{24,}}') AS g FROM documents)",
)
def word_glue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F29."""
    return docs(spark, sf_dir).select("doc_id", T.word_glue(F.col("text")).alias("reason"))


_UNIT_ROWS = [
    (1, "Exports of 476 million rupees.", "The report says 476 lakh."),
    (2, "Exports of 476 million rupees.", "The report says 476 million."),
    (3, "Budget: billion 3.68 and 12,500 crore", "It is 3.6 billion, 12,500 crore"),
    (4, "ten lakh 15,000 was paid", "15,000 million was paid"),
    (5, "No figures here.", "9 million"),
    (6, "2.5 crore 3.5 crore", "2 lakh and 4 lakh"),
    (7, "", ""),
]


#: Figures with units behind each text, which its summary repeats or changes.
_UNIT_TEXTS = [
    "doc_id + 1000", "concat(text, ' Exports of ', doc_id % 50, ' million and ', doc_id % 7, '.5 crore.')",
    "concat(substr(text, 1, 200), ' It was ', doc_id % 50, CASE WHEN doc_id % 3 = 0 THEN ' lakh' ELSE ' million' END)",
]


@query(
    "number_unit_consistency",
    rf"""
WITH t AS (SELECT * FROM {with_given_sql("id article summary", _UNIT_ROWS, "documents", _UNIT_TEXTS)}),
side AS (SELECT id, 0 AS s, article AS x FROM t UNION ALL SELECT id, 1, summary FROM t),
hit AS (SELECT id, s, unnest(regexp_extract_all(x, '(?:[0-9][0-9,]*(?:\.[0-9]+)?)\s*(?:ten\s*lakh|thousand|lakh|million|crore|billion)|(?:ten\s*lakh|thousand|lakh|million|crore|billion)\s*\.?\s*(?:[0-9][0-9,]*(?:\.[0-9]+)?)')) AS h,
  generate_subscripts(regexp_extract_all(x, '(?:[0-9][0-9,]*(?:\.[0-9]+)?)\s*(?:ten\s*lakh|thousand|lakh|million|crore|billion)|(?:ten\s*lakh|thousand|lakh|million|crore|billion)\s*\.?\s*(?:[0-9][0-9,]*(?:\.[0-9]+)?)'), 1) AS k FROM side),
pair AS (SELECT id, s, k, CAST(round_even(CAST(replace(regexp_extract(h, '[0-9][0-9,]*(?:\.[0-9]+)?'), ',', '') AS DOUBLE), 0) AS BIGINT) AS number,
  CASE WHEN regexp_matches(h, 'ten\s*lakh') THEN 'million' ELSE regexp_extract(h, 'thousand|lakh|million|crore|billion') END AS unit FROM hit),
bad AS (SELECT p.id, p.k, p.number, p.unit FROM pair p WHERE s = 1 AND EXISTS (SELECT 1 FROM pair q WHERE q.id = p.id AND q.s = 0 AND q.number = p.number)
  AND NOT EXISTS (SELECT 1 FROM pair q WHERE q.id = p.id AND q.s = 0 AND q.number = p.number AND q.unit = p.unit))
SELECT t.id, (SELECT count(*) FROM pair p WHERE p.id = t.id AND s = 0) AS n_article, (SELECT count(*) FROM pair p WHERE p.id = t.id AND s = 1) AS n_summary,
  (SELECT 'unit_mismatch:' || arg_min(number, k) || ':' || arg_min(unit, k) FROM bad b WHERE b.id = t.id HAVING count(*) > 0) AS reason
FROM t""",
)
def number_unit_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F28, F30, J7, on given rows and all documents."""
    t = with_given(spark, sf_dir, "id article summary", _UNIT_ROWS, "documents", _UNIT_TEXTS).withColumns({"a": T.number_units(F.col("article")), "s": T.number_units(F.col("summary"))})
    return t.select("id", F.size("a").cast("long").alias("n_article"), F.size("s").cast("long").alias("n_summary"), T.unit_mismatch(F.col("s"), F.col("a")).alias("reason"))


@query(
    "word_repetition",
    f"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[{BLOCK}]+')) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL),
f AS (SELECT doc_id, sum(n) AS total, bool_or(length(w) > 3 AND n >= 12 AND w NOT IN ('that', 'this', 'with', 'from')) AS hit FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(total >= 20 AND hit, false) AS repeated FROM documents d LEFT JOIN f USING (doc_id)""",
)
def word_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F32: some word of more than 3 characters 12 times or more, among 20 words or more."""
    words = F.regexp_extract_all("text", F.lit(f"[{BLOCK}]+"), F.lit(0))
    return spread(docs(spark, sf_dir, "doc_id", "text")).select("doc_id", R.word_repeated(ignored=LATIN.repetition_ignored)(words).alias("repeated"))


def _phrase_sql(n: int) -> str:
    middle = " || ' ' || ".join(f"w[i + {k}]" for k in range(1, n - 1))
    return f"""
WITH w AS (SELECT doc_id, {words_sql("text")} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {n} + 2, 1))) AS i FROM w),
k AS (SELECT doc_id, i, right(w[i], 1) || ' ' || {middle} || ' ' || left(w[i + {n - 1}], 1) AS key, length(w[i]) AS size FROM p),
e AS (SELECT doc_id, key, min(i) AS low, max(i) AS high, arg_max(size, i) AS size FROM k GROUP BY ALL),
f AS (SELECT doc_id, bool_or(high - low > {n - 1} OR (high - low = {n - 1} AND size > 1)) AS repeated FROM e GROUP BY doc_id)
SELECT d.doc_id, coalesce(f.repeated, false) AS repeated FROM documents d LEFT JOIN f USING (doc_id)"""


@query("phrase_repetition", _phrase_sql(4))
def phrase_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F33, four tokens."""
    return spread(docs(spark, sf_dir, "doc_id", "text")).select("doc_id", R.phrase_repeated(4)(T.words(F.col("text"))).alias("repeated"))


@query("phrase_repetition_3", _phrase_sql(3))
def phrase_repetition_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F33, the older rule of three tokens."""
    return spread(docs(spark, sf_dir, "doc_id", "text")).select("doc_id", R.phrase_repeated(3)(T.words(F.col("text"))).alias("repeated"))


@query(
    "repetition_loop",
    f"""
WITH w AS (SELECT doc_id, {words_sql("text")} AS w FROM documents),
g AS (SELECT doc_id, unnest({ngrams_sql("w", 4)}) AS g FROM w WHERE len(w) >= 12),
c AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL), f AS (SELECT doc_id, max(n) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(f.n, 0) AS BIGINT) AS most, coalesce(f.n >= 3, false) AS looping FROM documents d LEFT JOIN f USING (doc_id)""",
)
def repetition_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some window of four words three times or more, among 12 words or more."""
    most = spread(docs(spark, sf_dir, "doc_id", "text")).select("doc_id", R.most_of_a_run(4, 12)(T.words(F.col("text"))).alias("most"))
    return most.select("doc_id", "most", (F.col("most") >= 3).alias("looping"))


@query(
    "stutter",
    f"""
WITH w AS (SELECT doc_id, {words_sql("text")} AS w FROM documents)
SELECT doc_id, CAST(len(list_filter(range(1, greatest(len(w) - 4, 1)), lambda i: w[i : i + 2] = w[i + 3 : i + 5])) AS INT) AS stutters FROM w""",
)
def stutter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10."""
    w = docs(spark, sf_dir).select("doc_id", T.words(F.col("text")).alias("w"))
    return w.select("doc_id", T.stutters(F.col("w")).alias("stutters"))


#: Given rows, since the words of the tables are invented: a headline, and a text below it.
_GIVEN_HEADLINES = [
    (-1, "Cricket team wins\nThe match was short."),
    (-2, "Weather\nForeign guests came from India and from Japan."),
    (-3, "A victory, no defeat\nIt rained."),
    (-4, "Minister speaks\nNothing else."),
    (-5, "Decision and statement\nThe election."),
    (-6, "Plain news\nabout teams and matches"),
]


#: Given rows of the other profile: names of its lists, one of them twice in its list, some of several words.
_GIVEN_SINHALA = [
    (-1, f"{SINHALA.categories[0][1][0]} x\nplain"),
    (-2, f"plain\n{SINHALA.categories[1][1][0]}, {SINHALA.categories[1][1][4]}."),
    (-3, f"{SINHALA.categories[2][2][0]} {SINHALA.categories[2][2][1]}\n{SINHALA.categories[2][1][3]}"),
    (-4, f"{SINHALA.categories[2][2][0]}\nplain"),
    *((-10 - k, f"{SINHALA.categories[k][1][-1]}\n{SINHALA.categories[k][1][-2]}") for k in range(3)),
    (-20, "plain\n" + " ".join(k for k in SINHALA.categories[0][1] if SINHALA.categories[0][1].count(k) > 1)),
    (-21, "plain\n" + ". ".join(next(k for k in SINHALA.categories[n][1] if " " in k) for n in range(3))),
]


def _category_sql(profile: ScriptProfile = LATIN, given: list[tuple] = _GIVEN_HEADLINES) -> str:
    def hits(x: str, keys: tuple[str, ...]) -> str:
        return "(" + " + ".join(["0", *(f"CAST(contains(' ' || {x} || ' ', ' {k} ') AS INT)" for k in (T.plain_keyword(k, profile) for k in keys))]) + ")"

    matcher = f"lower({squeeze_sql(f"regexp_replace(text, '[^{profile.block}A-Za-z0-9{WS}]', ' ', 'g')")})"
    headline = f"lower({squeeze_sql(f"regexp_replace(string_split(text, chr(10))[1], '[^{profile.block}A-Za-z0-9{WS}]', ' ', 'g')")})"
    cases = " ".join(f"WHEN 2 * {hits('h', strong)} + {hits('c', strong)} + 0.5 * {hits('h', weak)} >= 2 THEN '{n}'" for n, strong, weak in profile.categories)
    given = f"SELECT * FROM {literal_sql('doc_id text', given)} UNION ALL SELECT doc_id, text FROM documents"
    return f"SELECT doc_id, CASE {cases} ELSE 'General' END AS category FROM (SELECT doc_id, {headline} AS h, {matcher} AS c FROM ({given}))"


@query("keyword_category", _category_sql())
def keyword_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F36, F37 on given rows and all documents; the first line plays the headline."""
    h, c = T.matcher_text(F.split("text", "\n")[0]), T.matcher_text(F.col("text"))
    rows = docs(spark, sf_dir, "doc_id", "text").unionByName(literal(spark, "doc_id text", _GIVEN_HEADLINES))
    return rows.select("doc_id", h.alias("h"), c.alias("c")).select("doc_id", T.category(F.col("h"), F.col("c")).alias("category"))


@query("keyword_category_sinhala", _category_sql(SINHALA, _GIVEN_SINHALA))
def keyword_category_sinhala(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F36, F37 with the long lists of the Sinhala profile, on given rows and all documents."""
    rows = docs(spark, sf_dir, "doc_id", "text").unionByName(literal(spark, "doc_id text", _GIVEN_SINHALA))
    texts = rows.select("doc_id", T.matcher_text(F.split("text", "\n")[0], SINHALA).alias("h"), T.matcher_text(F.col("text"), SINHALA).alias("c"))
    return texts.select("doc_id", T.category(F.col("h"), F.col("c"), SINHALA).alias("category"))


_ANSWERS = [
    (1, "```json\nHere is the rewritten text\n# Title\n\n**Bold** line\n  plain \n```", "Plain headline ### Article: rest\nsecond"),
    (2, "one\n\ntwo", "- • listed headline </s> tail"),
    (3, "", "  "),
    (4, "REWRITTEN ARTICLE: x\nkept", "a b c d e f g h i j k l"),
]


_ANSWER_TEXTS = [
    "doc_id + 1000", "concat('```json', chr(10), 'Here is the rewritten text', chr(10), '# ', substr(text, 1, 60), chr(10), chr(10), '**', substr(text, 1, 400), '**')",
    "concat(substr(text, 1, 80), CASE WHEN doc_id % 2 = 0 THEN ' ### Article: rest' ELSE '' END)",
]


@query(
    "clean_answers",
    r"""
WITH t AS (SELECT * FROM """
    + with_given_sql("id answer headline", _ANSWERS, "documents", _ANSWER_TEXTS)
    + rf"""),
l AS (SELECT id, headline, list_filter(string_split(regexp_replace(answer, '```[a-z]*', '', 'g'), chr(10)), lambda x: {trim_sql("x")} <> '' AND NOT regexp_matches(lower(x), 'here is the rewritten|rewritten article')) AS lines FROM t),
h AS (SELECT *, {trim_sql(f"regexp_replace(regexp_replace(string_split({trim_sql('headline')}, chr(10))[1], '(?s)(?:###|Article:|Category:|Headline:|<[|]|</s>|Note:).*$', ''), '^[-• ]+', '')")} AS head FROM l)
SELECT id, array_to_string(list_transform(lines, lambda x: regexp_replace(regexp_replace({trim_sql("x")}, '^#+ *', ''), '\*\*', '', 'g')), chr(10)) AS response, head, array_to_string(({words_sql("head")})[1:10], ' ') AS head10 FROM h""",
)
def clean_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8, F9, on given rows and all documents."""
    t = with_given(spark, sf_dir, "id answer headline", _ANSWERS, "documents", _ANSWER_TEXTS)
    return t.select("id", T.clean_response(F.col("answer")).alias("response"), T.clean_output(F.col("headline")).alias("head"), T.clean_output(F.col("headline"), 10).alias("head10"))


_HEADLINES = [
    (1, "Floods hit the south - Photos", "Text (photo/video) goes on [Gallery] here."),
    (2, "Team wins (Video) | Photos", "No tags."),
    (3, "Video games are popular", "A [photo] B"),
    (4, "Budget passed, Update -", "(VIDEO) start"),
]
_TAGS = "|".join(LATIN.media_tags)
_TAGGED_TEXTS = [
    "doc_id + 1000", "concat(substr(text, 1, 60), CASE doc_id % 3 WHEN 0 THEN ' - Photos' WHEN 1 THEN ' (Video) | photo' ELSE '' END)",
    "concat(substr(text, 1, 300), ' [Gallery] end (photo/video)')",
]


@query(
    "media_tags",
    rf"""
SELECT id, regexp_replace(regexp_replace(headline, '(?i)(?:[ \-–—|/,]*[\(\[]?\b(?:{_TAGS})\b[\)\]]?)+[ .!]*$', '', 'g'), '[ \-–—|/,:;]+$', '', 'g') AS headline,
  {squeeze_sql(rf"regexp_replace(body, '(?i)[\(\[] *(?:{_TAGS})(?: *[/,] *(?:{_TAGS}))* *[\)\]]', ' ', 'g')")} AS body FROM """
    + with_given_sql("id headline body", _HEADLINES, "documents", _TAGGED_TEXTS),
)
def media_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12, F13, on given rows and all documents."""
    t = with_given(spark, sf_dir, "id headline body", _HEADLINES, "documents", _TAGGED_TEXTS)
    return t.select("id", T.drop_trailing_tags(F.col("headline")).alias("headline"), T.drop_inline_tags(F.col("body")).alias("body"))


_MARKED = [
    (1, "First part. Second part! It is time to discuss.", "Title here. Rest."),
    (2, "Did you know? The rest follows.", "Nothing"),
    (3, "Nothing special here.", "Did you know this? Yes."),
]


_MARKED_TEXTS = ["doc_id + 1000", "CASE doc_id % 3 WHEN 0 THEN concat(text, ' It is time to discuss.') WHEN 1 THEN concat('Did you know? ', text) ELSE text END", "lang"]


@query(
    "marker_sentences",
    rf"""
SELECT id, CASE WHEN position('time to discuss' IN text) > 0 AND length(regexp_replace(substr(text, position('time to discuss' IN text) + 15), '^[{WS}]*[./!?…]*|[./!?…]*[{WS}]*$', '', 'g')) <= 2
    THEN regexp_replace(regexp_extract(substr(text, 1, position('time to discuss' IN text) - 1), '(?s)^(.*[.!?]\s+)', 1), '[{WS}]+$', '') ELSE text END AS without_closing,
  CASE WHEN position('Did you know' IN text) BETWEEN 1 AND 6 AND regexp_matches(text, '[.!?][{WS}]') THEN {trim_sql(r"regexp_extract(text, '(?s)^.*?[.!?]\s+(.*)$', 1)")} ELSE text END AS without_opening,
  CASE WHEN starts_with(text || ' ' || text, text) AND text <> '' THEN regexp_replace(substr(text || ' ' || text, length(text) + 1), '^[{WS}:.*-]+', '') ELSE text END AS without_title
FROM """
    + with_given_sql("id text other", _MARKED, "documents", _MARKED_TEXTS),
)
def marker_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10, F14, F15, P14, on given rows and all documents."""
    t = with_given(spark, sf_dir, "id text other", _MARKED, "documents", _MARKED_TEXTS)
    c = F.col("text")
    return t.select("id", T.drop_closing_sentence(c, LATIN.closing_markers).alias("without_closing"), T.drop_opening_sentence(c, LATIN.opening_markers).alias("without_opening"), T.drop_title(F.concat(c, F.lit(" "), c), c).alias("without_title"))


@query(
    "stop_trimming",
    "SELECT conv_id, turn, sha256(string_split(string_split(text, '. ')[1], chr(10))[1]) AS trimmed_sha, sha256("
    + trim_sql(r"regexp_replace(text, '(?s)(?:\x{fffd}|\n#|<\|eot_id\|>|<end_of_turn>).*$', '')")
    + ") AS cut_sha FROM conversations",
)
def stop_trimming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F67, F75."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return t.select("conv_id", "turn", F.sha2(T.trim_at_stops(F.col("text"), (". ", "\n")), 256).alias("trimmed_sha"), F.sha2(T.cut_broken(F.col("text")), 256).alias("cut_sha"))


@query("row_hashes", "SELECT doc_id, sha256(lang || chr(0) || text) AS row_sha, substr(sha256('42' || chr(0) || doc_id), 1, 16) AS order_key FROM documents")
def row_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F72, L4."""
    return docs(spark, sf_dir).select("doc_id", T.row_hash(F.col("lang"), F.col("text")).alias("row_sha"), F.substring(T.row_hash(F.lit("42"), F.col("doc_id").cast("string")), 1, 16).alias("order_key"))


@query(
    "clean_end_flags",
    f"SELECT doc_id, regexp_matches({trim_sql('text')}, '[.?!]$') AS clean_end, len({words_sql('text')}) BETWEEN 8 AND 130 AS in_band, {trim_sql('text')} = '' AS empty FROM documents",
)
def clean_end_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F73."""
    c = F.col("text")
    return docs(spark, sf_dir).select("doc_id", T.trim_ws(c).rlike("[.?!]$").alias("clean_end"), T.word_count(c).between(8, 130).alias("in_band"), (T.trim_ws(c) == "").alias("empty"))


_TORN = [
    (1, "මෙම ප්‍ර දේශයේ වාහන"),
    (2, "පා රිභෝගික සේවා අත් අඩංගුවට"),
    (3, "වැරදි ්ා පද"),
    (4, "plain text"),
    (5, ""),
]
_TORN_TEXTS = ["doc_id + 1000", f"CASE WHEN doc_id % 2 = 0 THEN concat(text, ' {_TORN[0][1]} ', lang) ELSE concat('{_TORN[1][1]} ', text, ' {_TORN[2][1]}') END"]
_HEALED = rf"regexp_replace(text, '(^|[^\p{{L}}\p{{N}}_])([{SINHALA.block}][\x{{200d}}{SINHALA.joining_sign}]?[{SINHALA.cluster_ends}])[{WS}]+([{SINHALA.block}]+)', '\1\2\3', 'g')"
for _pattern, _word in SINHALA.repairs:
    _HEALED = f"regexp_replace({_HEALED}, '{_pattern}', '{_word}', 'g')"


@query("sinhala_repairs", f"SELECT id, {squeeze_sql(_HEALED)} AS healed, regexp_matches(text, '{SINHALA.joining_sign}[{SINHALA.dependent_signs}]') AS garbled, regexp_replace(text, '{SINHALA.joining_sign}[{SINHALA.dependent_signs}]', '', 'g') AS without FROM " + with_given_sql("id text", _TORN, "documents", _TORN_TEXTS))
def sinhala_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11, F35, P14, on given rows and all documents."""
    c = F.col("text")
    return with_given(spark, sf_dir, "id text", _TORN, "documents", _TORN_TEXTS).select("id", T.heal(c, SINHALA).alias("healed"), T.is_garbled(c, SINHALA).alias("garbled"), T.drop_garbled(c, SINHALA).alias("without"))


@query("sql_functions", f"SELECT lang, count(*) AS n, sum(len({words_sql('text')})) AS words, sum(len({sentences_sql('text')})) AS sentences FROM documents GROUP BY lang")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions under names that SQL can call."""
    from ..functions.register import register

    register(spark)
    docs(spark, sf_dir).createOrReplaceTempView("weftline_documents")
    return spark.sql("SELECT lang, count(*) AS n, sum(size(text_words(text))) AS words, sum(size(text_sentences(text))) AS sentences FROM weftline_documents GROUP BY lang")


@query(
    "sql_table_functions",
    f"""WITH w AS (SELECT doc_id, unnest({words_sql('text')}) AS word FROM documents), s AS (SELECT doc_id, unnest({sentences_sql('text')}) AS s FROM documents)
SELECT doc_id, words, word_chars, coalesce(sentences, 0) AS sentences, coalesce(sentence_chars, 0) AS sentence_chars FROM (SELECT doc_id, count(*) AS words, CAST(sum(length(word)) AS BIGINT) AS word_chars FROM w GROUP BY doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS sentences, CAST(sum(length(s)) AS BIGINT) AS sentence_chars FROM s GROUP BY doc_id) USING (doc_id)""",
)
def sql_table_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and sentences as rows of table functions that SQL can join laterally."""
    from ..functions.register import register

    register(spark)
    docs(spark, sf_dir).createOrReplaceTempView("weftline_documents")
    return spark.sql("""WITH w AS (SELECT doc_id, count(*) AS words, sum(length(r.word)) AS word_chars FROM weftline_documents d, LATERAL text_word_rows(d.text) AS r GROUP BY doc_id),
    s AS (SELECT doc_id, count(*) AS sentences, sum(length(r.sentence)) AS sentence_chars FROM weftline_documents d, LATERAL text_sentence_rows(d.text) AS r GROUP BY doc_id)
    SELECT doc_id, words, word_chars, coalesce(sentences, 0) AS sentences, coalesce(sentence_chars, 0) AS sentence_chars FROM w LEFT JOIN s USING (doc_id)""")


_U64 = "18446744073709551616::UHUGEINT"


def _mix_sql(x: str) -> str:
    a = f"(xor({x}, {x} >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT % {_U64})::UBIGINT"
    return f"list_transform(list_transform([{a}], lambda p: (xor(p, p >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT % {_U64})::UBIGINT), lambda p: xor(p, p >> 31))[1]"


_GOLDEN = "11400714819323198485::UHUGEINT"


@query(
    "sql_aggregates",
    rf"""WITH d AS (SELECT lang, doc_id, text, length(text) AS n, len({words_sql('text')}) AS words FROM documents),
fp AS (SELECT lang, count(*) AS n, {', '.join(f"sum(('0x' || substr(sha256(text), {8 * k + 1}, 8))::BIGINT)::HUGEINT AS s{k}" for k in range(8))} FROM d GROUP BY lang),
seeded AS (SELECT lang, words, n, {_mix_sql(f"((doc_id::UHUGEINT + {_GOLDEN}) % {_U64})::UBIGINT")} AS seed FROM d),
turns AS (SELECT lang, words, n, sample, {_mix_sql(f"((seed::UHUGEINT + sample::UHUGEINT * {_GOLDEN}) % {_U64})::UBIGINT")} >> 32 AS u FROM seeded, range(0, {A.SAMPLES}) t(sample)),
drawn AS (SELECT lang, sample, words, n, len(list_filter([{', '.join(map(str, A.DRAWN))}], lambda t: t <= u)) AS times FROM turns),
samples AS (SELECT lang, sample, sum(words * times)::DOUBLE / sum(n * times) AS r FROM drawn GROUP BY ALL),
boot AS (SELECT lang, round(quantile_cont(r, 0.025), 9) AS low, round(quantile_cont(r, 0.975), 9) AS high FROM samples GROUP BY lang),
q AS (SELECT lang, round(quantile_cont(n, 0.025), 6) AS p025, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.975), 6) AS p975 FROM d GROUP BY lang)
SELECT lang, substr(sha256(concat_ws('|', n, {', '.join(f's{k}' for k in range(8))})), 1, 16) AS fingerprint, p025, median, p975, low, high FROM fp JOIN q USING (lang) JOIN boot USING (lang)""",
)
def sql_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.11, A9, A15, F70: registered aggregates in SQL text, through states of blocks of 1,000 ids that are merged by language."""
    from ..functions.register import register

    register(spark)
    docs(spark, sf_dir).createOrReplaceTempView("weftline_documents")
    return spark.sql("""WITH parts AS (
      SELECT lang, fingerprint_part(text) AS f, percentile_part(length(text)) AS p, bootstrap_part(doc_id, size(text_words(text)), length(text)) AS b
      FROM weftline_documents GROUP BY lang, doc_id DIV 1000),
    merged AS (SELECT lang, fingerprint_merge(f) AS f, percentile_merge(p) AS p, bootstrap_merge(b) AS b FROM parts GROUP BY lang),
    final AS (SELECT lang, fingerprint_final(f) AS fingerprint, percentile_final(p, 0.025D) AS p025, percentile_final(p, 0.5D) AS median, percentile_final(p, 0.975D) AS p975, bootstrap_final(b) AS ends FROM merged)
    SELECT lang, fingerprint, round(p025, 6) AS p025, round(median, 6) AS median, round(p975, 6) AS p975, round(ends[0], 9) AS low, round(ends[1], 9) AS high FROM final""")


_D = r"\p{Nd}"


@query(
    "extracted_dates",
    rf"""SELECT doc_id, array_to_string(list_concat(list_concat(regexp_extract_all(text, '{_D}{{4}}[{WS}]+[^{WS}]+[{WS}]+{_D}{{1,2}}'), regexp_extract_all(text, '{_D}{{1,2}}[/-]{_D}{{1,2}}[/-]{_D}{{2,4}}')), regexp_extract_all(text, '{_D}{{4}}[/-]{_D}{{1,2}}[/-]{_D}{{1,2}}')), '|') AS dates
FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {literal_sql("doc_id text", [(-1, "On 2026 May 16 and 3/4/2025, not 2024-12-01x")])})""",
)
def extracted_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F27 on all documents and a given row."""
    rows = docs(spark, sf_dir, "doc_id", "text").unionByName(literal(spark, "doc_id text", [(-1, "On 2026 May 16 and 3/4/2025, not 2024-12-01x")]))
    return rows.select("doc_id", F.array_join(T.dates(F.col("text")), "|").alias("dates"))


@query("percent_format", "SELECT lang, printf('%.2f%%', 100.0::DOUBLE * count(*) FILTER (length(text) > 2000) / count(*)) AS long_share FROM documents GROUP BY lang")
def percent_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a share as a report prints it."""
    return docs(spark, sf_dir, "lang", "text").groupBy("lang").agg(T.percent(F.count_if(F.length("text") > 2000) / F.count("*")).alias("long_share"))
