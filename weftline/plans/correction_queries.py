"""Queries over edits, corrections and what surrounds generation.

Each document is cut into passages of 40 words, the last of what remains, and each passage is a correction task: the target is its words; the
source has every ninth word in lower case and every 23rd doubled, by the passage's number; the prediction undoes the former for every second one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import edits as E
from ..functions import prompts as P
from ..functions import text as T
from ..operators import corrections as C
from ..sources.shared import stored
from ._tables import docs, literal, literal_sql, r6, spread, table, trim_sql, with_given, with_given_sql, words_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


PASSAGE = 40


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, category, document, source, target, prediction, and contextual, protected and lemma_pairs."""
    d = spread(docs(spark, sf_dir, "doc_id", "lang", "source", "text")).select("doc_id", F.col("lang").alias("category"), F.col("source").alias("document"), T.words(F.col("text")).alias("all"))

    def passages(x):
        return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / PASSAGE).cast("int")), lambda k: F.slice(x, k * PASSAGE + 1, F.lit(PASSAGE))))

    # An outer explode brings no filter that would cut the text again; documents without words fall out behind it.
    w = d.select("doc_id", "category", "document", F.posexplode_outer(T.let(F.col("all"), passages)).alias("k", "w")).where("w IS NOT NULL").withColumn("id", F.col("doc_id") * (1 << 20) + F.col("k"))
    turn = F.col("doc_id") + F.col("k")

    def spoil(keep: bool):
        def word(x, i):
            lowered = F.when((i + turn) % 9 == 0, F.lower(x)).otherwise(x) if not keep else x
            return F.when((i + turn) % 23 == 0, F.concat(lowered, F.lit(" "), lowered)).otherwise(lowered)

        return F.array_join(F.transform("w", word), " ")

    clean = F.array_join("w", " ")
    broken = turn % 4 != 0
    last = F.element_at("w", -1)
    w = w.withColumns({"clean": clean, "spoilt": F.when(broken, spoil(False))})
    clean, spoilt = F.col("clean"), F.col("spoilt")
    return w.select(
        "id",
        "category",
        "document",
        F.when(broken, spoilt).otherwise(clean).alias("source"),
        clean.alias("target"),
        F.when(broken & (turn % 2 == 0), spoil(True)).when(broken, spoilt).otherwise(clean).alias("prediction"),
        (turn % 5 == 0).alias("contextual"),
        F.slice("w", 1, 2).alias("protected"),
        F.when(broken & (turn % 6 == 0), F.array(F.struct(F.array(F.lower(last)).alias("old"), F.array(last).alias("new")))).otherwise(F.array().cast(C.PAIRS)).alias("lemma_pairs"),
    )


@query("edit_extraction")
def edit_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit pairs by frequency."""
    e = C.gold_edits(tasks(spark, sf_dir))
    pairs = e.select(F.explode("gold_pairs").alias("p"))
    return pairs.groupBy(F.array_join("p.old", " ").alias("old"), F.array_join("p.new", " ").alias("new")).agg(F.count("*").alias("n"))


@query("correction_metrics")
def correction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By category and, with a null category, overall; pairs of every third row are taught."""
    sums = C.sums_with_unseen(tasks(spark, sf_dir), F.col("id") % 3 == 0, "category")
    names = [c for c in sums.columns if c != "category"]
    return C.metrics(sums.rollup("category").agg(*(F.sum(c).alias(c) for c in names)), ["category"])


@query("correction_intervals")
def correction_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1000 samples of the sources as documents; pairs of every third row are taught."""
    return C.bootstrap_sums(C.sums_with_unseen(tasks(spark, sf_dir), F.col("id") % 3 == 0, "document"), "document")


@query("pair_disjoint_split")
def pair_disjoint_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by split and changed."""
    e = stored(C.gold_edits(tasks(spark, sf_dir)).select("id", "changed", "gold_pairs"), "edits")
    return C.pair_disjoint_split(e).join(e.select("id", "changed"), "id").groupBy("split", "changed").agg(F.count("*").alias("n"))


@query("edit_scripts")
def edit_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts from source to target, applied again, by status and reasons."""
    # A Python function beside the outcome would bring a copy of its reasons for each use of them, so targets are normalised first.
    t = tasks(spark, sf_dir).select("id", "source", E.normal(F.col("target")).alias("target"))
    applied = C.apply_scripts(t.withColumn("script", E.make_script(E.normal(F.col("source")), F.col("target"))))
    back = (F.col("status") != "APPLIED") | (F.col("text") == F.col("target"))
    return applied.withColumn("back", back).groupBy("status", F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"), F.sum("operation_count").alias("operations"), F.bool_and("back").alias("round_trip"))


@query("replacement_scripts")
def replacement_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that replacements can express, and why others cannot."""
    t = tasks(spark, sf_dir).withColumns({"s": E.normal(F.col("source")), "t": E.normal(F.col("target"))})
    t = t.withColumn("changes", E.word_edits(E.edit_words(F.col("s")), E.edit_words(F.col("t"))))
    made = t.withColumn("r", E.make_replacements("s", "t", "changes")).withColumn("back", E.replacements_to_script("s", F.coalesce("r.script", F.lit("KEEP"))))
    outcome = F.coalesce("r.error", F.when(F.col("r.script") == "KEEP", "KEEP").otherwise("REPLACE"))
    return made.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.count_if(F.col("back.error").isNotNull()).alias("not_read_back"))


@query("candidate_validation")
def candidate_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By category, rates of statuses, metrics of the candidates as they came (raw) and as they may be used (safe), and the gate."""
    t = tasks(spark, sf_dir).withColumn("candidate", F.when(F.col("id") % 11 == 0, "").when(F.col("id") % 7 == 0, F.regexp_replace("target", "[0-9]", "")).otherwise(F.col("prediction")))
    e = C.raw_and_safe(t.select("id", "category", "source", "target", "candidate")).withColumn("unseen", F.col("gold"))

    def rate(name: str):
        return r6(F.avg((F.col("status") == name).cast("int"))).alias(name.lower() + "_rate")

    rates = [rate(s) for s in ("INVALID", "REJECTED", "APPLIED", "KEEP")]
    names = [f"{s.lower()}_rate" for s in ("INVALID", "REJECTED", "APPLIED", "KEEP")]
    scores = ("exact_match", "edit_precision", "edit_recall", "edit_f05", "clean_preservation")
    m = C.metrics(C.partial_sums(e, ["category", "kind"], rates), ["category", "kind", *names])
    # Two rows of each category become one.
    columns = [F.max(F.when(F.col("kind") == kind, F.col(c))).alias(f"{kind}_{c}") for kind in ("raw", "safe") for c in scores]
    scored = m.where("category IS NOT NULL").groupBy("category").agg(F.max("n").alias("n"), *(F.max(c).alias(c) for c in names), *columns)
    return C.acceptance(scored.withColumn("edit_f05", F.col("safe_edit_f05"))).drop("edit_f05")


_EDITED = "concat('abcdefghij', text)"
_MADE_SCRIPT = """CASE doc_id % 14 WHEN 0 THEN ' KEEP ' WHEN 1 THEN '[{"s": 0, "e": 3, "o": "abc", "n": "x"}, {"s": 5, "e": 7, "o": "fg", "n": ""}]' WHEN 2 THEN '[{"s": 0,' WHEN 3 THEN '{}' WHEN 4 THEN '[]'
WHEN 5 THEN concat('[', repeat('{"s": 0, "e": 1, "o": "a", "n": "b"},', 32), '{"s": 0, "e": 1, "o": "a", "n": "b"}]') WHEN 6 THEN '[{"s": 0, "e": 1, "o": "a", "n": "b", "x": 1}]' WHEN 7 THEN '[{"s": 0.5, "e": 1, "o": "a", "n": "b"}]'
WHEN 8 THEN '[{"s": 0, "e": 1, "o": "a", "n": 5}]' WHEN 9 THEN concat('[{"s": 0, "e": ', length(text) + 11, ', "o": "a", "n": "b"}]') WHEN 10 THEN '[{"s": 0, "e": 3, "o": "abc", "n": "x"}, {"s": 2, "e": 3, "o": "c", "n": "y"}]'
WHEN 11 THEN '[{"s": 0, "e": 3, "o": "abc", "n": "x"}, {"s": 4, "e": 6, "o": "zz", "n": "y"}, {"s": 0, "e": 0, "o": 1, "n": "y"}]' WHEN 12 THEN '[{"s": 0, "e": 0, "o": "", "n": "q"}, {"s": 3, "e": 5, "o": "de", "n": "de"}]' ELSE '[{"s": true, "e": 1, "o": "a", "n": "b"}]' END"""


@query(
    "operation_checks",
    f"""WITH t AS (SELECT doc_id, {_EDITED} AS source, trim({_MADE_SCRIPT}) AS script FROM documents),
w AS (SELECT *, CASE WHEN script = 'KEEP' THEN NULL WHEN NOT json_valid(script) THEN 'invalid_json' WHEN json_type(script) <> 'ARRAY' OR json_array_length(script) = 0 THEN 'script_must_be_KEEP_or_nonempty_list' WHEN json_array_length(script) > 32 THEN 'too_many_operations' END AS whole FROM t),
o AS (SELECT doc_id, source, generate_subscripts(x, 1) - 1 AS k, unnest(x) AS o FROM (SELECT doc_id, source, json_extract(script, '$[*]') AS x FROM w WHERE whole IS NULL AND script <> 'KEEP')),
f AS (SELECT *, json_type(o, '$.s') AS ts, json_type(o, '$.e') AS te, json_type(o, '$.o') AS t_o, json_type(o, '$.n') AS tn, TRY_CAST(o ->> '$.s' AS BIGINT) AS s, TRY_CAST(o ->> '$.e' AS BIGINT) AS e, o ->> '$.o' AS old, o ->> '$.n' AS new FROM o),
b AS (SELECT *, CASE WHEN list_sort(json_keys(o)) <> ['e', 'n', 'o', 's'] THEN 'operation_schema' WHEN ts NOT IN ('UBIGINT', 'BIGINT') OR te NOT IN ('UBIGINT', 'BIGINT') THEN 'offset_type' WHEN t_o <> 'VARCHAR' OR tn <> 'VARCHAR' THEN 'text_type'
  WHEN s < 0 OR e < s OR e > length(source) THEN 'offset_range' WHEN s < lag(e) OVER (PARTITION BY doc_id ORDER BY k) OR s = lag(s) OVER (PARTITION BY doc_id ORDER BY k) THEN 'operations_overlap_or_share_start'
  WHEN substr(source, s + 1, e - s) <> old THEN 'old_text_mismatch' WHEN old = new THEN 'no_op' END AS error FROM f),
n AS (SELECT doc_id, count(*) AS operations, min(k) FILTER (error IS NOT NULL) AS place, arg_min(error, k) FILTER (error IS NOT NULL) AS error FROM b GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(operations, 0) AS INT) AS operations, coalesce(whole, n.error) AS error, CAST(place AS INT) AS place FROM w LEFT JOIN n USING (doc_id)""",
)
def operation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts with each kind of error, checked as ordered rows."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_EDITED).alias("source"), F.expr(_MADE_SCRIPT).alias("script"))
    return E.check_operations(rows, "doc_id", "source", "script")


_PROMPT_TASK = "CASE doc_id % 6 WHEN 0 THEN 'style' WHEN 1 THEN 'summarizer' WHEN 2 THEN 'headline' WHEN 3 THEN 'unknown' WHEN 4 THEN NULL ELSE 'grammar' END"
_PROMPT_TEXT = "CASE WHEN doc_id % 7 = 0 THEN concat('### Instruction: do it', chr(10), text) WHEN doc_id % 11 = 0 THEN concat('<|begin_of_text|>', text) ELSE concat('  ', text, chr(10)) END"


def _prompts_sql() -> str:
    def lit(x: str) -> str:
        return "concat(" + ", chr(10), ".join(f"'{part}'" for part in x.split("\n")) + ")"

    def template(name: str) -> str:
        asked = f"replace(replace('{P.ASKED[name]}', '{{style}}', coalesce(style, '{P.DEFAULT_STYLE}')), '{{length}}', coalesce(len, '{P.DEFAULT_LENGTH}'))"
        rules = lit(P.FACT_RULES[name] + "\n\n") + ", " if name in P.FACT_RULES else ""
        return f"concat({lit(P.INSTRUCTION)}, {asked}, {lit(chr(10) * 2)}, {rules}{lit(P.INPUT)}, {trim_sql('t')}, {lit(chr(10) * 2 + P.RESPONSE)})"

    cases = " ".join(f"WHEN task = '{n}' THEN {template(n)}" for n in P.ASKED)
    rows = f"SELECT doc_id, {_PROMPT_TASK} AS task, {_PROMPT_TEXT} AS t, CASE WHEN doc_id % 2 = 0 THEN lang END AS style, CASE WHEN doc_id % 5 = 0 THEN 'short' END AS len FROM documents"
    return f"SELECT doc_id, length(p) AS chars, sha256(p) AS prompt_sha FROM (SELECT doc_id, CASE WHEN contains(t, '### Instruction:') OR contains(t, '<|begin_of_text|>') THEN t {cases} ELSE {template('grammar')} END AS p FROM ({rows}))"


@query("prompts", _prompts_sql())
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """each document in the template of its task; texts that are prompts already pass."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_PROMPT_TASK} AS task", f"{_PROMPT_TEXT} AS t", "CASE WHEN doc_id % 2 = 0 THEN lang END AS style", "CASE WHEN doc_id % 5 = 0 THEN 'short' END AS len")
    p = rows.select("doc_id", P.build_prompt(F.col("task"), F.col("t"), F.col("style"), F.col("len")).alias("p"))
    return p.select("doc_id", F.length("p").cast("long").alias("chars"), F.sha2("p", 256).alias("prompt_sha"))


@query("style_divergence")
def style_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F51."""
    t = tasks(spark, sf_dir)
    return t.select("id", r6(E.style_divergence("target", "prediction")).alias("divergence"), (F.col("target") == F.col("prediction")).alias("verbatim"))


@query("consensus")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F68."""
    t = tasks(spark, sf_dir)
    return t.select("id", E.pick_consensus(F.array("source", "target", "prediction", "target")).alias("chosen")).select("id", F.sha2("chosen", 256).alias("chosen_sha"))


_ANSWERS = [
    (1, '```json\n{"short": "a", "medium": "b", "long": "c"}\n```'),
    (2, 'Sure: {"short": "x y", "medium": "m", "long": "l"} done'),
    (3, '{"short": "only"}'),
    (4, "no json"),
    (5, '{"short": 1, "medium": "b", "long": "c"}'),
]


_ANSWER_ROWS = [
    "doc_id + 1000",
    """CASE doc_id % 4 WHEN 0 THEN concat('```json', chr(10), '{"short": "', lang, '", "medium": "', source, '", "long": "', n_chars, '"}', chr(10), '```') WHEN 1 THEN concat('Sure: {"short": "', lang, '", "medium": "', source, '", "long": "x"} done')
    WHEN 2 THEN concat('{"short": "', source, '"}') ELSE concat('no json from ', source) END""",
]


@query(
    "teacher_json",
    r"WITH t AS (SELECT id, regexp_extract(regexp_replace(answer, '```(?:json)?', '', 'g'), '(?s)\{.*\}') AS j FROM "
    + with_given_sql("id answer", _ANSWERS, "documents", _ANSWER_ROWS)
    + r"), v AS (SELECT id, CASE WHEN j <> '' AND json_valid(j) THEN j END AS j FROM t) SELECT id, json_extract_string(j, '$.short') AS short, json_extract_string(j, '$.medium') AS medium, json_extract_string(j, '$.long') AS long, coalesce(json_extract_string(j, '$.short') IS NOT NULL AND json_extract_string(j, '$.medium') IS NOT NULL AND json_extract_string(j, '$.long') IS NOT NULL, false) AS complete FROM v",
)
def teacher_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F61, on given rows and one of each document."""
    t = with_given(spark, sf_dir, "id answer", _ANSWERS, "documents", _ANSWER_ROWS)
    j = F.regexp_extract(F.regexp_replace("answer", "```(?:json)?", ""), r"(?s)\{.*\}", 0)
    p = t.select("id", F.from_json(j, "short string, medium string, long string").alias("p")).select("id", "p.*")
    return p.withColumn("complete", F.col("short").isNotNull() & F.col("medium").isNotNull() & F.col("long").isNotNull())


_STREAMS = [
    (1, 'data: {"d": "Hel"}\ndata: {"d": "lo"}\n\ndata: [DONE]'),
    (2, '{"d": "whole"}'),
    (3, "data: [DONE]"),
    (4, 'noise\ndata: {"d": "x"}\ndata: broken'),
]


_STREAM_ROWS = [
    "doc_id + 1000",
    """CASE doc_id % 3 WHEN 0 THEN concat('data: {"d": "', lang, '"}', chr(10), 'data: {"d": "', source, '"}', chr(10), chr(10), 'data: [DONE]') WHEN 1 THEN concat('{"d": "', source, '"}') ELSE concat('noise', chr(10), 'data: broken') END""",
]


@query(
    "router_response",
    r"WITH l AS (SELECT id, generate_subscripts(x, 1) AS k, unnest(x) AS line FROM (SELECT id, string_split(body, chr(10)) AS x FROM "
    + with_given_sql("id body", _STREAMS, "documents", _STREAM_ROWS)
    + r")), p AS (SELECT id, k, trim(regexp_replace(line, '^data:', '')) AS j FROM l WHERE starts_with(line, 'data:') OR starts_with(line, '{')) SELECT i.id, coalesce(string_agg(CASE WHEN json_valid(j) THEN json_extract_string(j, '$.d') END, '' ORDER BY k), '') AS text FROM (SELECT DISTINCT id FROM l) i LEFT JOIN p USING (id) GROUP BY i.id",
)
def router_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one JSON object, or lines of a stream whose parts are joined, on given rows and one of each document."""
    lines = F.filter(F.split("body", "\n"), lambda x: F.startswith(x, F.lit("data:")) | F.startswith(x, F.lit("{")))
    parts = F.transform(lines, lambda x: F.get_json_object(F.trim(F.regexp_replace(x, "^data:", "")), "$.d"))
    return with_given(spark, sf_dir, "id body", _STREAMS, "documents", _STREAM_ROWS).select("id", F.array_join(F.array_compact(parts), "").alias("text"))


@query(
    "budgets",
    f"""
WITH n AS (SELECT doc_id, lang, length(text) AS c, len({words_sql("text")}) AS w FROM documents)
SELECT doc_id, CAST(least(greatest(floor(w * 1.5), 64), 600) AS INT) AS grammar, CAST(greatest(40, least(floor(w * 0.49::DOUBLE * 3) + 30, 180)) AS INT) AS summary, CAST(least(greatest(floor(c / 1.4::DOUBLE) + 1200, 3000), 8192) AS INT) AS style,
  CAST(least(greatest(512, floor(w * 2.5::DOUBLE)), 4096) AS INT) AS rewrite, CAST(least(greatest(floor(w * 0.2::DOUBLE), 40), 120) AS INT) AS test, CAST(greatest(10, floor(w * 0.1::DOUBLE)) AS INT) AS short_target,
  'Article (' || lang || ', ' || w || ' words):' AS prompt
FROM n""",
)
def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token budgets and a prompt from a template."""
    n = docs(spark, sf_dir).select("doc_id", "lang", F.length("text").alias("c"), T.word_count(F.col("text")).alias("w"))
    w, c = F.col("w"), F.col("c")
    return n.select(
        "doc_id",
        T.clamp(F.floor(w * 1.5), 64, 600).cast("int").alias("grammar"),
        F.greatest(F.lit(40), F.least(F.floor(w * 0.49 * 3) + 30, F.lit(180))).cast("int").alias("summary"),
        T.clamp(F.floor(c / 1.4) + 1200, 3000, 8192).cast("int").alias("style"),
        F.least(F.greatest(F.lit(512), F.floor(w * 2.5)), F.lit(4096)).cast("int").alias("rewrite"),
        T.clamp(F.floor(w * 0.2), 40, 120).cast("int").alias("test"),
        F.greatest(F.lit(10), F.floor(w * 0.1)).cast("int").alias("short_target"),
        F.format_string("Article (%s, %d words):", "lang", "w").alias("prompt"),
    )


@query(
    "label_masking",
    "WITH x AS (SELECT event_id, CAST(user_id % 7 AS INT) AS p, [event_id % 11 - 2, event_id % 13, event_id % 17, 40000 - event_id % 5, -100, event_id % 19, 7, 8] AS ids FROM events), c AS (SELECT event_id, p, list_transform(ids, lambda i: CASE WHEN i BETWEEN 0 AND 39998 THEN i ELSE 1 END) AS ids FROM x) SELECT event_id, array_to_string(ids, ',') AS ids, array_to_string(list_concat(list_transform(range(0, p), lambda i: -100), ids[p + 1 : 8]), ',') AS labels FROM c",
)
def label_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids out of range become padding; a prompt's labels are masked. Ids are derived from events."""
    k = F.col("event_id")
    ids = F.array(k % 11 - 2, k % 13, k % 17, 40000 - k % 5, F.lit(-100).cast("long"), k % 19, F.lit(7).cast("long"), F.lit(8).cast("long"))
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 7).cast("int").alias("p"), F.transform(ids, lambda i: F.when(i.between(0, 39998), i).otherwise(F.lit(1).cast("long"))).alias("ids"))
    labels = F.concat(F.array_repeat(F.lit(-100).cast("long"), F.col("p")), F.slice("ids", F.col("p") + 1, F.lit(8)))
    return e.select("event_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), F.array_join(F.transform(labels, lambda x: x.cast("string")), ",").alias("labels"))


_TASKS = [("grammar", 600, True), ("headline", 52, True), ("style", 8192, True), ("summarizer", 180, True), ("extractive", 0, False)]
_TASK_OF = "CASE WHEN n_chars < 500 THEN 'grammar' WHEN lang = 'en' THEN 'headline' WHEN lang = 'de' THEN 'style' ELSE 'summarizer' END"


@query(
    "task_catalogue",
    f"SELECT v.task, v.most_tokens, v.needs_model, coalesce(d.n, 0) AS documents FROM {literal_sql('task most_tokens needs_model', _TASKS).replace('AS t(', 'AS v(')} LEFT JOIN (SELECT {_TASK_OF} AS task, count(*) AS n FROM documents GROUP BY 1) d USING (task)",
)
def task_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC12: the tasks as a table, with the documents that fall to each."""
    fallen = table(spark, sf_dir, "documents").groupBy(F.expr(_TASK_OF).alias("task")).agg(F.count("*").alias("documents"))
    return literal(spark, "task most_tokens needs_model", _TASKS).join(fallen, "task", "left").fillna({"documents": 0})


@query(
    "conversation_pairs",
    "SELECT conv_id, turn, next_turn, length(prompt) AS prompt_chars, length(response) AS response_chars FROM (SELECT conv_id, turn, role, text AS prompt, lead(turn) OVER w AS next_turn, lead(role) OVER w AS next_role, lead(text) OVER w AS response FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'",
)
def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with the answers that follow them, as generation rows have them."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("prompt"), F.lead("turn").over(w).alias("next_turn"), F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("response"))
    return c.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", "next_turn", F.length("prompt").cast("long").alias("prompt_chars"), F.length("response").cast("long").alias("response_chars"))
