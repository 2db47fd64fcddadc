"""The functions by name, for SQL.

What needs no Python becomes a temporary SQL function, which Spark inlines into the plan; alignment and sequences are Arrow functions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import aggregates, edits, metrics
from .text import SENTENCE_LEAST, WS, _nfc


def register(spark: SparkSession) -> None:
    """Scalar functions, aggregates, the table function summary_rows, and text_word_rows, text_sentence_rows and text_edit_rows for LATERAL joins."""
    from . import tables  # uses the operators, which use the functions

    aggregates.register(spark)
    tables.register(spark)
    ws = WS.replace("\\", "\\\\")

    def trimmed(t: str) -> str:
        return f"regexp_replace({t}, '^[{ws}]+|[{ws}]+$', '')"

    def words(t: str) -> str:
        return f"filter(split({t}, '[{ws}]+'), w -> w <> '')"

    sentences = f"filter(transform(split({trimmed('t')}, '(?<=[.!?])[{ws}]+'), s -> {trimmed('s')}), s -> length(s) >= {SENTENCE_LEAST})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION text_trim(t STRING) RETURNS STRING RETURN {trimmed('t')}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION text_words(t STRING) RETURNS ARRAY<STRING> RETURN {words('t')}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION text_sentences(t STRING) RETURNS ARRAY<STRING> RETURN {sentences}")
    for name, function in {
        "nfc": _nfc,
        "lcs_length": metrics.lcs_length,
        "word_edits": edits.word_edits,
        "edit_script": edits.make_script,
        "text_similarity": edits.text_similarity,
        "style_divergence": edits.style_divergence,
        "pick_consensus": edits.pick_consensus,
    }.items():
        spark.udf.register(name, function)
    # A generator takes no SQL function, so the expressions stand in the table functions themselves.
    for name, column, expression in (("text_word_rows", "word", words("t")), ("text_sentence_rows", "sentence", sentences)):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS TABLE(place INT, {column} STRING) RETURN SELECT x.pos, x.col FROM posexplode({expression}) AS x(pos, col)")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION text_edit_rows(a STRING, b STRING) RETURNS TABLE(i1 INT, i2 INT, old ARRAY<STRING>, new ARRAY<STRING>) "
        f"RETURN SELECT x.i1, x.i2, x.old, x.new FROM inline(word_edits({words('a')}, {words('b')})) AS x(i1, i2, old, new)"
    )
