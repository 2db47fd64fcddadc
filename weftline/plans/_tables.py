"""Access to the driver's tables, and the pieces of SQL that the oracles share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import spread  # noqa: F401


def docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text", "lang", "source", "n_chars")))


def dealt_docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """documents dealt by doc_id. Words that become rows then need no shuffle of their own for what is counted by document."""
    return docs(spark, sf_dir, *columns).repartition("doc_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A small table of given rows, made in the JVM."""
    names = columns.split()
    values = ", ".join("(" + ", ".join(sql_value(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def literal_sql(columns: str, rows: list[tuple]) -> str:
    """The same rows for DuckDB, to stand behind FROM."""
    values = ", ".join("(" + ", ".join(sql_value(v, duck=True) for v in row) + ")" for row in rows)
    return f"(VALUES {values}) AS t({', '.join(columns.split())})"


def with_given(spark: SparkSession, sf_dir: str, columns: str, rows: list[tuple], name: str, expressions: list[str]) -> DataFrame:
    """Given rows, and rows that SQL expressions make of each row of a table."""
    return literal(spark, columns, rows).union(table(spark, sf_dir, name).selectExpr(*expressions))


def with_given_sql(columns: str, rows: list[tuple], name: str, expressions: list[str]) -> str:
    """The same for DuckDB, to stand behind FROM."""
    return f"(SELECT * FROM {literal_sql(columns, rows)} UNION ALL SELECT {', '.join(expressions)} FROM {name}) AS t({', '.join(columns.split())})"


def sql_value(v: object, duck: bool = False) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    if isinstance(v, int):
        return str(v)
    if duck:
        return "'" + v.replace("'", "''") + "'"
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def r6(c: Column) -> Column:
    """Rounded to 6 places, as reports and value hashes need it."""
    return F.round(c, 6)


# Shared SQL. WS is the class of functions.text.WS.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def squeeze_sql(x: str) -> str:
    return trim_sql(f"regexp_replace({x}, '[{WS}]+', ' ', 'g')")


def words_sql(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{WS}]+'), lambda w: w <> '')"


def tokens_sql(x: str, block: str = "A-Za-zÀ-ÖØ-öø-ÿ") -> str:
    return rf"list_filter(string_split_regex({x}, '[^\p{{L}}\p{{N}}_{block}]+'), lambda w: w <> '')"


def sentences_sql(x: str, least: int = 15) -> str:
    marked = rf"regexp_replace({trim_sql(x)}, '([.!?])[{WS}]+', '\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {trim_sql('s')}), lambda s: length(s) >= {least})"


def ngrams_sql(tokens: str, n: int, sep: str = " ") -> str:
    """Shifted copies of the list, zipped."""
    many = f"greatest(len({tokens}) - {n - 1}, 0)"
    parts = ", ".join(f"({tokens})[{k + 1} : {many} + {k}]" for k in range(n))
    return f"list_transform(list_zip({parts}), lambda x: {f" || '{sep}' || ".join(f'x[{k + 1}]' for k in range(n))})"
