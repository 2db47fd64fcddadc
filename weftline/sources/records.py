"""Record files: JSON arrays and JSON lines in, partitioned and appended files out."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import nfc, trim_ws
from ..operators.joins import with_place
from .shared import shared_path  # noqa: F401

MODES = ("FAILFAST", "DROPMALFORMED", "PERMISSIVE")
BAD = "_corrupt_record"


def is_array_file(spark: SparkSession, path: str) -> bool:
    """SRC1: whether the first character that is no white space is a bracket; only the first lines are read."""
    first = spark.read.text(path).where(trim_ws(F.col("value")) != "").first()
    return first is not None and first["value"].lstrip().startswith("[")


def read_records(spark: SparkSession, path: str, schema: StructType | str, mode: str = "DROPMALFORMED") -> DataFrame:
    """SRC1 to SRC4: a JSON array or JSON lines with a given schema.

    FAILFAST stops at a malformed record, DROPMALFORMED leaves it out, PERMISSIVE keeps it in the column _corrupt_record. Blank lines are
    skipped in all modes.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    reader = spark.read.option("mode", mode).option("multiLine", is_array_file(spark, path))
    if mode == "PERMISSIVE":
        ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        return reader.option("columnNameOfCorruptRecord", BAD).schema(f"{ddl}, {BAD} string").json(path)
    return reader.schema(schema).json(path)


def scan_report(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """SRC4's report: good and bad records in one row."""
    # The text column of bad records alone cannot be queried on a raw file, so the flag is taken with a field.
    rows = read_records(spark, path, schema, "PERMISSIVE")
    return rows.groupBy(F.col(BAD).isNotNull().alias("bad")).agg(F.count("*").alias("n"), F.count(rows.columns[0]).alias("with_key"))


def bad_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """SRC3, SRC4: file, line (from 1), reason and text of each line that is no record of the schema; blank lines are none and are not reported.

    Lines are numbered in files that are read in splits: a task counts the lines of its split, and the lines of the splits before, one number a split, are
    added up. reason: no_json, no_object, or field:<name> for the first field whose value is of another type.
    """
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    # Numbers of a split's lines follow one another, so its first number tells each line's place in it.
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "block", "first", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    json = F.try_parse_json("value")
    kind = F.schema_of_variant("_json")

    def wrong(name: str, to: str) -> Column:
        held = F.try_variant_get("_json", f"$.{name}", "variant")
        return F.when(held.isNotNull() & F.try_variant_get("_json", f"$.{name}", "string").isNotNull() & F.try_variant_get("_json", f"$.{name}", to).isNull(), f"field:{name}")

    broken = F.coalesce(*(wrong(f.name, f.dataType.simpleString()) for f in fields.fields))
    reason = F.when(F.col("_json").isNull(), "no_json").when(~kind.startswith("OBJECT"), "no_object").otherwise(broken)
    bad = lines.where(trim_ws(F.col("value")) != "").withColumn("_json", json).withColumn("reason", reason).where("reason IS NOT NULL").select("file", "block", "id", "reason", "value")
    return bad.join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "reason", F.col("value").alias("text"))


def physical_position(df: DataFrame, name: str = "pos") -> DataFrame:
    """SRC5: row numbers from 1 in the order of files, blocks and lines; df comes straight from a file source."""
    order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return with_place(df.select("*", order.alias("_at")), F.col("_at"), name).drop("_at")


def row_range(df: DataFrame, start: int, end: int) -> DataFrame:
    """SRC5: the rows from start to end, by physical order, both included."""
    return physical_position(df).where(F.col("pos").between(start, end))


def load_inputs(df: DataFrame, order: Column, text: str = "input", key: str = "id") -> DataFrame:
    """SRC6: normalised inputs with an id; rows without one get row-%06d by their place. Empty inputs and repeated ids fail the query."""
    placed = with_place(df, order, "_n")
    named = placed.withColumn(key, F.coalesce(F.col(key).cast("string"), F.format_string("row-%06d", "_n"))).withColumn(text, trim_ws(nfc(F.coalesce(F.col(text), F.lit("")))))
    counts = named.groupBy(key).agg(F.count("*").alias("_c"))
    checked = named.join(counts, key)
    fine = F.assert_true((F.col("_c") == 1) & (F.col(text) != ""), F.concat(F.lit("empty or repeated input: "), F.col(key)))
    return checked.where(fine.isNull()).drop("_c", "_n")


def require_equal_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """SRC11: one row with both counts; fails if they differ."""
    both = a.agg(F.count("*").alias("a")).crossJoin(b.agg(F.count("*").alias("b")))  # one row by one
    return both.where(F.assert_true(F.col("a") == F.col("b"), F.lit("row counts differ")).isNull())


def write_records(df: DataFrame, path: str, *, mode: str = "overwrite", by: str | None = None, fmt: str = "json") -> None:
    """SNK1, SNK2, SNK3: overwrite or append, in one folder or one for each value of a column. A task's files appear when it has succeeded."""
    writer = df.write.mode(mode)
    (writer.partitionBy(by) if by else writer).format(fmt).save(path)


def membership(parts: dict[str, DataFrame], key: str, row_sha: Column) -> DataFrame:
    """SNK5: split, key and row_sha of every row of every part."""
    rows = [df.select(F.lit(name).alias("split"), key, row_sha.alias("row_sha")) for name, df in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def manifest(df: DataFrame, seconds: Column) -> DataFrame:
    """SNK7: rows, seconds and rows a second, in one row."""
    return df.agg(F.count("*").alias("rows"), F.sum(seconds).alias("seconds")).withColumn("rows_per_second", F.try_divide("rows", "seconds"))


def markdown(report: DataFrame, most: int = 200) -> str:
    """SNK6: a small report as a Markdown table; a report of more than `most` rows is no report and fails."""
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    head = "| " + " | ".join(report.columns) + " |\n|" + "---|" * len(report.columns)
    return "\n".join([head, *("| " + " | ".join("-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows)])


def table_digest(df: DataFrame) -> str:
    """SHA-256 of a table's rows whatever their order: of the number of rows and the sums of parts of the rows' own hashes."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    parts = [F.sum(F.conv(F.substring(row, k * 8 + 1, 8), 16, 10).cast("decimal(20,0)")).alias(f"s{k}") for k in range(8)]
    return hashlib.sha256("|".join(map(str, df.agg(F.count("*"), *parts).first())).encode()).hexdigest()


def json_report(report: DataFrame, inputs: dict[str, DataFrame], most: int = 200) -> str:
    """SNK6: a small report as JSON, with the digest of each input table; a report of more than `most` rows fails."""
    rows = report.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    return json.dumps({"inputs": {name: {"sha256": table_digest(df)} for name, df in inputs.items()}, "rows": [json.loads(r) for r in rows]}, ensure_ascii=False, indent=2)
