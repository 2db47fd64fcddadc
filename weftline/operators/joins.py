"""Joins with the checks and fallbacks that corpus work needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import nfc, scoring_text
from ..sources.shared import stored


def not_yet_done(source: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of source whose keys were not written yet. A null key was never written, so its rows stay."""
    return source.join(done.select(*keys).distinct(), keys, "left_anti")


def lookup(left: DataFrame, right: DataFrame, keys: list[str], value: str, *, order: Column, alias: str) -> DataFrame:
    """The value of the last row (by order) of right that matches the first key, else the next key, and so on; null if none."""
    out = left
    for k in keys:
        last = right.where(F.col(k).isNotNull()).groupBy(k).agg(F.max_by(value, order).alias(f"_{alias}_{k}"))
        out = out.join(last, k, "left")
    return out.withColumn(alias, F.coalesce(*(f"_{alias}_{k}" for k in keys))).drop(*(f"_{alias}_{k}" for k in keys))


def completeness(gold: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Counts of matched, missing and unknown keys, and of keys that repeat on either side, in one row."""
    g = gold.groupBy(key).agg(F.count("*").alias("g"))
    p = predictions.groupBy(key).agg(F.count("*").alias("p"))
    both = g.join(p, key, "full_outer")
    return both.agg(
        F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("matched"),
        F.count_if(F.col("p").isNull()).alias("missing"),
        F.count_if(F.col("g").isNull()).alias("unknown"),
        F.count_if(F.col("g") > 1).alias("repeated_gold"),
        F.count_if(F.col("p") > 1).alias("repeated_predictions"),
    )


def one_to_one(gold: DataFrame, predictions: DataFrame, key: str, inputs: tuple[str, str] | None = None) -> DataFrame:
    """The inner join, which fails when it runs if a key is missing, unknown or repeated.

    inputs: the gold side's input and the one that was submitted with the prediction. They must be equal as scoring_text() has them; a null one was not
    submitted and is not compared. An empty gold input fails as well. The checks are part of the plan: a full outer join over counts, so no action runs before the query's own.
    """
    # Inputs are compared by digest, taken before rows are dealt, so that a text is shuffled only if the caller reads it.
    ours, theirs = (F.sha2(nfc(scoring_text(F.col(c))), 256) for c in inputs) if inputs else (F.lit(None), F.lit(None))
    sent = F.col(inputs[1]).isNotNull() if inputs else F.lit(False)
    g = gold.withColumn("_ours", ours).withColumn("_g", F.count("*").over(Window.partitionBy(key)))
    p = predictions.withColumns({"_theirs": theirs, "_sent": sent}).withColumn("_p", F.count("*").over(Window.partitionBy(key)))
    both = g.join(p, key, "full_outer")
    name = F.col(key).cast("string")
    fine = F.assert_true((F.col("_g") == 1) & (F.col("_p") == 1), F.concat(F.lit("not one to one: "), name)).isNull()
    if inputs:
        nothing = F.sha2(F.lit(""), 256)
        fine = fine & F.assert_true(F.coalesce(F.col("_ours"), nothing) != nothing, F.concat(F.lit("empty input: "), name)).isNull()
        fine = fine & F.assert_true(~F.col("_sent") | (F.col("_ours") == F.col("_theirs")), F.concat(F.lit("inputs differ: "), name)).isNull()
    return both.where(fine).drop("_g", "_p", "_ours", "_theirs", "_sent")


def zip_rows(left: DataFrame, right: DataFrame, left_order: Column, right_order: Column) -> DataFrame:
    """Rows joined by place, as far as the shorter side goes; column pos from 1.

    Places come from counts of range partitions, so no task sees all rows.
    """
    return with_place(left, left_order, "pos").join(with_place(right, right_order, "pos"), "pos")


def with_place(df: DataFrame, order: Column, name: str) -> DataFrame:
    """Row numbers from 1 in the order of a key: a range partitioning, the sizes of its partitions, and numbers within them.

    The ranged rows are written once and both the sizes and the rows are read from there. Planned twice, a range partitioning may draw its
    borders differently. Rows of equal keys are numbered in any order.
    """
    ranged = df.withColumn("_o", order).repartitionByRange("_o").sortWithinPartitions("_o")
    # The id holds the partition in its upper and the place in its lower 33 bits.
    rows = stored(ranged.withColumn("_id", F.monotonically_increasing_id()).drop("_o"), "ranged").withColumn("_part", F.shiftright("_id", 33))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = rows.join(F.broadcast(before), "_part")  # one row for each partition
    return placed.withColumn(name, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).drop("_id", "_part", "_before")


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, alias: str) -> DataFrame:
    """For each row of left the value of the last row of right at or before it, within `by`; null if there is none.

    Both sides are put in one order and the last known value is carried forward: one shuffle, no inequality join.
    """
    columns = [c for c in left.columns if c not in (*by, at)]
    rows = left.select(*by, at, F.lit(1).alias("_side"), F.struct(*columns).alias("_row"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_value"))
    marks = right.select(*by, at, F.lit(0).alias("_side"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"))
    # At equal times right's rows come first, so they count.
    order = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.union(marks).withColumn(alias, F.last("_value", ignorenulls=True).over(order))
    return both.where("_side = 1").select(*by, at, "_row.*", alias)
