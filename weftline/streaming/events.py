"""Structured Streaming over event tables: windows, deduplication and keyed state.

A stream is run on what its folder holds (availableNow) and its result written to the shared folder; with a longer-lived trigger the
same transformations run on and on. Times without a zone are taken as UTC, since watermarks need timestamps with one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import shared_path

LATE = "10 minutes"


def read_events(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The table as a stream, with ts as a timestamp."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def run_once(result: DataFrame, tag: str, mode: str = "complete") -> DataFrame:
    """Run a stream on what is there and return what it gave. In complete mode the last batch replaces those before."""
    spark = result.sparkSession
    out, state = shared_path(spark, tag), shared_path(spark, f"{tag}-state")
    schema = result.schema

    def write(batch: DataFrame, number: int) -> None:
        # A batch that is run again after a failure replaces its own files.
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    query = result.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out)


def tumbling(events: DataFrame, length: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark("ts", LATE).groupBy(F.window("ts", length).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", length, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    grouped = events.withWatermark("ts", LATE).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of_each(events: DataFrame, keys: list[str]) -> DataFrame:
    """Resumable append: a key seen before within the watermark is not given again."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(keys)


def _limiter(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The allowed rate of one key: 15 % more after 15 successes in a row, half after a failure."""
    rate, streak, seen = state.get if state.exists else (1.0, 0, 0)
    # A key's events may come in several chunks; they are put in order together. A micro-batch bounds what one key has here.
    for failed in pd.concat(list(batches)).sort_values(["ts", "event_id"])["failed"]:
        seen += 1
        if failed:
            rate, streak = max(rate * 0.5, 0.01), 0
        else:
            streak += 1
            if streak == 15:
                rate, streak = rate * 1.15, 0
    state.update((rate, streak, seen))
    yield pd.DataFrame({"user_id": [key[0]], "rate": [rate], "streak": [streak], "seen": [seen]})


def adaptive_limits(events: DataFrame, failed) -> DataFrame:
    """user_id, rate, streak and seen after each batch; a user's events of a batch are taken in the order of their times."""
    rows = events.select("user_id", "ts", "event_id", failed.alias("failed"))
    return rows.groupBy("user_id").applyInPandasWithState(_limiter, "user_id long, rate double, streak long, seen long", "rate double, streak long, seen long", "update", GroupStateTimeout.NoTimeout)
