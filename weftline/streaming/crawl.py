"""A crawl of ascending ids as a streaming source: each id is asked once, dead or alive, and a restart goes on behind the last id asked.

The source's offset is the next id. Spark keeps the offsets of a micro-batch in the query's checkpoint before it runs, and asks a batch that
failed half way again as it was; one that was written is not asked again. The source notes how far it has planned in a file of its own, since after a
restart Spark does not tell a source where it stands. Ids of a batch are dealt to tasks; only ranges pass through the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Ids that one task asks for.
IDS_OF_A_TASK = 1000


class IdRange(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class IdReader(DataSourceStreamReader):
    """Micro-batches of `step` ids from `start` up to `end`, both included."""

    def __init__(self, start: int, end: int, step: int, each: int, progress: str):
        self.start, self.end, self.step, self.each, self.progress = start, end, step, each, progress
        self.next: int | None = None

    def initialOffset(self) -> dict:
        return {"next": self.start}

    def latestOffset(self) -> dict:
        """One step behind what was planned so far. Spark begins each batch where the last one ended, so nothing is left out whatever is returned."""
        self.next = max(self._planned(), min(self._planned() + self.step, self.end + 1))
        return {"next": self.next}

    def partitions(self, start: dict, end: dict) -> list[IdRange]:
        self.next = max(self._planned(), end["next"])
        store, path = arrow_fs.FileSystem.from_uri(self.progress)
        with store.open_output_stream(f"{path}.new", compression=None) as out:
            out.write(json.dumps({"next": self.next}).encode())
        store.move(f"{path}.new", path)
        return [IdRange(low, min(low + self.each, end["next"])) for low in range(start["next"], end["next"], self.each)]

    def _planned(self) -> int:
        if self.next is None:
            store, path = arrow_fs.FileSystem.from_uri(self.progress)
            if store.get_file_info(path).type == arrow_fs.FileType.File:
                with store.open_input_stream(path, compression=None) as file:
                    self.next = json.loads(file.read())["next"]
            else:
                self.next = self.start
        return self.next

    def read(self, partition: IdRange) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array(range(partition.low, partition.high), pa.int64())], names=["id"])


class AscendingIds(DataSource):
    """spark.readStream.format("ascending_ids") with the options start, end, step, each (ids of a task) and progress (a file's URI, which the driver reaches)."""

    @classmethod
    def name(cls) -> str:
        return "ascending_ids"

    def schema(self) -> str:
        return "id long"

    def streamReader(self, schema) -> IdReader:
        o = self.options
        return IdReader(int(o.get("start", 0)), int(o["end"]), int(o.get("step", 1000)), int(o.get("each", IDS_OF_A_TASK)), o["progress"])


def crawl(spark: SparkSession, folder: str, fetch: Callable[[int, int], DataFrame], *, end: int, start: int = 0, step: int = 1000) -> DataFrame:
    """Ask all ids from start to end that were not asked before in this folder; all rows asked so far: batch, id, alive and the columns of fetch().

    fetch(low, high) gives a row for each live id of the range: id and what was found there. An id without a row is dead; it is remembered like the others and
    never asked again. The result of a batch replaces that of a try of the same batch which failed.
    """
    spark.dataSource.register(AscendingIds)
    asked = f"{folder}/asked"
    source = spark.readStream.format("ascending_ids").options(start=str(start), end=str(end), step=str(step), progress=f"{folder}/progress.json").load()

    def ask(ids: DataFrame, number: int) -> None:
        low, high = ids.agg(F.min("id"), F.max("id")).first()
        if low is not None:
            found = fetch(low, high).withColumn("alive", F.lit(True))
            ids.join(found, "id", "left").fillna({"alive": False}).write.mode("overwrite").parquet(f"{asked}/batch={number}")

    query = source.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(ask).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.parquet(asked)
