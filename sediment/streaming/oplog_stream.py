"""Following an operation log: a file stream of log entries that keeps a materialised item table.

A recovery concerns all removed items at once, so no state by key can hold it; each batch recomputes the
closed form over the entries seen and replaces the table, which makes repeated batches harmless. Another
generation than the table's means that the log was rewritten: the state is dropped and read anew.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.oplog import live_items


def read_log_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


class ItemTable:
    """Entries seen so far below `path`, in versions; a pointer file names the current one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _pointer(self) -> dict:
        try:
            with open(os.path.join(self.path, "current.json")) as f:
                return json.load(f)
        except FileNotFoundError:
            return {"version": -1, "generation": None, "offset": None}

    def entries(self) -> DataFrame | None:
        v = self._pointer()["version"]
        return None if v < 0 else self.spark.read.parquet(os.path.join(self.path, f"v{v}"))

    def items(self) -> DataFrame | None:
        entries = self.entries()
        return None if entries is None else live_items(entries)

    def apply(self, batch: DataFrame, generation: str | None = None) -> None:
        """Add entries; those already held are ignored."""
        now = self._pointer()
        held = self.entries() if generation is None or now["generation"] in (None, generation) else None
        new = batch if held is None else held.unionByName(batch, allowMissingColumns=True)
        version = now["version"] + 1
        target = os.path.join(self.path, f"v{version}")
        new.dropDuplicates(["log_offset"]).write.mode("overwrite").parquet(target)
        top = self.spark.read.parquet(target).agg(F.max("log_offset")).first()[0]
        tmp = os.path.join(self.path, "current.json.new")
        with open(tmp, "w") as f:
            json.dump({"version": version, "generation": generation or now["generation"], "offset": top}, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, os.path.join(self.path, "current.json"))


def follow(stream: DataFrame, table: ItemTable, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(lambda batch, _: table.apply(batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
