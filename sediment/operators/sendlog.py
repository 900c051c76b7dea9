"""The send log: what a client knows to be stored, by generation, session and item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def invalidate(log: DataFrame, generation: str, kept_item: str | None) -> DataFrame:
    """Rows that are still known: those of the store's generation, and those of the item that the store says it still has. A row without an item counts as stale."""
    ok = F.coalesce(F.col("gc_generation") == generation, F.lit(False))
    if kept_item is not None:
        ok = ok | F.coalesce(F.col("item_id") == kept_item, F.lit(False))
    return log.where(ok)


def touch(log: DataFrame, seen: DataFrame, key: str, generation: str, session: str) -> DataFrame:
    """The log after a session saw `seen` (key, further columns): known rows are stamped, others added."""
    stamped = seen.dropDuplicates([key]).withColumn("gc_generation", F.lit(generation)).withColumn("latest_session_id", F.lit(session))
    rest = log.join(stamped.select(key), key, "left_anti")
    again = stamped.join(log.select(key, "item_id"), key, "left")
    return rest.unionByName(again.select(*rest.columns), allowMissingColumns=True)


def commit(log: DataFrame, session: str, item: str) -> DataFrame:
    """The log of a finished session: rows that it didn't touch go, the others belong to its item."""
    return log.where(F.col("latest_session_id") == session).withColumn("item_id", F.lit(item))


def unsent(addresses: DataFrame, log: DataFrame) -> DataFrame:
    return addresses.join(log.select("address"), "address", "left_anti")


def batch_hashes(entries: DataFrame, batch: str, path: str = "abs_path") -> DataFrame:
    """(batch, hash): one hash over the paths and all attributes of a batch's entries in order."""
    whole = F.to_json(F.struct(*(c for c in entries.columns if c != batch)))
    return entries.groupBy(batch).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.sha2(whole, 256).alias("h")))), lambda e: e["h"]), ""), 256).alias("hash"))


def batches(entries: DataFrame, most: int = 128) -> DataFrame:
    """Entries with `batch`: the files of one directory, at most `most` together."""
    from pyspark.sql import Window

    own = Window.partitionBy("parent").orderBy("seq")
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    return entries.withColumn("parent", parent).withColumn("k", F.floor((F.row_number().over(own) - 1) / most)).withColumn("batch", F.concat_ws("#", "parent", F.col("k").cast("string"))).drop("k")


def cached(entries: DataFrame, batch: str, cache: DataFrame) -> DataFrame:
    """Batches with what the cache holds of them, null on a miss."""
    return batch_hashes(entries, batch).join(cache, "hash", "left")
