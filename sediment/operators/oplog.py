"""The operation log as a relation: which items live, what compaction keeps, and tailing.

An item lives if it was never removed after its addition, or a recovery came after its last removal;
that is a closed form over the maxima of log offsets, so replay needs no order and no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import ADD, RECOVER, REMOVE


def item_states(log: DataFrame) -> DataFrame:
    """All added items with `removed_at` (last removal after the addition, or null) and `live`."""
    added = log.where(F.col("op") == ADD).select(F.col("log_offset").alias("added_at"), "item_id", *([c for c in log.columns if c == "metadata"]))
    gone = log.where(F.col("op") == REMOVE).select(F.col("log_offset").alias("off"), F.explode("removed_ids").alias("item_id")).groupBy("item_id").agg(F.max("off").alias("off"))
    recovered = log.agg(F.max(F.when(F.col("op") == RECOVER, F.col("log_offset"))).alias("recovered_at"))
    out = added.join(gone, "item_id", "left").withColumn("removed_at", F.when(F.col("off") > F.col("added_at"), F.col("off"))).drop("off")
    out = out.crossJoin(F.broadcast(recovered))  # one row
    return out.withColumn("live", F.col("removed_at").isNull() | F.coalesce(F.col("recovered_at") > F.col("removed_at"), F.lit(False))).drop("recovered_at")


def live_items(log: DataFrame) -> DataFrame:
    return item_states(log).where("live").drop("live", "removed_at")


def removed_items(log: DataFrame) -> DataFrame:
    return item_states(log).where("NOT live").drop("live")


def compact(log: DataFrame, items: DataFrame) -> DataFrame:
    """What remains of a log: additions of items that still exist."""
    return log.where(F.col("op") == ADD).join(items.select("item_id"), "item_id", "left_semi").select(*log.columns)


def tail(log: DataFrame, after: int | None, until: int | None = None) -> DataFrame:
    """Entries behind an offset, up to a pinned one."""
    out = log if after is None else log.where(F.col("log_offset") > after)
    return out if until is None else out.where(F.col("log_offset") <= until)


def next_offset(log: DataFrame) -> int:
    top = log.agg(F.max("log_offset")).first()[0]
    return 0 if top is None else top + 1
