"""Jobs and quotas over event tables: transitions, fixed windows, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Which states may follow which.
TRANSITIONS = {
    "received": ("stored", "failed", "cancelled"),
    "stored": ("parsing", "retrying", "failed", "cancelled"),
    "parsing": ("normalizing", "retrying", "failed", "cancelled"),
    "normalizing": ("chunking", "retrying", "failed", "cancelled"),
    "chunking": ("indexing", "retrying", "failed", "cancelled"),
    "indexing": ("ready", "retrying", "failed", "cancelled"),
    "ready": (),
    "retrying": ("received", "failed", "cancelled"),
    "failed": ("retrying",),
    "cancelled": (),
}


def illegal_transitions(events: DataFrame, allowed: DataFrame) -> DataFrame:
    """(job, id, before, status): steps that the table (before, status) doesn't allow. events: job, id, ts, status."""
    w = Window.partitionBy("job").orderBy("ts", "id")
    steps = events.withColumn("before", F.lag("status").over(w)).filter("before is not null and before <> status")
    return steps.join(F.broadcast(allowed), ["before", "status"], "left_anti").select("job", "id", "before", "status")


def latest_state(events: DataFrame) -> DataFrame:
    return events.groupBy("job").agg(F.max_by("status", F.struct("ts", "id")).alias("status"), F.max("ts").alias("ts"))


def quota_windows(events: DataFrame, seconds: int = 60) -> DataFrame:
    """(key, window_start, calls, tokens): aligned fixed windows."""
    return events.groupBy("key", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens")).select("key", F.col("w.start").alias("window_start"), "calls", "tokens")


def first_deliveries(events: DataFrame, key: str) -> DataFrame:
    """The earliest event of each deduplication key."""
    names = events.columns
    return events.groupBy(key).agg(F.min_by(F.struct(*(F.col(c) for c in names)), F.struct("ts", "id")).alias("x")).select("x.*")


def fresh_only(events: DataFrame) -> DataFrame:
    """Events whose version isn't below one seen before for the same key."""
    w = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("seen", F.max("version").over(w)).filter(F.col("seen").isNull() | (F.col("version") >= F.col("seen"))).drop("seen")
