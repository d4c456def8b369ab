"""Streams of events: counters, deduplication, quotas and circuit breakers on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def usage_counters(events: DataFrame) -> DataFrame:
    """Running calls, failures and tokens by (operation, model)."""
    return events.groupBy("operation", "model").agg(F.count("*").alias("calls"), F.count_if(F.col("status") != "success").alias("failures"), F.sum("tokens").alias("tokens"))


def deduplicate(events: DataFrame, key: str, delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def quota(events: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """(key, id, admitted, used): a window of a key begins with its first event; an event is admitted while the window's
    tokens with it don't exceed the limit. events: key, id, ts, tokens; state is one window a key."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, used = state.get if state.exists else (-1, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        for r in rows.itertuples():
            at = int(r.ts.timestamp() * 1000)
            if start < 0 or at >= start + seconds * 1000:
                start, used = at, 0
            ok = used + int(r.tokens) <= limit
            used += int(r.tokens) if ok else 0
            out.append((key[0], r.id, ok, used))
        state.update((start, used))
        yield pd.DataFrame(out, columns=["key", "id", "admitted", "used"])

    return events.groupBy("key").applyInPandasWithState(run, "key string, id long, admitted boolean, used long", "start long, used long", "append", GroupStateTimeout.NoTimeout)


def breaker(events: DataFrame, failures: int = 3, open_seconds: int = 300, successes: int = 2) -> DataFrame:
    """(key, id, state, admitted): closed until so many failures in a row, then open for a time, then half open, where
    one failure opens it again and so many successes close it. events: key, id, ts, ok."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mode, count, until = state.get if state.exists else ("closed", 0, 0)
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts", "id"]).itertuples():
            at = int(r.ts.timestamp() * 1000)
            if mode == "open" and at >= until:
                mode, count = "half_open", 0
            admitted = mode != "open"
            if admitted:
                if r.ok:
                    count = count + 1 if mode == "half_open" else 0
                    if mode == "half_open" and count >= successes:
                        mode, count = "closed", 0
                else:
                    count += 1
                    if mode == "half_open" or count >= failures:
                        mode, count, until = "open", 0, at + open_seconds * 1000
            out.append((key[0], r.id, mode, admitted))
        state.update((mode, count, until))
        yield pd.DataFrame(out, columns=["key", "id", "state", "admitted"])

    return events.groupBy("key").applyInPandasWithState(run, "key string, id long, state string, admitted boolean", "mode string, count long, until long", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, into Parquet (complete results replace what a batch wrote), and reads it."""
    spark, schema = stream.sparkSession, stream.schema
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode(mode)
    if mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:
        save: Callable[[DataFrame, int], None] = lambda df, _: df.write.mode("overwrite").parquet(path)
        writer = writer.foreachBatch(save)
    writer.start().awaitTermination()
    return spark.read.schema(schema).parquet(path)
