"""Exact deduplication by a tree of merges of sorted digest runs (operator 6).

A run is the digests of one partition, sorted and cut into slices of the digest space; a slice travels as one binary
value of fixed-size records. Runs are exchanged in rounds: in round r the runs whose numbers agree after division by
FAN**r meet, slice by slice, and a multiway merge of the sorted slices makes one run of them (the sort used is a
merge of the ascending runs that it finds). Equal digests become one record with the best identifier of all and the
sum of their counts, at every level, and every level verifies what it merges: a digest is the full SHA-256 with the
normalised length. The last round leaves one run. Slices get narrower from round to round, so that a merge holds about
RECORDS records however long the runs are. Texts never leave the first scan.

A group of copies is one record in each run from the first level on, so a hot group never meets in one task. Rows
learn their survivor from the last run: digests held by more than 1/HOT of all rows (hence fewer than HOT of
them) by broadcast, the others by a join in which no key is hot.

Edge cases: null text counts as empty; empty texts are equal to each other. Among equal texts the row with the
most code points stays, then the smallest doc_id (null last), then the smallest hash of the original text. Repeated
rows of one doc_id with equal texts count in group_size each and are all marked kept; keep() returns one of them. Very
long texts are hashed whole and move only as rows that repeat a doc_id and text. Other columns are ignored, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import SPACE, Batches, lean, mark, materialize, size_partitions, without

#: Runs that one merge takes.
FAN = 16
#: Records that a merge holds, about.
RECORDS = 200_000
#: A digest with more than 1/HOT of the rows is broadcast; there are fewer than HOT.
HOT = 2000
#: Of a run, in the order that survivors are chosen by. worse: fewer code points count as more.
RECORD = np.dtype([("d", "<u8", 4), ("norm_len", "<i8"), ("worse", "<i8"), ("null", "<i8"), ("doc_id", "<i8"), ("mark", "<i8"), ("n", "<i8")])
RUN_SCHEMA = "run long, slice long, records binary"


def normalize(text):
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), SPACE, "")


def digest_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, digest binary, norm_len, n_points) of each row."""
    t = normalize(docs["text"])
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        mark(docs).alias("mark"),
        F.unhex(F.sha2(t, 256)).alias("digest"),
        F.length(t).cast("long").alias("norm_len"),
        F.length(F.coalesce(docs["text"].cast("string"), F.lit(""))).cast("long").alias("n_points"),
    )


def merge(runs: list[np.ndarray]) -> np.ndarray:
    """One run of sorted runs: equal digests are one record, that of the survivor, with the sum of their counts."""
    x = np.concatenate(runs)
    if len(x) < 2:
        return x
    first = x["d"][:, 0]
    order = np.argsort(first, kind="stable")
    same = np.diff(first[order]) == 0
    if same.any():  # ties of the first word: by all that orders records
        tied = np.append(same, False) | np.append(False, same)
        some = x[order[tied]]
        keys = (some["mark"], some["doc_id"], some["null"], some["worse"], some["norm_len"], *(some["d"][:, i] for i in (3, 2, 1, 0)))
        order[tied] = order[tied][np.lexsort(keys)]
    x = x[order]
    new = np.append(True, (x["d"][1:] != x["d"][:-1]).any(axis=1) | (x["norm_len"][1:] != x["norm_len"][:-1]))
    starts = np.flatnonzero(new)
    out = x[starts]
    out["n"] = np.add.reduceat(x["n"], starts)
    return out


def _slices(run: int, x: np.ndarray, bits: int) -> pa.RecordBatch:
    """A run's records, cut by the first bits of the digest."""
    of = (x["d"][:, 0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)
    names, starts = np.unique(of, return_index=True)
    parts = np.split(x, starts[1:]) if len(x) else []
    return pa.RecordBatch.from_arrays([pa.array([run] * len(parts), pa.int64()), pa.array(names), pa.array([p.tobytes() for p in parts], pa.binary())], ["run", "slice", "records"])


def first_runs(rows: DataFrame, bits: int) -> DataFrame:
    """RUN_SCHEMA: the sorted run of each partition; longer ones than RECORDS rows in several pieces under one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId(), [], 0
        for b in batches:
            x = np.zeros(b.num_rows, RECORD)
            x["d"] = np.frombuffer(b"".join(b.column(2).to_pylist()), ">u8").reshape(-1, 4)
            ids = b.column(0)
            x["doc_id"], x["null"] = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            x["mark"], x["norm_len"], x["worse"], x["n"] = b.column(1).to_numpy(), b.column(3).to_numpy(), -b.column(4).to_numpy(), 1
            held.append(merge([x]))
            size += len(held[-1])
            if size >= RECORDS:
                yield _slices(number, merge(held), bits)
                held, size = [], 0
        if held:
            yield _slices(number, merge(held), bits)

    return rows.select("doc_id", "mark", "digest", "norm_len", "n_points").mapInArrow(lean(run), RUN_SCHEMA)


def _survivors(_: int, x: np.ndarray) -> pa.RecordBatch:
    """The last run as rows."""
    data = x["d"].astype(">u8").tobytes()
    digests = [data[i : i + 32] for i in range(0, len(data), 32)]
    columns = [pa.array(digests, pa.binary()), pa.array(x["norm_len"]), pa.array(x["doc_id"], mask=x["null"] == 1), pa.array(x["mark"]), pa.array(x["n"])]
    return pa.RecordBatch.from_arrays(columns, ["digest", "norm_len", "keep_id", "keep_mark", "n"])


def _merging(give: Callable[[int, np.ndarray], pa.RecordBatch]) -> Callable[[Batches], Batches]:
    """Merges the records of each (run, slice), which come one after the other."""

    def run(batches: Batches) -> Batches:
        key, held = None, []
        for b in batches:
            for number, piece, records in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (number, piece) != key:
                    yield give(key[0], merge(held))
                    held = []
                key = number, piece
                held.append(np.frombuffer(records, RECORD))
        if held:
            yield give(key[0], merge(held))

    return run


def tree_merge(spark: SparkSession, rows: DataFrame, n_rows: int, fan: int = FAN) -> DataFrame:
    """(digest, norm_len, keep_id, keep_mark, n): the last run."""
    parts, left = size_partitions(spark), max(1, rows.rdd.getNumPartitions())

    def bits_for(runs: int) -> int:
        """So many that a merge into one of the runs holds RECORDS at most, and that every core has some."""
        return max(0, int(np.ceil(np.log2(max(1, n_rows / runs / RECORDS, 4 * parts / runs)))))

    left = -(-left // fan)
    bits = bits_for(left)
    runs = first_runs(rows, bits)
    while True:
        narrower = bits_for(-(-left // fan)) if left > 1 else bits

        runs = runs.select(F.floor(F.col("run") / fan).alias("run"), "slice", "records")
        runs = runs.repartition(parts, "run", "slice").sortWithinPartitions("run", "slice")
        if left == 1:
            return runs.mapInArrow(lean(_merging(_survivors)), "digest binary, norm_len long, keep_id long, keep_mark long, n long")
        runs = runs.mapInArrow(lean(_merging(partial(_slices, bits=narrower))), RUN_SCHEMA)
        left, bits = -(-left // fan), narrower


def decided(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row: doc_id, mark, digest, keep_id, keep_mark, group_size."""
    rows = materialize(spark, digest_rows(docs), "digests")
    n_rows = rows.count()
    # alone in its group: the row keeps itself, without a join
    winners = materialize(spark, tree_merge(spark, rows, n_rows).filter("n > 1").withColumnRenamed("n", "group_size"), "survivors")
    hot, key = max(2, n_rows // HOT + 1), ["digest", "norm_len"]
    named = lambda df, p: df.withColumnsRenamed({c: f"{p}_{c}" for c in ("keep_id", "keep_mark", "group_size")})
    near = rows.select("doc_id", "mark", *key).join(F.broadcast(named(winners.filter(F.col("group_size") >= hot), "hot")), key, "left")
    # rows of hot digests go round the shuffled join
    done = near.filter("hot_group_size is not null").select("doc_id", "mark", "digest", F.col("hot_keep_id").alias("keep_id"), F.col("hot_keep_mark").alias("keep_mark"), F.col("hot_group_size").alias("group_size"))
    open_ = near.filter("hot_group_size is null").join(named(winners.filter(F.col("group_size") < hot), "some"), key, "left")
    alone = F.col("some_group_size").isNull()
    open_ = open_.select("doc_id", "mark", "digest", F.when(alone, F.col("doc_id")).otherwise(F.col("some_keep_id")).alias("keep_id"), F.when(alone, F.col("mark")).otherwise(F.col("some_keep_mark")).alias("keep_mark"), F.coalesce("some_group_size", F.lit(1).cast("long")).alias("group_size"))
    return done.unionByName(open_)


def dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    return decided(spark, docs).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their columns: one of each group of equal texts."""
    copies = decided(spark, docs).filter("group_size > 1").groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("m"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("mark") == F.col("keep_mark"))).alias("stays")).count()
    copies = materialize(spark, copies, "copies")
    return without(docs, copies.filter("not stays").select("d", "m"), copies.filter("stays and count > 1").select("d", "m"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS n, sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS h
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""
