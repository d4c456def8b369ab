"""Nearest neighbours for query sets of any size: exact, block against slice, and by inverted lists over centroids.

Both deal queries into blocks of about QUERIES and vectors into slices of about ROWS; a block and a slice meet in one
task, which multiplies them and returns the best k of each query. No query reaches the driver, the number of jobs and
of plan nodes doesn't depend on the sizes, and a group is bounded however many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

#: Vectors of a slice and queries of a block, about.
ROWS, QUERIES = 50_000, 10_000
#: Numbers of one product of a block and a slice.
CELLS = 2_000_000
#: Vectors that a scan takes at once, and rows of a batch of its results.
BATCH = 10_000
#: Rows that centroids are fitted on at most, and the rows of these that a list has on average at least.
SAMPLE, PER_LIST = 20_000, 40
FOUND = "qid long, chunk_id long, score double"


def matrix(column: pa.ChunkedArray | pa.Array, dimension: int | None = None) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else pc.list_flatten(column).to_numpy()
    return flat.astype(float, copy=False).reshape(len(column), dimension or -1) if len(column) else np.zeros((0, dimension or 1))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zeros stay."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def best(qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, exclude_self: bool) -> pa.Table:
    """FOUND: the best k of the vectors for each query, by cosine rounded to six digits, ties by id. So many queries at
    once that a product has CELLS numbers, or one."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    own, other = np.linalg.norm(queries, axis=1), np.linalg.norm(vectors, axis=1)
    k, step = min(k + exclude_self, len(ids)), max(1, CELLS // max(1, len(ids)))
    for i in range(0, len(qids) if k else 0, step):
        s, scale = queries[i : i + step] @ vectors.T, np.outer(own[i : i + step], other)
        np.round(np.divide(s, scale, out=s, where=scale > 0), 6, out=s)  # a product with a vector of length 0 is 0
        least = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
        for q, row, low in zip(qids[i : i + step], s, least, strict=True):
            some = np.flatnonzero(row >= low)
            some = some[np.lexsort((ids[some], -row[some]))]
            some = some[ids[some] != q][:k] if exclude_self else some[:k]
            out.append((np.full(len(some), q), ids[some], row[some]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["qid", "chunk_id", "score"])


def fewest(found: pa.Table, k: int) -> pa.Table:
    """The best k rows of each query of FOUND."""
    q, c, s = (found[n].to_numpy() for n in ("qid", "chunk_id", "score"))
    order = np.lexsort((c, -s, q))
    new = np.flatnonzero(np.append(True, np.diff(q[order]) != 0)) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(new, np.diff(np.append(new, len(q))))
    return found.take(pa.array(order[place < k]))


def scan(chunks: DataFrame, qids: np.ndarray, queries: np.ndarray, k: int, exclude_self: bool = True) -> DataFrame:
    """FOUND: of each task the best k of its vectors for the queries, which are broadcast. A task holds one product of
    CELLS numbers and at most twice its results, whatever the number of queries and vectors."""
    shared = chunks.sparkSession.sparkContext.broadcast((qids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, queries = shared.value
        held: list[pa.Table] = []
        for b in batches:
            for at in range(0, b.num_rows if len(qids) else 0, BATCH):
                part = b.slice(at, BATCH)
                held.append(best(qids, queries, part.column(0).to_numpy(), matrix(part.column(1), queries.shape[1]), k, exclude_self))
                if sum(t.num_rows for t in held) > 2 * k * len(qids):
                    held = [fewest(pa.concat_tables(held), k)]
        if held:
            yield from fewest(pa.concat_tables(held), k).combine_chunks().to_batches(BATCH)

    return clean(chunks, "chunk_id", "embedding").mapInArrow(run, FOUND)


def _meeting(k: int, exclude_self: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, chunks: pa.Table) -> pa.Table:
        own, other = matrix(queries["query_vector"]), matrix(chunks["embedding"])
        if not len(own) or not len(other):
            own = other = np.zeros((0, 1))
        return best(queries["qid"].to_numpy()[: len(own)], own, chunks["chunk_id"].to_numpy()[: len(other)], other, k, exclude_self)

    return run


def top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def clean(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows with a key and a vector without nulls."""
    return df.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector)).filter(F.col(key).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull()))


def _all(n: int):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, n) - 1).cast("long")))


def exact(chunks: DataFrame, queries: DataFrame, k: int, exclude_self: bool = True, rows: int = ROWS, block: int = QUERIES) -> DataFrame:
    """(qid, chunk_id, score, rank): the exact best k of chunks (chunk_id, embedding) for queries (qid, query_vector).

    Every block meets every slice, so vectors are shuffled once a block of queries; the work is queries by vectors.
    Rows without a key or vector are left out; all vectors have one length. Equal scores rank by chunk_id.
    """
    chunks, queries = clean(chunks, "chunk_id", "embedding"), clean(queries, "qid", "query_vector")
    slices, blocks = -(-chunks.count() // rows), -(-queries.count() // block)
    left = queries.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(max(1, blocks)))).withColumn("slice", _all(slices))
    right = chunks.withColumn("slice", F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, slices)))).withColumn("block", _all(blocks))
    return top(left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInArrow(_meeting(k, exclude_self), FOUND), k)


@dataclass
class Lists:
    """Centroids of inverted lists, and how many lists a query looks at."""

    centroids: np.ndarray
    probes: int

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each row, nearest first."""
        s = unit(x) @ self.centroids.T
        return np.argsort(-s, axis=1, kind="stable")[:, :n]


def fit(chunks: DataFrame, k: int = 10, recall: float = 0.95, sample: int = SAMPLE, rounds: int = 12) -> Lists:
    """Lists from the sample rows whose hashed ids are smallest: spherical k-means, as many lists as the square root of the
    sample, and the least number of probes that finds that share of the sample's own best k. As a last resort that is
    all lists, which is exact."""
    rows = clean(chunks, "chunk_id", "embedding").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample)
    x = unit(matrix(rows.toArrow()["embedding"]))
    if not len(x):
        return Lists(np.zeros((1, 1)), 1)
    n = max(1, min(int(len(x) ** 0.5), len(x) // PER_LIST))
    centroids = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(rounds):
        of = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, x)
        centroids = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, unit(sums), centroids)
    of = np.argmax(x @ centroids.T, axis=1)
    asked = x[:: max(1, len(x) // 500)]
    s = asked @ x.T
    most = min(len(x), k + 1)
    neighbours = np.argpartition(-s, most - 1, axis=1)[:, :most]
    order = np.argsort(-(asked @ centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    needed = np.sort(np.take_along_axis(place, of[neighbours], axis=1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1
    return Lists(centroids, probes)


def _listed(df: DataFrame, key: str, vector: str, lists: Lists, n: int) -> DataFrame:
    """(key, vector, list): a row for each of a vector's n nearest lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = lists.nearest(matrix(b.column(1), lists.centroids.shape[1]), n)
                yield b.append_column("lists", pa.array(near.tolist(), pa.list_(pa.int64())))

    rows = clean(df, key, vector)
    schema = StructType([*rows.schema, StructField("lists", ArrayType(LongType()))])
    return rows.mapInArrow(run, schema).select(key, vector, F.explode("lists").alias("list"))


def index(chunks: DataFrame, lists: Lists) -> DataFrame:
    """(chunk_id, embedding, list): every row in its list. Write it partitioned or bucketed by list to search it often."""
    return _listed(chunks, "chunk_id", "embedding", lists, 1)


def search(indexed: DataFrame, queries: DataFrame, lists: Lists, k: int, exclude_self: bool = True, rows: int = ROWS, block: int = QUERIES) -> DataFrame:
    """(qid, chunk_id, score, rank): the best k in the lists that each query probes.

    Long lists are cut into slices and the queries of a list into blocks, from counts by list (a row a list).
    """
    asked = _listed(queries, "qid", "query_vector", lists, min(lists.probes, len(lists.centroids)))
    sizes = indexed.groupBy("list").agg(F.ceil(F.count("*") / rows).alias("slices"))
    wants = asked.groupBy("list").agg(F.ceil(F.count("*") / block).alias("blocks"))
    plan = F.broadcast(sizes.join(wants, "list"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = asked.join(plan, "list").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks"))).withColumn("slice", every("slices"))
    right = indexed.join(plan, "list").withColumn("slice", F.pmod(F.xxhash64("chunk_id"), F.col("slices"))).withColumn("block", every("blocks"))
    keys = ["list", "block", "slice"]
    left, right = left.select(*keys, "qid", "query_vector"), right.select(*keys, "chunk_id", "embedding")
    return top(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meeting(k, exclude_self), FOUND), k)
