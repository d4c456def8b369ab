"""Best-fit packing of documents into training sequences (operator 13).

Documents are tokenised where they are read and cut into pieces of at most SIZE tokens; only narrow rows of pieces
travel. Pieces are dealt into groups of about GROUP rows, whatever the number of documents, and each group is packed by
best-fit decreasing: pieces in descending order of length, each into the open sequence with the least room that still
holds it. A segment tree over remaining capacities, whose leaves count the open sequences of each capacity, finds that
sequence in a logarithmic number of steps.

A group leaves a few sequences that are poorly filled: the last ones it opened, for want of short pieces. So the TAIL
emptiest sequences of each group are opened again and their pieces dealt into new groups of the same size, round after
round, until one group is left; every round has a small share of the rows of the one before. What all groups lose
together is then about what one group loses. No task or group sees more rows for more documents.

Edge cases: null text counts as empty; such a document is one piece, the end id. A null doc_id and rows that repeat are
documents like any other: each row has pieces of its own, told apart by their places. Ties of length are packed in the
order of doc_id and piece. A very long text becomes many full pieces, each a sequence by itself, and a rest. Other
columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from quern.llm.common import materialize
from quern.llm.rans import END_ID, token_batches

SIZE = 4096
#: Pieces that a group has, about.
GROUP = 4096
#: Emptiest sequences of a group that the next round packs again.
TAIL = 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: A sequence's id: its round, group and number within the group.
_GROUP_BITS, _NUMBER_BITS = 36, 20


class BestFit:
    """Open sequences by remaining capacity: a segment tree over capacities counts them."""

    def __init__(self, size: int):
        self.size = size
        self.leaves = 1 << max(1, (size - 1).bit_length())
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}
        #: Remaining capacity of each sequence.
        self.left: list[int] = []

    def _tightest(self, length: int) -> int | None:
        """The smallest capacity of an open sequence that is length at least."""
        count, at = self.count, self.leaves + length
        if length >= self.size:
            return None
        while not count[at]:  # up, until there is something to the right
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at *= 2
            if not count[at]:
                at += 1
        return at - self.leaves

    def _add(self, capacity: int, n: int) -> None:
        at = self.leaves + capacity
        while at:
            self.count[at] += n
            at >>= 1

    def place(self, length: int) -> tuple[int, int]:
        """The sequence for a piece, and its offset there."""
        if not 0 < length <= self.size:
            raise ValueError(f"a piece has 1 to {self.size} tokens, not {length}")
        room = self._tightest(length)
        if room is None:
            room, number = self.size, len(self.left)
            self.left.append(room)
        else:
            number = self.open[room].pop()
            self._add(room, -1)
        self.left[number] = room - length
        if room > length:
            self.open.setdefault(room - length, []).append(number)
            self._add(room - length, 1)
        return number, self.size - room


def best_fit(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, packed in descending order of length (ties: as they come), and the tokens in
    each sequence."""
    packer = BestFit(size)
    out = np.zeros((len(lengths), 2), np.int64)
    order = np.argsort(-lengths, kind="stable")
    out[order] = [packer.place(x) for x in lengths[order].tolist()] if len(order) else out
    return out[:, 0], out[:, 1], size - np.array(packer.left, np.int64)


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """PIECES of each row, and with ids their tokens (binary, little-endian unsigned 32-bit)."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    names = [f.split()[0] for f in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, tokens in token_batches(batches, path, end_id):
            rows, kept = [], []
            for key, x in zip(keys.to_pylist(), tokens, strict=True):
                wide = np.frombuffer(x, "<u2").astype("<u4").tobytes()
                for start in range(0, len(wide) // 4, size):
                    own = wide[4 * start : 4 * (start + size)]
                    rows.append((key, start // size, start, len(own) // 4, zlib.crc32(own)))
                    kept += [own] if ids else []
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.binary())] if ids else [])], [*names, *(["ids"] if ids else [])])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return own.mapInArrow(run, PIECES + (", ids binary" if ids else ""))


def _round(rows: DataFrame, number: int, groups: int, size: int, tail: int) -> DataFrame:
    """rows with sequence_id, offset and whether the sequence is opened again; packed group by group."""
    schema = StructType([*rows.schema, StructField("sequence_id", LongType()), StructField("offset", LongType()), StructField("again", BooleanType())])

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.drop_columns(["grp"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sequence, offset, filled = best_fit(table["length"].to_numpy(), size)
        again = np.zeros(len(filled), bool)
        if groups > 1:
            again[np.argsort(filled, kind="stable")[:tail]] = True
            again &= filled < size
        base = (number << _GROUP_BITS | key[0].as_py()) << _NUMBER_BITS
        for name, values in (("sequence_id", base + sequence), ("offset", offset), ("again", again[sequence])):
            table = table.append_column(name, pa.array(values))
        return table

    dealt = rows.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(pack, schema)


def pack(spark: SparkSession, rows: DataFrame, size: int = SIZE, group: int = GROUP, tail: int = TAIL) -> DataFrame:
    """rows (doc_id, piece, length and any others) with sequence_id and offset."""
    done, number = None, 0
    while True:
        # written before it is dealt out, so that a row that is read again gets the same group
        rows = materialize(spark, rows, f"pieces-{number}")
        groups = -(-rows.count() // group) or 1
        packed = _round(rows, number, groups, size, tail)
        if groups > 1:
            packed = materialize(spark, packed, f"packed-{number}")
        ready = packed.filter("not again").drop("again")
        done = ready if done is None else done.unionByName(ready)
        if groups == 1:
            return done
        rows, number = packed.filter("again").drop("again", "sequence_id", "offset"), number + 1


def packed(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Each piece of each document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(spark, pieces(docs, path))


def sequences(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """(sequence_id, n_tokens, ids binary u32): the sequences themselves. A sequence has SIZE pieces at most."""
    rows = pack(spark, pieces(docs, path, ids=True))
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
