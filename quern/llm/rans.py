"""Token ids as static range asymmetric numeral systems: self-contained files of independent blocks (operator 2).

Writing takes three passes. (1) Documents are tokenised where they are read, so that two bytes a token travel from
there on and no text. (2) Token counts of all documents give one frequency table, shared by all blocks, of 2**SCALE
slots. (3) Documents are range-partitioned by doc_id and sorted; each task cuts its share into blocks of about BLOCK
tokens, whole documents each, and encodes each block on its own: token i of a block belongs to lane i mod LANES, every
lane is one coder with a 64-bit state, and the lanes' 32-bit words are interleaved in the order in which decoding asks
for them. Every EVERY steps a checkpoint records the lanes' states and the place in the words, with checksums of the
stretch that follows. Stretches are decoded side by side, or one alone (part), without a look at the others.

A folder of files holds two Parquet tables, so that it can lie in any store and is written through Spark's commits:
``table`` has one row (scale, freq: u32[...], crc, end_id), ``blocks`` has rows of BLOCK_SCHEMA and payload. With both,
open_files() decodes in any session. A payload is, all little-endian:

    magic "QRN2" | scale u32 | lanes u32 | every u32 | crc of the table u32 | n_tokens u64 | n_stretches u32
    | crc of what follows up to the words u32
    | (first word u64, words u64, crc of words u32, crc of ids as u32 u32) a stretch | states u64[lanes] a stretch | words u32[...]

Edge cases: null text counts as empty and has the end id alone. Rows with a null doc_id come first. Rows may repeat;
each has its own place, ties of doc_id in the order of their ids. Very long texts are tokenised whole and make a block
of their own. Other columns are ignored, whatever their names. An empty table gives no blocks.
"""

from __future__ import annotations

import contextlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import lean_memory, materialize, scratch_path, size_partitions
from quern.llm.words import binary, gather, parts

SCALE = 20
LOW = 1 << 31
LANES = 512
EVERY = 128
BLOCK = 1 << 19
END_ID = 1
#: Bytes of texts that are tokenised together.
SLICE = 12_000_000
#: Bytes of encoded words that a task keeps.
CACHE_BYTES = 64_000_000
#: Outside of these characters (ASCII white space, printable ASCII, Latin letters) a text is encoded as a whole.
_OTHER = re.compile("[^\t-\r\x20-\x7e\xa0-ɏ]")
_BLANKS = bytes(32 if 9 <= c <= 13 else c for c in range(256))
_HEAD = struct.Struct("<4sIIIIQII")
_STRETCH = np.dtype([("first", "<u8"), ("words", "<u8"), ("words_crc", "<u4"), ("ids_crc", "<u4")])
BLOCK_SCHEMA = "part int, block int, start long, n_tokens long, doc_ids array<long>, lens array<long>"


class WordEncoder:
    """The tokenizers library with a table of the words met so far.

    Its vocabulary drops white space before anything else and lower-cases, so words are independent: each new word
    is encoded once by the library, as is any text with characters beyond Latin letters or with the string of an added
    token (in any case), which the library gives that token's id. A mark that ends a word after a letter is a token of its own, so
    such a word is its base and the mark. Words are found, numbered and looked up on the bytes of many texts at once.
    """

    #: Marks that may end a word, and the bytes that are no (part of a) Latin letter. Of two bytes, D7 and F7 are none.
    MARKS = b".,!?;:"
    OTHER = np.array([c != 32 and not (97 <= c <= 122 or 0xC3 <= c <= 0xC9 or 0x80 <= c < 0xC0) for c in range(256)])

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        #: The library finds these in the text as it is, before it normalises.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.is_mark = np.zeros(256, bool)
        self.is_mark[list(self.MARKS)] = True
        self.cache_bytes = cache_bytes
        self.forget()

    def forget(self) -> None:
        """Back to the empty word and the marks."""
        ids = [np.zeros(0, "<u2"), *self._library([chr(c) for c in self.MARKS])]
        self.bases = pa.array([b" ", *(bytes([c, 32]) for c in self.MARKS)], pa.large_binary())
        self.store = np.concatenate(ids)
        self.size = np.array([len(x) for x in ids])
        self.first = np.cumsum(self.size) - self.size
        self.mark_code = np.zeros(256, np.int64)
        self.mark_code[list(self.MARKS)] = np.arange(1, len(ids))

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u2") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: pa.Array, plain: np.ndarray) -> None:
        """New words, each with its blank. Plain ones, of letters alone, are encoded many at a time: each ends with the
        one token that ends a word."""
        for some, alone in ((words.filter(pa.array(plain)), False), (words.filter(pa.array(~plain)), True)):
            if not len(some):
                continue
            offsets, data = parts(some)
            cuts = offsets if alone else np.append(offsets[:-1:200], offsets[-1])
            data = data.tobytes()
            ids = self._library([data[a : b - 1].decode() for a, b in zip(cuts, cuts[1:], strict=False)])
            flat = np.concatenate(ids)
            ends = np.cumsum([len(x) for x in ids]) if alone else np.flatnonzero(self.is_end[flat]) + 1
            if len(ends) != len(some):
                raise ValueError("the vocabulary does not end words as expected")
            size = np.diff(ends, prepend=0)
            self.first = np.append(self.first, len(self.store) + ends - size)
            self.size, self.store = np.append(self.size, size), np.append(self.store, flat)
            self.bases = pa.concat_arrays([self.bases, some])

    def _codes(self, bases: pa.Array, plain: np.ndarray) -> np.ndarray:
        codes = pc.index_in(bases, value_set=self.bases)
        if codes.null_count:
            new = codes.is_null()
            self._learn(bases.filter(new), plain[new.to_numpy(zero_copy_only=False)])
            codes = pc.index_in(bases, value_set=self.bases)
        return codes.to_numpy()

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words (distinct, each with its blank) one after the other, and where each ends."""
        offsets, data = parts(words)
        strange = self.OTHER[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        strange[lead[(data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7)]] = True
        n = np.diff(np.append(0, np.cumsum(strange))[offsets])
        last = data[np.maximum(offsets[1:] - 2, 0)]
        marked = (n == 1) & self.is_mark[last] & (np.diff(offsets) > 2)
        left = np.ones(len(data), bool)
        left[offsets[1:][marked] - 2] = False
        shorter = offsets - np.append(0, np.cumsum(marked))
        bases = binary(shorter, data[left].tobytes()).dictionary_encode()
        of = bases.indices.to_numpy()
        plain = np.zeros(len(bases.dictionary), bool)
        plain[of] = n - marked == 0
        codes = self._codes(bases.dictionary, plain)[of]
        # one or two codes a word
        ends = np.arange(1, len(codes) + 1) + np.cumsum(marked)
        both = np.empty(ends[-1] if len(ends) else 0, np.int64)
        both[ends - 1 - marked] = codes
        both[ends[marked] - 1] = self.mark_code[last[marked]]
        flat, cut = gather(self.store, self.first, self.size, both)
        return flat, cut[ends - 1]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 16-bit integers."""
        lower = [t.lower() for t in texts]
        whole = [i for i, t in enumerate(texts) if _OTHER.search(t) or any(a in lower[i] for a in self.added)]
        strange = set(whole)
        data = [b"" if i in strange else t.replace("\xa0", " ").encode().translate(_BLANKS) for i, t in enumerate(lower)]
        # a word ends with its blank; a text ends with one
        joined = b" ".join([*data, b""])
        bounds = np.append(0, np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) + 1)
        words = binary(bounds, joined).dictionary_encode()
        store, ends = self._distinct(words.dictionary)
        size = np.diff(ends, prepend=0)
        out, ends = gather(store, ends - size, size, words.indices.to_numpy())
        # the place of each text's last word
        last = np.searchsorted(bounds, np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) + 1)) - 1
        cuts = [0, *(ends[last] * 2).tolist()]
        flat = out.tobytes()
        result = [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for i, x in zip(whole, self._library([texts[i] for i in whole]), strict=True):
            result[i] = x.tobytes()
        if self.bases.nbytes + self.store.nbytes + 16 * len(self.size) > self.cache_bytes:
            self.forget()
        return result


_encoders: dict[str, WordEncoder] = {}


@contextlib.contextmanager
def _encoder(path: str) -> Iterator[WordEncoder]:
    """The encoder of this worker. The library's vocabulary stays; the words it learns go when the task ends."""
    with lean_memory():
        if path not in _encoders:
            _encoders.clear()
            _encoders[path] = WordEncoder(path)
        encoder = _encoders[path]
        try:
            yield encoder
        finally:
            encoder.forget()


class Table:
    """A frequency table over ids: freq sums to 2**SCALE and is at least 1 for every id that occurs."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self._symbols: np.ndarray | None = None

    @property
    def symbols(self) -> np.ndarray:
        if self._symbols is None:
            self._symbols = np.repeat(np.arange(len(self.freq), dtype=np.uint16), self.freq.astype(np.int64))
        return self._symbols

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> Table:
        total, slots = int(counts.sum()), 1 << SCALE
        if not total:
            return cls(np.zeros(len(counts), np.int64))
        freq = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) * (slots / total)).astype(np.int64)), 0)
        over = int(freq.sum()) - slots
        order = np.argsort(-freq, kind="stable")
        if over < 0:
            freq[order[0]] -= over
        while over > 0:  # take from the largest; none falls below 1
            take = np.minimum(freq[order] - 1, np.maximum(1, freq[order] * over // max(1, int(freq.sum()))))
            take = np.where(freq[order] > 1, take, 0)
            cut = np.minimum(np.cumsum(take), over)
            freq[order] -= np.diff(np.concatenate(([0], cut)))
            over = int(freq.sum()) - slots
        return cls(freq)


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = EVERY) -> bytes:
    n = len(ids)
    lanes = max(1, min(lanes, n))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    freq, start = table.freq[ids], table.start[ids]
    words: list[np.ndarray] = []
    states: list[bytes] = []
    top, low, scale = np.uint64(63 - SCALE), np.uint64(32), np.uint64(SCALE)
    for s in range(steps - 1, -1, -1):
        a, b = s * lanes, min(n, (s + 1) * lanes)
        f, y = freq[a:b], x[: b - a]
        full = np.flatnonzero(y >= f << top)
        some = y[full]
        words.append(some.astype("<u4"))
        y[full] = some >> low
        q = y // f
        x[: b - a] = (q << scale) + (y - q * f) + start[a:b]
        if s % every == 0:
            states.append(x.astype("<u8").tobytes())
    words.reverse()
    states.reverse()
    sizes = np.cumsum([0, *map(len, words)])
    flat = np.concatenate(words) if words else np.zeros(0, "<u4")
    stretches = np.zeros(len(states), _STRETCH)
    wide = ids.astype("<u4")
    for i in range(len(states)):
        first, last = sizes[i * every], sizes[min(steps, (i + 1) * every)]
        stretches[i] = first, last - first, zlib.crc32(flat[first:last]), zlib.crc32(wide[i * every * lanes : (i + 1) * every * lanes])
    plan = stretches.tobytes() + b"".join(states)
    return _HEAD.pack(b"QRN2", SCALE, lanes, every, table.crc, n, len(states), zlib.crc32(plan)) + plan + flat.tobytes()


def _run(x: np.ndarray, words: np.ndarray, at: np.ndarray, n: int, table: Table) -> np.ndarray:
    """n ids of each stretch (a row of states x), whose words begin at a place of their own."""
    rows, lanes = x.shape
    out = np.empty((rows, n), np.uint16)
    symbols, freq, start = table.symbols, table.freq, table.start
    mask, scale, low = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    for a in range(0, n, lanes):
        b = min(n, a + lanes)
        y = x[:, : b - a]
        slot = y & mask
        s = symbols[slot]
        out[:, a:b] = s
        y = freq[s] * (y >> scale) + slot - start[s]
        need = y < LOW
        k = need.sum(axis=1)
        row, col = np.nonzero(need)  # in order of rows
        rank = np.arange(len(row)) - (np.cumsum(k) - k)[row]
        y[row, col] = (y[row, col] << low) | words[at[row] + rank]
        at = at + k
        x[:, : b - a] = y
    return out


def decode_block(data: bytes, table: Table, part: int | None = None) -> np.ndarray:
    """Ids of a block, all stretches side by side, or of its part-th stretch alone, whose own bytes only are looked at.

    Raises ValueError where a checksum fails.
    """
    magic, scale, lanes, every, table_crc, n, count, plan_crc = _HEAD.unpack_from(data)
    words_at = _HEAD.size + count * (_STRETCH.itemsize + 8 * lanes)
    plan = memoryview(data)[_HEAD.size : words_at]
    if magic != b"QRN2" or zlib.crc32(plan) != plan_crc:
        raise ValueError("damaged block")
    if scale != SCALE or table_crc != table.crc:
        raise ValueError("the block needs another frequency table")
    stretches = np.frombuffer(plan, _STRETCH, count)
    states = np.frombuffer(plan, "<u8", count * lanes, count * _STRETCH.itemsize).reshape(count, lanes)
    words, size = np.frombuffer(data, "<u4", offset=words_at), every * lanes
    some = np.arange(count) if part is None else np.array([part])
    for t in stretches[some]:
        if zlib.crc32(words[int(t["first"]) : int(t["first"] + t["words"])]) != t["words_crc"]:
            raise ValueError("damaged words")
    at = stretches["first"].astype(np.int64)
    full = some[(some + 1) * size <= n]
    ids = [_run(states[full].copy(), words, at[full], size, table).ravel()] if len(full) else []
    if len(some) and (some[-1] + 1) * size > n:  # the last stretch is shorter
        ids.append(_run(states[some[-1:]].copy(), words, at[some[-1:]], int(n - some[-1] * size), table).ravel())
    out = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
    wide = out.astype("<u4")
    for i, t in enumerate(stretches[some]):
        if zlib.crc32(wide[i * size : (i + 1) * size]) != t["ids_crc"]:
            raise ValueError("decoded ids don't have the recorded checksum")
    return out


def token_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int = END_ID) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Keys, and ids with the end id as little-endian unsigned 16-bit integers, of batches of (key, text)."""
    end = np.array([end_id], "<u2").tobytes()
    with _encoder(path) as encoder:
        for batch in batches:
            step = max(1, int(batch.num_rows * SLICE / max(1, batch.nbytes)))
            for i in range(0, batch.num_rows, step):
                some = batch.slice(i, step)
                yield some.column(0), [x + end for x in encoder.encode(["" if t is None else t for t in some.column(1).to_pylist()])]


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids) of each row: big-endian unsigned 16-bit ids with the end id, so that their order is that of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids in token_batches(batches, path, end_id):
            ends = np.cumsum([0, *map(len, ids)])
            data = np.frombuffer(b"".join(ids), "<u2").astype(">u2").tobytes()
            yield pa.RecordBatch.from_arrays([keys, pa.array([data[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())], ["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def frequency_table(tokens: DataFrame, n_ids: int = 49408) -> Table:
    """From the counts of all tokens of all documents; no more rows than ids reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), ">u2"), minlength=n_ids)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["id", "n"])

    counts = np.zeros(n_ids, np.int64)
    for r in tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    return Table.from_counts(counts)


def encode_blocks(spark: SparkSession, tokens: DataFrame, table: Table, block: int = BLOCK) -> DataFrame:
    """BLOCK_SCHEMA and payload binary: whole documents in ascending doc_id order within a part, parts in order."""
    freq = table.freq.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, own = TaskContext.get().partitionId(), Table(freq)
        keys: list[int | None] = []
        ids: list[bytes] = []
        size = number = start = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, ids, size, number, start
            lens = [len(x) // 2 for x in ids]
            data = encode_block(np.frombuffer(b"".join(ids), ">u2").astype(np.uint16), own)
            row = [[part], [number], [start], [size], [keys], [lens], [data]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["part", "block", "start", "n_tokens", "doc_ids", "lens", "payload"])
            number, start = number + 1, start + size
            keys, ids, size = [], [], 0
            return out

        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(k)
                ids.append(x)
                size += len(x) // 2
                if size >= block:
                    yield flush()
        if keys:
            yield flush()

    ordered = tokens.select("doc_id", "ids").repartitionByRange(size_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    return ordered.mapInArrow(run, f"{BLOCK_SCHEMA}, payload binary")


def decode_documents(files: DataFrame, table: Table, checksum: bool = False) -> DataFrame:
    """(part, doc_id, start within the part, n_tokens, ids binary u32) of each document, or with checksum ids_crc32."""
    last, kind = ("ids_crc32", "long") if checksum else ("ids", "binary")
    freq = table.freq.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Table(freq)
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_block(row["payload"], own).astype("<u4")
                lens = np.array(row["lens"], np.int64)
                ends = np.cumsum(lens)
                out = [(zlib.crc32 if checksum else bytes)(ids[a:b].tobytes()) for a, b in zip(ends - lens, ends, strict=True)]
                n = len(lens)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - lens), pa.array(lens), pa.array(out, pa.int64() if checksum else pa.binary())], ["part", "doc_id", "start", "n_tokens", last])

    return files.select("part", "start", "doc_ids", "lens", "payload").mapInArrow(run, f"part int, doc_id long, start long, n_tokens long, {last} {kind}")


def write_files(spark: SparkSession, docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Writes the tables ``table`` and ``blocks`` into folder. path: the tokenizer's vocabulary."""
    tokens = materialize(spark, tokenised(docs, path or public_tokenizers.path("word_bpe_49k.json"), end_id), "tokens")
    table = frequency_table(tokens)
    row = (SCALE, bytearray(table.freq.astype("<u4").tobytes()), table.crc, end_id)
    spark.createDataFrame([row], "scale int, freq binary, crc long, end_id int").coalesce(1).write.parquet(f"{folder}/table")
    encode_blocks(spark, tokens, table).write.option("compression", "none").parquet(f"{folder}/blocks")


def open_files(spark: SparkSession, folder: str) -> tuple[DataFrame, Table, dict[int, int]]:
    """The blocks, their frequency table and each part's first place, from what lies in folder alone."""
    row = spark.read.schema("scale int, freq binary, crc long, end_id int").parquet(f"{folder}/table").first()
    table = Table(np.frombuffer(row.freq, "<u4").astype(np.int64))
    if row.scale != SCALE or row.crc != table.crc:
        raise ValueError("damaged frequency table")
    files = spark.read.schema(f"{BLOCK_SCHEMA}, payload binary").parquet(f"{folder}/blocks")
    bases, place = {}, 0
    for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # one row a partition
        bases[r.part], place = place, place + r.n
    return files, table, bases


def write(spark: SparkSession, docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> tuple[DataFrame, Table, dict[int, int]]:
    """Writes the files to the shared folder and opens them."""
    folder = scratch_path(spark, "rans")
    write_files(spark, docs, folder, path, end_id)
    return open_files(spark, folder)


def digests(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from the files."""
    files, table, bases = write(spark, docs, path)
    parts = spark.createDataFrame(list(bases.items()), "part int, base long")
    out = decode_documents(files, table, checksum=True)
    return out.join(F.broadcast(parts), "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
