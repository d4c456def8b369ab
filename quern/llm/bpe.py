"""Byte-level BPE encoding and decoding by corpus-level merge replay (operator 10).

Words are those of the pre-tokenisation pattern. The distinct words that a task has not met yet form one corpus: their
bytes lie in one array, linked to their neighbours, and an inverted index from the rank of a token pair to its
positions applies every merge in rank order over all words at once; a merge looks only at the two neighbours it
touched. Texts are cut into units, where a single blank stands between two characters that are no white space: no
match of the pattern goes on there. Distinct units are found and looked up on the bytes of many texts at once, and the
ids of those known are kept for the task's later texts (bounded). Units are independent, so this equals encoding each
match on its own.

Edge cases: null text counts as empty; an empty text has no ids. A very long text goes through as a whole; a text of a
single very long word is encoded by the same heap of ranks, in n log n. Rows may repeat; each row gets its own result,
ties of any kind too. Other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from quern.llm.common import lean_memory
from quern.llm.words import binary, distinct, gather

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Bytes of encoded units that a task keeps, and of words (with what an entry takes besides its characters).
CACHE_BYTES = 16_000_000
ENTRY = 200
#: Bytes of text that go through together.
SLICE = 1_000_000
#: White space beyond ASCII, and the separators of ASCII: texts with it go through the pattern as a whole.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, cache_bytes: int = CACHE_BYTES):
        self.ranks, self.pattern, self.cache_bytes = ranks, regex.compile(pattern), cache_bytes
        top = max(ranks.values(), default=0)
        self.width = "<u2" if top < 1 << 16 else "<u4"
        #: Ends each word in the corpus; it is in no pair.
        self.stop = top + 1
        tokens = [b""] * (top + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_size = np.fromiter(map(len, tokens), np.int64, top + 1)
        self.token_first = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs, early = [], np.zeros(top + 2, bool)
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs.append((left * (top + 2) + right, rank))
                    early[left] |= rank < left
                    early[right] |= rank < right
        pairs.sort()
        self.pair_keys, self.pair_ranks = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(1, np.int64) - 1, np.zeros(1, np.int64))
        #: Tokens that may at once take part in a merge of lower rank than their own.
        self.early = early
        self.forget()

    def forget(self) -> None:
        self._forget_words()
        self.units = pa.array([], pa.large_binary())
        self.store = np.zeros(0, self.width)
        self.first = self.size = np.zeros(0, np.int64)

    def _forget_words(self) -> None:
        self.words: dict[str, bytes] = {}
        self.words_size = 0

    @classmethod
    def from_file(cls, path: str, **options) -> MergeReplay:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}, **options)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, -1 where no merge joins them."""
        key = left * (self.stop + 1) + right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as bytes of self.width; all words go through the merges together, rank by rank."""
        if not words:
            return []
        text = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        symbols = self.byte_ids[text]
        symbols[stops] = self.stop
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        pair = np.full(n, -1, np.int64)  # rank of the pair that begins here
        pair[:-1] = self._rank(symbols[:-1], symbols[1:])
        index: dict[int, list[np.ndarray]] = {}  # rank of a pair: where such pairs begin
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            ranks = pair[at]
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, some in zip(ranks[np.append(0, cuts)].tolist(), np.split(at, cuts), strict=True):
                if r in index:
                    index[r].append(some)
                else:
                    index[r] = [some]
                    heapq.heappush(heap, r)

        add(np.arange(n))
        while heap:
            rank = heapq.heappop(heap)
            found = index.pop(rank)
            at = distinct(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
            at = at[pair[at] == rank]
            if len(at) > 1 and (after[at[:-1]] == at[1:]).any():  # of overlapping pairs the leftmost goes first
                keep, last = [], -1
                for i, j in zip(at.tolist(), after[at].tolist(), strict=True):
                    if i != last:
                        keep.append(i)
                        last = j
                at = np.array(keep, np.int64)
            if self.early[rank] and len(at) > 1:  # its product may merge before its next occurrence in the word
                first = np.append(True, np.diff(np.searchsorted(stops, at)) > 0)
                if not first.all():
                    index[rank] = [at[~first]]
                    heapq.heappush(heap, rank)
                    at = at[first]
            if not len(at):
                continue
            right = after[at]
            beyond = after[right]
            symbols[at], symbols[right], pair[right] = rank, -1, -1
            after[at], before[beyond] = beyond, at
            pair[at] = self._rank(symbols[at], symbols[beyond])
            left = before[at]
            left = left[left >= 0]
            pair[left] = self._rank(symbols[left], symbols[after[left]])
            add(np.concatenate((at, left)))
        live = (symbols >= 0) & (symbols != self.stop)
        ids = symbols[live].astype(self.width).tobytes()
        ends = (np.cumsum(live)[stops] * int(self.width[-1])).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _learn(self, words: Iterable[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.words]
        whole, rest = {}, []
        for w in new:
            b = w.encode("utf-8", "surrogatepass")
            if (r := self.ranks.get(b)) is None:
                rest.append((w, b))
            else:
                whole[w] = r
        self.words_size += sum(map(len, new)) * 3 + len(new) * ENTRY
        self.words.update({w: np.array(r, self.width).tobytes() for w, r in whole.items()})
        self.words.update(zip((w for w, _ in rest), self.replay([b for _, b in rest]), strict=True))

    def _units(self, units: list[str]) -> list[bytes]:
        """Ids of each unit."""
        find = self.pattern.findall
        # a unit whose one blank is its first character: many at a time, each beginning a new group of words
        simple = [u for u in units if u[:1] == " " and " " not in u[1:] and not u[-1].isspace()]
        split: dict[str, list[str]] = {}
        at = iter(simple)
        for w in find("".join(simple)):
            if w[0] == " ":
                own = split[next(at)] = []
            own.append(w)
        split.update((u, find(u)) for u in units if u not in split)
        self._learn(w for ws in split.values() for w in ws)
        word = self.words.__getitem__
        out = [b"".join(map(word, split[u])) for u in units]
        if self.words_size > self.cache_bytes:
            self._forget_words()
        return out

    def _codes(self, units: pa.Array) -> np.ndarray:
        codes = pc.index_in(units, value_set=self.units)
        if codes.null_count:
            new = units.filter(codes.is_null())
            ids = self._units([u.decode("utf-8", "surrogatepass") for u in new.to_pylist()])
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // int(self.width[-1])
            self.first = np.append(self.first, len(self.store) + np.cumsum(size) - size)
            self.size, self.store = np.append(self.size, size), np.append(self.store, np.frombuffer(b"".join(ids), self.width))
            self.units = pa.concat_arrays([self.units, new])
            codes = pc.index_in(units, value_set=self.units)
        return codes.to_numpy()

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, of self.width, and where each text ends."""
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        flat = np.frombuffer(b"".join(data), np.uint8)
        blank = _BLANK[flat]
        cuts = np.flatnonzero((flat[1:-1] == 32) & ~blank[:-2] & ~blank[2:]) + 1
        odd = [i for i, t in enumerate(texts) if _ODD.search(t)]
        if odd:  # no cuts within
            cuts = cuts[~np.isin(np.searchsorted(ends, cuts, side="right"), odd)]
        bounds = distinct(np.concatenate(([0], cuts, ends)))
        units = binary(bounds, flat.tobytes()).dictionary_encode()
        codes = self._codes(units.dictionary)[units.indices.to_numpy()]
        ids, cut = gather(self.store, self.first, self.size, codes)
        out = ids, np.append(0, cut)[np.searchsorted(bounds, ends)]
        if self.units.nbytes + self.store.nbytes + 16 * len(self.size) > self.cache_bytes:
            self.forget()
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, of self.width."""
        ids, ends = self.encode_flat(texts)
        return [ids[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and where those of each id end."""
        return gather(self.token_bytes, self.token_first, self.token_size, ids.astype(np.int64))

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decode_flat(np.asarray(ids))[0].tobytes()


_coders: dict[str, MergeReplay] = {}


@contextlib.contextmanager
def _coder(path: str) -> Iterator[MergeReplay]:
    """The coder of this worker. Its tables (one row a rank) stay; the words it learns go when the task ends."""
    with lean_memory():
        if path not in _coders:
            _coders.clear()
            _coders[path] = MergeReplay.from_file(path)
        coder = _coders[path]
        try:
            yield coder
        finally:
            coder.forget()


def _slices(batch: pa.RecordBatch, column: str, chars: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch of about so many bytes of text, nulls as empty texts."""
    col = batch.column(column)
    start, n = 0, batch.num_rows
    step = max(1, int(n * chars / max(1, col.nbytes)))
    while start < n:
        part = batch.slice(start, step)
        yield part, ["" if t is None else t for t in part.column(column).to_pylist()]
        start += step


def encode(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids binary little-endian unsigned 32-bit) of each row."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(batches):
        with _coder(path) as coder:
            for batch in batches:
                for part, texts in _slices(batch, text, SLICE):
                    ids = [np.frombuffer(x, coder.width).astype("<u4").tobytes() for x in coder.encode_batch(texts)]
                    yield pa.RecordBatch.from_arrays([part.column(key), pa.array(ids, pa.binary())], [key, "ids"])

    schema = docs.select(key).schema.add("ids", "binary")
    return docs.select(key, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, text binary: UTF-8) of each row that encode() gave."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(batches):
        with _coder(path) as coder:
            for batch in batches:
                out = [coder.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, pa.binary())], [key, "text"])

    return encoded.select(key, ids).mapInArrow(run, encoded.select(key).schema.add("text", "binary"))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: n_tokens, and sha256 of the ids and of the bytes decoded from them."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(batches):
        with _coder(path) as coder:
            for batch in batches:
                for part, texts in _slices(batch, "text", SLICE):
                    ids, ends = coder.encode_flat(texts)
                    back, token_ends = coder.decode_flat(ids)
                    wide, byte_ends = memoryview(ids.astype("<u4")).cast("B"), np.append(0, token_ends)[ends].tolist()
                    back, id_ends = memoryview(back), (ends * 4).tolist()
                    columns = [part.column("doc_id"), pa.array(np.diff(ends, prepend=0))]
                    columns += [pa.array([hashlib.sha256(data[i:j]).hexdigest() for i, j in zip([0, *cuts], cuts, strict=False)], pa.string()) for data, cuts in ((wide, id_ends), (back, byte_ends))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, SCHEMA)
