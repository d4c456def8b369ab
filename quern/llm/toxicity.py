"""Toxicity scores by non-negative positive-unlabelled learning (operator 3).

Confirmed toxic documents are the positives; documents without any label lookup are the unlabelled ones. With the
class prior p, the risk of a classifier g is p R+(g, P) + max(0, R-(g, U) - p R-(g, P)), where R+ and R- are mean
logistic losses of the positive and negative answer; where the second term falls below zero its gradient is
reversed, so that the model doesn't explain the unlabelled rows away. Features are the words of a text and their
beginnings (4 to 6 letters), by their share of all words; kept are those that set positives and unlabelled apart.

The prior is the share of toxic labels. Training takes at most MAX_POSITIVE toxic documents and MAX_UNLABELLED
others, chosen by a hash of doc_id; everything else runs over all rows. Only the text is an input of a score.

Edge cases: null text counts as empty; an empty text gets the score of no evidence. Labels that repeat a doc_id
count as their maximum; null labels are left out. Without positives all scores are 0. Rows may repeat; each gets
its own score. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fold, lean_memory

MAX_POSITIVE = 3000
MAX_UNLABELLED = 8000
#: Features that the model keeps, at most.
MAX_FEATURES = 3000
#: Bytes of parts of texts that a task remembers, and what a part takes besides its characters.
CACHE_BYTES = 60_000_000
ENTRY = 150
_WORD = re.compile(r"[^\W\d_]+")
#: Of a feature's share of a text's words, in hundredths, so much counts.
MOST = 4.0


def word_features(word: str) -> list[int]:
    out = [xxhash.xxh32_intdigest(f"w {word}")]
    out += [xxhash.xxh32_intdigest(f"p {word[:k]}") for k in (4, 5, 6) if len(word) > k]
    return out


def _chunks(text: str) -> tuple[Counter[str], int]:
    """Lower-cased parts between white space with their counts, and how many there are."""
    parts = text.lower().split()
    return Counter(parts), len(parts)


def values(counts: np.ndarray, n_words: int) -> np.ndarray:
    return np.minimum(MOST, 100 * counts / max(n_words, 10))


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all features, each once, and their values."""
    parts, n = _chunks(text)
    got: Counter[int] = Counter()
    for part, k in parts.items():
        for w in _WORD.findall(part):
            for f in word_features(w):
                got[f] += k
    return np.fromiter(got.keys(), np.int64, len(got)), values(np.fromiter(got.values(), float, len(got)), n)


class Model:
    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias
        self._known = dict(zip(features.tolist(), range(len(features)), strict=True))
        self._hits: dict[str, tuple[int, ...]] = {}
        self._seen: set[str] = set()
        self._size = 0

    def forget(self) -> None:
        self._seen.clear()
        self._hits.clear()
        self._size = 0

    def score(self, text: str) -> float:
        if not len(self.features):
            return 0.0
        parts, n = _chunks(text)
        if self._size > CACHE_BYTES:
            self.forget()
        for part in (new := parts.keys() - self._seen):
            if at := tuple(k for w in _WORD.findall(part) for f in word_features(w) if (k := self._known.get(f)) is not None):
                self._hits[part] = at
        self._seen |= new
        self._size += sum(map(len, new)) + len(new) * ENTRY
        got: Counter[int] = Counter()
        for part in parts.keys() & self._hits.keys():
            for k in self._hits[part]:
                got[k] += parts[part]
        z = self.bias
        if got:
            z += float(self.weights[list(got)] @ values(np.fromiter(got.values(), float, len(got)), n))
        return float(1 / (1 + np.exp(-min(40, max(-40, z)))))


def candidates(positive: list[tuple[np.ndarray, np.ndarray]], least: int = 3) -> np.ndarray:
    """Sorted features of so many positives at least: any other can't be evidence."""
    names, n = np.unique(np.concatenate([x for x, _ in positive]) if positive else np.zeros(0, np.int64), return_counts=True)
    return names[n >= least]


def among(row: tuple[np.ndarray, np.ndarray], names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in names of a document's features that are there, and their values."""
    x, v = row
    if not len(names):
        return np.zeros(0, np.int64), np.zeros(0)
    at = np.minimum(np.searchsorted(names, x), len(names) - 1)
    there = names[at] == x
    return at[there].astype(np.int32), v[there].astype(np.float32)


def fit(names: np.ndarray, positive: list[tuple[np.ndarray, np.ndarray]], unlabelled: list[tuple[np.ndarray, np.ndarray]], prior: float, rounds: int = 300, l2: float = 2e-4) -> Model:
    """Non-negative risk with logistic loss, minimised by Adam over whole batches. Documents hold places in names."""
    if not positive or not unlabelled or not prior:
        return Model(np.zeros(0, np.int64), np.zeros(0), -40.0)
    # four bytes a number: this is what the driver holds
    both = [*positive, *unlabelled]
    where, value = np.concatenate([x for x, _ in both]).astype(np.int32), np.concatenate([v for _, v in both]).astype(np.float32)
    sizes = np.array([len(x) for x, _ in both])
    cut = sum(len(x) for x, _ in positive)
    side = lambda weights, part: np.bincount(where[part], weights[part], len(names))
    in_p, in_u = slice(0, cut), slice(cut, None)
    mean_p, mean_u = side(value, in_p) / len(positive), side(value, in_u) / len(unlabelled)
    var_p, var_u = side(value**2, in_p) / len(positive) - mean_p**2, side(value**2, in_u) / len(unlabelled) - mean_u**2
    z = (mean_p - mean_u) / np.sqrt((var_p + 0.01) / len(positive) + (var_u + 0.01) / len(unlabelled))
    # evidence for the positive class: the negative one is what is left
    kept = np.flatnonzero(mean_p > 2 * mean_u)
    kept = np.sort(kept[np.argsort(-z[kept], kind="stable")[:MAX_FEATURES]])
    column = np.full(len(names), -1, np.int32)
    column[kept] = np.arange(len(kept))
    col = column[where]
    there = col >= 0
    row, col, value = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[there], col[there], value[there]
    del where, both, there
    n_p, n = len(positive), len(sizes)
    w, b = np.zeros(len(kept)), -1.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for step in range(1, rounds + 1):
        g = np.bincount(row, w[col] * value, n) + b
        p, u = g[:n_p], g[n_p:]
        negative = np.mean(np.logaddexp(0, u)) - prior * np.mean(np.logaddexp(0, p))
        d = np.zeros(n)
        if negative >= 0:
            d[:n_p] = prior * ((sigmoid(p) - 1) - sigmoid(p)) / n_p
            d[n_p:] = sigmoid(u) / (n - n_p)
        else:
            d[:n_p] = prior * sigmoid(p) / n_p
            d[n_p:] = -sigmoid(u) / (n - n_p)
        grad = np.append(np.bincount(col, d[row] * value, len(w)) + l2 * w, d.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return Model(names[kept], w, float(b))


def train(docs: DataFrame, labels: DataFrame, folds: int | None = 5, held_out: int = 0, label: str = "toxic") -> Model:
    """From bounded samples; neither takes a row of the fold held out."""
    own = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y is not null")
    texts = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text"))
    if folds:
        own = own.filter(fold(F.col("id"), folds) != held_out)
    own = own.groupBy("id").agg(F.max("y").alias("y"))
    stats = own.agg(F.avg("y").alias("prior")).first()
    order = F.xxhash64("id")
    toxic = own.filter("y = 1").orderBy(order, "id").limit(MAX_POSITIVE).select("id")
    pool = texts.select("id").filter("id is not null")
    if folds:
        pool = pool.filter(fold(F.col("id"), folds) != held_out)
    pool = pool.distinct().orderBy(order, "id").limit(MAX_UNLABELLED)
    # both samples are of a fixed number of rows; of the unlabelled only features that positives have come here
    with lean_memory():
        positive = _gather(texts, toxic, None)
        names = candidates(positive)
        positive = [among(r, names) for r in positive]
        return fit(names, positive, _gather(texts, pool, names), float(stats.prior or 0))


def _gather(texts: DataFrame, ids: DataFrame, names: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and values of the texts of a bounded set of ids, in order of id; each id once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [document_features("" if t is None else t) for t in b.column(1).to_pylist()]
            rows = rows if names is None else [among(r, names) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i].astype(t).tobytes() for r in rows], pa.binary()) for i, t in enumerate(("<u4", "<f4")))], ["id", "x", "v"])

    got = texts.join(F.broadcast(ids), "id").mapInArrow(run, "id long, x binary, v binary").dropDuplicates(["id"]).toArrow().sort_by("id")
    return [(np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(v.as_buffer(), "<f4")) for x, v in zip(got["x"], got["v"], strict=True)]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean_memory():
            for b in batches:
                s = [model.score("" if t is None else t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])
            model.forget()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, folds: int | None = 5) -> DataFrame:
    """The rows of docs below the threshold, with their columns."""
    model = train(docs, labels, folds)

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with lean_memory():
            for texts in batches:
                yield texts.map(lambda t: model.score("" if t is None else t))
            model.forget()

    return docs.filter(toxic(docs["text"].cast("string")) < threshold)
