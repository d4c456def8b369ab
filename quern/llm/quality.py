"""Quality scores by Bradley-Terry pairwise ranking (operator 1).

A document is described by shape statistics of its whole text, each cut into quantile bins, so that the linear
model is additive and not linear in them. A preference pair is a good and a bad labelled document; the model
maximises the likelihood that the good one wins, with logistic loss on feature differences. Scores of the
training rows give the threshold: the quantile at the share of bad labels. The score is a sigmoid around it.

Training takes at most MAX_TRAIN labelled rows, chosen by a hash of doc_id; everything else runs over all rows.
Only the text is an input of a score.

Edge cases: null text counts as empty; an empty text is scored from its (zero) statistics. Labels that repeat a
doc_id count as their maximum; null labels are left out. Without both kinds of label all scores are 0.5. Rows may
repeat; each gets its own score. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fold

#: Labelled rows that the model is fitted on, at most.
MAX_TRAIN = 8000
BINS = 24
PAIRS = 60_000
NAMES = ("log_bytes", "log_words", "word_bytes", "types", "repeats", "upper", "digit", "space", "lines", "mark", "comma_stop", "bang", "pipe", "money", "percent", "amp", "star", "hash", "non_ascii", "cap_words", "stops_a_line", "cells", "stops")

_CLASSES = {
    "upper": range(65, 91), "digit": range(48, 58), "space": (9, 11, 12, 13, 32), "lines": (10,),
    "mark": [c for c in range(33, 127) if not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123)], "comma_stop": (44, 46), "bang": (33, 63), "pipe": (124,),
    "money": (36,), "percent": (37,), "amp": (38,), "star": (42,), "hash": (35,), "non_ascii": range(128, 256),
}
_SUMS = np.zeros((256, len(_CLASSES)))
for _i, _bytes in enumerate(_CLASSES.values()):
    _SUMS[list(_bytes), _i] = 1


def statistics(text: str) -> np.ndarray:
    data = text.encode("utf-8", "replace")
    n = max(1, len(data))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _SUMS
    words = text.split()
    m = max(1, len(words))
    types = len(set(words))
    repeats = sum(map(eq, words, words[1:]))
    caps = sum(map(str.isupper, words))
    lines, stops = text.count("\n") + 1, text.count(".")
    rate = counts / n
    return np.array([np.log1p(len(data)), np.log1p(len(words)), len(data) / m, types / m**0.85, repeats / m, *rate, caps / m, stops / lines, text.count(" | ") / m, stops / m])


def _vectors(texts: list[str]) -> np.ndarray:
    return np.stack([statistics(t) for t in texts]) if texts else np.zeros((0, len(NAMES)))


class Model:
    def __init__(self, edges: np.ndarray, weights: np.ndarray, threshold: float, scale: float):
        self.edges, self.weights, self.threshold, self.scale = edges, weights, threshold, scale

    def _bins(self, x: np.ndarray) -> np.ndarray:
        """Column of the weights for each statistic."""
        at = np.empty(x.shape, np.int64)
        for j in range(x.shape[1]):
            at[:, j] = np.searchsorted(self.edges[j], x[:, j], side="right") + j * BINS
        return at

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self._bins(x)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.strength(x) - self.threshold) * self.scale, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, l2: float = 1e-4, rounds: int = 400, seed: int = 7) -> Model:
    """Bradley-Terry: P(i beats j) = sigmoid(w . (f_i - f_j)), over random pairs of a good i and a bad j."""
    width = x.shape[1]
    if not len(x) or not 0 < y.sum() < len(y):
        return Model(np.zeros((width, BINS - 1)), np.zeros(width * BINS), 0.0, 1.0)
    # half of the cuts from either class: the rare one isn't squeezed into a bin
    q = np.linspace(0, 1, BINS // 2 + 1)[1:-1]
    edges = np.stack([np.sort(np.concatenate((np.quantile(x[y == 1, j], q), np.quantile(x[y == 0, j], q), [np.median(x[:, j])])))[: BINS - 1] for j in range(width)])
    model = Model(edges, np.zeros(width * BINS), 0.0, 1.0)
    at = model._bins(x)
    rng = np.random.default_rng(seed)
    good, bad = rng.choice(np.flatnonzero(y == 1), pairs), rng.choice(np.flatnonzero(y == 0), pairs)
    w, m, v = model.weights, np.zeros(width * BINS), np.zeros(width * BINS)
    for step in range(1, rounds + 1):
        some = slice((step % 10) * pairs // 10, (step % 10 + 1) * pairs // 10)
        i, j = at[good[some]], at[bad[some]]
        p = 1 / (1 + np.exp(w[i].sum(axis=1) - w[j].sum(axis=1)))  # of losing
        g = l2 * w - (np.bincount(i.ravel(), np.repeat(p, width), len(w)) - np.bincount(j.ravel(), np.repeat(p, width), len(w))) / len(p)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weights = w
    s = np.sort(model.strength(x))
    k = min(len(s) - 1, max(1, int(round((y == 0).mean() * len(s)))))
    model.threshold = float((s[k - 1] + s[k]) / 2)
    model.scale = float(1 / max(1e-6, np.std(s)) * 3)
    return model


def train(docs: DataFrame, labels: DataFrame, folds: int | None = 3, held_out: int = 1, label: str = "quality", limit: int = MAX_TRAIN) -> Model:
    """From at most `limit` labelled rows, none of them of the fold held out."""
    own = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).filter("id is not null and y is not null")
    if folds:
        own = own.filter(fold(F.col("id"), folds) != held_out)
    own = own.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(limit)
    texts = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text"))
    rows = texts.join(F.broadcast(own), "id")  # `limit` rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(["" if t is None else t for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], ["id", "y", "x"])

    # a repeated document counts once; the order makes the model the same on every run
    got = rows.select("id", "text", "y").mapInArrow(run, "id long, y int, x array<double>").dropDuplicates(["id"]).toPandas().sort_values("id")
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(NAMES))
    return fit(x, got["y"].to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(_vectors(["" if t is None else t for t in b.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
