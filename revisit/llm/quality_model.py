"""Quality classifier: histogram gradient-boosted trees over text statistics.

Statistics of every whole text come from the numpy kernel.  The model is
fitted on a bounded sample of the labelled rows (``MAX_TRAIN_ROWS``, a stated
parameter; chosen by a hash of doc_id): features are cut into at most 64
quantile bins, each tree level is grown from gradient histograms, and the
fitted trees are flattened into arrays that all tasks traverse with numpy,
one step per level for all rows at once.

Defined cases: labels that are null, neither 0 nor 1, or contradict each
other for one doc_id are not learned from; of rows that repeat a labelled
doc_id the one with the smallest text hash is learned from; null or empty texts have all
statistics 0 and get a score like any other; without labels, or with labels
of one class only, the score is the share of label 1 (0.5 without labels);
repeated rows are scored alike; a null doc_id is scored and not held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revisit.llm import kernel as K
from revisit.llm.language_id import held_out
from revisit.llm.quality_rules import CLASSES, N_CLASSES, class_histogram, duplicate_lines, repeated_words

MAX_TRAIN_ROWS = 20_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
L2 = 1.0
MIN_CHILD = 5.0
N_FEATURES = N_CLASSES + 16


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of text statistics per document."""
    w = K.Words(data, off)
    n_docs = w.n_docs
    classes = class_histogram(data, off).astype(float)
    chars = classes.sum(axis=1)
    h = w.hashes()
    words = np.maximum(w.count, 1).astype(float)
    lines, dup_lines = duplicate_lines(w)
    word_bytes = (w.end - w.start).astype(float)
    mean_len = np.bincount(w.doc, word_bytes, n_docs) / words
    var_len = np.bincount(w.doc, word_bytes ** 2, n_docs) / words - mean_len ** 2
    times = K.repeat_counts(w.doc, h)
    same_next = np.bincount(w.doc[:-1][(h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])], minlength=n_docs) if len(h) else words * 0
    top = np.zeros(n_docs)
    np.maximum.at(top, w.doc, times)
    last, first = (CLASSES[data[w.end - 1]], CLASSES[data[w.start]]) if len(h) else (h[:0], h[:0])
    length = w.end - w.start
    single = np.bincount(w.doc[length == 1], minlength=n_docs)
    exclaim = K.per_text(data == 33, off)
    capital = first == 1

    def share(mask):
        return np.bincount(w.doc[mask], minlength=n_docs) / words
    return np.column_stack([
        classes / np.maximum(chars, 1)[:, None], np.log1p(chars), np.log1p(w.count), mean_len, np.sqrt(np.maximum(var_len, 0)),
        np.bincount(w.doc, 1 / np.maximum(times, 1), n_docs) / words, top / words, same_next / words,
        repeated_words(w, h) / words, lines, dup_lines / np.maximum(lines, 1), share(last == 5), share(last == 6),
        share(capital), single / words, exclaim / np.maximum(chars, 1), w.count / np.maximum(lines, 1)])


class BoostedTrees:
    """Flattened trees: ``feature``, ``cut`` (go right if bin > cut) and
    ``value``, each (trees, 2 ** (depth + 1) - 1); leaves have feature -1."""

    def __init__(self, edges: list[np.ndarray], base: float):
        self.edges, self.base = edges, base
        self.feature = np.zeros((0, 2 ** (DEPTH + 1) - 1), np.int16)
        self.cut, self.value = self.feature.copy(), self.feature.astype(float)

    def bins(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.zeros(x.shape, np.uint8)
        return np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)]).astype(np.uint8)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.base)
        rows = np.arange(len(bins))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(bins), np.int64)
            for _ in range(DEPTH):
                f = feature[node]
                child = 2 * node + 1 + (bins[rows, np.maximum(f, 0)] > cut[node])
                node = np.where(f >= 0, child, node)
            total += value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> BoostedTrees:
    share = float(y.mean()) if len(y) else 0.5
    base = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    if not len(y) or not 0 < share < 1:
        return BoostedTrees([], base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    model = BoostedTrees(edges, base)
    b = model.bins(x).astype(np.int64)
    n, m = b.shape
    size = 2 ** (DEPTH + 1) - 1
    margin = np.full(n, base)
    columns = np.arange(m) * BINS
    features, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        feature, cut, value = np.full(size, -1, np.int16), np.zeros(size, np.int16), np.zeros(size)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH + 1):
            first, width = 2 ** level - 1, 2 ** level
            live = np.flatnonzero(node >= first)
            cells = ((node[live] - first)[:, None] * (m * BINS) + columns + b[live]).ravel()
            gh = [np.bincount(cells, np.repeat(v[live], m), width * m * BINS).reshape(width, m, BINS) for v in (grad, hess)]
            g_all, h_all = (v[:, 0].sum(axis=1) for v in gh)
            value[first:first + width] = -RATE * g_all / (h_all + L2)
            if level == DEPTH:
                break
            g_left, h_left = (np.cumsum(v, axis=2) for v in gh)
            g_right, h_right = g_all[:, None, None] - g_left, h_all[:, None, None] - h_left
            gain = g_left ** 2 / (h_left + L2) + g_right ** 2 / (h_right + L2) - (g_all ** 2 / (h_all + L2))[:, None, None]
            gain[(h_left * 4 < MIN_CHILD) | (h_right * 4 < MIN_CHILD)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                if gain.reshape(width, -1)[k, best[k]] > 1e-6:
                    feature[first + k], cut[first + k] = divmod(int(best[k]), BINS)
            f = feature[node[live]]
            goes = f >= 0
            at = live[goes]
            node[at] = 2 * node[at] + 1 + (b[at, f[goes]] > cut[node[at]])
        features.append(feature)
        cuts.append(cut)
        values.append(value)
        margin += value[node]
    model.feature, model.cut, model.value = np.array(features), np.array(cuts), np.array(values)
    return model


def training_labels(labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(doc_id, quality) to learn from: one clear 0/1 label per doc_id, not
    held out, at most about ``max_rows`` of them by a hash of doc_id."""
    clear = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("doc_id", 3, 1))
             .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
             .where(F.col("quality") == F.col("_most")).drop("_most"))
    parts = max(1, -(-clear.count() // max_rows))
    return clear.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0)


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> BoostedTrees:
    chosen = training_labels(labels, max_rows)   # bounded, so it may be broadcast
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def features(data: np.ndarray, off: np.ndarray, table: pa.RecordBatch) -> dict:
        x = statistics(data, off)
        return {"doc_id": table.column(0), "quality": table.column(2), "h": table.column(3),
                "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))}
    measured = K.map_texts(joined.select("doc_id", "text", F.col("quality").cast("int").alias("quality"), F.xxhash64("text").alias("h")),
                           "doc_id long, quality int, h long, x array<double>", features, extra=("quality", "h"))
    rows = (measured.groupBy("doc_id").agg(F.min_by(F.struct("quality", "x"), "h").alias("row"))    # one row a labelled doc_id
            .select("doc_id", "row.quality", "row.x").toPandas().sort_values("doc_id", kind="stable"))
    if not len(rows):
        return fit(np.zeros((0, N_FEATURES)), np.zeros(0))
    return fit(np.stack(rows["x"].to_numpy()), rows["quality"].to_numpy().astype(float))


def score(docs: DataFrame, model: BoostedTrees) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text."""
    def judge(data: np.ndarray, off: np.ndarray, table: pa.RecordBatch) -> dict:
        s = model.score(statistics(data, off))
        return {"doc_id": table.column(0), "score": s, "predicted": (s >= 0.5).astype(np.int32)}
    return (K.map_texts(docs, "doc_id long, score double, predicted int", judge)
            .select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted"))


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))
