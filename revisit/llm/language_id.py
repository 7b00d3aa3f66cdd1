"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts hashed 1- to 3-character n-grams per language over every
training text (pre-summed in each task, then summed by Spark); the smoothed
log-probability matrix, languages x buckets, is broadcast and texts are
scored in batches by numpy gathers over the n-gram ids.

The matrix is bounded: ``BUCKETS`` columns, at most ``MAX_LANGS`` rows.  More
languages are scored in rounds, each with a matrix of its own; texts carry
the best language so far and the sum for the score from round to round.

``in_known_language`` rejects what no learned language explains.  Its measure
is the mean log-probability an n-gram under the predicted language, against
the training texts of that language: their mean less ``MAX_DEVIATION``
deviations, made of the spread between them and what chance does in a text of
this length.  Wherever the values lie, at most 1 / (1 + MAX_DEVIATION ** 2)
of a language's training texts are that low.

Defined cases: null text, empty text or a text without a letter gives ``und``
with score 0; rows with null ``lang`` or null text are not learned from; with
nothing to learn from, every text is ``und``; a null doc_id is never
held out and is predicted like any other; repeated rows are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revisit.llm import kernel as K
from revisit.llm.store import stored

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
MAX_LANGS = 256
SMOOTHING = 0.5
FIT_STEPS, FIT_BINS = 64, 64 * 40     # histogram of mean log-probabilities, 0 to -40
MAX_DEVIATION = 8
LETTER = r"\p{L}"
UNDETERMINED = "und"


def held_out(key: str = "doc_id", modulus: int = 4, remainder: int = 2):
    """True for the rows no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def characters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets): A-Z lower-cased, other ASCII non-letters as one blank."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    points = np.where((points >= 65) & (points <= 90), points + 32, points)
    blank = (points < 97) | ((points > 122) & (points < 128))
    return np.where(blank, 32, points).astype(np.uint64), before[off]


def gram_ids(points: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text index) of each n-gram that lies in one text."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.full(n, order, np.uint64)
    for j in range(order):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[j:j + n] + np.uint64(1)
    ids = ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    ok = doc[:n] == doc[order - 1:]
    return ids[ok], doc[:n][ok]


def known_texts(docs: DataFrame) -> DataFrame:
    """Rows a model may learn from."""
    return docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())


def language_rounds(known: DataFrame, max_langs: int = MAX_LANGS) -> list[tuple[list[str], np.ndarray]]:
    """(languages, their log priors) in rounds of at most ``max_langs``, by name."""
    langs = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}   # one row a language
    names, total = sorted(langs), sum(langs.values())
    parts = [names[lo:lo + max_langs] for lo in range(0, len(names), max_langs)]
    return [(part, np.log([langs[x] / total for x in part])) for part in parts]


def learn(known: DataFrame, names: list[str]) -> np.ndarray:
    """n-gram counts, languages x buckets."""
    index = {x: i for i, x in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(names), BUCKETS), np.int64)
        for batch in batches:
            data, off = K.text_buffer(batch.column(1))
            lang = np.array([index[x] for x in batch.column(0).to_pylist()], np.int64)
            for lo, hi in K.blocks(off):
                points, bounds = characters(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                for order in ORDERS:
                    ids, doc = gram_ids(points, bounds, order)
                    sums += np.bincount(lang[lo:hi][doc] * BUCKETS + ids, minlength=sums.size).reshape(sums.shape)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"cell": at.astype(np.int64), "n": sums.ravel()[at]})
    cells = (known.where(F.col("lang").isin(names)).select("lang", "text").mapInArrow(count, "cell long, n long")
             .groupBy("cell").agg(F.sum("n").alias("n")).toPandas())   # at most languages x buckets rows
    counts = np.zeros(len(names) * BUCKETS)
    counts[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return counts.reshape(len(names), BUCKETS)


def log_probabilities(counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Smoothed log probabilities with the prior in the last column."""
    matrix = counts + SMOOTHING
    return np.concatenate([np.log(matrix / matrix.sum(axis=1, keepdims=True)), prior[:, None]], axis=1)


def text_grams(points: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """All n-gram ids of each text."""
    n = len(bounds) - 1
    found = [gram_ids(points, bounds, order) for order in ORDERS]
    cut = [np.r_[0, np.cumsum(np.bincount(doc, minlength=n))] for _, doc in found]
    return [np.concatenate([ids[c[i]:c[i + 1]] for (ids, _), c in zip(found, cut)]) for i in range(n)]


def fit_bounds(known: DataFrame, names: list[str], counts: np.ndarray) -> np.ndarray:
    """(mean, variance between texts, variance of one n-gram) of each
    language's mean log-probability an n-gram.  Every training text with a
    letter is measured under its own language without its own counts, in one
    histogram of fixed size a language."""
    index = {x: i for i, x in enumerate(names)}
    table = known.sparkSession.sparkContext.broadcast(counts)   # bounded: MAX_LANGS x BUCKETS

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(names), FIT_BINS), np.int64)
        totals = table.value.sum(axis=1)
        for batch in batches:
            data, off = K.text_buffer(batch.column(1))
            lang = [index[x] for x in batch.column(0).to_pylist()]
            for lo, hi in K.blocks(off):
                for i, ids in enumerate(text_grams(*characters(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])), lo):
                    left = table.value[lang[i]][ids] - np.bincount(ids, minlength=BUCKETS)[ids]
                    value = np.log(left + SMOOTHING).mean() - np.log(totals[lang[i]] - len(ids) + SMOOTHING * BUCKETS)
                    sums[lang[i], min(FIT_BINS - 1, max(0, int(-value * FIT_STEPS)))] += 1
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"cell": at.astype(np.int64), "n": sums.ravel()[at]})
    cells = (known.where(F.col("lang").isin(names) & F.col("text").rlike(LETTER)).select("lang", "text")
             .mapInArrow(measure, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas())
    hist = np.zeros(len(names) * FIT_BINS)
    hist[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    hist = hist.reshape(len(names), FIT_BINS)
    value, n = -(np.arange(FIT_BINS) + 0.5) / FIT_STEPS, np.maximum(hist.sum(axis=1), 1)
    mean = hist @ value / n
    between = hist @ value ** 2 / n - mean ** 2
    one = np.empty(len(names))
    for i, row in enumerate(counts + SMOOTHING):
        p = row / row.sum()
        one[i] = p @ np.log(p) ** 2 - (p @ np.log(p)) ** 2
    return np.stack([mean, np.maximum(between, 0), one], axis=1)


def predict(rows: DataFrame, names: list[str], matrix: np.ndarray, bounds: np.ndarray | None, keep_text: bool) -> DataFrame:
    """``rows`` (doc, text, has_letter and the running columns) after one more
    round: best log-probability so far, sum of all relative to it, best
    language and its deviation from the bounds."""
    table = rows.sparkSession.sparkContext.broadcast(matrix.astype(np.float32))   # bounded: MAX_LANGS x BUCKETS
    out = rows.schema if keep_text else rows.drop("text").schema

    def score(data: np.ndarray, off: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
        points, edges = characters(data, off)
        n, logp = len(off) - 1, table.value
        total = np.tile(logp[:, -1].astype(float), (n, 1))
        grams = np.zeros(n)
        for order in ORDERS:
            ids, doc = gram_ids(points, edges, order)
            size = np.bincount(doc, minlength=n)
            grams += size
            ends = np.r_[0, np.cumsum(size)]
            for j in range(len(names)):
                sums = np.r_[0.0, np.cumsum(logp[j][ids], dtype=float)]
                total[:, j] += sums[ends[1:]] - sums[ends[:-1]]
        before = batch.column("best").to_numpy()
        at = total.argmax(axis=1)
        top = total[np.arange(n), at]
        best, new = np.maximum(top, before), top > before
        rest = batch.column("rest").to_numpy() * np.exp(before - best) + np.exp(total - best[:, None]).sum(axis=1)
        deviation = np.zeros(n)
        if bounds is not None:
            mean, between, one = bounds[at].T
            fit = (top - logp[at, -1]) / np.maximum(grams, 1)
            deviation = (fit - mean) / np.sqrt(between + one / np.maximum(np.diff(edges), 1))
        columns = {c: batch.column(c) for c in out.names} | {
            "best": pa.array(best), "rest": pa.array(rest),
            "lang_pred": pa.array([names[a] if x else y for a, x, y in zip(at, new, batch.column("lang_pred").to_pylist())], pa.string()),
            "deviation": pa.array(np.where(new, deviation, batch.column("deviation").to_numpy()))}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def small_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.text_buffer(batch.column("text"))
            for lo, hi in K.blocks(off):
                yield score(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], batch.slice(lo, hi - lo))
    return rows.mapInArrow(small_blocks, out)


def scored(docs: DataFrame, columns: list[str], fit: bool, max_langs: int = MAX_LANGS) -> DataFrame:
    """``doc`` (a struct of the columns), has_letter, lang_pred (null with
    nothing to learn from), score and deviation of every row; text if ``fit``."""
    known = known_texts(docs)
    rows = docs.select(F.struct(*columns).alias("doc"), "text", F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("has_letter"),
                       F.lit(float("-inf")).alias("best"), F.lit(0.0).alias("rest"), F.lit(None).cast("string").alias("lang_pred"),
                       F.lit(0.0).alias("deviation"))
    rounds = language_rounds(known, max_langs)
    for i, (names, prior) in enumerate(rounds):
        counts = learn(known, names)
        last = i == len(rounds) - 1
        rows = predict(rows, names, log_probabilities(counts, prior), fit_bounds(known, names, counts) if fit else None, fit or not last)
        if not last:
            rows = stored(rows, "languages")      # one matrix at a time in a task
    known_language = F.col("has_letter") & F.col("lang_pred").isNotNull()
    return rows.withColumn("score", F.when(known_language, 1 / F.col("rest")).otherwise(0.0))


def identify(docs: DataFrame, max_langs: int = MAX_LANGS) -> DataFrame:
    """Learn from the rows that are not held out, predict every row."""
    rows = scored(docs, ["doc_id"], False, max_langs).select("doc.doc_id", "has_letter", "lang_pred", "score")
    lang = F.when(F.col("has_letter") & F.col("lang_pred").isNotNull(), F.col("lang_pred")).otherwise(UNDETERMINED)
    return rows.select("doc_id", held_out().alias("held_out"), lang.alias("lang_pred"), "score")


def in_known_language(docs: DataFrame, max_langs: int = MAX_LANGS) -> DataFrame:
    """Rows of ``docs`` with a letter whose text is no further below what is
    usual in its predicted language than ``MAX_DEVIATION``; with nothing to
    learn from, all with a letter.  Rows with a null doc_id stay."""
    rows = scored(docs, [c for c in docs.columns if c != "text"], True, max_langs)
    kept = rows.where(F.col("doc.doc_id").isNull() | (F.col("has_letter") & (F.col("deviation") >= -MAX_DEVIATION)))
    return kept.select(*[(F.col("text") if c == "text" else F.col("doc")[c]).alias(c) for c in docs.columns])
