"""Quality rules: repetition and symbol counts, then distribution divergence.

Every text gets two histograms -- character classes, and common words (the
most frequent words of a language plus one bin for all others) -- which are
compared with the histograms of each language's documents by Jensen-Shannon
distance (base 2, 0 to 1).  References are counted over all documents with a
non-null ``lang``; a text is measured against its nearest reference, so its
own label is not needed.  Texts below the minimum lengths are not judged by
divergence: a short sample is far from any reference by chance.

Sizes: one reference is 9 class counts and ``TOP_WORDS`` word counts; at most
``MAX_LANGS`` are sent to a task.  More languages are compared in rounds, and
texts carry their least distances from round to round.  Word counts are pre-summed in each task as (lang, hash, count); the
top words of a language are found in two steps (64 slices, then their
winners), so no task holds a language's whole vocabulary.

Defined cases: null or empty text has no words, all counts 0 and
``base_failed``; repeated rows are judged alike; a null doc_id is carried; no
rows give no rows; without any labelled language the divergence test is
skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from revisit.llm import kernel as K
from revisit.llm.store import stored

TOP_WORDS = 64
MAX_LANGS = 256
MIN_WORDS = 50            # below: base rules fail
REPEAT_PERCENT = 50
GUARD_WORDS = 80          # word histogram is judged from here on
GUARD_CHARS = 200         # class histogram is judged from here on
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.48

SYMBOLS = b"#*$%&|<>"
# Character classes by lead byte: lower, upper, digit, space, line end, plain
# punctuation, symbols, other ASCII, non-ASCII.
CLASSES = np.full(256, 7, np.uint8)
CLASSES[97:123] = 0
CLASSES[65:91] = 1
CLASSES[48:58] = 2
CLASSES[[32, 9, 11, 12]] = 3
CLASSES[[10, 13]] = 4
CLASSES[list(b".,;:!?'\"()-")] = 5
CLASSES[list(SYMBOLS)] = 6
CLASSES[192:] = 8
CLASSES[128:192] = 9      # continuation bytes: not counted
N_CLASSES = 9
IS_SYMBOL = CLASSES == 6
IS_LEAD = CLASSES != 9


def class_histogram(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    classes = CLASSES[data]
    return np.stack([K.per_text(classes == c, off) for c in range(N_CLASSES)], axis=1)


def duplicate_lines(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word, those equal to an earlier one) of each text."""
    data, off = w.data, w.off
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    ends = np.flatnonzero(data == 10)
    cut[ends + 1] = True
    start = np.flatnonzero(cut[:n])
    end = np.r_[start[1:], n] if len(start) else start
    end = end - ((end > start) & (data[np.maximum(end - 1, 0)] == 10)) if n else end
    words_before = np.r_[0, np.cumsum(w.word)]
    full = words_before[end] > words_before[start] if len(start) else np.zeros(0, bool)
    start, end = start[full], end[full]
    doc = np.searchsorted(off, start, "right") - 1
    lines = np.bincount(doc, minlength=w.n_docs)
    if not len(start):
        return lines, lines.copy()
    key = K.mix(K.span_hashes(data, start, end) + K.mix(doc.astype(np.uint64) + np.uint64(1)))
    _, first = np.unique(key, return_index=True)
    return lines, lines - np.bincount(doc[first], minlength=w.n_docs)


def repeated_words(w: K.Words, hashes: np.ndarray, k: int = 3) -> np.ndarray:
    """Words of each text inside k-word windows that occur twice or more there."""
    grams, ok = w.grams(hashes, k)
    covered = np.zeros(len(hashes), bool)
    at = np.flatnonzero(ok)
    twice = at[K.repeat_counts(w.doc[at], grams[at]) > 1]
    for j in range(k):
        covered[twice + j] = True
    return np.bincount(w.doc[covered], minlength=w.n_docs)


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row's histogram to one reference."""
    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    q = reference / max(reference.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def language_rounds(docs: DataFrame, max_langs: int = MAX_LANGS) -> list[list[str]]:
    """The languages, in rounds of at most ``max_langs`` (one row a language is collected)."""
    langs = sorted(r["lang"] for r in docs.where(F.col("lang").isNotNull()).select("lang").distinct().collect())
    return [langs[lo:lo + max_langs] for lo in range(0, len(langs), max_langs)]


def language_references(docs: DataFrame, langs: list[str], top_words: int = TOP_WORDS) -> dict:
    """{lang: (class counts, sorted word hashes, their counts and the rest)}."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.text_buffer(batch.column(1))
            langs = np.array(batch.column(0).to_pylist(), object)
            for lo, hi in K.blocks(off):
                for lang in sorted(set(langs[lo:hi])):
                    rows = np.flatnonzero(langs[lo:hi] == lang) + lo
                    part = np.concatenate([data[off[i]:off[i + 1]] for i in rows])
                    part_off = np.r_[0, np.cumsum(off[rows + 1] - off[rows])]
                    w = K.Words(part, part_off)
                    values, n = np.unique(w.hashes(K.LOWER), return_counts=True)
                    classes = class_histogram(part, part_off).sum(axis=0)
                    kinds = np.r_[np.zeros(N_CLASSES, np.int8), np.ones(len(values), np.int8)]
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([lang] * len(kinds), pa.string()), "kind": kinds,
                        "value": np.r_[np.arange(N_CLASSES), values.view(np.int64)],
                        "n": np.r_[classes, n].astype(np.int64)})
    if not langs:
        return {}
    counted = (docs.where(F.col("lang").isin(langs))
               .select("lang", F.coalesce("text", F.lit("")).alias("text"))
               .mapInArrow(count, "lang string, kind byte, value long, n long")
               .groupBy("lang", "kind", "value").agg(F.sum("n").alias("n")))
    rank = F.row_number().over
    slices = counted.withColumn("slice", F.pmod(F.col("value"), F.lit(64)))
    words = slices.where("kind = 1")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n")).select(
        "lang", F.lit(2).cast("byte").alias("kind"), F.lit(0).cast("long").alias("value"), "n")
    order = (F.desc("n"), F.asc("value"))
    top = (words.withColumn("r", rank(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("r") <= top_words)
           .withColumn("r", rank(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= top_words)
           .select("lang", "kind", "value", "n"))
    kept = slices.where("kind = 0").select("lang", "kind", "value", "n").unionByName(totals).unionByName(top)
    found: dict = {lang: [np.zeros(N_CLASSES), [], 0] for lang in langs}
    for r in kept.collect():   # at most MAX_LANGS * (9 + 1 + top_words) rows
        if r["kind"] == 0:
            found[r["lang"]][0][r["value"]] = r["n"]
        elif r["kind"] == 1:
            found[r["lang"]][1].append((r["value"], r["n"]))
        else:
            found[r["lang"]][2] = r["n"]
    out = {}
    for lang, (classes, top_list, total) in found.items():
        top_list.sort()
        n = np.array([c for _, c in top_list], float)
        out[lang] = (classes, np.array([v for v, _ in top_list], np.int64).view(np.uint64), np.r_[n, total - n.sum()])
    return out


def nearest_distances(w: K.Words, lower: np.ndarray, classes: np.ndarray, references: dict) -> tuple[np.ndarray, np.ndarray]:
    """Least class and word distance of each text to any reference (0 without one)."""
    best_class = np.full(w.n_docs, 1.0 if references else 0.0)
    best_word = best_class.copy()
    vocabulary = np.unique(np.concatenate([v for _, v, _ in references.values()])) if references else lower[:0]
    if len(vocabulary):
        at = np.searchsorted(vocabulary, lower)
        at[at == len(vocabulary)] = 0
        common = vocabulary[at] == lower
        size = len(vocabulary)
        table = np.bincount(w.doc[common] * size + at[common], minlength=w.n_docs * size).reshape(w.n_docs, size)
    for class_ref, values, word_ref in references.values():
        best_class = np.minimum(best_class, js_distance(classes, class_ref))
        if len(values):
            own = table[:, np.searchsorted(vocabulary, values)]
            counts = np.concatenate([own, (w.count - own.sum(axis=1))[:, None]], axis=1)
            best_word = np.minimum(best_word, js_distance(counts, word_ref))
    return best_class, best_word


def running_distances(rows: DataFrame, references: dict) -> DataFrame:
    """``rows`` with js_class and js_word lowered by these references."""
    def lower(data: np.ndarray, off: np.ndarray, table: pa.RecordBatch) -> dict:
        w = K.Words(data, off)
        js_class, js_word = nearest_distances(w, w.hashes(K.LOWER), class_histogram(data, off), references)
        return {"doc_id": table.column(0), "text": table.column(1), "js_class": np.minimum(js_class, table.column(2).to_numpy()),
                "js_word": np.minimum(js_word, table.column(3).to_numpy())}
    return K.map_texts(rows, "doc_id long, text string, js_class double, js_word double", lower, extra=("js_class", "js_word"))


def quality_rules(docs: DataFrame, references: dict | None = None, max_class: float = MAX_CLASS_DISTANCE,
                  max_word: float = MAX_WORD_DISTANCE, max_langs: int = MAX_LANGS) -> DataFrame:
    """One row per document: counts, distances, ``base_failed`` and ``kept``."""
    rows = docs.select("doc_id", "text", F.lit(1.0).alias("js_class"), F.lit(1.0).alias("js_word"))
    if references is None:
        rounds = language_rounds(docs, max_langs)
        for langs in rounds[:-1]:            # one round's references at a time in a task
            rows = stored(running_distances(rows, language_references(docs, langs)), "distances")
        references = language_references(docs, rounds[-1]) if rounds else {}

    def judge(data: np.ndarray, off: np.ndarray, table: pa.RecordBatch) -> dict:
        w = K.Words(data, off)
        lead = IS_LEAD[data]
        h = w.hashes()
        _, dup = duplicate_lines(w)
        repeated = repeated_words(w, h)
        classes = class_histogram(data, off)
        js_class, js_word = nearest_distances(w, w.hashes(K.LOWER), classes, references)
        js_class = np.minimum(js_class, table.column(2).to_numpy())
        js_word = np.minimum(js_word, table.column(3).to_numpy())
        failed = (w.count < MIN_WORDS) | (100 * repeated > REPEAT_PERCENT * w.count)
        chars = K.per_text(lead, off)
        far = ((chars >= GUARD_CHARS) & (js_class > max_class)) | ((w.count >= GUARD_WORDS) & (js_word > max_word))
        return {"doc_id": table.column(0), "n_words": w.count.astype(np.int64),
                "word_chars": K.per_text(lead & w.word, off), "n_symbols": K.per_text(IS_SYMBOL[data], off),
                "n_dup_lines": dup.astype(np.int64), "n_repeat_words": repeated.astype(np.int64),
                "base_failed": failed, "kept": ~(failed | far), "js_class": js_class, "js_word": js_word}
    return K.map_texts(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                             "n_repeat_words long, base_failed boolean, kept boolean, js_class double, js_word double", judge,
                       extra=("js_class", "js_word"))
