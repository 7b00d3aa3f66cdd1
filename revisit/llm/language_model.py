"""LM scoring with a log-frequency Bloom filter.

The model is a bigram model over words and a text's end.  The counts of all
n-grams of all training texts are quantised, ``level = 1 + floor(log_1.5 c)``,
and an n-gram of level q is put into a Bloom filter q times, as (n-gram, 1) to
(n-gram, q): a count is read by asking for (n-gram, 1), (n-gram, 2), ... until
one is missing.  Hits are never missed; a false hit raises a level with a
chance of about one in eighty.  A bigram is only asked for where both its
words are known.

A word's probability is interpolated: ``w * c(hv) / c(h) + (1 - w) * p(v)`` with
``p(v) = (c(v) + 0.1) / (N + 0.1 * (V + 1))``, the counts read from the filter.
The weight w is one for each level of c(h), fitted by expectation maximisation
on all training texts, leaving out the occurrence that is looked at.  A text's
score depends on the levels of its n-grams alone, so the fit needs one
histogram of (level of v, level of h, level of hv), a bounded table, over all
training words.

1. Word counts: pre-summed in each task, summed by Spark, by 128-bit hashes.
2. N-grams are sent by slot, a range of their hash, as packed sorted numbers;
   the number of slots follows the input, each builds its slice of the filter.
3. The filter grows with the corpus; slices go to the workers in segments of
   at most ``SEGMENT_BYTES``, one round over the texts for each segment.  Each
   worker holds a copy, so it gives back what earlier tasks have freed.
4. The base score is exact: counts of the at most ``EXACT_WORDS`` words that
   are most frequent in all texts are broadcast, other words are joined with the
   counts by hash (none of them is frequent, so no key is hot).  That bound only
   says where a count is read.

Defined cases: null text counts as empty; an empty text has one token, its
end; a null doc_id is never held out; repeated rows are learned and scored
each; without training texts N and V are 0, every score is 0 and nothing is
known; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revisit.llm import kernel as K
from revisit.llm.language_id import held_out
from revisit.llm.store import stored

BASE = 1.5                        # of the quantised counts
BITS, HASHES = 10, 4              # bits a filter event, probes an event
START = 127                       # stands for the level of a text's start
MAX_LEVEL = 126
SLOT_BYTES = 4 << 20              # text that one slot's n-grams come from
SEGMENT_BYTES = 128 << 20         # filter bytes broadcast at a time
EXACT_WORDS = 500_000             # 12 MB
HELD_NGRAMS = 1_500_000          # of a task, about 100 MB while they are sent
HELD_WORDS = 1_000_000
ADD = 0.1
STEPS = 30

U = np.uint64
END = U(0x2545F4914F6CDD1D)       # token of a text's end, and word before its first
SHUFFLED = np.random.default_rng(7).permutation(256).astype(np.uint8)[K.LOWER]      # a second hash reads other bytes


class Tokens:
    """Tokens of a block of texts: words and, behind each text's words, its end."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        w = K.Words(data, off)
        self.first = w.first + np.arange(len(w.first))      # a text's first token, and the number of tokens
        self.end = self.first[1:] - 1
        self.n = int(self.first[-1])
        word = np.ones(self.n, bool)
        word[self.end] = False
        self.hash, self.second = np.full(self.n, END), np.full(self.n, END)
        self.hash[word] = w.hashes(K.LOWER)
        self.second[word] = w.hashes(SHUFFLED)
        before = np.r_[END, self.hash][:self.n]
        before[self.first[:-1]] = END
        self.word = K.mix(self.hash ^ U(1))                   # n-gram hashes
        self.pair = K.mix(before * U(K._GRAM) + K.mix(self.hash))
        self.text = np.repeat(np.arange(len(off) - 1), np.diff(self.first))


def level_of(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(LEVEL_FROM, count, "right"), MAX_LEVEL)


#: Least count of level 1, 2, ...; a count's level is the number of these not above it.
LEVEL_FROM = np.unique(np.ceil(BASE ** np.arange(MAX_LEVEL)).clip(max=2 ** 62)).astype(np.int64)
#: Mean count of each level; level 0 is none.
LEVEL_COUNT = np.r_[0.0, (LEVEL_FROM[:-1] + LEVEL_FROM[1:] - 1) / 2, float(LEVEL_FROM[-1])]


def summed(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values ascending, their counts)."""
    order = np.argsort(values)
    values = values[order]
    heads = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    if counts is None:
        return values[heads], np.diff(np.r_[heads, len(values)])
    return values[heads], np.add.reduceat(counts[order], heads) if len(heads) else counts[:0]


def texts_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    K.release()
    for batch in batches:
        data, off = K.text_buffer(batch.column(column))
        for lo, hi in K.blocks(off):
            yield batch.slice(lo, hi - lo), Tokens(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])


def word_codes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word by its two hashes, first position of each number)."""
    def heads_of(code: np.ndarray) -> np.ndarray:
        heads = np.zeros(int(code.max()) + 1 if len(code) else 0, np.int64)
        heads[code[::-1]] = np.arange(len(code))[::-1]
        return heads
    code = pd.factorize(a ^ K.mix(b))[0]
    heads = heads_of(code)
    if not (np.array_equal(a[heads[code]], a) and np.array_equal(b[heads[code]], b)):
        code = np.unique(np.stack([a, b]), axis=1, return_inverse=True)[1].reshape(-1)
        heads = heads_of(code)
    return code, heads


def word_counts(texts: DataFrame) -> DataFrame:
    """(a, b, n, everywhere): both hashes of each token, its count in training texts and in all."""
    columns = ["a", "b", "n", "everywhere"]

    def merge(held: list[tuple]) -> tuple:
        a, b, n, every = (np.concatenate(x) for x in zip(*held))
        code, heads = word_codes(a, b)
        return a[heads], b[heads], np.bincount(code, n).astype(np.int64), np.bincount(code, every).astype(np.int64)

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in merge(held)], names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch, t in texts_of(batches, 0):
            learned = (~batch.column(1).to_numpy(zero_copy_only=False))[t.text].astype(np.int64)
            held.append(merge([(t.hash, t.second, learned, np.ones(t.n, np.int64))]))
            size += len(held[-1][0])
            if size >= HELD_WORDS:
                yield batch_of(held)
                held, size = [], 0
                K.release()
        if held:
            yield batch_of(held)
    return (texts.select("text", "held_out").mapInArrow(run, "a long, b long, n long, everywhere long")
            .groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("everywhere").alias("everywhere")))


def slot_bits(texts: DataFrame, slot_bytes: int) -> int:
    """The slots are 2 ** bits; they follow the input."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(30, max(5, int(size // slot_bytes).bit_length()))


def ngram_blocks(texts: DataFrame, bits: int) -> DataFrame:
    """(slot, grams, counts): sorted n-gram numbers of a slot and their counts, packed, from a part of the texts."""
    shift = U(64 - bits)

    def emit(held: list[tuple]) -> pa.RecordBatch:
        grams, counts = summed(*(np.concatenate(x) for x in zip(*held)))
        slot = (grams >> shift).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        low, many = (grams & U(0xFFFFFFFF)).astype(np.uint32), counts.astype(np.int64)
        ends = np.r_[cut[1:], len(grams)]
        return pa.RecordBatch.from_arrays([
            pa.array(slot[cut].astype(np.int32)), pa.array([low[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
            pa.array([many[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())], names=["slot", "grams", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, t in texts_of(batches, 0):
            for grams in (t.word, t.pair):
                held.append(summed(grams))
                size += len(held[-1][0])
            if size >= HELD_NGRAMS:
                yield emit(held)
                held, size = [], 0
                K.release()
        if held:
            yield emit(held)
    return texts.select("text").mapInArrow(run, "slot int, grams binary, counts binary")


def place(slot: np.ndarray | int, gram: np.ndarray, event: np.ndarray, size: np.ndarray | int, number: int) -> np.ndarray:
    """Bit of an event's hash ``number`` in its slot's slice of ``size`` bytes."""
    key = np.asarray(slot, np.uint64) << U(32) | gram.astype(np.uint64)
    g = K.mix(key * U(0x9E3779B97F4A7C15) + K.mix(event.astype(np.uint64)))
    at = ((g & U(0xFFFFFFFF)) + (g >> U(32) | U(1)) * U(number)) & U(0xFFFFFFFF)
    return (at * (np.asarray(size, np.uint64) * U(8))) >> U(32)


def build_slices(blocks: DataFrame, bits_each: int = BITS) -> DataFrame:
    """(slot, slice): the filter over a slot's n-grams."""
    def build(table: pa.Table) -> pa.Table:
        slot = table["slot"][0].as_py()
        grams, counts = (np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in (("grams", np.uint32), ("counts", np.int64)))
        grams, counts = summed(grams, counts)
        levels = level_of(counts)
        size = max(8, -(-bits_each * int(levels.sum()) // 8))
        out = np.zeros(8 * size, bool)
        gram = np.repeat(grams, levels)
        event = np.arange(len(gram)) - np.repeat(np.cumsum(levels) - levels, levels) + 1
        for number in range(HASHES):
            out[place(slot, gram, event, size, number).astype(np.int64)] = True
        return pa.table({"slot": pa.array([slot], pa.int32()), "slice": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})
    return blocks.groupBy("slot").applyInArrow(build, "slot int, slice binary")


class Segment:
    """The slices of a range of slots."""

    def __init__(self, bits: int, lo: int, hi: int, slots: np.ndarray, slices: pa.ChunkedArray):
        self.shift, self.lo, self.hi = U(64 - bits), lo, hi
        self.size, self.start = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
        self.data, ends = K.text_buffer(slices)
        self.size[slots - lo], self.start[slots - lo] = np.diff(ends), ends[:-1]

    def levels(self, grams: np.ndarray, old: np.ndarray | None = None) -> np.ndarray:
        """Level of each n-gram of the segment's slots; the others keep theirs."""
        out = np.zeros(len(grams), np.uint8) if old is None else old.copy()
        slot = (grams >> self.shift).astype(np.int64)
        own = np.flatnonzero((slot >= self.lo) & (slot < self.hi))
        if not len(own):
            return out
        code, distinct = pd.factorize(grams[own])
        slot = (distinct >> self.shift).astype(np.int64)
        size, start = self.size[slot - self.lo], self.start[slot - self.lo]
        gram, level = distinct & U(0xFFFFFFFF), np.zeros(len(distinct), np.uint8)
        active = np.flatnonzero(size)
        for event in range(1, MAX_LEVEL + 1):
            hit = active
            for number in range(HASHES):
                at = place(slot[hit], gram[hit], np.array([event]), size[hit], number)
                hit = hit[(self.data[start[hit] + (at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & np.uint8(1) > 0]
            if not len(hit):
                break
            level[hit], active = event, hit
        out[own] = level[code]
        return out


def segments(slices: DataFrame, bits: int, segment_bytes: int) -> Iterator[Segment]:
    """The filter in ranges of slots of at most ``segment_bytes`` (one slot at least)."""
    sizes = slices.select("slot", F.octet_length("slice").alias("size")).orderBy("slot").toArrow()
    slots, size = sizes["slot"].to_numpy(), sizes["size"].to_numpy()
    total = np.r_[0, np.cumsum(size)]
    at = 0
    while at < len(slots) or not at:
        to = max(at + 1, int(np.searchsorted(total, total[at] + segment_bytes, "right")) - 1) if len(slots) else 0
        lo, hi = int(slots[at]) if len(slots) else 0, int(slots[to - 1]) + 1 if len(slots) else 0
        part = slices.where((F.col("slot") >= lo) & (F.col("slot") < hi)).toArrow()
        yield Segment(bits, lo, hi, part["slot"].to_numpy(), part["slice"])
        at = to
        if at >= len(slots):
            return


class ExactCounts:
    """Training counts of the most frequent words, by their two hashes."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: np.ndarray):
        order = np.argsort(a)
        self.a, self.b, self.n = a[order], b[order], n[order]

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Count in training texts, -1 for a word outside."""
        if not len(self.a):
            return np.full(len(a), -1)
        at = np.minimum(np.searchsorted(self.a, a), len(self.a) - 1)
        return np.where((self.a[at] == a) & (self.b[at] == b), self.n[at], -1)


def frequent(counts: DataFrame, words: int) -> DataFrame:
    """The words above the lowest count step that leaves at most ``words``; two
    words of one first hash are left to the join."""
    step = F.floor(4 * F.log2(F.col("everywhere").cast("double"))).cast("int")
    least, total = None, 0
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():     # some hundred steps
        total += r["count"]
        if total > words:
            break
        least = r["step"]
    return counts.where(step >= least) if least is not None else counts.where("false")


def text_levels(rows: DataFrame, parts: Iterator[Segment], exact: ExactCounts) -> DataFrame:
    """Per row: n_tokens, levels of its words and pairs (a byte a token), the
    exact base sums over frequent words and the other words' hashes."""
    context, columns = rows.sparkSession.sparkContext, ["doc_id", "held_out"]
    exact_words, last = context.broadcast(exact), None
    rows = rows.withColumn("words", F.lit(None).cast("binary")).withColumn("pairs", F.lit(None).cast("binary"))

    def both(batches: Iterator[pa.RecordBatch], broadcast) -> Iterator[tuple]:
        K.release()      # before a worker's copy of the segment is made
        segment = broadcast.value
        for batch, t in texts_of(batches, 2):
            old = [None, None] if batch.column(3).null_count else [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8) for i in (3, 4)]
            yield batch, t, segment.levels(t.word, old[0]), segment.levels(t.pair, old[1])

    def packed(levels: np.ndarray, t: Tokens) -> pa.Array:
        raw = levels.tobytes()
        return pa.array([raw[a:b] for a, b in zip(t.first[:-1].tolist(), t.first[1:].tolist())], pa.binary())

    def step(segment):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, t, words, pairs in both(batches, segment):
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed(words, t), packed(pairs, t)], names=[*columns, "text", "words", "pairs"])
        return run

    def finish(segment):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, t, words, pairs in both(batches, segment):
                code, heads = word_codes(t.hash, t.second)
                count = exact_words.value.find(t.hash[heads], t.second[heads])[code]
                log = np.where(count >= 0, np.log10(np.maximum(count, 0) + ADD), 0)
                rest = np.flatnonzero(count < 0)
                each, times = np.unique(t.text[rest] * len(heads) + code[rest], return_counts=True)
                cuts, word = np.searchsorted(each, np.arange(len(t.first)) * len(heads)), heads[each % max(1, len(heads))]
                others = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.StructArray.from_arrays(
                    [pa.array(t.hash[word].view(np.int64)), pa.array(t.second[word].view(np.int64)), pa.array(times.astype(np.int64))],
                    ["a", "b", "times"]))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:2], pa.array(np.diff(t.first)), packed(words, t), packed(pairs, t),
                     pa.array(np.add.reduceat(log, t.first[:-1])), pa.array(np.add.reduceat((count > 0).astype(np.int64), t.first[:-1])), others],
                    names=[*columns, "n_tokens", "words", "pairs", "log_sum", "n_known", "others"])
        return run
    for part in parts:
        if last is not None:
            rows = stored(rows.mapInArrow(step(last), "doc_id long, held_out boolean, text string, words binary, pairs binary"), "lm-levels")
        last = context.broadcast(part)
    return rows.mapInArrow(finish(last), "doc_id long, held_out boolean, n_tokens long, words binary, pairs binary, log_sum double, n_known long, "
                                         "others array<struct<a: long, b: long, times: long>>")


def level_triples(words: pa.Array, pairs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(level of the token, of the token before, of the pair) as one number
    each, and the first token of each text; before it stands ``START``."""
    w, p = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).astype(np.int64) for x in (words, pairs))
    first = np.r_[0, np.cumsum([len(x) for x in words.to_pylist()])].astype(np.int64)
    before = np.r_[0, w][:len(w)]
    before[first[:-1]] = START
    p = np.where((w > 0) & (before > 0), p, 0)
    return (w * 128 + before) * 128 + p, first


class Smoothed:
    """Probabilities of level triples."""

    def __init__(self, n: int, v: int, n_texts: int):
        self.total, self.n_texts, self.weight = n + ADD * (v + 1), n_texts, np.zeros(START + 1)

    def parts(self, triples: np.ndarray, left_out: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(level of the context's count, pair estimate, word probability),
        the first two with ``left_out`` occurrences less."""
        word, before, pair = triples >> 14, triples >> 7 & 127, triples & 127
        context = np.where(before == START, self.n_texts, LEVEL_COUNT[np.minimum(before, len(LEVEL_COUNT) - 1)]) - left_out
        seen = np.maximum(LEVEL_COUNT[np.minimum(pair, len(LEVEL_COUNT) - 1)] - left_out, 0)
        level = np.where(before == START, START, level_of(context))
        return level, np.minimum(1, seen / np.maximum(context, 1)), (LEVEL_COUNT[np.minimum(word, len(LEVEL_COUNT) - 1)] + ADD) / self.total

    def fit(self, triples: np.ndarray, n: np.ndarray) -> None:
        """A context of count c stands for those of count c - 1, since its own
        occurrence is left out; one seen once is left with nothing to learn from."""
        level, pair, word = self.parts(triples, 1)
        total = np.bincount(level, n, START + 1)
        self.weight = np.where(total > 0, 0.5, 0.0)
        self.weight[0] = 0
        for _ in range(STEPS):
            high = self.weight[level] * pair
            share = high / (high + (1 - self.weight[level]) * word)
            self.weight = np.bincount(level, n * share, START + 1) / np.maximum(total, 1)
        known = np.flatnonzero(total[1:START]) + 1
        if len(known):              # quantised counts less one may pass a level by
            self.weight[1:START] = np.interp(np.arange(1, START), known, self.weight[known])

    def log10(self, triples: np.ndarray) -> np.ndarray:
        level, pair, word = self.parts(triples)
        return np.log10(np.minimum(1, self.weight[level] * pair + (1 - self.weight[level]) * word))


def triple_counts(levels: DataFrame) -> DataFrame:
    """(triple, n) over all rows, pre-summed in each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held.append(summed(level_triples(batch.column(0), batch.column(1))[0]))
            if len(held) >= 16:
                held = [summed(*(np.concatenate(x) for x in zip(*held)))]
        if held:
            triples, n = summed(*(np.concatenate(x) for x in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(triples), pa.array(n.astype(np.int64))], names=["triple", "n"])
    return levels.select("words", "pairs").mapInArrow(run, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n"))


def score_texts(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES, exact_words: int = EXACT_WORDS,
                bits_each: int = BITS, slot_bytes: int = SLOT_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 10, 0).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    training = rows.where("not held_out")
    counts = stored(word_counts(rows), "lm-words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    top = frequent(counts, exact_words).toArrow()       # at most exact_words rows
    exact = ExactCounts(*(top[c].to_numpy().view(k) for c, k in (("a", np.uint64), ("b", np.uint64), ("n", np.int64))))
    bits = slot_bits(training, slot_bytes)
    slices = stored(build_slices(ngram_blocks(training, bits), bits_each), "lm-filter")
    table = stored(text_levels(rows, segments(slices, bits, segment_bytes), exact).withColumn("row", F.monotonically_increasing_id()), "lm-texts")

    found = triple_counts(table.where("not held_out")).toArrow()      # at most 128 ** 3 rows, some thousand in practice
    model = Smoothed(total["n"], total["v"], training.count())
    model.fit(found["triple"].to_numpy(), found["n"].to_numpy())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                triples, first = level_triples(batch.column(6), batch.column(7))
                code, distinct = pd.factorize(triples)
                yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(np.add.reduceat(model.log10(distinct)[code], first[:-1]))],
                                                 names=[*scored, "score"])
    scored = ["row", "doc_id", "held_out", "n_tokens", "n_known", "log_sum"]
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, log_sum double, score double"
    texts = table.select(*scored, "words", "pairs").mapInArrow(score, schema)
    rest = (table.select("row", F.inline("others")).join(counts, ["a", "b"])      # every word is counted
            .groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + ADD)).alias("rest_sum"),
                                F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rest_known")))
    bottom = float(np.log10(total["n"] + ADD * (total["v"] + 1)))
    return texts.join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("log_sum") + F.coalesce("rest_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(bottom)).alias("base_score"), "score")
