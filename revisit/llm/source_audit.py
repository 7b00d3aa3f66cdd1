"""Source divergence audit: terms kept by iceberg prefix refinement, then
divergences between the term distributions of a language's sources.

Terms are counted level by level.  A level is a byte length: a term no longer
than it is complete, a longer one stands there with its prefix.  Prefixes in
fewer than ``MIN_DOCS`` documents of their language are discarded, and the
next level (twice as long) reads only terms whose prefix is left, until no
longer term remains.  No longer prefix or term can be in more documents than
its prefix, so nothing that is kept gets lost, and the long tail of rare
terms is cut before it is shuffled at full length.

A level's prefixes are handed to the next one as a bitmap of their hashes of
at most ``BITMAP_BITS`` bits, whatever their number; a prefix that only shares
a bit with another costs a counted row and is discarded by its count later.

The divergence of two sources is summed over blocks of ``BLOCK`` sources:
a term goes once to each pair of blocks, split over ``salt``, and tasks add
up matrices, so no term emits its pairs of sources.

Defined cases: every row is a document of its own, repeated rows and null or
equal doc_ids too; null text, lang and source count as ''; a (lang, source)
without terms gives its pairs; a language without kept terms gives pairs of
value 0; a language with one source has no pairs; ties are ordered by the
item's bytes; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from revisit.llm import kernel as K
from revisit.llm.store import stored
from revisit.llm.token_split import ragged
from revisit.operators.sizing import broadcast_bounded

MIN_DOCS = 10
FIRST_LEVEL = 6
BITMAP_BITS = 1 << 27           # 16 MB, broadcast
HELD_ROWS = 250_000
TEXT_BYTES = 1 << 20
BLOCK = 64                      # sources a side of a matrix
CHUNK_TERMS = 64
TOP = 10
SCALE = 1_000_000_000

IS_TERM = np.zeros(256, bool)
IS_TERM[65:91] = IS_TERM[97:123] = IS_TERM[128:] = True


def term_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of each term of a block of texts."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IS_TERM[data]
    edge = np.zeros(len(data) + 1, bool)        # a text begins or ends here
    edge[off] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return start, end, np.searchsorted(off, start, "right") - 1


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each value by first appearance, first position of each number)."""
    code = pd.factorize(values)[0]
    heads = np.zeros(int(code.max()) + 1 if len(code) else 0, np.int64)
    heads[code[::-1]] = np.arange(len(code))[::-1]
    return code, heads


class Groups:
    """Numbers for the (lang, source) pairs a task meets."""

    def __init__(self):
        self.names, self.index, self.langs = [], {}, {}

    def number(self, lang: str, source: str) -> int:
        key = (lang, source)
        if key not in self.index:
            self.index[key] = len(self.names)
            self.names.append(key)
        return self.index[key]

    def lang_hash(self, lang: str) -> int:
        if lang not in self.langs:
            raw = np.frombuffer(lang.encode("utf-8", "surrogatepass") + b"\0", np.uint8)
            self.langs[lang] = int(K.span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])
        return self.langs[lang]


def in_bitmap(bits: np.ndarray, print_: np.ndarray) -> np.ndarray:
    at = print_ & np.uint64(len(bits) * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def level_rows(docs: DataFrame, before: int, level: int, bits: np.ndarray | None) -> DataFrame:
    """(lang, source, term, whole, print, docs, n) of the terms longer than
    ``before`` with a live prefix: whole terms by source, prefixes of
    ``level`` bytes by language only."""
    live = docs.sparkSession.sparkContext.broadcast(bits) if bits is not None else None

    def merged(held: list[tuple], groups: Groups) -> pa.RecordBatch:
        key, group, print_, n_docs, n, length = (np.concatenate(x) for x in list(zip(*held))[:6])
        data = np.concatenate([x[6] for x in held])
        code, heads = numbered(key)
        start = (np.cumsum(length) - length)[heads]
        size = length[heads]
        terms = pa.BinaryArray.from_buffers(pa.binary(), len(heads), [
            None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[ragged(start, size)]))])
        whole = group[heads] >= 0
        names = [groups.names[g if g >= 0 else -g - 1] for g in group[heads].tolist()]
        return pa.RecordBatch.from_arrays([
            pa.array([x for x, _ in names], pa.string()), pa.array([s if w else "" for (_, s), w in zip(names, whole)], pa.string()),
            terms, pa.array(whole), pa.array(print_[heads].view(np.int64)),
            pa.array(np.bincount(code, n_docs).astype(np.int64)), pa.array(np.bincount(code, n).astype(np.int64))],
            names=["lang", "source", "term", "whole", "print", "docs", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held, size = Groups(), [], 0
        first_of: dict[str, int] = {}                # one group for each language
        for batch in batches:
            pairs = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            number = np.array([groups.number(*x) for x in pairs], np.int64)
            lang = np.array([first_of.setdefault(x, g) for (x, _), g in zip(pairs, number.tolist())], np.int64)
            seed = np.array([groups.lang_hash(x) for x, _ in pairs], np.uint64)
            data, off = K.text_buffer(batch.column(0))
            for lo, hi in K.blocks(off, TEXT_BYTES):
                part = data[off[lo]:off[hi]]
                start, end, doc = term_spans(part, off[lo:hi + 1] - off[lo])
                doc = doc + lo
                if before:
                    longer = np.flatnonzero(end - start > before)
                    start, end, doc = start[longer], end[longer], doc[longer]
                    known = in_bitmap(live.value, K.mix(K.span_hashes(part, start, start + before, K.LOWER) ^ seed[doc]))
                    start, end, doc = start[known], end[known], doc[known]
                if not len(start):
                    continue
                whole = end - start <= level
                end = np.minimum(end, start + level)
                print_ = K.mix(K.span_hashes(part, start, end, K.LOWER) ^ seed[doc])
                group = np.where(whole, number[doc], -lang[doc] - 1)
                key = K.mix(print_ + K.mix(group.astype(np.uint64)))
                code, heads = numbered(key)
                once = numbered(K.mix(key + K.mix(doc.astype(np.uint64))))[1]
                length = (end - start)[heads]
                held.append((key[heads], group[heads], print_[heads], np.bincount(code[once], minlength=len(heads)),
                             np.bincount(code), length, K.LOWER[part[ragged(start[heads], length)]]))
                size += len(heads)
                if size >= HELD_ROWS:
                    yield merged(held, groups)
                    held, size = [], 0
        if held:
            yield merged(held, groups)
    return docs.mapInArrow(run, "lang string, source string, term binary, whole boolean, print long, docs long, n long")


def bitmap(prints: DataFrame) -> np.ndarray:
    """The prints as a bitmap of a power of two of bits, at most ``BITMAP_BITS``."""
    bits = 1 << 16
    n = prints.count()
    while bits < min(16 * n, BITMAP_BITS):
        bits *= 2
    at = F.col("print").bitwiseAND(F.lit(bits - 1))
    words = (prints.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(print & 63 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())      # at most BITMAP_BITS / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, first_level: int = FIRST_LEVEL) -> DataFrame:
    """(lang, source, term, n, lang_n) of each language's kept terms.
    ``docs``: text, lang, source without nulls."""
    found, before, level, bits = [], 0, first_level, None
    while True:
        rows = stored(level_rows(docs, before, level, bits).groupBy("lang", "source", "term", "whole", "print")
                      .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
                      .where(f"whole or docs >= {int(min_docs)}"), "audit-level")
        found.append(rows.where("whole").select("lang", "source", "term", "docs", "n"))
        prefixes = rows.where("not whole").select("print")
        if prefixes.isEmpty():
            break
        before, level, bits = level, 2 * level, bitmap(prefixes)
    terms = reduce(DataFrame.unionByName, found)
    whole = (terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
             .where(f"docs >= {int(min_docs)}").drop("docs"))
    return terms.join(whole, ["lang", "term"]).select("lang", "source", F.col("term").cast("string").alias("term"), "n", "lang_n")


def share(count: str, total: str = "total", terms: str = "terms") -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact; null without terms."""
    return F.expr(f"1L + (cast({SCALE} as decimal(10,0)) * cast({count} + 2 as decimal(20,0)))"
                  f" div nullif(cast({total} + 2 * {terms} as decimal(20,0)), cast(0 as decimal(20,0)))")


def gap(p: str = "p", q: str = "q") -> Column:
    """floor((p - q)^2 / (p + q)) of two shares, exact: shares are at most SCALE + 1."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def group_table(docs: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, langs): lang, source, pos (its number in the language), total,
    terms, none (share of an absent term); lang, lang_total, terms."""
    langs = stored(counts.select("lang", "term", "lang_n").distinct().groupBy("lang")
                   .agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("terms")), "audit-langs")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
              .join(langs.select("lang", "terms"), "lang", "left")
              .withColumn("total", F.coalesce("total", F.lit(0))).withColumn("terms", F.coalesce("terms", F.lit(0)))
              .withColumn("pos", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
              .withColumn("none", F.coalesce(share("0"), F.lit(1))))
    return stored(groups, "audit-groups"), langs


def block_pairs(df: DataFrame) -> DataFrame:
    """Each row once for every pair of blocks that has its block."""
    other = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other")).drop("other", "blocks")


class PairSums:
    """Sums of the gaps of all pairs of one pair of blocks."""

    def __init__(self, key: tuple, size: int):
        self.key, self.size = key, size
        self.none = [np.zeros(0, np.int64)] * 2       # shares of absent terms, left and right
        self.sums = None

    def absent(self, block: int, at: np.ndarray, p: np.ndarray) -> None:
        for side in (0, 1):
            if self.key[1 + side] == block:
                self.none[side] = p[np.argsort(at)]     # a block's sources are numbered from 0 without holes
        self.sums = np.zeros([len(x) for x in self.none], np.int64)

    def add(self, term: np.ndarray, block: np.ndarray, at: np.ndarray, p: np.ndarray) -> None:
        """Cells of whole terms; ``term`` ascends."""
        level = gaps(self.none[0][:, None], self.none[1][None])
        cuts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        for lo, hi in zip(range(0, len(cuts), CHUNK_TERMS), [*range(CHUNK_TERMS, len(cuts), CHUNK_TERMS), len(cuts)]):
            x, y = cuts[lo], cuts[hi] if hi < len(cuts) else len(term)
            sides = []
            for side in (0, 1):
                shares = np.repeat(self.none[side][None], hi - lo, 0)
                own = x + np.flatnonzero(block[x:y] == self.key[1 + side])
                shares[np.searchsorted(cuts, own, "right") - 1 - lo, at[own]] = p[own]
                sides.append(shares)
            self.sums += (gaps(sides[0][:, :, None], sides[1][:, None]) - level).sum(0)

    def rows(self) -> pa.RecordBatch:
        lang, left, right = self.key
        a, b = np.nonzero(np.triu(np.ones_like(self.sums), 1) if left == right else np.ones_like(self.sums))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a + left * self.size), pa.array(b + right * self.size),
                                           pa.array(self.sums[a, b])], names=["lang", "a", "b", "extra"])


def sum_matrices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Partial sums of the gaps of each pair of sources, less those of absent
    terms.  Rows come by (lang, left, right, term), the cells of absent terms
    (null term) first; a term has a row for each of its blocks."""
    held, now = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        ends = _changes(table)
        held = table.slice(ends[-2])            # its last term may go on
        now = yield from _add_terms(table.slice(0, ends[-2]), now, size)
    if held is not None:
        now = yield from _add_terms(held, now, size)
    if now is not None:
        yield now.rows()


def _changes(table: pa.Table, columns: tuple = ("lang", "left", "right", "term")) -> np.ndarray:
    """First rows of the runs of equal keys, and the number of rows."""
    n = table.num_rows
    new = np.zeros(max(n - 1, 0), bool)
    for name in columns:
        code = table[name].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new |= code[1:] != code[:-1]
    return np.r_[0, np.flatnonzero(new) + 1, n] if n else np.zeros(1, np.int64)


def _add_terms(table: pa.Table, now: PairSums | None, size: int) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return now
    bounds = _changes(table, ("lang", "left", "right"))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        part = table.slice(lo, hi - lo).combine_chunks()
        key = tuple(part[c][0].as_py() for c in ("lang", "left", "right"))
        if now is None or now.key != key:
            if now is not None:
                yield now.rows()
            now = PairSums(key, size)
        cells = part["cells"].combine_chunks()
        lengths, flat = cells.value_lengths().to_numpy(), cells.flatten()
        at, p = (flat.field(i).to_numpy() for i in range(2))
        block, ends = np.repeat(part["block"].to_numpy(), lengths), np.r_[0, np.cumsum(lengths)]
        none = part["term"].is_null().to_numpy()
        for i in np.flatnonzero(none).tolist():
            now.absent(part["block"][i].as_py(), at[ends[i]:ends[i + 1]], p[ends[i]:ends[i + 1]])
        first = int(none.sum())
        if first < part.num_rows:
            starts = _changes(part)[:-1]
            term = np.searchsorted(starts, np.arange(part.num_rows), "right")
            now.add(np.repeat(term, lengths)[ends[first]:], block[ends[first]:], at[ends[first]:], p[ends[first]:])
    return now


def source_pairs(counts: DataFrame, groups: DataFrame, block_size: int = BLOCK) -> DataFrame:
    """(lang, a, b, extra): a < b numbers of two sources of a language; extra is
    the sum of their gaps over all terms less that of as many absent terms."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.floor(F.col("pos") / block_size).cast("int")
    size = groups.groupBy("lang").agg((F.floor(F.max("pos") / block_size) + 1).cast("int").alias("blocks"))
    cells = F.collect_list(F.struct((F.col("pos") % block_size).cast("int").alias("at"), F.col("p"))).alias("cells")

    def blocked(df: DataFrame) -> DataFrame:        # at most block_size cells a row
        return block_pairs(df.withColumn("block", block).groupBy("lang", "term", "block").agg(cells)
                           .join(broadcast_bounded(size), "lang"))
    terms = blocked(counts.select("lang", "term", "pos", "p")).withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
    heads = (blocked(groups.select("lang", F.lit(None).cast("string").alias("term"), "pos", F.col("none").alias("p")))
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))
    return (heads.unionByName(terms).repartition(parts, "lang", "left", "right", "salt")
            .sortWithinPartitions("lang", "left", "right", F.asc_nulls_first("term"))
            .drop("salt").mapInArrow(lambda batches: sum_matrices(batches, block_size), "lang string, a long, b long, extra long")
            .groupBy("lang", "a", "b").agg(F.sum("extra").alias("extra")))


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, first_level: int = FIRST_LEVEL, top: int = TOP,
                  block: int = BLOCK) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = stored(kept_terms(docs, min_docs, first_level), "audit-terms")
    groups, langs = group_table(docs, counts)
    small = broadcast_bounded(groups.select("lang", "source", "pos", "total", "terms"))
    shares = (counts.join(small, ["lang", "source"]).join(broadcast_bounded(langs.select("lang", "lang_total")), "lang")
              .withColumn("p", share("n")).withColumn("q", share("lang_n", "lang_total")))
    pairs = stored(source_pairs(shares, groups, block), "audit-pairs")
    side = groups.select("lang", F.col("source"), F.col("pos"), F.col("none"), "terms")
    a, b = broadcast_bounded(side.withColumnsRenamed({"pos": "a", "none": "p"})), broadcast_bounded(
        side.select("lang", F.col("source").alias("item"), F.col("pos").alias("b"), F.col("none").alias("q")))
    both = pairs.unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "extra"))
    part_pair = (both.join(a, ["lang", "a"]).join(b, ["lang", "b"])
                 .select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("extra") + F.col("terms") * gap()).alias("value")))
    part_term = (shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap().alias("value")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (part_pair.withColumn("rank", F.row_number().over(order))
            .unionByName(part_term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)))
