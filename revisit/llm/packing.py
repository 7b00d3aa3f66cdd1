"""Packing: optimal length buckets and token-budget batches.

Lengths are word counts of whole texts.  The global length histogram (exact
up to 256 words, then 128 steps per doubling: at most a few thousand bins
whatever the corpus) goes to a dynamic program that chooses the bucket
boundaries with the least total padding.  The program takes a bin of several
lengths at the least padding that a boundary inside it could leave; bins at
which its best buckets end are counted again in ``SPLIT`` parts, until the
padding is proven to be within ``GAP`` of the least over all lengths.  Inside a bucket, documents are
numbered without a global window: rows are dealt to salted slices of about
``SLICE_ROWS`` by the bucket's own count, numbered within their slice, and
moved on by the counts of the slices before.  ``floor(number / capacity)`` is
the batch, so every batch of a bucket but its last is full.

Defined cases: null and empty texts have length 0 and share a bucket of
padded length 0 (at most ``budget`` of them a batch); a text longer than the
budget is a batch of its own that exceeds it; repeated rows are packed each;
null doc_ids are listed as null; no rows give no batches.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from revisit.llm import kernel as K
from revisit.llm.store import stored

BUDGET = 65_536
BUCKETS = 16
SLICE_ROWS = 20_000
SPLIT = 8
REACH = 32
GAP = 0.001


def text_lengths(docs: DataFrame) -> DataFrame:
    def count(data: np.ndarray, off: np.ndarray, table: pa.RecordBatch) -> dict:
        return {"doc_id": table.column(0), "length": K.Words(data, off).count.astype(np.int64)}
    return K.map_texts(docs, "doc_id long, length long", count)


def length_bin(length):
    """Lower edge of a length's histogram bin."""
    step = F.expr("shiftleft(1L, greatest(length(bin(length)) - 8, 0))")
    return length - F.pmod(length, step)


def best_ends(low: np.ndarray, n: np.ndarray, total: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Last bin of each bucket: the cut of the ascending bins into at most
    ``buckets`` runs with the least sum of (run's largest - length), where a
    run may end inside its last bin.  Such an end is taken at the bin's least
    length ``low`` and without padding in the bin: exact for a single length,
    never too much otherwise."""
    m = len(low)
    if not m:
        return []
    low = [int(v) for v in low]
    count, tokens = ([0, *itertools.accumulate(int(v) for v in column)] for column in (n, total))
    cost: list = [0] + [math.inf] * m
    cuts = []
    for _ in range(min(buckets, m)):
        # A run (i, j] costs a line in low[j] with slope -count[i]: the lower hull of the lines answers ascending lengths.
        step, back, hull, at = [0] + [math.inf] * m, [0] * (m + 1), [], 0
        for j in range(1, m + 1):
            if cost[j - 1] < math.inf:
                slope, base = -count[j - 1], cost[j - 1] + tokens[j - 1]
                while len(hull) > at + 1 and (base - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - slope):
                    hull.pop()
                hull.append((slope, base, j - 1))
            x = low[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] < hull[at][0] * x + hull[at][1]:
                at += 1
            step[j] = hull[at][0] * x + hull[at][1] + x * count[j - 1] - tokens[j - 1]
            back[j] = hull[at][2]
        cuts.append(back)
        cost = step
    out, j = [], m
    for back in reversed(cuts):
        if j == 0:
            break
        out.append(j - 1)
        j = int(back[j])
    return out[::-1]


def best_boundaries(top: np.ndarray, n: np.ndarray, total: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Largest length of each bucket, from exact ascending lengths."""
    return [int(top[i]) for i in best_ends(top, n, total, buckets)]


def settle(bins: pd.DataFrame, split, buckets: int = BUCKETS, gap: float = GAP) -> tuple[list[int], list[int]]:
    """Largest length and number of rows of each bucket, with padding at most
    ``gap`` of it above the least possible (0: the least).  ``split(bins)``
    gives the parts of bins (bin, n, total, low, top); those around the open
    ends are split too, which saves rounds."""
    if not len(bins):
        return [0], [0]
    while True:
        low, top, n, total = (bins[c].to_numpy(np.int64) for c in ("low", "top", "n", "total"))
        ends = np.array(best_ends(low, n, total, buckets))
        bucket = np.searchsorted(ends, np.arange(len(bins)))
        padding = (top[ends][bucket] * n - total).sum()
        least = np.delete(low[ends][bucket] * n - total, ends).sum()
        if padding - least <= gap * padding:
            return top[ends].tolist(), np.bincount(bucket, n).astype(np.int64).tolist()
        open_ends = ends[low[ends] < top[ends]]
        around = np.unique((open_ends[:, None] + np.arange(-REACH, REACH + 1)).clip(0, len(bins) - 1))
        coarse = bins.iloc[around[low[around] < top[around]]]
        bins = pd.concat([bins.drop(coarse.index), split(coarse)]).sort_values("top", ignore_index=True)


def global_boundaries(lengths: DataFrame, buckets: int = BUCKETS, gap: float = GAP) -> tuple[list[int], list[int]]:
    """``settle`` over a table of distinct lengths (length, n)."""
    def counted(rows: DataFrame, key) -> pd.DataFrame:
        return (rows.groupBy(key.alias("bin"))
                .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("length")).alias("total"), F.min("length").alias("low"), F.max("length").alias("top"))
                .orderBy("bin").toPandas())

    def split(coarse: pd.DataFrame) -> pd.DataFrame:
        lows, tops = (F.array(*[F.lit(int(v)) for v in coarse[c]]) for c in ("low", "top"))
        at = F.size(F.filter(lows, lambda v: v <= F.col("length"))) - 1
        inside = lengths.withColumn("low", F.get(lows, at).cast("long")).withColumn("top", F.get(tops, at).cast("long")).where("length <= top")
        step = F.expr(f"(top - low + {SPLIT}) div {SPLIT}")
        return counted(inside, F.col("length") - F.pmod(F.col("length") - F.col("low"), step))
    return settle(counted(lengths, length_bin(F.col("length"))), split, buckets, gap)


def pack(docs: DataFrame, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """One row per batch: bucket, its padded length, the documents and sums."""
    rows = stored(text_lengths(docs).withColumn("row", F.monotonically_increasing_id()), "lengths")
    lengths = stored(rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "histogram")
    tops, sizes = global_boundaries(lengths, buckets)
    slices = [max(1, -(-s // SLICE_ROWS)) for s in sizes]
    capacity = [max(1, budget // max(1, t)) for t in tops]

    def pick(values: list[int]):
        return F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("bucket"))
    edges = F.array(*[F.lit(t).cast("long") for t in tops])
    placed = rows.withColumn("bucket", F.size(F.filter(edges, lambda t: t < F.col("length"))))
    placed = placed.withColumn("slice", F.pmod(F.xxhash64("row"), pick(slices)))
    before = (placed.groupBy("bucket", "slice").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.sum("n").over(Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
              .select("bucket", "slice", F.coalesce("before", F.lit(0)).alias("before")))
    numbered = (placed.withColumn("number", F.row_number().over(Window.partitionBy("bucket", "slice").orderBy("row")))
                .join(before, ["bucket", "slice"])
                .withColumn("batch", F.floor((F.col("number") - 1 + F.col("before")) / pick(capacity))))
    batches = numbered.groupBy("bucket", "batch").agg(F.sort_array(F.collect_list(F.struct("row", "doc_id", "length"))).alias("docs"))
    padded = pick(tops)
    n_tokens = F.aggregate("docs", F.lit(0).cast("long"), lambda acc, d: acc + d["length"])
    return batches.select(
        "bucket", "batch", padded.alias("padded_length"), F.size("docs").cast("long").alias("n_docs"), n_tokens.alias("n_tokens"),
        (padded * F.size("docs") - n_tokens).alias("padding"),
        F.transform("docs", lambda d: d["doc_id"]).alias("doc_ids"), F.transform("docs", lambda d: d["length"]).alias("lengths"))
