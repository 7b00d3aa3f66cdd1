"""Hard-negative mining by segment summary filtering.

A vector is cut into equal segments, on several levels: 1, 2, 4, ... segments.
Each segment stores its mean m and its deviation s (root mean square distance
from the mean).  Over a segment of d components the inner product of two
vectors lies in d * (m * m' - s * s') to d * (m * m' + s * s'), so a level
bounds the whole score; finer levels bound it closer.  The summaries of a level
are one product of two matrices (means beside deviations), and only anchors and
rows that are still possible for someone go on to the next level and at last to
the exact score.

Anchors are taken in blocks of at most ``ANCHOR_ROWS``, which are broadcast;
all rows pass by in batches, in their own partitions, without a shuffle.  A
task keeps the first few rows of each list, which raises its bound from batch
to batch, and only those are merged over tasks: first the positives (best rows
of the anchor's label), then for each positive the best rows of other labels
inside its score range.

Defined cases: rows with a null vec_id, label or vector, or a null, infinite or
NaN component take no part; components are kept within 2 ** 20 after scaling,
so that scores fit 64 bits up to 2 ** 16 components; vectors of different lengths count as continued by
zeros; rows are told apart by their place, so a repeated row is a row of its
own (as anchor, positive and negative), but never positive of an anchor with
its own vec_id; no anchors give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from revisit.llm.store import stored

POSITIVES = NEGATIVES = 5
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10
LOW, HIGH, OF = 80, 100, 100          # range of a negative's score, in percent of the positive's
SEGMENTS = (1, 4, 16)                 # segments on each level
ANCHOR_ROWS = 4096                    # a block that is broadcast, and its lists in a task
BATCH_ROWS = 512                      # by a block's anchors: 16 MB a matrix
LARGEST = 1 << 20


def scaled_vectors(table: DataFrame) -> DataFrame:
    """vec_id, label (moved where vec_id is divisible by 7), integer components."""
    parts = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(x.cast("double") * 256, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))))
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    label = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label").cast("long") + 1) % LABELS).otherwise(F.col("label").cast("long"))
    return (table.select("vec_id", "label", "embedding").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
            .select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), parts.alias("vector")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles, continued by zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def summaries(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(means, deviations) of each vector's segments, times the root of their length."""
    width = -(-x.shape[1] // segments)
    parts = np.zeros((len(x), segments * width))
    parts[:, :x.shape[1]] = x
    parts = parts.reshape(len(x), segments, width)
    means = parts.mean(2)
    return means * np.sqrt(width), np.sqrt(np.maximum((parts - means[:, :, None]) ** 2, 0).sum(2))


class Vectors:
    """Vectors with their summaries; scores are exact integers."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, levels: tuple = SEGMENTS):
        self.ids, self.labels, self.x = ids, labels, x
        self.levels = [summaries(x, s) for s in levels if s <= max(1, x.shape[1])]
        self.largest = float(np.abs(x).max(initial=0))
        self.slack = 0.5 + 1e-9 * x.shape[1] * self.largest ** 2

    def bounds(self, other: "Vectors", level: int, mine: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) possible scores of the chosen rows of both."""
        (m, s), (n, t) = self.levels[level], other.levels[level]
        means, spread = m[mine] @ n[theirs].T, s[mine] @ t[theirs].T
        slack = self.slack + other.slack
        return means - spread - slack, means + spread + slack

    def scores(self, other: "Vectors", mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        if self.x.shape[1] * self.largest * other.largest < 2 ** 53:
            return (self.x[mine] @ other.x[theirs].T).astype(np.int64)
        return self.x[mine].astype(np.int64) @ other.x[theirs].astype(np.int64).T


def possible_pairs(anchors: Vectors, rows: Vectors, allowed: np.ndarray, low: np.ndarray, high: np.ndarray | None = None
                   ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the allowed pairs with low <= score <= high of
    the anchor.  Level after level, pairs out of bounds go, and so do anchors
    and rows without a pair; what is left is scored exactly."""
    mine, theirs = np.flatnonzero(allowed.any(1)), np.flatnonzero(allowed.any(0))
    left = allowed[np.ix_(mine, theirs)]
    for level in range(len(anchors.levels)):
        if not left.size:
            break
        least, most = anchors.bounds(rows, level, mine, theirs)
        left &= most >= low[mine, None]
        if high is not None:
            left &= least <= high[mine, None]
        some, any_ = left.any(1), left.any(0)
        mine, theirs, left = mine[some], theirs[any_], left[np.ix_(some, any_)]
    if not left.size:
        return mine[:0], theirs[:0], np.zeros(0, np.int64)
    score = anchors.scores(rows, mine, theirs)
    left &= score >= low[mine, None]
    if high is not None:
        left &= score <= high[mine, None]
    i, j = np.nonzero(left)
    return mine[i], theirs[j], score[i, j]


class Best:
    """The first ``k`` (score descending, vec_id) rows of each list."""

    def __init__(self, lists: int, k: int):
        self.k = k
        self.list = np.zeros(0, np.int64)
        self.score, self.id = self.list, self.list
        self.least = np.full(lists, -np.inf)      # no lower score enters the list

    def add(self, lists: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(lists):
            return
        lists, score, ids = np.r_[self.list, lists], np.r_[self.score, score], np.r_[self.id, ids]
        order = np.lexsort((ids, -score, lists))
        lists = lists[order]
        heads = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
        place = np.arange(len(lists)) - np.repeat(heads, np.diff(np.r_[heads, len(lists)]))
        keep = place < self.k
        self.list, self.score, self.id = lists[keep], score[order][keep], ids[order][keep]
        full = place == self.k - 1
        self.least[lists[full]] = score[order][full]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.list), pa.array(self.score), pa.array(self.id)], names=["list", "score", "vec_id"])


def row_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Vectors]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(lo, BATCH_ROWS)
            if part.num_rows:
                yield Vectors(part.column(0).to_numpy(), part.column(1).to_numpy(), matrix(part.column(2), width))


def first_of_lists(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each list over all tasks, with their rank."""
    order = Window.partitionBy("list").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_positives(rows: DataFrame, anchors: Vectors, k: int = POSITIVES) -> DataFrame:
    """(list = anchor's place, rank, vec_id, score) of the rows most like each
    anchor among those of its label."""
    held = rows.sparkSession.sparkContext.broadcast(anchors)
    width = anchors.x.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = held.value
        best = Best(len(a.ids), k)
        for part in row_batches(batches, width):
            allowed = (a.labels[:, None] == part.labels) & (a.ids[:, None] != part.ids)
            i, j, score = possible_pairs(a, part, allowed, best.least)
            best.add(i, score, part.ids[j])
        yield best.batch()
    return first_of_lists(rows.mapInArrow(run, "list long, score long, vec_id long"), k)


def best_negatives(rows: DataFrame, anchors: Vectors, positive: np.ndarray, positive_score: np.ndarray, k: int = NEGATIVES) -> DataFrame:
    """(list = a positive's place, rank, vec_id, score) of the best rows of
    another label within the score range; ``positive`` holds each positive's anchor."""
    low, high = -((-LOW * positive_score) // OF), HIGH * positive_score // OF
    held = rows.sparkSession.sparkContext.broadcast((anchors, positive, low, high))
    width = anchors.x.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, anchor, low, high = held.value
        best = Best(len(anchor), k)
        top = np.full(len(a.ids), -np.inf)
        np.maximum.at(top, anchor, high)
        for part in row_batches(batches, width):
            floor = np.full(len(a.ids), np.inf)       # the least score that any list of the anchor takes
            np.minimum.at(floor, anchor, np.maximum(low, best.least))
            i, j, score = possible_pairs(a, part, a.labels[:, None] != part.labels, floor, top)
            lists = [np.zeros(0, np.int64)] * 3
            if len(i):
                first, last = np.searchsorted(anchor, i), np.searchsorted(anchor, i, "right")    # lists come by anchor
                size = last - first
                own = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
                score, ids = np.repeat(score, size), np.repeat(part.ids[j], size)
                fits = (score >= low[own]) & (score <= high[own]) & (score >= best.least[own])
                lists = own[fits], score[fits], ids[fits]
            best.add(*lists)
        yield best.batch()
    return first_of_lists(rows.mapInArrow(run, "list long, score long, vec_id long"), k)


def mine_block(rows: DataFrame, block: pa.Table, width: int) -> DataFrame:
    """Rows of the result for one block of anchors."""
    spark = rows.sparkSession
    anchors = Vectors(block["vec_id"].to_numpy(), block["label"].to_numpy(), matrix(block["vector"], width))
    positives = best_positives(rows, anchors).orderBy("list", "rank").toArrow()      # at most POSITIVES for each anchor of the block
    place, ids, score = (positives[c].to_numpy() for c in ("list", "vec_id", "score"))
    names = spark.createDataFrame(pa.table({"list": np.arange(len(place)), "anchor_id": anchors.ids[place],
                                            "positive_id": ids, "positive_score": score}),
                                  "list long, anchor_id long, positive_id long, positive_score long")
    return best_negatives(rows, anchors, place, score).join(F.broadcast(names), "list").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine_negatives(table: DataFrame, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = stored(scaled_vectors(table).withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    anchors = rows.where(F.col("vec_id") % ANCHOR_EVERY == 0)
    blocks = -(-anchors.count() // anchor_rows)
    of_block = F.pmod(F.xxhash64("row"), F.lit(max(blocks, 1)))       # blocks of equal size but for chance
    rows, out = rows.drop("row"), None
    for b in range(blocks):
        found = stored(mine_block(rows, anchors.where(of_block == b).toArrow(), width), "negatives-block")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else rows.sparkSession.createDataFrame(
        [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
