"""Document fingerprints: MinHash signatures, banded candidates, verification.

``fingerprint`` columns come from ``PERMUTATIONS`` universal hash functions
(multiply-shift) minimised over a text's distinct 5-word shingles in numpy.
``similar_documents`` joins signature bands in Spark
and confirms links on the full shingle sets: equal sets are one class, every
class of a band bucket meets the bucket's smallest one (a star), and buckets
that still hold several components are compared whole, in blocks.
``near_groups`` gives each document the smallest doc_id its links reach.
``with_next`` gives each row the next document in doc_id order without a
global window: doc_id ranges (quantile cuts) become buckets that are sorted
on their own, and each bucket also gets the first row of the next one.

Defined cases: null text counts as empty; a text without words has the empty
set and the all-ones signature, so two of them are alike (1.0) and one
against any other text is 0; repeated rows (equal doc_id) are ordered by
their text and count as documents of their own; rows with a null doc_id come
before all others; the last document's next is the first one, and a single
document is its own next; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revisit.llm import kernel as K
from revisit.llm.components import components
from revisit.llm.store import semi_join, stored

WORDS = 5
PERMUTATIONS = 64
BANDS = 16
SIMILARITY = 0.8
SEED = 20_250_401
EMPTY = np.uint32(0xFFFFFFFF)

_rng = np.random.default_rng(SEED)
MULTIPLIERS = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def minhash(shingles: np.ndarray, chunk: int = 1 << 14) -> np.ndarray:
    """Smallest hash of the set under each permutation."""
    best = np.full(PERMUTATIONS, EMPTY, np.uint32)
    for lo in range(0, len(shingles), chunk):
        part = shingles[lo:lo + chunk]
        hashed = (MULTIPLIERS[:, None] * part[None, :] + OFFSETS[:, None]) >> np.uint64(32)
        best = np.minimum(best, hashed.min(axis=1).astype(np.uint32))
    return best


def signatures(data: np.ndarray, off: np.ndarray, k: int = WORDS) -> np.ndarray:
    w = K.Words(data, off)
    return np.stack([minhash(s) for s in K.distinct_sets(w, w.hashes(), k)]) if w.n_docs else np.zeros((0, PERMUTATIONS), np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def to_text(sigs: np.ndarray) -> list[str]:
    return [s.astype(">u4").tobytes().hex() for s in sigs]


def bucket_cuts(docs: DataFrame, n: int) -> list[int]:
    """At most n - 1 doc_id cut points (a bounded list, approximate quantiles)."""
    cuts = docs.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)
    return sorted({int(x) for x in cuts})


def with_next(docs: DataFrame, per_pair, schema: str) -> DataFrame:
    """``per_pair(rows) -> RecordBatch`` over runs of consecutive documents in
    doc_id order; ``rows`` is a list of (doc_id, text) whose last entry is
    only the successor of the one before."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = bucket_cuts(rows, 4 * parts)
    at = F.lit(0)
    if cuts:
        edges = F.array(*[F.lit(c).cast("long") for c in cuts])
        at = F.size(F.filter(edges, lambda c: c <= F.col("doc_id")))
    at = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(at).cast("int")
    placed = rows.select(at.alias("bucket"), "doc_id", "text")
    # The first row of each bucket (a bounded table: one row a bucket) goes to the bucket before it.
    head_key = F.struct(F.col("doc_id").isNotNull(), "doc_id", F.xxhash64("text").alias("h"), "text")
    low = (placed.select("bucket", "doc_id").groupBy("bucket")
           .agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("low")).collect())
    lows = {r["bucket"]: r["low"]["doc_id"] for r in low}
    if not lows:
        return spark.createDataFrame([], schema)
    order = sorted(lows)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    first_null = any(v is None for v in lows.values())
    wanted = F.col("doc_id").isin([v for v in lows.values() if v is not None]) if any(v is not None for v in lows.values()) else F.lit(False)
    if first_null:
        wanted = wanted | F.col("doc_id").isNull()
    moves = F.create_map(*[F.lit(x) for b in order for x in (b, before[b])])
    heads = (placed.where(F.coalesce(wanted, F.lit(False))).groupBy("bucket").agg(F.min(head_key).alias("head"))
             .select(moves[F.col("bucket")].alias("bucket"), F.lit(1).alias("after"), F.col("head.doc_id").alias("doc_id"), F.col("head.text").alias("text")))
    dealt = (placed.select("bucket", F.lit(0).alias("after"), "doc_id", "text").unionByName(heads)
             .withColumn("h", F.xxhash64("text"))
             .repartition(parts, "bucket").sortWithinPartitions("bucket", "after", F.asc_nulls_first("doc_id"), "h", "text")
             .select("bucket", "after", "doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        bucket, size = None, 0
        for batch in batches:
            for b, after, key, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if b != bucket:
                    held, bucket, size = [], b, 0
                held.append((key, text))
                size += len(text)
                if len(held) > 1 and (after or size > 2 * K.BLOCK_BYTES):
                    yield per_pair(held)
                    held, size = held[-1:], len(text)
    return dealt.mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The last quarter replaced by as much of the next document's start."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + following[:quarter]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form, with likenesses."""
    def per_pair(rows: list) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        data, off = K.text_buffer(pa.array(texts + changed, pa.large_string()))
        sigs = np.concatenate([signatures(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]) for lo, hi in K.blocks(off)])
        n = len(changed)
        own, nxt, after = sigs[:n], sigs[1:n + 1], sigs[n + 1:]
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([k for k, _ in rows[:n]], pa.int64()), "n_chars": pa.array([len(t) for t in texts[:n]], pa.int64()),
            "edited_sha256": [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in changed],
            "fingerprint": to_text(own), "edited_fingerprint": to_text(after),
            "near_edited": likeness(own, after), "near_next": likeness(own, nxt)})
    return with_next(docs, per_pair, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                     "edited_fingerprint string, near_edited double, near_next double")


def similar_documents(docs: DataFrame, k: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS) -> DataFrame:
    """(doc_id, near_id, jaccard), doc_id > near_id: links of at least the
    given Jaccard similarity that join the same groups as all such pairs that
    share a band would.  A document with the shingle set of a smaller doc_id
    links to the smallest one of that set (1.0); sets are linked through those
    smallest documents.  Rows without words or without doc_id take no part."""
    from revisit.llm import near_dedup as N     # which takes its tokens from here
    share = Fraction(str(similarity))
    num, den = share.numerator, share.denominator

    def build(data: np.ndarray, off: np.ndarray, table: pa.RecordBatch) -> dict:
        w = K.Words(data, off)
        sets = K.distinct_sets(w, w.hashes(), k)
        return {"doc_id": table.column(0), "sid": [N.set_id(s) for s in sets], "n_shingles": np.array([len(s) for s in sets], np.int64),
                "fingerprint": [minhash(s).tobytes() for s in sets]}
    table = stored(K.map_texts(docs.where("doc_id is not null"), "doc_id long, sid binary, n_shingles long, fingerprint binary", build)
                   .where("n_shingles > 0"), "signatures")
    classes = stored(table.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("fingerprint").alias("fingerprint"),
                                              F.first("n_shingles").alias("n_shingles")), "classes")
    copies = (table.select("sid", "doc_id").distinct().join(classes.select("sid", F.col("doc_id").alias("near_id")), "sid")
              .where("doc_id > near_id").select("doc_id", "near_id", F.lit(1.0).alias("jaccard")))

    # Buckets are the nodes of op3's search: a star first, then what the components leave open, in blocks.
    width = 4 * PERMUTATIONS // bands
    banded = classes.select("sid", F.posexplode(F.array(*[
        F.substring("fingerprint", 1 + i * width, width) for i in range(bands)])).alias("band", "value"))
    rows = stored(N.shared(banded.select(F.lit(0).cast("byte").alias("tree"), F.xxhash64("band", "value").alias("path"), "sid")), "buckets")
    involved = stored(classes.select("sid", "doc_id", "n_shingles").join(rows.select("sid").distinct(), "sid", "left_semi"), "classes")

    def members(data: np.ndarray, off: np.ndarray, part: pa.RecordBatch) -> dict:
        w = K.Words(data, off)
        sets = K.distinct_sets(w, w.hashes(), k)
        return {"sid": [N.set_id(s) for s in sets], "members": [s.tobytes() for s in sets]}
    texts = semi_join(docs.select("doc_id", "text"), involved, "doc_id")
    full = stored(K.map_texts(texts, "sid binary, members binary", members)
                  .join(involved.select("sid"), "sid", "left_semi").dropDuplicates(["sid"]), "sets")
    pivots = rows.groupBy("path").agg(F.min("sid").alias("pivot"))
    stars = rows.join(pivots, "path").where("sid <> pivot").select(F.col("pivot").alias("a"), F.col("sid").alias("b")).distinct()
    first = stored(N.confirm(stars, full, num, den), "links")
    labels = N.relabel(involved.select("sid", F.col("sid").alias("comp"), "n_shingles"), first)
    rest = N.compare(N.block_pairs(N.mixed_nodes(rows, labels), N.NODE_ROWS, True), full, num, den)
    links = stored(first.union(rest).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                value.append(common / (len(x) + len(y) - common))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "near_id": batch.column(1), "jaccard": pa.array(value, pa.float64())})
    least = classes.select("sid", "doc_id")
    both = (links.join(full.select(F.col("sid").alias("a"), F.col("members").alias("x")), "a")
            .join(full.select(F.col("sid").alias("b"), F.col("members").alias("y")), "b")
            .join(least.select(F.col("sid").alias("a"), F.col("doc_id").alias("i")), "a")
            .join(least.select(F.col("sid").alias("b"), F.col("doc_id").alias("j")), "b")
            .where("i <> j").select(F.greatest("i", "j").alias("doc_id"), F.least("i", "j").alias("near_id"), "x", "y"))
    return both.mapInArrow(verify, "doc_id long, near_id long, jaccard double").union(copies).distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, near_id of every row: the smallest doc_id reached through links
    of ``similar_documents``, its own without a link, null for a null doc_id."""
    found = components(stored(similar_documents(docs), "near-links").select(F.col("doc_id").alias("a"), F.col("near_id").alias("b")))
    rows = docs.select("doc_id")
    if found is None:
        return rows.select("doc_id", F.col("doc_id").alias("near_id"))
    return (rows.join(found.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
            .select("doc_id", F.coalesce("root", "doc_id").alias("near_id")))
