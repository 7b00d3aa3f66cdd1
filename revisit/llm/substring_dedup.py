"""Substring dedup: repeated passages found in prefix-partitioned suffix groups.

Suffixes are word positions with at least ``WINDOW`` words to go; a suffix is
a repeat when its first 50 words also start in a document with a smaller
doc_id.  The suffix tree over them is never needed below that depth, so a
suffix is held as two prefix fingerprints: that of its anchor (the smallest
16-word gram hash inside its window, which equal windows share) and that of
its 50 words.

1. Every text yields its distinct anchors.  Anchors that occur in one
   document only head subtrees without an inner node and are dropped; only
   texts with a shared anchor go on.  A text equal in words to one of a
   smaller doc_id is settled at once.
2. The remaining suffixes are split by prefix: those under an anchor of at
   most ``GROUP_DOCS`` documents form one group, in which they are sorted by
   their deeper prefix (Spark's external sort); neighbours that agree on it
   are the leaves under one deep inner node.  Larger groups are split by the
   longer, 50-word prefix: the smallest doc_id of each is a pre-aggregated
   minimum that is joined back.
3. A text sends each distinct suffix once; it gets back the prints that
   repeat and cuts every window that carries one, which merges overlapping
   windows into its maximal repeats.

Defined cases: null text has no words; texts below 50 words are kept whole;
repeated rows (equal doc_id) never remove words of each other, since neither
id is smaller; rows with a null doc_id are kept whole and remove nothing; no
rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revisit.llm import kernel as K
from revisit.llm.store import anti_join, semi_join, stored

WINDOW = 50
ANCHOR = 16
GROUP_DOCS = 1000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def words_sha(data: bytes) -> str:
    return hashlib.sha256(b" ".join(data.split())).hexdigest()


def row_key(sha: str) -> int:
    """Tells rows of one doc_id with different words apart."""
    return int.from_bytes(bytes.fromhex(sha[:16]), "big", signed=True)


def suffix_prints(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, 50-word print) of each position with 50 words to go."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return h[:0], h[:0]
    least, width, span = K.gram_hashes(h, ANCHOR), 1, WINDOW - ANCHOR + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[:n], least[span - width:span - width + n]), K.gram_hashes(h, WINDOW)


def text_prints(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(raw, np.uint8)
    return suffix_prints(K.Words(data, np.array([0, len(data)])).hashes())


def document_table(docs: DataFrame) -> DataFrame:
    """doc_id, row key, word count, digest of the words, distinct anchors."""
    def build(data: np.ndarray, off: np.ndarray, table: pa.RecordBatch) -> dict:
        w = K.Words(data, off)
        anchors, _ = suffix_prints(w.hashes())
        raw = data.tobytes()
        shas = [words_sha(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        listed = [np.unique(anchors[a:a + n - WINDOW + 1]).view(np.int64) if n >= WINDOW else np.zeros(0, np.int64)
                  for a, n in zip(w.first[:-1].tolist(), w.count.tolist())]
        return {"doc_id": table.column(0), "row_key": np.array([row_key(s) for s in shas], np.int64),
                "n_words": w.count.astype(np.int64), "sha": shas, "anchors": pa.array(listed, pa.list_(pa.int64()))}
    return K.map_texts(docs, "doc_id long, row_key long, n_words long, sha string, anchors array<long>", build)


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list]]:
    """(text bytes, other columns) of each row; column 1 is the text."""
    for batch in batches:
        rest = [batch.column(i).to_pylist() for i in range(batch.num_columns) if i != 1]
        for text, *others in zip(batch.column(1), *rest):
            yield (text.as_py() or "").encode("utf-8", "surrogatepass"), others


def suffix_rows(texts: DataFrame) -> DataFrame:
    """Distinct suffixes of each text under shared anchors: (anchor, large,
    print, doc_id, row_key).  ``texts``: doc_id, text, row_key, shared."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*held)]
            return pa.RecordBatch.from_pydict(dict(zip(("anchor", "large", "print", "doc_id", "row_key"), cols)))
        for raw, (doc_id, key, shared) in _text_rows(batches):
            if row_key(words_sha(raw)) != key:
                continue      # another row of the same doc_id
            anchors, prints = text_prints(raw)
            values = np.array([s["anchor"] for s in shared], np.int64).view(np.uint64)
            large = np.array([s["large"] for s in shared], bool)
            order = np.argsort(values)
            values, large = values[order], large[order]
            prints, first = np.unique(prints, return_index=True)
            anchors = anchors[first]
            at = np.minimum(np.searchsorted(values, anchors), len(values) - 1)
            live = values[at] == anchors
            n = int(live.sum())
            held.append((anchors[live].view(np.int64), large[at[live]], prints[live].view(np.int64),
                         np.full(n, doc_id, np.int64), np.full(n, key, np.int64)))
            size += n
            if size > 100_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
    return texts.select("doc_id", "text", "row_key", "shared").mapInArrow(
        emit, "anchor long, large boolean, print long, doc_id long, row_key long")


def deep_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves under a deep inner node, but for those of its smallest doc_id;
    rows come sorted by (anchor, print, doc_id)."""
    last = None     # (anchor, print, smallest doc_id) of the node that is open
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, deep, doc = (batch.column(i).to_numpy() for i in range(3))
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (deep[1:] != deep[:-1])]
        heads = np.flatnonzero(new)
        least = doc[heads].copy()
        if last is not None and last[:2] == (anchor[0], deep[0]):
            least[0] = last[2]
        least_of = least[np.cumsum(new) - 1]
        last = (anchor[-1], deep[-1], least_of[-1])
        keep = pa.array(doc > least_of)
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (2, 3, 1)], names=["doc_id", "row_key", "print"])


def repeats(docs: DataFrame, group_docs: int = GROUP_DOCS) -> tuple[DataFrame, DataFrame]:
    """(documents, repeats): per row its words' digest and ``copy`` (all words
    repeat a smaller doc_id), and the repeated suffix prints per document."""
    table = stored(document_table(docs), "suffix-docs")
    copies = (table.where(f"doc_id is not null and n_words >= {WINDOW}").groupBy("sha")
              .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"))
    marked = table.join(copies, "sha", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("first")
    heads = marked.where(f"not copy and doc_id is not null and n_words >= {WINDOW}").select(
        "doc_id", "row_key", F.explode("anchors").alias("anchor"))
    live = (heads.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
            .where("lo < hi").select("anchor", (F.col("n") > group_docs).alias("large")))
    shared = stored(heads.join(live, "anchor").groupBy("doc_id", "row_key")
                    .agg(F.collect_list(F.struct("anchor", "large")).alias("shared")), "suffix-shared")
    texts = semi_join(docs.select("doc_id", "text"), shared, "doc_id").join(shared, "doc_id")
    rows = stored(suffix_rows(texts), "suffixes")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["anchor", "print", "doc_id", "row_key"]
    small = (rows.where("not large").select(columns).repartition(parts, "anchor").sortWithinPartitions("anchor", "print", "doc_id")
             .mapInArrow(deep_repeats, "doc_id long, row_key long, print long"))
    large = rows.where("large").select(columns)
    least = (large.groupBy("anchor", "print").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
             .where("least < most").drop("most"))
    split = large.join(least, ["anchor", "print"]).where("doc_id > least").select("doc_id", "row_key", "print")
    found = small.unionByName(split).groupBy("doc_id", "row_key").agg(F.collect_list("print").alias("prints"))
    return marked.select("doc_id", "row_key", "n_words", "sha", "copy"), found


def covered(raw: bytes, prints: list) -> np.ndarray:
    """Words of a text inside windows with one of the given prints."""
    _, own = text_prints(raw)
    start = np.flatnonzero(np.isin(own, np.asarray(prints, np.int64).view(np.uint64)))
    edge = np.zeros(len(raw.split()) + 1, np.int64)
    edge[start] += 1
    edge[start + WINDOW] -= 1
    return np.cumsum(edge[:-1]) > 0


def digest_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    marked, found = repeats(docs)
    found = stored(found, "suffix-found")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw, (doc_id, key, prints) in _text_rows(batches):
            if row_key(words_sha(raw)) == key:
                gone = covered(raw, prints)
                kept = hashlib.sha256(b" ".join([x for x, g in zip(raw.split(), gone) if not g])).hexdigest()
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id], pa.int64()), "row_key": pa.array([key], pa.int64()),
                                                  "cut": pa.array([int(gone.sum())], pa.int64()), "cut_sha": [kept]})
    cuts = (semi_join(docs.select("doc_id", "text"), found, "doc_id").join(found, "doc_id")
            .select("doc_id", "text", "row_key", "prints").mapInArrow(cut, "doc_id long, row_key long, cut long, cut_sha string")
            .dropDuplicates(["doc_id", "row_key"]))
    return marked.join(cuts, ["doc_id", "row_key"], "left").select(
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(EMPTY_SHA)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated words cut out of ``text``; texts without any
    keep their bytes, others keep the white space between kept words."""
    marked, found = repeats(docs)
    none = F.expr("cast(array() as array<bigint>)")
    whole = marked.where("copy").dropDuplicates(["doc_id", "row_key"]).select(
        "doc_id", F.struct("row_key", F.lit(True).alias("copy"), none.alias("prints")).alias("decision"))
    decisions = found.select("doc_id", F.struct("row_key", F.lit(False).alias("copy"), "prints").alias("decision")).unionByName(whole)
    per_doc = stored(decisions.groupBy("doc_id").agg(F.collect_list("decision").alias("decisions")), "suffix-decisions")

    def cut(text: str | None, found: list | None) -> str | None:
        if not text or found is None or not len(found):
            return text
        raw = text.encode("utf-8", "surrogatepass")
        key = row_key(words_sha(raw))
        for d in found:
            if d["row_key"] == key:
                if d["copy"]:
                    return ""
                data = np.frombuffer(raw, np.uint8)
                w = K.Words(data, np.array([0, len(data)]))
                gone = np.flatnonzero(covered(raw, d["prints"]))
                ends = np.r_[w.start[1:], len(data)]     # a word goes with the white space behind it
                mask = np.zeros(len(data) + 1, np.int64)
                np.add.at(mask, w.start[gone], 1)
                np.add.at(mask, ends[gone], -1)
                return data[np.cumsum(mask[:-1]) == 0].tobytes().decode("utf-8", "surrogatepass")
        return text
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = batch.column(0).flatten()
            texts = [cut(t, d.as_py()) for t, d in zip(arrays[at].to_pylist(), batch.column(1))]
            arrays[at] = pa.array(texts, arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, names=names)
    # Only texts that lose words meet their decisions; a row is held as one column, so its names cannot clash.
    touched = semi_join(docs, per_doc, "doc_id").select(*names).select(F.struct(*names).alias("row"))
    own = per_doc.select(F.col("doc_id").alias("touched_id"), "decisions")
    changed = touched.join(own, F.col("row.doc_id") == F.col("touched_id")).select("row", "decisions").mapInArrow(run, docs.schema)
    return anti_join(docs, per_doc, "doc_id").unionByName(changed)
