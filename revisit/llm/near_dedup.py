"""MinHash near-dedup: a chosen-path set similarity join.

A document is its set of distinct word shingles.  Equal sets are one class;
each class has ``TOKENS`` minwise tokens.  ``TREES`` independent trees branch
the classes: a node chooses ``BRANCH`` token positions (a function of its
path) and sends every class to the children named by its tokens there, so a
pair of similarity s stays together in at least one child with probability
1 - (1 - s) ** 2 per level, and nodes with a single class end at once.  Below
depth ``FIRST_DEPTH`` about 0.97 of the pairs at similarity 0.85 share a node
of a tree; with four trees about one in a million is missed.

Only classes that still share a node there are looked up again with their
full sets.  Comparing follows the components found so far:

- first every class meets the smallest class of its nodes (one candidate a
  class, the likeliest by its tokens, confirmed on full sets): a star instead
  of all pairs, which joins large groups of copies;
- nodes whose classes are all in one component are done.  In the others a
  class stays if it has a possible partner there: of another component, of a
  size that allows the similarity (exact), and with so many equal tokens that
  a pair at the threshold has fewer with a chance of at most ``MISSED``, far
  below that of the trees.  Classes that met at random end here and send no
  full sets.  If a node is small (``NODE_ROWS`` classes, ``NODE_SHINGLES``
  shingles), the full sets that stay are compared in one task by counting all
  intersections, and links between components are reported, one for each pair of components joined.  One tree
  is compared before the others, which then only see what is left;
- larger mixed nodes branch on; at ``MAX_DEPTH`` they are cut into blocks and
  every pair of blocks is compared.

Defined cases: null or empty texts and texts without words have the empty set
and link to nothing; rows that repeat a doc_id are one document with several
sets; rows with a null doc_id link to nothing, have a null component and are
kept; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revisit.llm import kernel as K
from revisit.llm.components import components
from revisit.llm.fingerprints import PERMUTATIONS as TOKENS, minhash
from revisit.llm.store import semi_join, stored

TREES = 4
BRANCH = 2
FIRST_DEPTH = 3
MAX_DEPTH = 8
NODE_ROWS = 4096
NODE_SHINGLES = 4_000_000
DENSE_CELLS = 30_000_000
MISSED = 1e-9
PATHS = "tree byte, path long, sid binary"


def shingle_table(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, set size, set id (digest of the set), minwise tokens."""
    def build(data: np.ndarray, off: np.ndarray, table: pa.RecordBatch) -> dict:
        w = K.Words(data, off)
        sets = K.distinct_sets(w, w.hashes(K.LOWER), k)
        return {"doc_id": table.column(0), "n_shingles": np.array([len(s) for s in sets], np.int64),
                "sid": [set_id(s) for s in sets], "tokens": [minhash(s).tobytes() if len(s) else b"" for s in sets]}
    return K.map_texts(docs, "doc_id long, n_shingles long, sid binary, tokens binary", build)


def set_id(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    def build(data: np.ndarray, off: np.ndarray, table: pa.RecordBatch) -> dict:
        w = K.Words(data, off)
        sets = K.distinct_sets(w, w.hashes(K.LOWER), k)
        return {"sid": [set_id(s) for s in sets], "members": [s.tobytes() for s in sets]}
    return K.map_texts(docs, "sid binary, members binary", build)


def children(path: np.ndarray, tokens: np.ndarray) -> list[np.ndarray]:
    """Paths of the children each row goes to."""
    at = K.mix(path ^ np.uint64(0xA0761D6478BD642F))
    first = (at % np.uint64(TOKENS)).astype(np.int64)
    step = ((at >> np.uint64(32)) % np.uint64(TOKENS - 1)).astype(np.int64) + 1
    rows = np.arange(len(path))
    out = []
    for c in range(BRANCH):
        i = (first + c * step) % TOKENS
        out.append(K.mix(path * np.uint64(0x9E3779B97F4A7C15) + K.mix(tokens[rows, i].astype(np.uint64) + (i.astype(np.uint64) << np.uint64(32)))))
    return out


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def roots(classes: DataFrame, trees: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _tokens(batch.column(1))
            for tree in range(trees):
                root = np.full(len(tokens), K.mix(np.array([tree + 1], np.uint64))[0])
                for path in children(root, tokens):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(path), tree, np.int8)), pa.array(path.view(np.int64)), batch.column(0)],
                                                     names=["tree", "path", "sid"])
    return classes.select("sid", "tokens").mapInArrow(run, PATHS)


def branch(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Children of nodes: ``rows`` (tree, path, sid) of nodes that branch on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in children(batch.column(1).to_numpy().view(np.uint64), _tokens(batch.column(3))):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(path.view(np.int64)), batch.column(2)], names=["tree", "path", "sid"])
    return rows.join(classes, "sid").select("tree", "path", "sid", "tokens").mapInArrow(run, PATHS)


def shared(rows: DataFrame) -> DataFrame:
    """Rows whose node holds more than one class."""
    nodes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("path")
    return rows.join(nodes, "path").select("tree", "path", "sid")


def estimate(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(a, b, likeness) of the pairs whose tokens agree often enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likeness = (_tokens(batch.column(2)) == _tokens(batch.column(3))).mean(axis=1)
            keep = pa.array(likeness >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(likeness).filter(keep)],
                                             names=["a", "b", "likeness"])
    both = (pairs.join(classes.select(F.col("sid").alias("a"), F.col("tokens").alias("x")), "a")
            .join(classes.select(F.col("sid").alias("b"), F.col("tokens").alias("y")), "b"))
    return both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary, likeness double")


def confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs with den * intersection >= num * union on their full sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                if den * min(len(x), len(y)) < num * max(len(x), len(y)):
                    keep.append(False)
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * common >= num * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in range(2)], names=["a", "b"])
    needed = semi_join(sets, pairs.select(F.col("a").alias("sid")).union(pairs.select("b")), "sid")
    both = (pairs.select("a", "b").join(needed.select(F.col("sid").alias("a"), F.col("members").alias("x")), "a")
            .join(needed.select(F.col("sid").alias("b"), F.col("members").alias("y")), "b"))
    return both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def repeated_shingles(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, number) of each shingle that occurs in two sets or more, set after
    set, and the occurrences of each number."""
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable").astype(np.int32)
    values = values[order]
    number = np.cumsum(np.r_[False, values[1:] != values[:-1]][:len(values)], dtype=np.int32)
    del values
    df = np.bincount(number)
    column = np.cumsum(df > 1, dtype=np.int32) - 1
    column[df < 2] = -1
    token = np.empty_like(order)
    token[order] = column[number]
    del order, number
    used = token >= 0
    return np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])[used], token[used], df[df > 1]


def product(table: np.ndarray, rows: np.ndarray, columns: int = 1024) -> np.ndarray:
    """Common shingles of the given rows with all, by parts of the columns."""
    out = np.zeros((len(rows), len(table)), np.float32)
    for lo in range(0, table.shape[1], columns):
        part = table[:, lo:lo + columns].astype(np.float32)
        out += part[rows] @ part.T
    return out


def rows_of(batches: Iterator[pa.RecordBatch], columns: int, rows: int = 512) -> Iterator[tuple]:
    """Rows as Python values, a few hundred at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            part = batch.slice(lo, rows)
            yield from zip(*(part.column(i).to_pylist() for i in range(columns)))


def node_links(sets: list[np.ndarray], comp: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """Links between different components among a node's full sets.  All
    intersections are counted, for a block of sets at a time: by a product of
    0/1 matrices over the shingles that occur twice, or through an inverted
    index where that touches less; a component joined to another one is not
    reported again."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    ids: dict[bytes, int] = {}
    label = np.array([ids.setdefault(c, len(ids)) for c in comp])
    member, token, df = repeated_shingles(sets)
    n_columns = len(df)
    dense = n * n_columns <= DENSE_CELLS and n * n * n_columns < 60 * float((df.astype(float) ** 2).sum())
    if dense:
        table = np.zeros((n, n_columns), np.uint8)
        table[member, token] = 1
    else:
        by_token = np.argsort(token, kind="stable")
        postings, start = member[by_token], np.r_[0, np.cumsum(df)]
    first = np.searchsorted(member, np.arange(n + 1))
    out = []
    for lo in range(0, n, 256):
        rows = np.arange(lo, min(lo + 256, n))
        rows = rows[(label[rows][:, None] != label[None, :]).any(axis=1)] if (label != label[0]).any() else rows[:0]
        block = product(table, rows) if dense and len(rows) else None
        for i, x in enumerate(rows.tolist()):
            if dense:
                common = block[i]
            else:
                words = token[first[x]:first[x + 1]]
                m = df[words]
                at = np.repeat(start[words] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                common = np.bincount(postings[at], minlength=n)
            hits = np.flatnonzero((den * common >= num * (size[x] + size - common)) & (label != label[x]))
            while len(hits):
                y = int(hits[0])
                out.append((x, y))
                label[label == label[y]] = label[x]
                hits = hits[label[hits] != label[x]]
    return out


def least_agreeing(threshold: float) -> int:
    """Equal tokens to ask of a pair: one at the threshold has fewer with a
    chance of at most ``MISSED`` (binomial)."""
    below = 0.0
    for m in range(TOKENS):
        below += math.comb(TOKENS, m) * threshold ** m * (1 - threshold) ** (TOKENS - m)
        if below > MISSED:
            return m
    return TOKENS


def partnered(tokens: np.ndarray, size: np.ndarray, comp: np.ndarray, num: int, den: int, rows: int = 16) -> np.ndarray:
    """Marks the classes of a group that have a possible partner in it."""
    need = least_agreeing(num / den)
    keep = np.zeros(len(size), bool)
    for lo in range(0, len(size), rows):
        s, c = size[lo:lo + rows, None], comp[lo:lo + rows, None]
        x, y = np.nonzero((c != comp) & (den * np.minimum(s, size) >= num * np.maximum(s, size)))
        hit = (tokens[lo + x] == tokens[y]).sum(axis=1) >= need
        keep[lo + x[hit]] = keep[y[hit]] = True
    return keep


def likely(groups: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of ``groups`` (path, i, j, sid, comp) with a possible partner in their group."""
    names = ["path", "i", "j", "sid", "comp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        key = None

        def close() -> Iterator[pa.RecordBatch]:
            ids: dict[bytes, int] = {}
            comp = np.array([ids.setdefault(row[1], len(ids)) for row in held])
            tokens = np.frombuffer(b"".join(row[2] for row in held), np.uint32).reshape(-1, TOKENS)
            rows = np.flatnonzero(partnered(tokens, np.array([row[3] for row in held], np.int64), comp, num, den)).tolist()
            if rows:
                columns = [[part] * len(rows) for part in key] + [[held[r][c] for r in rows] for c in range(2)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                                                 names=names)
        for *k, sid, comp, tokens, size in rows_of(batches, 7):
            if k != key and held:
                yield from close()
                held = []
            key = k
            held.append((sid, comp, tokens, size))
        if held:
            yield from close()
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (groups.join(classes.select("sid", "tokens", "n_shingles"), "sid").select(*names, "tokens", "n_shingles")
            .repartition(parts, "path", "i", "j").sortWithinPartitions("path", "i", "j", "sid")
            .mapInArrow(run, "path long, i int, j int, sid binary, comp binary"))


def compare(groups: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) found inside each group of ``groups`` (path, i, j, sid, comp)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        key = None

        def close() -> pa.RecordBatch:
            found = node_links([m for _, _, m in held], [c for _, c, _ in held], num, den) if len(held) > 1 else []
            return pa.RecordBatch.from_pydict({"a": pa.array([held[x][0] for x, _ in found], pa.binary()),
                                               "b": pa.array([held[y][0] for _, y in found], pa.binary())})
        for *k, sid, comp, members in rows_of(batches, 6):
            if k != key and held:
                yield close()
                held = []
            key = k
            held.append((sid, comp, np.frombuffer(members, np.uint64)))
        if held:
            yield close()
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (groups.join(semi_join(sets, groups, "sid"), "sid").select("path", "i", "j", "sid", "comp", "members")
            .repartition(parts, "path", "i", "j").sortWithinPartitions("path", "i", "j", "sid")
            .mapInArrow(run, "a binary, b binary"))


def mixed_nodes(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of nodes with several components: (tree, path, sid, comp, n, shingles)."""
    known = rows.join(labels, "sid")
    nodes = (known.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"),
                                       F.min("comp").alias("low"), F.max("comp").alias("high"))
             .where("low < high").select("path", "n", "shingles"))
    return known.join(nodes, "path").select("tree", "path", "sid", "comp", "n", "shingles")


def block_pairs(mixed: DataFrame, rows_in_node: int, whole: bool) -> DataFrame:
    """Groups to compare: small nodes as they are; with ``whole`` also large
    ones, as all pairs of blocks of their rows."""
    small = (F.col("n") <= rows_in_node) & (F.col("shingles") <= NODE_SHINGLES)
    if not whole:
        return mixed.where(small).select("path", F.lit(0).alias("i"), F.lit(0).alias("j"), "sid", "comp")
    blocks = F.ceil(F.greatest(F.when(small, F.lit(1.0)).otherwise(2 * F.col("n") / rows_in_node), 2 * F.col("shingles") / NODE_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("sid"), "blocks").cast("int")
    return (mixed.withColumn("blocks", F.when(small, F.lit(1)).otherwise(blocks)).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("path", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "sid", "comp"))


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components (sid, comp) after joining them along the links."""
    ends = links
    for end in ("a", "b"):
        ends = ends.join(labels.select(F.col("sid").alias(end), F.col("comp").alias(f"{end}_comp")), end)
    found = components(ends.select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")))
    if found is None:
        return labels
    return stored(labels.join(found.withColumnRenamed("node", "comp"), "comp", "left")
                  .select("sid", F.coalesce("root", "comp").alias("comp"), "n_shingles"), "labels")


def similar_classes(docs: DataFrame, classes: DataFrame, k: int, num: int, den: int, trees: int = TREES,
                    node_rows: int = NODE_ROWS, max_depth: int = MAX_DEPTH) -> DataFrame | None:
    """(sid, comp) of the classes that share a deep node; None without any.
    ``classes``: sid, doc_id of one member, tokens, n_shingles."""
    threshold = num / den
    least = threshold - 5 * math.sqrt(threshold * (1 - threshold) / TOKENS)
    tokens = classes.select("sid", "tokens")
    rows = stored(shared(roots(tokens, trees)), "paths")
    for _ in range(1, FIRST_DEPTH):
        rows = stored(shared(branch(rows, tokens)), "paths")
    if not rows.limit(1).count():
        return None
    involved = stored(classes.join(rows.select("sid").distinct(), "sid", "left_semi"), "classes")
    tokens = involved.select("sid", "tokens")
    texts = semi_join(docs.select("doc_id", "text"), involved, "doc_id")
    sets = stored(full_sets(texts, k).join(involved.select("sid"), "sid", "left_semi").dropDuplicates(["sid"]), "sets")
    labels = involved.select("sid", F.col("sid").alias("comp"), "n_shingles")

    pivots = rows.groupBy("path").agg(F.min("sid").alias("pivot"))
    stars = rows.join(pivots, "path").where("sid <> pivot").select(F.col("pivot").alias("a"), F.col("sid").alias("b")).distinct()
    best = (estimate(stars, tokens, least).groupBy("b")
            .agg(F.max_by(F.struct("a"), F.struct("likeness", "a")).alias("best")).select(F.col("best.a").alias("a"), "b"))
    labels = relabel(labels, confirm(stored(best, "pairs"), sets, num, den))
    for depth in range(FIRST_DEPTH, max_depth + 1):
        for part in ("tree = 0", "tree > 0"):
            groups = block_pairs(mixed_nodes(rows.where(part), labels), node_rows, depth == max_depth)
            groups = stored(likely(groups, involved, num, den), "groups")
            labels = relabel(labels, compare(groups, sets, num, den))
        if depth == max_depth:
            break
        large = stored(mixed_nodes(rows, labels).where((F.col("n") > node_rows) | (F.col("shingles") > NODE_SHINGLES))
                       .select("tree", "path", "sid"), "large")
        if not large.limit(1).count():
            break
        rows = stored(shared(branch(large, tokens)), "paths")
    return labels


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked where
    den * intersection >= num * union of their k-word shingle sets."""
    table = stored(shingle_table(docs, k), "shingles")
    usable = table.where("doc_id is not null and n_shingles > 0")
    classes = stored(usable.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("tokens").alias("tokens"),
                                                 F.first("n_shingles").alias("n_shingles")), "classes")
    labels = similar_classes(docs, classes, k, num, den)
    # Classes, and rows of one doc_id with different sets, meet in a component.
    ends = usable.select("doc_id", "sid").distinct()
    if labels is not None:
        ends = ends.join(labels, "sid", "left").select("doc_id", F.coalesce("comp", "sid").alias("sid"))
    ends = stored(ends.distinct(), "ends")
    several = ends.groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("b")).where("a < b")
    same = ends.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("sid").alias("b"))
    merged = components(same)
    if merged is not None:
        ends = ends.join(merged.withColumnRenamed("node", "sid"), "sid", "left").select("doc_id", F.coalesce("root", "sid").alias("sid"))
    lowest = ends.groupBy("sid").agg(F.min("doc_id").alias("component_id"))
    by_doc = ends.join(lowest, "sid").select("doc_id", "component_id").distinct()
    return table.join(by_doc, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"))
