"""Byte-level BPE encoding and decoding with a given rank file.

Merging is a Spark higher-order function: a word's bytes become an array of
pieces and ``aggregate`` folds ranked merges over it -- every step joins the
leftmost neighbours of lowest rank, until no neighbours have a rank.  A piece
is one number: the rank it has with its right neighbour, its place in the word
and its id, in that order, so the least number is the pair to merge.  Ranks
come from a map (left id, right id) -> rank, laid out as two arrays: rows of
pairs, shifted so that they interlock, make one array of cells, so that a
look-up is two array accesses and one comparison.  The bytes' own pairs are
ranked in numpy.  The two arrays are a table
of one row that is broadcast to the rows of words, many words a row; as
literals they would stand in every description of the plan that the driver
keeps.

A word that is itself in the rank file is one id.  Other words are counted
over the whole corpus (pre-summed in each task), and the
``DICTIONARY_WORDS`` most frequent are folded once and broadcast.  That bound
only decides where a word is folded: blocks of texts carry their remaining
distinct words through the same fold expression, without a shuffle.  A fold
step copies the word, so a fold is quadratic in the word: words of more than
``LONG_WORD_BYTES`` take the same merges from a heap instead.

Decoding concatenates the binary pieces of the ids.

Defined cases: null text counts as empty and encodes to no ids; repeated rows
and null doc_ids are encoded like any other; texts without any word outside
the dictionary skip the fold; no rows give no rows.  A rank file has to hold
all 256 single bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from revisit.llm import kernel as K
from revisit.llm.store import stored
from revisit.llm.token_split import DistinctWords, WordTable, ragged

DICTIONARY_WORDS = 700_000      # about 40 MB in each Python worker
DICTIONARY_WORD_BYTES = 64      # longer words are left to the texts' own fold
LONG_WORD_BYTES = 512           # longer words are merged with a heap
SPLIT_BYTES = 1 << 19
COUNT_ROWS = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


MAX_IDS = 65536
SPREAD = 1021                # odd: a row and a right id determine the left id
DRAWS = 10_000
ID_BITS, PLACE_AT, RANK_AT = 17, 20, 40      # of a piece: id, place in the word, rank
NO_RANK = 1 << ID_BITS
NO_PAIR = 1 << 62            # of an empty cell: no pair comes near it
MAX_PLACES = 1 << (RANK_AT - PLACE_AT)


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """{(left id, right id): rank of the joined piece}."""
    out = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
            if left is not None and right is not None:
                out[left, right] = rank
    return out


def interlock(pairs: dict[tuple[int, int], int]) -> tuple[list[int], list[int]]:
    """(shift of each row, cells holding pair and rank or ``NO_PAIR``): a pair of
    row (left + SPREAD * right) % 65536 is at cell shift + right and nowhere
    else."""
    rows: list[list[tuple[int, int]]] = [[] for _ in range(MAX_IDS)]
    for left, right in pairs:
        rows[(left + SPREAD * right) % MAX_IDS].append((left, right))
    n_shifts = max(1, 2 * len(pairs))
    shifts, cells = [0] * MAX_IDS, [NO_PAIR] * (n_shifts + MAX_IDS + 1)
    draw = random.Random(0)
    for row in sorted((r for r in range(MAX_IDS) if rows[r]), key=lambda r: -len(rows[r])):
        for _ in range(DRAWS):
            shift = draw.randrange(n_shifts)
            if all(cells[shift + right] == NO_PAIR for _, right in rows[row]):
                break
        else:
            shift = len(cells)      # a place of its own
            cells += [NO_PAIR] * (MAX_IDS + 1)
        shifts[row] = shift
        for left, right in rows[row]:
            cells[shift + right] = (left << ID_BITS | right) << ID_BITS | pairs[left, right]
    return shifts, cells


class Ranks:
    """The rank file and its literal columns."""

    def __init__(self, ranks: dict[bytes, int]):
        if ranks and max(ranks.values()) >= MAX_IDS:
            raise ValueError("ids of 65536 and more are not supported")
        self.by_piece = ranks
        self.end = max(ranks.values(), default=-1) + 1      # stands before and after a word; in no pair
        self.shifts, self.cells = interlock(pair_ranks(ranks))
        self.byte_ids = np.array([ranks.get(bytes([i]), 0) for i in range(256)], np.int64)
        self.byte_pairs = np.array([[ranks.get(bytes([i, j]), NO_RANK) for j in range(256)] for i in range(256)], np.int64)

    def pieces(self) -> BytePieces:
        return BytePieces(self.byte_ids, self.byte_pairs, self.end)

    def fold(self, df: DataFrame, column: str) -> DataFrame:
        """``df`` with ``ids``: the merges folded over each array of an array
        column of byte pieces.  The two arrays are read once a row of ``df``."""
        arrays = pa.table(lists(np.array(self.shifts, np.int32), np.array(self.cells, np.int64)), names=["_shifts", "_cells"])
        tables = F.broadcast(df.sparkSession.createDataFrame(arrays))
        words = F.col(column)
        folded = let(F.struct("_shifts", "_cells"), lambda t: F.transform(words, lambda b: fold_merges(b, RankColumns(t))))
        return df.crossJoin(tables).select(*df.columns, folded.alias("ids"))


class BytePieces:
    """Words as their bytes' pieces, with an end mark at both sides."""

    def __init__(self, byte_ids: np.ndarray, byte_pairs: np.ndarray, end: int):
        self.byte_ids, self.byte_pairs, self.end = byte_ids, byte_pairs, end

    def __call__(self, data: np.ndarray, off: np.ndarray) -> pa.Array:
        length = np.diff(off)
        if length.max(initial=0) + 2 > MAX_PLACES:
            raise ValueError("a word of 2 ** 20 bytes and more is not folded")
        ends = np.r_[0, np.cumsum(length + 2)]
        place = np.arange(ends[-1]) - np.repeat(ends[:-1], length + 2)
        ids, rank = np.full(ends[-1], self.end), np.full(ends[-1], NO_RANK)
        at = ragged(ends[:-1] + 1, length)          # of each byte
        ids[at] = self.byte_ids[data]
        pair = np.ones(len(data), bool)
        pair[off[1:][length > 0] - 1] = False       # a word's last byte
        left = np.flatnonzero(pair)
        rank[at[left]] = self.byte_pairs[data[left], data[left + 1]]
        values = pa.array(rank << RANK_AT | place << PLACE_AT | ids)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def bits(value: Column, low: int, high: int) -> Column:
    """``value`` with its bits from ``low`` to ``high`` alone."""
    return value.bitwiseAND(F.lit((1 << high) - (1 << low)).cast("long"))


class RankColumns:
    def __init__(self, tables: Column):
        self.shifts, self.cells = tables["_shifts"], tables["_cells"]

    def joined(self, left: Column, right: Column) -> Column:
        """Rank of two neighbouring ids joined, or ``NO_RANK``: a cell of
        another pair differs in the bits above the rank."""
        shift = F.get(self.shifts, bits(left + right * SPREAD, 0, 16).cast("int"))
        pair = F.shiftleft(left, 2 * ID_BITS) + F.shiftleft(right, ID_BITS)
        return F.least(F.get(self.cells, shift + right.cast("int")).bitwiseXOR(pair), F.lit(NO_RANK).cast("long"))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(first: Column, table: RankColumns) -> Column:
    """Ids of one word: the ranked merges folded over the pieces of its bytes.

    A step replaces the least piece, which is the leftmost of lowest rank, and
    its right neighbour by the piece of the joined id (an id is its piece's
    rank), and ranks it with its two neighbours."""
    def merge(pieces: Column, best: Column, at: Column) -> Column:      # 1-based; the end marks stand outside
        new, before, after = F.shiftright(best, RANK_AT), F.get(pieces, at - 2), F.get(pieces, at + 1)
        left = F.shiftleft(table.joined(bits(before, 0, ID_BITS), new), RANK_AT) + bits(before, 0, RANK_AT)
        joined = F.shiftleft(table.joined(new, bits(after, 0, ID_BITS)), RANK_AT) + bits(best, PLACE_AT, RANK_AT) + new
        return F.concat(F.slice(pieces, F.lit(1), at - 2), F.array(left, joined), F.slice(pieces, at + 2, F.size(pieces)))

    def step(pieces: Column, _: Column) -> Column:
        return let(F.array_min(pieces), lambda best: F.when(best >= F.lit(NO_RANK << RANK_AT).cast("long"), pieces).otherwise(
            let(F.array_position(pieces, best).cast("int"), lambda at: merge(pieces, best, at))))
    return F.aggregate(first, first, step, lambda pieces: F.transform(
        F.slice(pieces, F.lit(2), F.size(pieces) - 2), lambda piece: bits(piece, 0, ID_BITS).cast("int")))


def text_blocks(batch: pa.RecordBatch, column: int, max_bytes: int = SPLIT_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of blocks of whole texts."""
    data, off = K.text_buffer(batch.column(column))
    for lo, hi in K.blocks(off, max_bytes):
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]


def binary_array(data: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def count_words(docs: DataFrame, pattern: str, skip: WordTable) -> DataFrame:
    """(word, n) over all texts but for the words to skip and long ones (those are folded with their text)."""
    broadcast = docs.sparkSession.sparkContext.broadcast(skip)

    def summed(held: list[tuple]) -> pa.RecordBatch:
        """Counts of several blocks by the words' hashes: a collision may lose
        a word here, which is then folded with its texts."""
        hashes, counts, data, lengths = (np.concatenate(x) for x in zip(*held))
        code, heads = pd.factorize(hashes)[0], np.unique(hashes, return_index=True)[1]
        heads.sort()      # codes are numbered by first appearance
        start = (np.cumsum(lengths) - lengths)[heads]
        words = binary_array(data[ragged(start, lengths[heads])], np.r_[0, np.cumsum(lengths[heads])])
        return pa.RecordBatch.from_arrays([words, pa.array(np.bincount(code, counts, len(heads)).astype(np.int64))], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, data, off in text_blocks(batch, 0):
                words = DistinctWords(data, off, pattern)
                rows = np.flatnonzero((words.length <= DICTIONARY_WORD_BYTES) & (broadcast.value.find(words) < 0))
                held.append((words.hash[rows], words.counts()[rows], words.flat(rows)[0], words.length[rows]))
                size += len(rows)
                if size >= COUNT_ROWS:
                    yield summed(held)
                    held, size = [], 0
        if size:
            yield summed(held)
    return (docs.where(F.length("text") > 0).select("text").mapInArrow(run, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def frequent_words(counted: DataFrame, words: int) -> DataFrame:
    """The most frequent words, at most ``words`` of them: those above the
    lowest frequency step that fits (a histogram of a few hundred steps; no
    task ranks all words)."""
    step = F.floor(4 * F.log2(F.col("n").cast("double"))).cast("int")
    sizes = counted.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    least, total = None, 0
    for r in sizes:
        total += r["count"]
        if total > words:
            break
        least = r["step"]
    return counted.where(step >= least) if least is not None else counted.where("false")


def table_of(words: pa.Array, ids: np.ndarray, ids_off: np.ndarray) -> WordTable:
    return WordTable(*K.text_buffer(words), ids, ids_off)


def word_dictionary(docs: DataFrame, ranks: Ranks, pattern: str, words: int = DICTIONARY_WORDS) -> WordTable:
    """Ids of the rank file's own words and of the most frequent others, a
    bounded table."""
    spark = docs.sparkSession
    pieces, own = pa.array(list(ranks.by_piece), pa.binary()), np.array(list(ranks.by_piece.values()), np.int32)
    known = table_of(pieces, own, np.arange(len(own) + 1))
    top = frequent_words(stored(count_words(docs, pattern, known), "words"), words)
    pieces_of = ranks.pieces()

    def with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.text_buffer(batch.column(0))
            yield pa.RecordBatch.from_arrays(lists(batch.column(0), pieces_of(data, off)), names=["words", "first"])
    listed = (top.select("word").repartition(2 * spark.sparkContext.defaultParallelism, "word")
              .mapInArrow(with_bytes, "words array<binary>, first array<array<long>>"))
    rows = ranks.fold(listed, "first").select("words", "ids").toArrow()
    if not rows.num_rows:
        return known
    found = rows["ids"].combine_chunks().flatten()
    sizes = np.r_[np.ones(len(own), np.int64), found.value_lengths().to_numpy()]
    return table_of(pa.chunked_array([pieces, rows["words"].combine_chunks().flatten()]),
                    np.r_[own, found.flatten().to_numpy()], np.r_[0, np.cumsum(sizes)])


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long word: the same merges, lowest rank and then leftmost
    first, from a heap over linked pieces, in O(n log n)."""
    n = len(word)
    end = list(range(1, n + 1))                 # a piece begins at i and ends at end[i]; 0 once it is joined to the left
    before = list(range(-1, n))
    find = ranks.get
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := find(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != to:
            continue                            # one of the two pieces has changed since
        end[i], end[middle] = to, 0
        if to < n:
            before[to] = i
            if (rank := find(word[i:end[to]])) is not None:
                heapq.heappush(heap, (rank, i, end[to]))
        left = before[i]
        if left >= 0 and (rank := find(word[left:to])) is not None:
            heapq.heappush(heap, (rank, left, to))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


def lists(*columns) -> list[pa.Array]:
    """Each column as one row that lists it."""
    return [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c if isinstance(c, pa.Array) else pa.array(c)) for c in columns]


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in as few bytes each as the largest takes; a
    batch of many blocks waits between Spark and its workers."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if values.max(initial=0) <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def unpack(data) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return raw[1:].view(f"u{raw[0]}").astype(np.int64)


def encode_words(docs: DataFrame, ranks: dict[bytes, int], pattern: str, per_text, schema: str,
                 words: int = DICTIONARY_WORDS) -> DataFrame:
    """``per_text(doc_id, ids as int32 array) -> tuple`` over every text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    loaded = Ranks(ranks)
    known = docs.sparkSession.sparkContext.broadcast((word_dictionary(rows, loaded, pattern, words), ranks))
    pieces_of = loaded.pieces()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block: its keys, words a text, number of each word
        in the block, ids a distinct word (-1: to be folded), ids of the words
        found, byte pieces of those to be folded.  Texts and table stay here."""
        table, by_piece = known.value
        for batch in batches:
            for lo, hi, data, off in text_blocks(batch, 1):
                found = DistinctWords(data, off, pattern)
                row = table.find(found)
                long = np.flatnonzero((row < 0) & (found.length > LONG_WORD_BYTES))
                ids = [merge_long(data[a:a + n].tobytes(), by_piece) for a, n in zip(found.start[long].tolist(), found.length[long].tolist())]
                size, hit = np.full(len(row), -1, np.int64), np.flatnonzero(row >= 0)
                size[hit], size[long] = table.ids_length[row[hit]], [len(x) for x in ids]
                flat = np.r_[table.ids[ragged(table.ids_start[row[hit]], size[hit])], np.array([i for x in ids for i in x], np.int32)]
                missing, ends = found.flat(np.flatnonzero(size < 0))
                known_first = np.r_[hit, long]                  # the order of the flat ids
                packed = (np.diff(found.first), found.code, size + 1, known_first, flat)
                yield pa.RecordBatch.from_arrays(
                    [*lists(batch.column(0).slice(lo, hi - lo)), *[pa.array([pack(x)], pa.binary()) for x in packed], *lists(pieces_of(missing, ends))],
                    names=[*carried, "bytes"])
    carried = ["keys", "sizes", "codes", "lengths", "order", "flat"]
    chunks = rows.mapInArrow(gather, "keys array<long>, " + "".join(f"{c} binary, " for c in carried[1:]) + "bytes array<array<long>>")
    folded = loaded.fold(chunks, "bytes").select(*carried, "ids")
    names = [part.split()[0] for part in schema.split(",")]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lays the ids of the words out in the order of the texts."""
        for batch in batches:
            for keys, *arrays, ids in zip(*(batch.column(i) for i in range(7))):
                sizes, code, length, order, flat = (unpack(a.as_buffer()) for a in arrays)
                length -= 1
                miss = np.flatnonzero(length < 0)
                length[miss] = ids.values.value_lengths().to_numpy()
                order = np.r_[order, miss]
                start = np.zeros(len(length), np.int64)
                start[order] = np.cumsum(length[order]) - length[order]
                flat = np.r_[flat.astype(np.int32), ids.values.flatten().to_numpy().astype(np.int32)]
                each = length[code]
                listed = flat[ragged(start[code], each)]
                ends = np.r_[0, np.cumsum(each)][np.r_[0, np.cumsum(sizes)]].tolist()
                out = [per_text(key, listed[a:b]) for key, a, b in zip(keys.as_py(), ends, ends[1:])]
                yield pa.RecordBatch.from_pydict({name: list(column) for name, column in zip(names, zip(*out))})
    return folded.mapInArrow(finish, schema)


def decode(ids: np.ndarray, pieces: list[bytes]) -> bytes:
    return b"".join([pieces[i] for i in ids.tolist()])


def id_pieces(ranks: dict[bytes, int]) -> list[bytes]:
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pieces


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every text."""
    return encode_words(docs, read_ranks(path), pattern, lambda key, ids: (key, ids.tolist()), "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    ranks = read_ranks(path)
    pieces = id_pieces(ranks)
    numbers = [str(i) for i in range(len(pieces))]

    def per_text(key: int, ids: np.ndarray) -> tuple:
        listed = ids.tolist()
        return (key, len(listed), hashlib.sha256(" ".join([numbers[i] for i in listed]).encode()).hexdigest(),
                hashlib.sha256(decode(ids, pieces)).hexdigest())
    return encode_words(docs, ranks, pattern, per_text, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
