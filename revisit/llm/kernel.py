"""Vectorised text primitives on Arrow string batches.

A batch of texts is handled as one byte buffer with document offsets.  Words
are maximal runs of bytes other than space and ``\\x09-\\x0D`` (UTF-8 never
puts those bytes inside another code point), so word bounds, word hashes and
word n-gram hashes come from a few numpy passes over the buffer instead of a
Python loop over words.  Buffers are walked in blocks of whole documents of
about ``BLOCK_BYTES``; memory follows the block, or the longest single text.

Hashes are 64-bit polynomial hashes over bytes, finalised with a mixer; they
depend on the bytes alone, so equal words have equal hashes in any task.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_BYTES = 1 << 20
HASH_BYTES = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_GRAM = 0xD6E8FEB86659FD93

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
KEEP = np.arange(256, dtype=np.uint8)
LOWER = KEEP.copy()
LOWER[65:91] += 32

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def release() -> None:
    """Give what is freed back to the system: a worker lives on from task to
    task, and the C library keeps the space of an earlier one's arrays."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc has it
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _grow_powers(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, HASH_BYTES + 4096)
        _powers = np.cumprod(np.r_[_U(1), np.full(size - 1, _BASE, np.uint64)])
        _inverses = np.cumprod(np.r_[_U(1), np.full(size - 1, _BASE_INV, np.uint64)])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def blocks(off: np.ndarray, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``max_bytes`` of text, one row at least."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """Word bounds of the documents of one block."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off, self.n_docs = data, off, len(off) - 1
        word = ~IS_SPACE[data]
        self.word = word
        n = len(data)
        edge = np.zeros(n + 1, bool)      # a text begins here
        edge[off[:-1]] = True
        edge[n] = True
        if n:
            before = np.r_[False, word[:-1]] & ~edge[:-1]
            after = np.r_[word[1:], False] & ~edge[1:]
            self.start = np.flatnonzero(word & ~before)
            self.end = np.flatnonzero(word & ~after) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, off)   # index of each text's first word
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.count)

    def hashes(self, fold: np.ndarray = KEEP) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end, fold)

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, ok) of the k words from each position on; ``ok`` marks
        positions whose k words lie in one text."""
        n = len(hashes)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        return gram_hashes(hashes, k), self.doc[:n - k + 1] == self.doc[k - 1:]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray = KEEP) -> np.ndarray:
    """Hash of each byte span; spans ascend and do not overlap."""
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        base = int(start[lo])
        hi = max(lo + 1, int(np.searchsorted(end, base + HASH_BYTES, "right")))
        seg = fold[data[base:int(end[hi - 1])]]
        _grow_powers(len(seg) + 1)
        sums = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum((seg.astype(np.uint64) + _U(1)) * _powers[:len(seg)], out=sums[1:])
        s, e = start[lo:hi] - base, end[lo:hi] - base
        out[lo:hi] = mix((sums[e] - sums[s]) * _inverses[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive values, by doubling."""
    done, length, power, width, rest = None, 0, h, 1, k
    while rest:
        if rest & 1:
            if done is None:
                done, length = power, width
            else:
                step = _U(pow(_GRAM, width, 1 << 64))
                m = len(h) - (length + width) + 1
                done, length = done[:m] * step + power[length:length + m], length + width
        rest >>= 1
        if rest:
            m = len(h) - 2 * width + 1
            power = power[:m] * _U(pow(_GRAM, width, 1 << 64)) + power[width:width + m]
            width *= 2
    return mix(done)


def per_text(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of a byte-level mask in each text."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def repeat_counts(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each element: how often its value occurs in its text."""
    if not len(value):
        return np.zeros(0, np.int64)
    key = mix(value + mix(doc.astype(np.uint64) + _U(1)))
    order = np.argsort(key)
    same = key[order]
    heads = np.flatnonzero(np.r_[True, same[1:] != same[:-1]])
    sizes = np.diff(np.r_[heads, len(same)])
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(sizes, sizes)
    return out


def distinct_sets(w: Words, h: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text; a shorter text with
    words has its whole sequence as one shingle, one without words has none."""
    grams, _ = w.grams(h, k)
    out = []
    for a, n in zip(w.first[:-1].tolist(), w.count.tolist()):
        if n >= k:
            out.append(np.unique(grams[a:a + n - k + 1]))
        elif n:
            out.append(gram_hashes(h[a:a + n], n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def map_texts(df: DataFrame, schema: str, per_block: Callable, key: str = "doc_id", text: str = "text",
              extra: tuple[str, ...] = ()) -> DataFrame:
    """``per_block(data, off, table) -> dict of columns`` over blocks of whole
    texts; ``table`` is the Arrow batch slice with the key and extra columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            for lo, hi in blocks(off):
                part = data[off[lo]:off[hi]]
                cols = per_block(part, off[lo:hi + 1] - off[lo], batch.slice(lo, hi - lo))
                if cols is not None:
                    yield pa.RecordBatch.from_pydict(cols)
    return df.select(key, text, *extra).mapInArrow(run, schema)
