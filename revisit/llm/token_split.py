"""Splitting texts into the words that byte-level BPE merges, in numpy.

``spans`` gives the byte span of every match of a split pattern in a block of
texts.  For ``PATTERN``, the usual split of byte-level BPE, a code point's
class (letter, number, white space, other) decides all bounds, so they come
from a few passes over the block; any other pattern is matched text by text.
``DistinctWords`` numbers the distinct words of a block, ``WordTable`` looks
words up.  Both find words by 64-bit hash and compare the bytes, so a hash
collision costs time but never gives a wrong word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import regex

from revisit.llm import kernel as K

#: Fixed value: the split that the public byte-level vocabularies use.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, LETTER, NUMBER, SPACE = range(4)


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """Class of each code point, as the pattern's own classes have it."""
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, points):
            for a, b in ((m.start(), min(m.end(), 0xD800)), (max(m.start(), 0xD800) + 0x800, m.end() + 0x800)):
                out[a:max(a, b)] = kind
    return out


def _class_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks the code points at which a match of ``PATTERN`` begins; ``first``
    marks those at which a text begins, and has one element more."""
    n = len(codes)
    kind = code_point_classes()[codes]
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    # White space ends one short of what follows; a blank goes with it.
    after = np.flatnonzero(run & ~first[:n] & (kind != SPACE))
    after = after[kind[after - 1] == SPACE]
    start[after - 1] = True
    start[after] = codes[after - 1] != ord(" ")
    # An apostrophe that begins a match takes a contraction's letters.
    at = np.flatnonzero(start & (codes == ord("'")))
    second = np.r_[codes, 0, 0]
    inside = np.r_[~first[:n], False, False]

    def follows(i: np.ndarray, letter: str) -> np.ndarray:
        return inside[i] & (second[i] == ord(letter))
    for short in ("s", "t", "m", "d", "re", "ve", "ll"):
        hit = at[np.logical_and.reduce([follows(at + 1 + j, c) for j, c in enumerate(short)])]
        start[hit + 1] = False
        end = hit + 1 + len(short)
        start[end[end < n]] = True
    return start


def spans(data: np.ndarray, off: np.ndarray, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) byte offsets of all matches in the texts of a block."""
    if pattern != PATTERN:
        return _pattern_spans(data, off, pattern)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.zeros(len(at) + 1, bool)
    first[np.searchsorted(at, off)] = True
    start = at[_class_starts(codes, first)]
    return start, np.r_[start[1:], len(data)][:len(start)]


def _pattern_spans(data: np.ndarray, off: np.ndarray, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    find, starts, ends = regex.compile(pattern).finditer, [], []
    for lo, hi in zip(off[:-1].tolist(), off[1:].tolist()):
        part = data[lo:hi]
        at = np.r_[np.flatnonzero((part & 0xC0) != 0x80), hi - lo] + lo
        found = np.array([m.span() for m in find(part.tobytes().decode("utf-8")) if m.end() > m.start()], np.int64).reshape(-1, 2)
        starts.append(at[found[:, 0]])
        ends.append(at[found[:, 1]])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(none + starts), np.concatenate(none + ends)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (``length`` of them) of each row, one after another."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)


class DistinctWords:
    """Distinct words of a block: ``code`` of each word, span and hash of each code."""

    def __init__(self, data: np.ndarray, off: np.ndarray, pattern: str):
        self.data = data
        start, end = spans(data, off, pattern)
        self.first = np.searchsorted(start, off)      # index of each text's first word
        hashes = K.span_hashes(data, start, end)
        self.code = pd.factorize(hashes)[0]
        heads = self._heads()
        length = end - start
        same = np.array_equal(length, length[heads[self.code]]) and np.array_equal(
            data[ragged(start, length)], data[ragged(start[heads[self.code]], length)])
        if not same:
            raw = data.tobytes()
            self.code = pd.factorize(np.array([raw[a:b] for a, b in zip(start.tolist(), end.tolist())], object))[0]
            heads = self._heads()
        self.start, self.length, self.hash = start[heads], length[heads], hashes[heads]

    def _heads(self) -> np.ndarray:
        n = len(self.code)
        heads = np.zeros(int(self.code.max()) + 1 if n else 0, np.int64)
        heads[self.code[::-1]] = np.arange(n)[::-1]
        return heads

    def counts(self) -> np.ndarray:
        return np.bincount(self.code, minlength=len(self.start))

    def flat(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the given distinct words."""
        return self.data[ragged(self.start[rows], self.length[rows])], np.r_[0, np.cumsum(self.length[rows])]


class WordTable:
    """Words (flat bytes and offsets) and the ids of each (likewise)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, ids: np.ndarray, ids_off: np.ndarray):
        hashes = K.span_hashes(data, off[:-1], off[1:])
        order = np.argsort(hashes, kind="stable")
        self.hash, self.data, self.ids = hashes[order], data, ids.astype(np.int32)
        self.start, self.length = off[:-1][order].astype(np.int32), np.diff(off)[order].astype(np.int32)
        self.ids_start, self.ids_length = ids_off[:-1][order].astype(np.int32), np.diff(ids_off)[order].astype(np.int32)

    def find(self, words: DistinctWords) -> np.ndarray:
        """Row of each distinct word, -1 without one."""
        if not len(self.hash):
            return np.full(len(words.hash), -1)
        row = np.minimum(np.searchsorted(self.hash, words.hash), len(self.hash) - 1)
        hit = np.flatnonzero((self.hash[row] == words.hash) & (self.length[row] == words.length))
        length = words.length[hit]
        differs = words.data[ragged(words.start[hit], length)] != self.data[ragged(self.start[row[hit]], length)]
        bad = np.add.reduceat(differs, np.cumsum(length) - length) if len(hit) else np.zeros(0, int)
        out = np.full(len(words.hash), -1)
        out[hit[bad == 0]] = row[hit[bad == 0]]
        return out
