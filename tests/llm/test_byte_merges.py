"""Merge fold of the byte-level BPE operator."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from revisit.llm import byte_bpe


def merged(word, ranks):
    """Lowest rank first, then leftmost, one pair at a time."""
    pieces = [bytes([b]) for b in word]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(pieces, pieces[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in pieces]
        _, i = min(found)
        pieces[i:i + 2] = [pieces[i] + pieces[i + 1]]


def folded(spark, words, ranks):
    table, off = byte_bpe.Ranks(ranks), np.r_[0, np.cumsum([len(w) for w in words])]
    data = np.frombuffer(b"".join(words), np.uint8)
    rows = spark.createDataFrame(pa.table(byte_bpe.lists(table.pieces()(data, off)), names=["words"]))
    return table.fold(rows, "words").first().ids


@pytest.mark.parametrize("top", [1000, 65535])
def test_fold_equals_single_merges(spark, top):
    draw = random.Random(top)
    ids = draw.sample(range(top + 1), 500)
    ids[0] = top                                   # the last id that fits
    pieces = {bytes([i]) for i in range(256)}
    while len(pieces) < 500:                       # ranks do not follow the pieces' length
        pieces.add(bytes(draw.choices(b"abc", k=draw.randint(2, 6))))
    ranks = dict(zip(sorted(pieces), ids))
    words = [bytes(draw.choices(b"abc", k=draw.randint(1, 40))) for _ in range(60)] + [bytes(range(256)), b"a" * 512]
    assert folded(spark, words, ranks) == [merged(w, ranks) for w in words]


def test_a_step_copies_a_word_once():
    fold = str(byte_bpe.fold_merges(F.col("first"), byte_bpe.RankColumns(F.col("tables"))))
    assert (fold.count("concat("), fold.count("slice("), fold.count("array_min(")) == (1, 3, 1)      # the last slice is after the fold
