"""Memory of the numpy steps inside one task."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from revisit.llm import byte_bpe, kernel, language_model, near_dedup


def peak(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_tokens_of_a_large_batch_stay_small():
    text = " ".join(f"w{i % 5000}" for i in range(40_000))
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 24)], names=["text"])
    n, most = peak(lambda: sum(t.n for _, t in language_model.texts_of(iter([batch]), 0)))
    assert n == 24 * 40_001 and most < 64 << 20


def test_hashes_do_not_depend_on_the_segments(monkeypatch):
    data = np.frombuffer(b"some words of a text " * 3000, np.uint8)
    w = kernel.Words(data, np.array([0, len(data)]))
    whole = w.hashes()
    monkeypatch.setattr(kernel, "HASH_BYTES", 100)
    assert np.array_equal(w.hashes(), whole)


@pytest.mark.parametrize("values", [[], [0, 255], [256, 1], [70_000], [2 ** 33, 0]])
def test_packed_numbers(values):
    assert byte_bpe.unpack(byte_bpe.pack(np.array(values, np.int64))).tolist() == values


def test_words_of_a_text_travel_packed(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id long, text string")
    ranks = {bytes([i]): i for i in range(256)}
    plan = byte_bpe.encode_words(docs, ranks, r"\S+|\s+", lambda key, ids: (key, " ".join(map(str, ids.tolist()))), "doc_id long, ids string")
    assert {r.doc_id: r.ids for r in plan.collect()} == {1: "97 32 98 32 97", 2: ""}


def test_node_links_equal_brute_force_in_little_memory():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2 ** 62, 4000).astype(np.uint64)
    sets = [np.unique(np.r_[base[:3900 - 3 * i], rng.integers(0, 2 ** 62, 4 * i).astype(np.uint64)]) for i in range(300)]
    comp = [bytes([i // 256, i % 256]) for i in range(300)]
    links, most = peak(lambda: near_dedup.node_links(sets, comp, 90, 100))
    label = list(range(300))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for x in range(300):
        for y in range(x):
            common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * common >= 90 * (len(sets[x]) + len(sets[y]) - common):
                label[root(x)] = root(y)
    mine = list(range(300))

    def root_of(x):
        while mine[x] != x:
            x = mine[x]
        return x
    for x, y in links:
        mine[root_of(x)] = root_of(y)
    assert len({(root(i), root_of(i)) for i in range(300)}) == len({root(i) for i in range(300)}) == len({root_of(i) for i in range(300)})
    assert most < 50 << 20


def test_repeated_shingles_are_those_of_two_sets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 12)).astype(np.uint64)) for _ in range(12)]
    member, token, df = near_dedup.repeated_shingles(sets)
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    assert df.tolist() == counts[counts > 1].tolist()
    assert [(m, values[counts > 1][t]) for m, t in zip(member.tolist(), token.tolist())] == [
        (i, v) for i, s in enumerate(sets) for v in s if v in values[counts > 1]]


def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_texts_of_a_task_start_without_what_earlier_ones_freed():
    held = [np.ones(12_000) for _ in range(1500)]       # 96 kB each, all from the C library's heap
    last = held[-1]                                     # keeps the heap from shrinking by itself
    before = resident()
    del held
    assert before - resident() < 20 << 20
    assert list(language_model.texts_of(iter([]), 0)) == []
    assert before - resident() > 100 << 20 and last[0] == 1
