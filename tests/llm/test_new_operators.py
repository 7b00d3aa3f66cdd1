"""Language-model scores, hard negatives, source audit and long words against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from revisit.llm import byte_bpe, hard_negatives, language_model, source_audit

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def some_texts(n=160, seed=4):
    r = random.Random(seed)
    vocabulary = ["the", "of", "é", "Straße", "漢字", "naïve", *(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))]
    rows = [(i, " ".join(r.choice(vocabulary[:r.choice((6, 40, 206))]) for _ in range(r.randrange(1, 60)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (None, "the of null key"), (3, rows[3][1]), (5, rows[5][1]), (n + 3, "THE Of, the-of " * 400),
             (n + 4, "x" * 300_000), (n + 5, "once"), (n + 6, "İ K ſ Á")]
    return rows


# -- 11: LM scoring --------------------------------------------------------------------------------------------------

def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)) + [None]


def is_held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def level(c):
    return sum(1 for k in range(60) if c >= math.ceil(1.5 ** k) and (k == 0 or math.ceil(1.5 ** k) > math.ceil(1.5 ** (k - 1))))


def mean_count(lev):
    starts = sorted({math.ceil(1.5 ** k) for k in range(60)})
    return (starts[lev - 1] + starts[lev] - 1) / 2 if lev else 0.0


def model_scores(rows):
    """The model with dictionaries for the filter."""
    train = [tokens(t) for i, t in rows if not is_held_out(i)]
    words = Counter(w for ws in train for w in ws)
    pairs = Counter(p for ws in train for p in zip(["<s>", *ws], ws))
    n, v = sum(words.values()), len(words)

    def cells(ws):
        for h, w in zip(["<s>", *ws], ws):
            before = h if h == "<s>" else level(words[h])
            yield level(words[w]), before, level(pairs[h, w]) if w in words and before else 0
    triples = Counter(c for ws in train for c in cells(ws))

    def parts(cell, less):
        w, h, p = cell
        context = (len(train) if h == "<s>" else mean_count(h)) - less
        pair = min(1, max(mean_count(p) - less, 0) / max(context, 1))
        return h if h == "<s>" else level(context), pair, (mean_count(w) + 0.1) / (n + 0.1 * (v + 1))
    weight = defaultdict(lambda: 0.5, {0: 0.0})
    for _ in range(language_model.STEPS):
        top, total = Counter(), Counter()
        for c, k in triples.items():
            at, pair, word = parts(c, 1)
            high = weight[at] * pair
            top[at] += k * high / (high + (1 - weight[at]) * word)
            total[at] += k
        weight = defaultdict(float, {h: top[h] / total[h] for h in total})
    known = sorted(h for h in total if h not in (0, "<s>"))
    for h in range(1, 100):         # levels without a count of their own lie between their neighbours
        low, high = max([k for k in known if k <= h], default=known[0]), min([k for k in known if k >= h], default=known[-1])
        weight[h] = weight[low] + (weight[high] - weight[low]) * (h - low) / (high - low) if low < high else weight[low]
    out = []
    for i, t in rows:
        ws = tokens(t)
        score = 0.0
        for c in cells(ws):
            at, pair, word = parts(c, 0)
            score += math.log10(min(1, weight[at] * pair + (1 - weight[at]) * word))
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        out.append((i, is_held_out(i), len(ws), sum(words[w] > 0 for w in ws), n, base, score))
    return out


def test_scores_equal_the_model_without_a_filter(spark):
    """With many bits an event the filter has no false hits; with few segments, slots and frequent words, rounds and joins do the work."""
    rows = some_texts()
    docs = spark.createDataFrame([(*x, 1.0, "c", 5) for x in rows], "doc_id long, text string, score double, words string, n_tokens int").repartition(3)
    want = sorted(model_scores(rows), key=str)
    for kw in ({}, {"segment_bytes": 40_000, "exact_words": 5, "slot_bytes": 1 << 14}, {"exact_words": 0}):
        got = sorted(map(tuple, language_model.score_texts(docs, bits_each=400, **kw).select(
            "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=str)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)


def test_false_hits_are_rare(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    few, many = (language_model.score_texts(docs, bits_each=b).agg(F.sum("score"), F.sum("n_tokens")).first() for b in (language_model.BITS, 200))
    assert many[0] <= few[0] <= many[0] + 0.03 * many[1]


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_model.score_texts(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_scores_without_training_texts(spark):
    schema = "doc_id long, text string"
    assert language_model.score_texts(spark.createDataFrame([], schema)).count() == 0
    held = [i for i in range(200) if is_held_out(i)][:3]
    got = language_model.score_texts(spark.createDataFrame([(i, "a b") for i in held], schema)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got] == [(3, 0, 0, 0.0, 0.0)] * 3


# -- 12: hard negatives ----------------------------------------------------------------------------------------------

def brute_negatives(rows):
    good = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows
            if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, lab, v in good:
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in good]
        for p, i, _ in sorted(x for x in scored if x[2] == lab and x[1] != a)[:5]:
            fits = sorted(x[:2] for x in scored if x[2] != lab and 80 * -p <= 100 * -x[0] <= 100 * -p)[:5]
            out += [(a, i, k + 1, j, -p, -s) for k, (s, j) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 2])
def test_hard_negatives(spark, monkeypatch, block):
    r = np.random.default_rng(1)
    rows = [(i, int(r.integers(0, 4)), [float(np.float32(x)) for x in r.normal(0.05, 0.2, 13)]) for i in range(600)]
    rows += [(200, 1, rows[3][2]), (601, None, rows[1][2]), (602, 1, None), (603, 1, [1.0, None]), (604, 2, [float("nan")] * 13),
             (605, 2, [float("inf")] * 13), (None, 1, rows[1][2]), (606, 1, []), (607, 2, [1.0]), (608, 3, [0.5] * 20), (609, -3, rows[0][2]),
             rows[4], rows[4], rows[100], (700, 2, [0.0] * 13), (800, 0, rows[200][2])]
    table = spark.createDataFrame([(*x, 7, 1) for x in rows], "vec_id long, label int, embedding array<float>, score int, list int").repartition(5)
    got = hard_negatives.mine_negatives(table, block)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_bounds_hold_on_every_level():
    r = np.random.default_rng(2)
    for width in (1, 3, 16, 64):
        a, b = (hard_negatives.Vectors(np.arange(40), np.zeros(40), np.floor(r.normal(0, 90, (40, width)))) for _ in range(2))
        every = np.arange(40)
        exact = a.scores(b, every, every)
        gaps = []
        for k in range(len(a.levels)):
            least, most = a.bounds(b, k, every, every)
            assert (least <= exact).all() and (exact <= most).all()
            gaps.append((most - least).sum())
        assert gaps == sorted(gaps, reverse=True)


def test_large_components_and_no_anchors(spark):
    schema = "vec_id long, label int, embedding array<double>"
    rows = [(100, 1, [1e300, 2.0]), (1, 1, [1e300, 1.0]), (2, 2, [1e300, 0.0])]
    got = hard_negatives.mine_negatives(spark.createDataFrame(rows, schema)).collect()
    big = 1 << 20
    assert [tuple(r) for r in got] == [(100, 1, 1, 2, big * big + 512 * 256, big * big)]
    assert hard_negatives.mine_negatives(spark.createDataFrame(rows[1:], schema)).count() == 0
    assert hard_negatives.mine_negatives(spark.createDataFrame([], schema)).count() == 0


# -- 13: source audit ------------------------------------------------------------------------------------------------

def brute_audit(rows, least):
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW)))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        spread = Counter(t for d in own for t in d[2])
        kept = sorted(t for t, k in spread.items() if k >= least)

        def shares(picked):
            n = Counter()
            for d in picked:
                n.update({t: d[2][t] for t in kept if t in d[2]})
            return {t: 1 + 10 ** 9 * (n[t] + 2) // (sum(n.values()) + 2 * len(kept)) for t in kept}, n
        q, _ = shares(own)
        by = {s: shares([d for d in own if d[1] == s]) for s in {d[1] for d in own}}
        for s, (p, n) in by.items():
            pair = [(-sum((p[t] - o[t]) ** 2 // (p[t] + o[t]) for t in kept), x.encode(), x) for x, (o, _) in by.items() if x != s]
            term = [(-((p[t] - q[t]) ** 2 // (p[t] + q[t])), t.encode(), t) for t in kept if n[t] and p[t] > q[t]]
            for part, items, top in (("pair", pair, None), ("term", term, 10)):
                out += [(lang, s, part, x, -v, k + 1) for k, (v, _, x) in enumerate(sorted(items)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least,level,block", [(10, 6, 64), (3, 1, 4), (1, 2, 1)])
def test_source_audit(spark, least, level, block):
    r = random.Random(6)
    rows = [(text, r.choice(["en", "en", "de", None]), r.choice(["a", "b", "é", "", None, "z1", "z2", "z3", "z4"])) for _, text in some_texts(200)]
    rows += [("prefixlong" + "y" * 5000, "fr", "one")] * 12 + [("prefixlong" + "z" * 5000, "fr", "two")] * 4 + [("", "xx", "s"), (None, "xx", "t"), ("rare", "yy", "s")]
    docs = spark.createDataFrame([(1, *x, 9, 9) for x in rows], "doc_id long, text string, lang string, source string, term int, docs int").repartition(4)
    got = sorted(map(tuple, source_audit.audit_sources(docs, least, level, block=block).collect()))
    assert got == brute_audit(rows, least)


def test_source_audit_false_bits_and_empty(spark, monkeypatch):
    """A bitmap of a few bits lets every prefix through; the counts still decide."""
    docs = spark.createDataFrame([(t, "en", "ab"[i % 2]) for i, (_, t) in enumerate(some_texts(80))], "text string, lang string, source string")
    want = sorted(map(tuple, source_audit.audit_sources(docs, 3, 2).collect()))
    full = source_audit.bitmap
    monkeypatch.setattr(source_audit, "bitmap", lambda prints: np.full_like(full(prints), 255))
    assert sorted(map(tuple, source_audit.audit_sources(docs, 3, 2).collect())) == want
    assert source_audit.audit_sources(docs.where("false")).count() == 0


# -- 8: long words ---------------------------------------------------------------------------------------------------

def test_long_words_equal_the_public_library(spark):
    import public_tokenizers as P
    import tiktoken
    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    r = random.Random(1)
    rows = [("".join(r.choice(alphabet) for _ in range(n)), n) for alphabet in ("abcdefghijklmnopqrstuvwxyz", "aé漢", "x")
            for n in (500, 513, 20_000)] + [("a b " + "q" * 600 + " c", 1)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {x["doc_id"]: x["ids_sha256"] for x in byte_bpe.round_trip(docs, path, P.PATTERN).collect()}
    assert got == {i: hashlib.sha256(" ".join(map(str, enc.encode_ordinary(t))).encode()).hexdigest() for i, (t, _) in enumerate(rows)}
    megabyte = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(1_000_000))
    one = byte_bpe.round_trip(spark.createDataFrame([(1, megabyte)], "doc_id long, text string"), path, P.PATTERN).first()
    assert one["decoded_sha256"] == hashlib.sha256(megabyte.encode()).hexdigest() and one["n_tokens"] > 400_000


# -- helper names as extra columns, texts with very many spans -------------------------------------------------------

def test_repeats_and_secrets_with_clashing_columns(spark):
    import corpus_pipeline
    passage = " ".join(f"w{i}" for i in range(60))
    names = ["_decisions", "decisions", "row", "touched_id", "spans", "base", "tested", "text_", "new", "doc", "key"]
    schema = "doc_id long, text string, lang string, n_chars int, " + ", ".join(f"{n} string" for n in names)
    rows = [(i, t, "en", 1, *names) for i, t in ((1, "a " + passage + " b"), (2, "c " + passage + " token=abcdef12"), (None, passage), (3, None))]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    cut = corpus_pipeline.cut_repeated_passages(spark, docs, "")
    assert cut.schema.names == docs.schema.names
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {1: rows[0][1], 2: "c token=abcdef12", None: passage, 3: None}
    clean = corpus_pipeline.redact_secrets(spark, cut, "")
    assert {r["doc_id"]: r["text"] for r in clean.collect()}[2] == "c [SECRET]"
    assert all(r[n] == n for r in clean.collect() for n in names)


def test_many_hashes_in_one_text(spark):
    import time
    from revisit.llm import secret_scan
    r = random.Random(2)
    hashes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(30_000)]
    free = "Zq8Lw2XvB7Tn4KsJ9RyQ"
    text = " ".join(hashes[:15_000]) + f" {free} " + " ".join(hashes[15_000:])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    row = secret_scan.scan(docs).first()
    assert row["n_hex"] == 30_000 and (time.time() - began) < 60
    assert len(row["spans"].split(",")) in (30_000, 30_001)
