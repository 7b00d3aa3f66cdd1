"""The corpus pipeline stage by stage, on a small fixture with planted cases."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from revisit.llm import queries as llm_queries
from revisit.llm.store import stored


def sentence(n, seed):
    r = random.Random(seed)
    return [r.choice("the of and to in was house water light green river stone morning evening summer winter".split()) + str(r.randrange(50)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    base, passage = sentence(200, 1), sentence(60, 2)
    near = base[:]
    near[100] = "other"
    return [(0, " ".join(base)), (1, " ".join(near)), (2, " ".join(sentence(80, 3) + passage)), (3, " ".join(passage + sentence(90, 4))),
            (4, "12345 ?? !!"), (5, None), (6, " ".join(sentence(70, 5)) + " password: hunter2secret99"), (7, " ".join(sentence(90, 6)))]


def test_stages(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "kept") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    columns, texts = docs.columns, dict(rows)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, ""), name)
        assert docs.columns == columns
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    assert set(seen["language_id"]) == {0, 1, 2, 3, 6, 7}
    assert set(seen["near_dedup"]) == {0, 2, 3, 6, 7}
    cut = seen["substring_dedup"]
    assert cut[3]["text"] == " ".join(sentence(90, 4)) and cut[3]["n_chars"] == len(cut[3]["text"])
    assert all(cut[i]["text"] == texts[i] for i in (0, 2, 6, 7))
    red = seen["secret_scan"]
    assert red[6]["text"].endswith(" [SECRET]") and red[6]["n_chars"] == len(red[6]["text"]) and red[7]["text"] == texts[7]
    batches = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sorted(i for b in batches for i in b["doc_ids"]) == [0, 2, 3, 6, 7]


def learned_rows(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")


def test_gibberish_and_unlearned_scripts_go(spark):
    """Random letters and a script nobody learned, beside short clean texts."""
    r = random.Random(12)
    noise = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9))) for _ in range(50)) for _ in range(40)]
    other = ["Это русский текст о погоде и о зиме в большом городе, без единой метки.", "これは日本語の文章です。今日は天気がいいので散歩に行きます。"]
    short = ["the weather was fine", "hello", "Good morning, this is a short note about the house.", "la casa de la ciudad", "und der Tag"]
    docs = learned_rows(spark)
    rows = [(-1 - i, t, None) for i, t in enumerate(noise + other + short)]
    kept = corpus_pipeline.identify_language(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), "")
    got = {x["doc_id"] for x in kept.select("doc_id").collect()}
    assert sorted(i for i in got if i < 0) == sorted(i for i, t, _ in rows if t in short)
    clean = docs.where(F.col("text").rlike(r"\p{L}"))
    assert sum(i >= 0 for i in got) >= 0.99 * clean.count()


def test_unlabelled_rows_and_repeated_ids(spark):
    """Without a label all texts with a letter stay; a letterless row does not take a clean one of its doc_id along."""
    rows = [(i, " ".join(sentence(40, i)), None) for i in range(8)] + [(3, "12345 ?!", None), (9, None, None), (None, "17", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = sorted([r[:2] for r in rows[:8]] + [(None, "17")], key=str)
    for lang in (None, "en"):
        kept = corpus_pipeline.identify_language(spark, docs.withColumn("lang", F.lit(lang).cast("string")), "")
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_run_over_the_small_tables(spark, small_dir):
    batches = corpus_pipeline.run(spark, small_dir)
    listed = [i for b in batches.collect() for i in b["doc_ids"]]
    assert len(listed) == len(set(listed)) > 100


def test_every_operator_is_registered():
    names = list(llm_queries.queries())
    assert list(dict.fromkeys(n.split("_")[0] for n in names)) == [f"op{i}" for i in range(1, 14)] and len(corpus_pipeline.STAGES) == 5
