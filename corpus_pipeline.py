"""Corpus pipeline over ``documents``: language ID, near-dedup, substring
dedup, secret scan, packing.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor
kept and calls one operator of ``revisit.llm``; all but the last return the
columns of their input.  ``run`` writes each stage's result as Parquet in the
shared folder and reads it again as the next one's documents.

Defined cases: extra columns pass through unchanged; ``n_chars``, where
present, follows a changed text; the first stage rejects texts without a
letter and, where a language was learned, texts unlike the training texts of
every learned language (gibberish, other languages), each row by itself: with
no label to learn from, all texts with a letter stay; null doc_ids pass all
filters; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from revisit.llm import language_id, near_dedup, packing, secret_scan, substring_dedup
from revisit.llm.store import anti_join, stored

WORDS, SIMILAR, OF = 5, 80, 100        # word shingles and least Jaccard similarity, in percent


def _with_length(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter and texts far from every learned language go, row by row."""
    return language_id.in_known_language(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return anti_join(docs, near_dedup.near_duplicates(docs, WORDS, SIMILAR, OF).where(~F.col("kept")), "doc_id")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has go."""
    return _with_length(substring_dedup.remove_repeats(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; the documents stay."""
    return _with_length(secret_scan.redact(docs))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-budget batches of the documents that are left."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("secret_scan", redact_secrets),
    ("packing", pack_batches),
]

# A model, a similarity join and the randomness tests are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
