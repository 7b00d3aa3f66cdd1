"""Readers and writers (the reference's CSV load, Parquet hand-offs and
CSV submission), with explicit schemas and write modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             infer_schema: bool = False) -> DataFrame:
    """CSV with a header row.  A declared schema avoids the extra full pass
    that ``inferSchema`` costs; inference stays available as a flag."""
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", infer_schema).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists",
                  partition_by: list[str] | None = None) -> None:
    """Unpartitioned by default, as in the reference (partitioning by
    customer id creates one folder per customer)."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header; one file per task (no funnel through one task)."""
    df.write.mode(mode).option("header", True).csv(path)


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` and return a DataFrame reading it back.

    This cuts the lineage with a table in the shared folder: a lost
    executor re-reads files instead of recomputing the plan that built them.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
