"""Purchase facts kept up to date: a new day's lines are added without
reading the earlier ones again.

Facts are mergeable: lines, quantities and amounts of the same (customer, day,
product) add up.  Each absorbed input is a batch with a name; its facts are
written under ``facts/<batch>`` first and its name to ``absorbed`` last.  A
batch that is listed is not absorbed again; one that a lost driver left
unlisted is overwritten by its repetition.  Readers take the listed batches
only and add up days that several batches share.

Defined cases: an input without lines is absorbed as an empty batch; lines
that arrive late are a batch of their own; no batch gives no facts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from revisit.functions.expressions import MONEY_SCALE
from revisit.operators.lookback import purchase_facts

KEYS = ("id", "date", "category", "company", "brand")


class FactStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def absorbed(self) -> list[str]:
        """Names of the batches, one row each."""
        try:
            rows = self.spark.read.schema("batch string").parquet(f"{self.path}/absorbed").distinct().collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        return sorted(r["batch"] for r in rows)

    def absorb(self, batch: str, lines: DataFrame) -> bool:
        """Add the facts of ``lines``; False if the batch is already there."""
        if not batch or "/" in batch:
            raise ValueError("a batch needs a name without a slash")
        if batch in self.absorbed():
            return False
        purchase_facts(lines).write.mode("overwrite").parquet(f"{self.path}/facts/{batch}")
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{self.path}/absorbed")
        return True

    def facts(self, first=None, last=None) -> DataFrame | None:
        """One row per (id, date, product) over all batches; ``first`` and
        ``last`` days are pushed into the scans."""
        batches = self.absorbed()
        if not batches:
            return None
        found = self.spark.read.parquet(*[f"{self.path}/facts/{b}" for b in batches])
        scale = found.schema["a"].metadata.get(MONEY_SCALE)
        if first is not None:
            found = found.where(F.col("date") >= F.lit(first).cast(T.DateType()))
        if last is not None:
            found = found.where(F.col("date") <= F.lit(last).cast(T.DateType()))
        meta = {"metadata": {MONEY_SCALE: scale}} if scale is not None else {}
        return found.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum("a").alias("a", **meta))
