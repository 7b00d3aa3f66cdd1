"""Hot-key splitting for row-level joins.

A join whose output is row level cannot be pre-aggregated, so a key that
holds a large share of one side (one customer with a third of all purchase
lines) would land in one task.  ``salted_join`` splits such keys:

1. ``hot_keys`` counts the big side's keys (pre-aggregated in each task) and
   keeps those above an equal share of the rows, total / shuffle partitions.
   Fewer keys than partitions can exceed that share and none needs more
   buckets than there are partitions, so the list is bounded by
   construction, with no cut.  It is written once: both sides of a join see
   the same list.
2. Big-side rows of a hot key are spread over its buckets by a hash of the
   row's columns; small-side rows of a hot key are replicated once per bucket;
   every other key uses bucket 0.  The join runs on (key, bucket): the hot
   key's rows are shared by several tasks and each output pair appears exactly
   once.  The bucket is a function of the row alone, so a task that is
   repeated after a lost executor deals its rows as before, in whatever order
   they reach it.
3. Equal rows would share a bucket.  Where a hot key can have many
   (``collapse``), they are joined as one row with their number, combined in
   each task before the shuffle, and listed again behind the join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from revisit.session import scratch_path
from revisit.sources.io import materialize


def hot_keys(df: DataFrame, key: str, rows_per_task: int | None = None) -> DataFrame:
    """(key, _buckets) of the keys with more rows than one task's share;
    ``rows_per_task`` overrides the share."""
    spark = df.sparkSession
    counts = materialize(df.select(F.col(key).alias("_key")).where(F.col("_key").isNotNull()).groupBy("_key").agg(F.count(F.lit(1)).alias("_n")),
                         scratch_path(spark, "hot_keys", uuid.uuid4().hex))
    if rows_per_task is None:
        total = counts.agg(F.sum("_n")).first()[0] or 0
        rows_per_task = max(1, -(-total // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return counts.where(F.col("_n") > rows_per_task).select(
        F.col("_key").alias(key), F.ceil(F.col("_n") / F.lit(rows_per_task)).cast("int").alias("_buckets"))


def bucket_of(columns: list[str], buckets) -> Column:
    """Bucket of a row: a function of its columns."""
    return F.pmod(F.xxhash64(*columns), buckets).cast("int")


def collapse_equal(big: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``big`` with ``_copies``: equal rows of a hot key as one row."""
    keys = F.broadcast(hot.select(key))
    few = big.join(keys, key, "left_semi").select(*big.columns).groupBy(*big.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return big.join(keys, key, "left_anti").select(*big.columns, F.lit(1).cast("long").alias("_copies")).unionByName(few)


def salted_join(big: DataFrame, small: DataFrame, big_key: str, small_key: str,
                extra: Column | None = None, how: str = "inner",
                hot: DataFrame | None = None, rows_per_task: int | None = None, collapse: bool = False) -> DataFrame:
    """``big JOIN small ON big_key = small_key [AND extra]`` with hot keys
    split across tasks.  ``how`` is ``inner`` or ``left`` (big side
    preserved).  Helper columns are dropped from the result."""
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left (big side preserved)")
    hot = hot if hot is not None else hot_keys(big, big_key, rows_per_task)
    on = F.col(big_key) == F.col(small_key)
    if extra is not None:
        on = on & extra
    if hot.isEmpty():               # no key exceeds a task's share
        return big.join(small.hint("merge"), on, how)
    columns = big.columns
    if collapse:
        big = collapse_equal(big, big_key, hot)
    hb = F.broadcast(hot.withColumnRenamed(big_key, "_hk_big").withColumnRenamed("_buckets", "_b_big"))
    hs = F.broadcast(hot.withColumnRenamed(big_key, "_hk_small").withColumnRenamed("_buckets", "_b_small"))
    b = (big.join(hb, F.col(big_key) == F.col("_hk_big"), "left")
         .withColumn("_salt", F.when(F.col("_b_big").isNull(), F.lit(0)).otherwise(bucket_of(columns, F.col("_b_big"))))
         .drop("_hk_big", "_b_big"))
    s = (small.join(hs, F.col(small_key) == F.col("_hk_small"), "left")
         .withColumn("_salt_s", F.explode(
             F.when(F.col("_b_small").isNull(), F.array(F.lit(0)))
             .otherwise(F.sequence(F.lit(0), F.col("_b_small") - 1))))
         .drop("_hk_small", "_b_small"))
    joined = b.join(s.hint("merge"), on & (F.col("_salt") == F.col("_salt_s")), how).drop("_salt", "_salt_s")
    if collapse:
        joined = joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).drop("_copy", "_copies")
    return joined
