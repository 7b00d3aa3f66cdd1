"""Transaction reduction: keep a purchase line if its category OR company
OR brand appears among the offers.

Plan: three broadcast hash joins against the (bounded) distinct key lists,
each adding a match flag, then one filter -- a single scan, no shuffle, all
inside one code-generated stage.  (A single semi-join with an OR condition
would plan as a nested-loop join.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from revisit.operators.keys import offer_key_values
from revisit.operators.sizing import as_bounded
from revisit.operators.skew import salted_join
from revisit.schemas import PRODUCT_FIELDS


def reduce_transactions(transactions: DataFrame, offers) -> DataFrame:
    offers = as_bounded(offers)
    if offers.small or transactions.isStreaming:
        return _flagged(transactions, offers).select(*transactions.columns)
    # Past the broadcast bound the distinct products of the lines meet the key
    # lists, and lines join the products that stay, hot products split.
    key = F.xxhash64(*PRODUCT_FIELDS)
    kept = _flagged(transactions.select(*PRODUCT_FIELDS).distinct(), offers).select(
        *[F.col(f).alias(f"_kept_{f}") for f in PRODUCT_FIELDS], key.alias("_kept_key"))
    same = F.lit(True)
    for f in PRODUCT_FIELDS:
        same = same & F.col(f).eqNullSafe(F.col(f"_kept_{f}"))
    joined = salted_join(transactions.withColumn("_product_key", key), kept, "_product_key", "_kept_key", extra=same, collapse=True)
    return joined.select(*transactions.columns)


def _flagged(rows: DataFrame, offers) -> DataFrame:
    out = rows
    flags = []
    for field in PRODUCT_FIELDS:
        flag = f"_in_offer_{field}"
        keys = offer_key_values(offers.df, field).withColumn(flag, F.lit(True))
        out = out.join(offers.hint(keys), field, "left")
        flags.append(F.coalesce(F.col(flag), F.lit(False)))
    keep = flags[0] | flags[1] | flags[2]
    return out.where(keep)


def category_dept_map(transactions: DataFrame) -> DataFrame:
    """Row count per (dept, category) -- a partial/final hash aggregate."""
    return transactions.groupBy("dept", "category").agg(F.count(F.lit(1)).alias("count"))
