"""Declared schemas of the input tables and the fixed names used across the package."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values (must match the feature table layout):
# the three product fields a coupon names, the look-back windows in days,
# and the columns excluded from the model's feature vector.
PRODUCT_FIELDS = ("company", "category", "brand")
WINDOWS = (30, 60, 90, 180)
USER_WINDOW = 30
NON_FEATURE_COLUMNS = frozenset({
    "id", "chain", "offer", "market", "repeattrips", "repeater", "offerdate",
    "category", "company", "brand", "productid",
    "split",  # our own cohort marker (train / test in one table)
})
COHORT_KEYS = ("split", "id", "offer")


def transactions_schema(category_type: T.DataType = T.LongType(),
                        brand_type: T.DataType = T.LongType(),
                        amount_type: T.DataType = T.DoubleType()) -> T.StructType:
    """One row per purchased line.  Product fields are integer codes in the
    original data; the fixtures derived from the driver tables use strings
    for category and brand."""
    return T.StructType([
        T.StructField("id", T.LongType(), False),
        T.StructField("dept", T.IntegerType(), True),
        T.StructField("category", category_type, True),
        T.StructField("company", T.LongType(), True),
        T.StructField("brand", brand_type, True),
        T.StructField("date", T.DateType(), False),
        T.StructField("purchasequantity", T.LongType(), True),
        T.StructField("purchaseamount", amount_type, True),
    ])


def offers_schema(category_type: T.DataType = T.LongType(),
                  brand_type: T.DataType = T.LongType()) -> T.StructType:
    return T.StructType([
        T.StructField("offer", T.LongType(), False),
        T.StructField("category", category_type, True),
        T.StructField("company", T.LongType(), True),
        T.StructField("brand", brand_type, True),
        T.StructField("offervalue", T.DoubleType(), True),
    ])


HISTORY_SCHEMA = T.StructType([
    T.StructField("split", T.StringType(), False),
    T.StructField("id", T.LongType(), False),
    T.StructField("chain", T.IntegerType(), True),
    T.StructField("offer", T.LongType(), True),
    T.StructField("market", T.IntegerType(), True),
    T.StructField("repeattrips", T.IntegerType(), True),
    T.StructField("repeater", T.StringType(), True),
    T.StructField("offerdate", T.DateType(), True),
])

SUBMISSION_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("repeatProbability", T.FloatType(), True),
])
