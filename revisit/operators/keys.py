"""Key lists derived from the offer catalogue (kept as DataFrames, never
collected to the driver and pasted into SQL text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from revisit.functions.expressions import product_id
from revisit.schemas import PRODUCT_FIELDS


def offer_key_values(offers: DataFrame, field: str) -> DataFrame:
    """Distinct non-null values of one product field among the offers."""
    return offers.select(field).where(F.col(field).isNotNull()).distinct()


def offer_keys(offers: DataFrame) -> DataFrame:
    """All three key lists in one long table: (key_field, key_value)."""
    parts = [offer_key_values(offers, f).select(
        F.lit(f).alias("key_field"), F.col(f).cast("string").alias("key_value"))
        for f in PRODUCT_FIELDS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def offer_productids(offers: DataFrame) -> DataFrame:
    """Distinct ``"category company brand"`` ids (null if any part is null)."""
    return offers.select(product_id("category", "company", "brand").alias("productid")).distinct()


def offer_products(offers: DataFrame) -> DataFrame:
    """Distinct fully known product triples among the offers."""
    keys = ["category", "company", "brand"]
    return offers.select(*keys).where(
        F.col("category").isNotNull() & F.col("company").isNotNull() & F.col("brand").isNotNull()
    ).distinct()


def offers_by_field(offers: DataFrame, field: str) -> DataFrame:
    """field value -> sorted array of the offers naming it.  At most one row
    per offer, so it inherits the catalogue's size bound."""
    return (offers.where(F.col(field).isNotNull())
            .groupBy(field)
            .agg(F.array_sort(F.collect_set(F.col("offer").cast("long"))).alias(f"_offers_{field}")))
