"""Product and category market features.

Both come from one aggregate, ``category_products``: every transaction in
an offered category grouped by product triple (line count and spend).  Its
size is bounded by the number of distinct products in the offered
categories, never by the number of transactions, and a hot product is
combined map-side before the shuffle.

* ``product_share``: for each offered product, its line count over the
  line count of its category (a *row-count* share, as the reference codes
  it).
* ``competition``: per offered category, the number of products with known
  company and brand, and the dominant product's *spend* share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from revisit.functions.expressions import MONEY_SCALE, count_if, money_scale_of, money_units, money_value, product_id, safe_ratio
from revisit.operators.keys import offer_key_values, offer_products
from revisit.operators.sizing import as_bounded
from revisit.session import scratch_path
from revisit.sources.io import materialize


def category_products(transactions: DataFrame, offers) -> DataFrame:
    """Lines and spend (in money units) per product of an offered category."""
    offers = as_bounded(offers)
    cats = offer_key_values(offers.df, "category")
    lines = transactions.select("category", "company", "brand", "purchaseamount")
    if offers.small:
        lines = lines.join(F.broadcast(cats), "category", "left_semi")
    units, scale = money_units("purchaseamount", transactions.schema["purchaseamount"].dataType)
    products = lines.groupBy("category", "company", "brand").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(units).alias("spend", metadata={MONEY_SCALE: scale}))
    # Past the broadcast bound products, not lines, meet the key list: a hot category is combined first.
    return products if offers.small else products.join(cats, "category", "left_semi")


def product_share(transactions: DataFrame, offers, products: DataFrame | None = None) -> DataFrame:
    offers = as_bounded(offers)
    if products is None:        # read twice: totals and products
        products = materialize(category_products(transactions, offers), scratch_path(transactions.sparkSession, "products", uuid.uuid4().hex))
    # Totals are combined in each task before they are shuffled, so no task holds a category's products.
    totals = products.groupBy("category").agg(F.sum("n_lines").alias("category_lines"))
    wanted = offers.hint(offer_products(offers.df))
    return (products.join(wanted, ["category", "company", "brand"], "left_semi")
            .join(offers.hint(totals), "category")
            .select(product_id("category", "company", "brand").alias("productid"),
                    "category", "company", "brand",
                    safe_ratio("n_lines", "category_lines").alias("marketshare_in_cat")))


def competition(transactions: DataFrame, offers, products: DataFrame | None = None) -> DataFrame:
    cp = products if products is not None else category_products(transactions, offers)
    scale = money_scale_of(cp, "spend")
    # cp has one row per (category, company, brand), so counting rows with
    # both parts known equals COUNT(DISTINCT company, brand).
    return cp.groupBy("category").agg(
        count_if(F.col("company").isNotNull() & F.col("brand").isNotNull()).alias("competing_products_in_cat"),
        safe_ratio(money_value(F.max("spend"), scale), money_value(F.sum("spend"), scale)).alias("marketshare_dominant_prod_in_cat"))
