"""Feature assembly: one row per cohort row (split, id, offer) with the 34
model features.

The 24 window features and the 4 user features come out of one aggregate
keyed by the cohort; the two market tables are joined to it, both bounded by
the offer catalogue and broadcast.  The purchase lines are scanned twice: for
the per-day facts and for the per-product totals, each stored once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from revisit.operators.enrich import history_offers
from revisit.operators.lookback import cohort_date_bounds, lookback_features, purchase_facts
from revisit.operators.market import category_products, competition, product_share
from revisit.operators.sizing import as_bounded
from revisit.session import scratch_path
from revisit.sources.io import materialize
from revisit.schemas import NON_FEATURE_COLUMNS, PRODUCT_FIELDS, USER_WINDOW, WINDOWS


def _stored(df: DataFrame) -> DataFrame:
    """An aggregate several consumers read, written once to the shared folder."""
    return materialize(df, scratch_path(df.sparkSession, "assemble", uuid.uuid4().hex))


def feature_order(windows=WINDOWS, user_window: int = USER_WINDOW) -> list[str]:
    """Feature columns in the reference's assembly order."""
    cols = [f"prodid_spend_{user_window}", f"prodid_count_{user_window}",
            f"total_spend_{user_window}", f"visits_{user_window}", "marketshare_in_cat"]
    first = min(windows)
    for n in windows:
        for f in PRODUCT_FIELDS:
            cols.append(f"has_bought_{f}_q_{n}")
            if n == first:
                cols.append(f"never_bought_{f}")
            cols.append(f"has_bought_{f}_a_{n}")
    return cols + ["competing_products_in_cat", "marketshare_dominant_prod_in_cat"]


def assemble_features(transactions: DataFrame, offers, history: DataFrame,
                      windows=WINDOWS, prefilter_dates: bool = True,
                      facts: DataFrame | None = None, products: DataFrame | None = None,
                      hot: DataFrame | None = None) -> DataFrame:
    """``facts`` / ``products`` / ``hot`` (customers to split) may be passed in already materialised (the
    pipeline writes them once for its intermediate tables)."""
    offers = as_bounded(offers)
    cohort = history_offers(history, offers, with_productid=True, with_offervalue=False)
    if facts is None:
        span = max(tuple(windows) + (USER_WINDOW,))
        bounds = cohort_date_bounds(history, span) if prefilter_dates else None
        facts = _stored(purchase_facts(transactions, date_bounds=bounds))
    feats = lookback_features(cohort, facts, windows=windows, user_window=USER_WINDOW, hot=hot)
    cp = products if products is not None else _stored(category_products(transactions, offers))
    share = offers.hint(product_share(transactions, offers, cp).select("productid", "marketshare_in_cat"))
    comp = offers.hint(competition(transactions, offers, cp))
    out = feats.join(share, "productid", "left").join(comp, "category", "left")
    head = list(cohort.columns)
    return out.select(*head, *feature_order(windows))


def feature_columns(df: DataFrame) -> list[str]:
    """Model inputs: every column but the identifiers, outcome and product
    keys -- sorted, so the vector layout does not depend on hash order."""
    return sorted(c for c in df.columns if c not in NON_FEATURE_COLUMNS)


def feature_matrix_long(features: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """The model input in long form: one row per (cohort row, feature) with
    the feature's position in the sorted vector layout and its value as
    DOUBLE (nulls filled with 0, as the assembler receives them)."""
    cols = cols or feature_columns(features)
    filled = features.select(
        "split", "id", "offer",
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    long = filled.unpivot(["split", "id", "offer"], cols, "feature", "value")
    position = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("feature")) - 1
    return long.select("split", "id", "offer", position.cast("int").alias("position"), "feature", "value")


def cohort_row_checks(history: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Row invariants of the derived cohort tables, one row per check.

    Each table has one row per history row, and its values are consistent:
    a count of ``never_bought`` flags (every field) that equals the count of
    zero-match rows, seen through the sums -- so the check reads the features
    and not only the cohort.  A last row counts repeated cohort keys.
    """
    expected = history.select(F.count(F.lit(1))).scalar()
    parts = []
    for name, df in tables.items():
        flags = [c for c in df.columns if c.startswith("never_bought_")]
        broken = F.lit(False)
        for c in flags:
            field = c.removeprefix("never_bought_")
            shortest = min((x for x in df.columns if x.startswith(f"has_bought_{field}_q_")), key=lambda x: int(x.rsplit("_", 1)[1]))
            amount = shortest.replace("_q_", "_a_")
            broken = broken | ((F.col(c) == 1) & ((F.coalesce(shortest, F.lit(1)) != 0) | (F.coalesce(amount, F.lit(1.0)) != 0)))
        if "visits_30" in df.columns:
            broken = broken | ((F.col("visits_30") == 0) & ((F.col("total_spend_30") != 0) | (F.col("prodid_count_30") != 0)))
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(broken).alias("n_broken"))
                     .select(F.lit(name).alias("check"), "n_rows", "n_broken"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumn("n_expected", expected)
    dupes = (history.groupBy("split", "id", "offer").count().where(F.col("count") > 1)
             .agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit("duplicate_cohort_keys").alias("check"), "n_rows", F.lit(0).cast("long").alias("n_broken"),
                     F.lit(0).cast("long").alias("n_expected")))
    return rows.unionByName(dupes).withColumn("ok", (F.col("n_rows") == F.col("n_expected")) & (F.col("n_broken") == 0))
