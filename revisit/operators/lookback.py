"""Look-back purchase features.

Every feature of a (customer, offer) row is a sum over that customer's own
purchase lines in the days up to the offer date, split by window and by
whether a line shares the offer's company, category or brand.  One pass does
all windows and fields:

1. ``purchase_facts`` aggregates the lines to one row per (customer, day,
   product).  It does not look at the offers, so its size never depends on
   the catalogue and never exceeds the number of lines; the aggregate is
   partial/final and hashed on all its keys, so a customer holding a third of
   all lines is spread over the tasks.
2. ``lookback_features`` joins the cohort to those facts on the customer
   (hot customers split into buckets), so each fact meets only the offers its
   own customer holds, and sums conditionally.  Sums are combined per bucket
   before they meet.

Equality with a brute-force reading of the rules is tested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from revisit.functions.expressions import (MONEY_SCALE, days_before, in_lookback,
                                          money_scale_of, money_units, money_value, sum_if)
from revisit.operators.skew import hot_keys, salted_join
from revisit.schemas import COHORT_KEYS, PRODUCT_FIELDS, USER_WINDOW, WINDOWS

# What a line is matched with: the cohort key, its date and the offer's product.
_MATCH_KEYS = (*COHORT_KEYS, "offerdate", *PRODUCT_FIELDS)


def cohort_date_bounds(cohort: DataFrame, days: int, eager: bool = True) -> tuple[Column, Column]:
    """[min(offerdate) - days, max(offerdate)]: the only dates any cohort row
    can look back to, used to pre-filter the transactions in the scan.

    ``eager`` computes the two dates with one small aggregate job (partial
    min/max per task, one row to the driver) and returns literals, which
    Spark hands to the Parquet reader as pushed filters for row-group
    skipping.  Otherwise they stay scalar subqueries (evaluated in the scan,
    but Spark pushes at most one of the two into Parquet).
    """
    if not eager:
        return (cohort.select(F.date_sub(F.min("offerdate"), days)).scalar(),
                cohort.select(F.max("offerdate")).scalar())
    row = cohort.agg(F.date_sub(F.min("offerdate"), days).alias("lo"),
                     F.max("offerdate").alias("hi")).first()
    return F.lit(row["lo"]).cast("date"), F.lit(row["hi"]).cast("date")


def purchase_facts(transactions: DataFrame, date_bounds: tuple[Column, Column] | None = None) -> DataFrame:
    """One row per (id, date, category, company, brand): number of lines and
    sums of quantity and amount."""
    t = transactions.select("id", "date", "category", "company", "brand", "purchasequantity", "purchaseamount")
    if date_bounds is not None:
        t = t.where(F.col("date").between(*date_bounds))
    a, scale = money_units("purchaseamount", transactions.schema["purchaseamount"].dataType)
    return t.groupBy("id", "date", "category", "company", "brand").agg(
        F.count(F.lit(1)).alias("n"), F.sum("purchasequantity").alias("q"), F.sum(a).alias("a", metadata={MONEY_SCALE: scale}))


VISIT_WORD = 60     # days in one word of a visit bitmap


def _visit_words(days: int) -> int:
    return days // VISIT_WORD + 1


def lookback_sums(cohort: DataFrame, facts: DataFrame, windows: tuple, user_window: int | None,
                  hot: DataFrame | None = None, rows_per_task: int | None = None) -> DataFrame:
    """Conditional sums per distinct (cohort key, offer date, product) that has
    any fact in its window."""
    who = cohort.select(*_MATCH_KEYS).distinct()
    f = facts.select(F.col("id").alias("_f_id"), F.col("date").alias("_f_date"),
                     *[F.col(x).alias(f"_f_{x}") for x in PRODUCT_FIELDS], "n", "q", "a")
    if hot is None:
        hot = hot_keys(facts, "id", rows_per_task)
    span = max(tuple(windows) + ((user_window,) if user_window else ()))
    j = salted_join(f, who, "_f_id", "id", extra=in_lookback("_f_date", "offerdate", span), hot=hot.withColumnRenamed("id", "_f_id"))
    dd = days_before("offerdate", "_f_date")
    match = {x: F.col(f"_f_{x}") == F.col(x) for x in PRODUCT_FIELDS}
    aggs = []
    for w in windows:
        for x in PRODUCT_FIELDS:
            here = (dd <= w) & match[x]
            aggs += [sum_if(here, "n").alias(f"n_{x}_{w}"), sum_if(here, "q").alias(f"q_{x}_{w}"), sum_if(here, "a").alias(f"a_{x}_{w}")]
    if user_window:
        within = dd <= user_window
        product = within & match["company"] & match["category"] & match["brand"]
        aggs += [sum_if(product, "a").alias("a_product"), sum_if(product, "q").alias("q_product"), sum_if(within, "a").alias("a_all")]
        for i in range(_visit_words(user_window)):
            bit = F.expr(f"shiftleft(1L, datediff(offerdate, _f_date) - {i * VISIT_WORD})")
            inside = within & (dd >= i * VISIT_WORD) & (dd < (i + 1) * VISIT_WORD)
            aggs.append(F.bit_or(F.when(inside, bit)).alias(f"days_{i}"))
    return j.groupBy(*_MATCH_KEYS).agg(*aggs)


def _window_columns(n: int, never: bool, scale: int) -> list[Column]:
    out = []
    for f in PRODUCT_FIELDS:
        none = F.coalesce(F.col(f"n_{f}_{n}"), F.lit(0)) == 0
        out.append(F.when(none, F.lit(0).cast("long")).otherwise(F.col(f"q_{f}_{n}")).alias(f"has_bought_{f}_q_{n}"))
        if never:
            out.append(F.when(none, F.lit(1)).otherwise(F.lit(0)).alias(f"never_bought_{f}"))
        out.append(F.when(none, F.lit(0.0)).otherwise(money_value(f"a_{f}_{n}", scale)).alias(f"has_bought_{f}_a_{n}"))
    return out


def lookback_features(cohort: DataFrame, facts: DataFrame, windows=WINDOWS,
                      never_window: int | None = None, user_window: int | None = USER_WINDOW,
                      carry: list[str] | None = None, hot: DataFrame | None = None,
                      rows_per_task: int | None = None) -> DataFrame:
    """Per cohort row (repeated rows stay repeated): has_bought_{field}_{q,a}_{N}
    for every window N, never_bought_{field} for ``never_window`` (default: the
    shortest window) and, unless ``user_window`` is None, the user spend
    features over ``user_window`` days.  ``cohort`` carries the offer's
    category, company and brand.

    0 / 0.0 / never_bought=1 hold only when no line matched; a match whose
    values are all null keeps a null sum.
    """
    windows = tuple(windows)
    never_window = min(windows) if never_window is None and windows else never_window
    front = [c for c in cohort.columns if carry is None or c in carry or c in COHORT_KEYS]
    sums = lookback_sums(cohort, facts, windows, user_window, hot, rows_per_task)
    sums = sums.select(*[F.col(k).alias(f"_k_{k}") for k in _MATCH_KEYS], *[c for c in sums.columns if c not in _MATCH_KEYS])
    on = F.col("id") == F.col("_k_id")
    for k in _MATCH_KEYS:
        if k != "id":
            on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    scale = money_scale_of(facts, "a")
    out = [F.col(c) for c in front]
    for n in windows:
        out += _window_columns(n, n == never_window, scale)
    if user_window:
        visits = sum((F.coalesce(F.bit_count(f"days_{i}"), F.lit(0)) for i in range(_visit_words(user_window))), F.lit(0))
        out += [
            F.coalesce(money_value("a_product", scale), F.lit(0.0)).alias(f"prodid_spend_{user_window}"),
            F.coalesce("q_product", F.lit(0).cast("long")).alias(f"prodid_count_{user_window}"),
            F.coalesce(money_value("a_all", scale), F.lit(0.0)).alias(f"total_spend_{user_window}"),
            visits.cast("long").alias(f"visits_{user_window}"),
        ]
    return cohort.join(sums.hint("merge"), on, "left").select(*out)


def has_bought(cohort_offers: DataFrame, facts: DataFrame, days: int, hot: DataFrame | None = None) -> DataFrame:
    """The has_bought_{N} table: history columns, offer details, then per
    field q / never_bought / a for one window."""
    return lookback_features(cohort_offers, facts, windows=(days,), user_window=None, hot=hot)


def user_spend(cohort_offers: DataFrame, facts: DataFrame, days: int = USER_WINDOW, hot: DataFrame | None = None) -> DataFrame:
    """30-day spend on the offered product, total spend and visit days."""
    keep = [c for c in ("category", "company", "brand") if c in cohort_offers.columns]
    return lookback_features(cohort_offers.select(*COHORT_KEYS, "offerdate", *keep), facts,
                             windows=(), user_window=days, carry=keep, hot=hot)


CELLS = 3       # date cells in a window; a window touches one more at most


def cell_of(date, days: int) -> Column:
    """Number of the date cell that holds a date, for windows of ``days``."""
    return F.floor(F.unix_date(F.col(date) if isinstance(date, str) else date) / max(1, -(-(days + 1) // CELLS))).cast("int")


def by_cell(transactions: DataFrame, cohort_offers: DataFrame, days: int) -> tuple[DataFrame, DataFrame]:
    """(lines, cohort rows) keyed by customer and date cell: a line has the
    cell of its date, a cohort row is repeated for the cells of its window."""
    t = (transactions.where(F.col("id").isNotNull() & F.col("date").isNotNull())
         .select(F.struct(F.col("id"), cell_of("date", days).alias("cell")).alias("_t_key"), "category", "company", "brand",
                 "purchasequantity", "purchaseamount", "date"))
    cells = F.sequence(cell_of(F.date_sub("offerdate", days), days), cell_of("offerdate", days))
    c = (cohort_offers.where(F.col("id").isNotNull() & F.col("offerdate").isNotNull())
         .select(*COHORT_KEYS, F.col("category").alias("offer_category"), F.col("company").alias("offer_company"),
                 F.col("brand").alias("offer_brand"), "offerdate", F.explode(cells).alias("cell"))
         .withColumn("_c_key", F.struct("id", "cell")).drop("cell"))
    return t, c


def lookback_join(transactions: DataFrame, cohort_offers: DataFrame, days: int,
                  split_hot_keys: bool = True, hot_from: DataFrame | None = None,
                  rows_per_task: int | None = None) -> DataFrame:
    """Row-level look-back join: every purchase line of a cohort customer in
    the ``days`` up to and including the offer date.

    An interval join by date cells: both sides meet on (customer, cell), so a
    line only forms a pair with cohort rows whose window touches its cell,
    however long the customer's history is; the range itself is checked on
    those pairs.  A (customer, cell) with more than a task's share of the
    lines is split by ``salted_join``.  ``hot_from``: a table with ``id`` and
    ``date`` to count instead of ``transactions`` (e.g. the unreduced lines:
    two columns to read, counts can only be higher).
    """
    t, c = by_cell(transactions, cohort_offers, days)
    window = in_lookback("date", "offerdate", days)
    if split_hot_keys:
        source = transactions if hot_from is None else hot_from
        keys = source.where(F.col("id").isNotNull() & F.col("date").isNotNull()).select(
            F.struct(F.col("id"), cell_of("date", days).alias("cell")).alias("_t_key"))
        j = salted_join(t, c, "_t_key", "_c_key", extra=window, hot=hot_keys(keys, "_t_key", rows_per_task), collapse=True)
    else:
        j = c.join(t.hint("merge"), (F.col("_t_key") == F.col("_c_key")) & window)
    return j.select(*COHORT_KEYS, "category", "company", "brand",
                    "offer_category", "offer_company", "offer_brand",
                    "purchasequantity", "purchaseamount", "date", "offerdate")
