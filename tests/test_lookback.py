"""Look-back window semantics on hand-made rows (FIXTURES.md section 4)."""

from pyspark.sql import functions as F

from helpers import D, by_key, history, offers, tx
from revisit.operators.enrich import history_offers
from revisit.operators.lookback import (has_bought, lookback_features, lookback_join,
                                        purchase_facts, user_spend)

OFFERS = [(0, 10, 100, 1000, 1.0)]


def _features(spark, txs, hist, offer_rows=OFFERS, windows=(30,)):
    o = offers(spark, offer_rows)
    h = history(spark, hist)
    cohort = history_offers(h, o, with_productid=True)
    facts = purchase_facts(tx(spark, txs))
    return by_key(lookback_features(cohort, facts, windows=windows))


def test_window_ends_are_inclusive(spark):
    od = D(2000, 3, 31)
    rows = [
        (1, 10, 100, 1000, od, 1, 1.0),                   # offer day
        (1, 10, 100, 1000, D(2000, 3, 1), 2, 2.0),        # exactly 30 days back
        (1, 10, 100, 1000, D(2000, 2, 29), 4, 4.0),       # 31 days back
        (1, 10, 100, 1000, D(2000, 4, 1), 8, 8.0),        # one day after
    ]
    r = _features(spark, rows, [(1, 0, od)])[1]
    assert r["has_bought_company_q_30"] == 3
    assert r["has_bought_company_a_30"] == 3.0
    assert r["never_bought_company"] == 0
    assert r["visits_30"] == 2
    assert r["total_spend_30"] == 3.0
    assert r["prodid_count_30"] == 3


def test_fields_match_independently(spark):
    od = D(2000, 1, 31)
    rows = [
        (1, 10, 999, 999, od, 1, 1.0),     # category only
        (1, 999, 100, 999, od, 2, 2.0),    # company only
        (1, 999, 999, 1000, od, 4, 4.0),   # brand only
        (1, 999, 999, 999, od, 8, 8.0),    # nothing: counts in totals only
    ]
    r = _features(spark, rows, [(1, 0, od)])[1]
    assert (r["has_bought_category_q_30"], r["has_bought_company_q_30"], r["has_bought_brand_q_30"]) == (1, 2, 4)
    assert r["prodid_count_30"] == 0 and r["prodid_spend_30"] == 0.0
    assert r["total_spend_30"] == 15.0 and r["visits_30"] == 1


def test_unknown_offer_and_no_purchases(spark):
    od = D(2000, 1, 31)
    rows = [(1, 10, 100, 1000, od, 1, 1.0)]
    r = _features(spark, rows, [(1, 42, od), (2, 0, od)])
    unknown, idle = r[1], r[2]
    assert unknown["category"] is None and unknown["productid"] is None
    assert unknown["has_bought_brand_q_30"] == 0 and unknown["never_bought_brand"] == 1
    assert unknown["total_spend_30"] == 1.0  # totals do not depend on the offer
    assert idle["has_bought_brand_a_30"] == 0.0 and idle["never_bought_category"] == 1
    assert idle["visits_30"] == 0 and idle["total_spend_30"] == 0.0


def test_null_offerdate_gives_defaults(spark):
    rows = [(1, 10, 100, 1000, D(2000, 1, 1), 1, 1.0)]
    r = _features(spark, rows, [(1, 0, None)])[1]
    assert r["has_bought_company_q_30"] == 0 and r["never_bought_company"] == 1
    assert r["visits_30"] == 0


def test_null_brand_never_matches(spark):
    od = D(2000, 1, 31)
    rows = [(1, 10, 100, None, od, 1, 1.0)]
    r = _features(spark, rows, [(1, 0, od)], offer_rows=[(0, 10, 100, None, 1.0)])[1]
    assert r["has_bought_brand_q_30"] == 0 and r["never_bought_brand"] == 1
    assert r["has_bought_category_q_30"] == 1
    assert r["productid"] is None and r["prodid_count_30"] == 0


def test_matched_nulls_keep_null_sum(spark):
    od = D(2000, 1, 31)
    rows = [(1, 10, 100, 1000, od, None, None)]
    r = _features(spark, rows, [(1, 0, od)])[1]
    assert r["never_bought_company"] == 0
    assert r["has_bought_company_q_30"] is None and r["has_bought_company_a_30"] is None
    # user features coalesce to 0 as in the reference
    assert r["prodid_spend_30"] == 0.0 and r["total_spend_30"] == 0.0 and r["visits_30"] == 1


def test_two_offers_same_customer_not_doubled(spark):
    od = D(2000, 1, 31)
    offer_rows = [(0, 10, 100, 1000, 1.0), (1, 20, 100, 2000, 2.0)]
    rows = [(1, 10, 100, 1000, od, 1, 1.0), (1, 20, 200, 2000, od, 2, 2.0)]
    o = offers(spark, offer_rows)
    h = history(spark, [(1, 0, od), (1, 1, od)])
    out = lookback_features(history_offers(h, o), purchase_facts(tx(spark, rows)), windows=(30,))
    got = {r["offer"]: r for r in out.collect()}
    assert len(got) == 2
    assert got[0]["has_bought_company_q_30"] == 1 and got[1]["has_bought_company_q_30"] == 1
    assert got[0]["has_bought_brand_q_30"] == 1 and got[1]["has_bought_brand_q_30"] == 2
    assert got[0]["total_spend_30"] == 3.0 and got[1]["total_spend_30"] == 3.0


def test_windows_nest(spark):
    od = D(2000, 12, 31)
    rows = [(1, 10, 100, 1000, D(2000, 12, 31) - (D(2000, 12, 31) - D(2000, 12, 31)), 1, 1.0)]
    rows += [(1, 10, 100, 1000, od.fromordinal(od.toordinal() - d), 1, 1.0) for d in (31, 61, 91, 181)]
    r = _features(spark, rows, [(1, 0, od)], windows=(30, 60, 90, 180))[1]
    assert [r[f"has_bought_brand_q_{n}"] for n in (30, 60, 90, 180)] == [1, 2, 3, 4]


def test_one_pass_equals_brute_force_on_the_fixtures(spark, small_dir):
    from test_property import brute
    from revisit.sources.fixtures import load_tables
    for fixture in ("sparse", "dense"):
        tb = load_tables(spark, small_dir, fixture)
        out = lookback_features(history_offers(tb.history, tb.offers), purchase_facts(tb.transactions)).collect()
        lines: dict = {}
        for r in tb.transactions.collect():
            lines.setdefault(r.id, []).append(dict(id=r.id, category=r.category, company=r.company, brand=r.brand, date=r.date,
                                                   q=r.purchasequantity, a=float(r.purchaseamount)))
        products = [(o.category, o.company, o.brand) for o in tb.offers.df.orderBy("offer").collect()]
        for r in out:
            want = brute(lines.get(r.id, []), products, [(r.id, r.offer, r.offerdate)])[(r.id, r.offer)]
            for column, v in want.items():
                assert r[column] == v or abs(r[column] - v) < 1e-6, (r.id, column)


def test_facts_do_not_grow_with_the_catalogue(spark, small_dir):
    from revisit.sources.fixtures import load_tables
    tb = load_tables(spark, small_dir, "dense")
    n_facts, n_lines = purchase_facts(tb.transactions).count(), tb.transactions.count()
    assert n_facts <= n_lines
    products = [tuple(r) for r in tb.transactions.select("category", "company", "brand").distinct().orderBy("category", "company", "brand").collect()]
    facts = purchase_facts(tb.transactions).cache()
    schema = tb.offers.df.schema
    for n in (8, 64, 400):
        o = spark.createDataFrame([(i, *p, 1.0) for i, p in enumerate(products[:n])], schema)
        h = tb.history.withColumn("offer", (F.col("id") % n).cast("long"))
        assert lookback_features(history_offers(h, o), facts).count() == tb.history.count()


def test_repeated_history_rows_stay(spark):
    od = D(2000, 1, 31)
    o, h = offers(spark, OFFERS), history(spark, [(1, 0, od), (1, 0, od)])
    out = lookback_features(history_offers(h, o), purchase_facts(tx(spark, [(1, 10, 100, 1000, od, 3, 7.5)]))).collect()
    assert [r.has_bought_brand_q_30 for r in out] == [3, 3]


def test_long_visit_windows(spark):
    od = D(2000, 12, 31)
    rows = [(1, 10, 100, 1000, od.fromordinal(od.toordinal() - d), 1, 1.0) for d in (0, 0, 59, 60, 61, 119, 120, 150, 151)]
    r = lookback_features(history_offers(history(spark, [(1, 0, od)]), offers(spark, OFFERS)), purchase_facts(tx(spark, rows)), user_window=150).first()
    assert r.visits_150 == 7


def test_user_spend_columns(spark):
    od = D(2000, 1, 31)
    o = offers(spark, OFFERS)
    h = history(spark, [(1, 0, od)])
    out = user_spend(history_offers(h, o), purchase_facts(tx(spark, [(1, 10, 100, 1000, od, 3, 7.5)])))
    assert out.columns == ["split", "id", "offer", "category", "company", "brand",
                           "prodid_spend_30", "prodid_count_30", "total_spend_30", "visits_30"]
    r = out.collect()[0]
    assert (r.prodid_spend_30, r.prodid_count_30, r.total_spend_30, r.visits_30) == (7.5, 3, 7.5, 1)


def test_lookback_join_rows(spark):
    od = D(2000, 1, 31)
    o = offers(spark, OFFERS)
    h = history(spark, [(1, 0, od)])
    rows = [(1, 10, 100, 1000, od, 1, 1.0), (1, 10, 100, 1000, D(1999, 12, 31), 1, 1.0),
            (1, 10, 100, 1000, D(1999, 12, 30), 1, 1.0), (2, 10, 100, 1000, od, 1, 1.0)]
    out = lookback_join(tx(spark, rows), history_offers(h, o), 31)
    assert out.count() == 2
    assert set(out.columns) >= {"offer_category", "offer_company", "offer_brand", "offerdate"}


def test_salted_join_splits_hot_key_and_keeps_every_pair(spark):
    from revisit.operators.skew import collapse_equal, hot_keys
    od = D(2000, 1, 31)
    hot_rows = [(7, 10, 100, 1000, od.fromordinal(od.toordinal() - (i % 40)), 1, float(i)) for i in range(3000)]
    cold_rows = [(i, 10, 100, 1000, od, 1, 1.0) for i in range(1, 6)]
    t = tx(spark, hot_rows + cold_rows)
    o = offers(spark, OFFERS)
    h = history(spark, [(7, 0, od)] + [(i, 0, od) for i in range(1, 6)])
    cohort = history_offers(h, o)
    hot = hot_keys(t, "id", 300).collect()
    assert [(r.id, r._buckets) for r in hot] == [(7, 10)]
    assert [r.id for r in hot_keys(t, "id").collect()] == [7]           # an equal share of 8 partitions
    salted = lookback_join(t, cohort, 30, rows_per_task=300)
    plain = lookback_join(t, cohort, 30, split_hot_keys=False)
    # hot lines sit 0..39 days back, 31 of every 40 fall in the window
    assert salted.count() == plain.count() == 3000 * 31 // 40 + 5
    assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0
    from_raw = lookback_join(t, cohort, 30, hot_from=t, rows_per_task=300)
    assert from_raw.exceptAll(plain).count() == 0 and from_raw.count() == plain.count()
    # equal lines of one customer meet as one row with their number
    same = tx(spark, [(7, 10, 100, 1000, od, 1, 1.0)] * 1000)
    few = collapse_equal(same, "id", hot_keys(same, "id", 300)).collect()
    assert [r["_copies"] for r in few] == [1000]
    assert lookback_join(same, cohort, 30, rows_per_task=300).count() == 1000


def test_buckets_do_not_depend_on_the_order_of_rows(spark):
    from revisit.operators.skew import bucket_of
    rows = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    first = rows.repartition(7, "v").withColumn("b", bucket_of(["k", "v"], F.lit(10)))
    again = rows.orderBy(F.desc("v")).repartition(3).withColumn("b", bucket_of(["k", "v"], F.lit(10)))
    assert first.exceptAll(again).count() == 0
    assert first.select("b").distinct().count() == 10


def test_pairs_form_only_in_touched_cells(spark):
    from revisit.operators.lookback import CELLS, by_cell
    last = D(2020, 1, 1)
    t = tx(spark, [(7, 10, 100, 1000, D.fromordinal(last.toordinal() - i), 1, 1.0) for i in range(20 * 365)])
    cohort = history_offers(history(spark, [(7, 0, D(2010, 5, 5)), (7, 0, None)]), offers(spark, OFFERS))
    lines, rows = by_cell(t, cohort, 30)
    pairs = lines.join(rows, F.col("_t_key") == F.col("_c_key")).count()
    assert 31 <= pairs <= 31 * (CELLS + 1) // CELLS + 11
    assert lookback_join(t, cohort, 30).count() == 31


def test_no_cap_on_hot_keys_or_buckets(spark):
    from revisit.operators.skew import hot_keys, salted_join
    big = spark.range(24_000).select((F.col("id") % 12_000).alias("k"), F.col("id").alias("v"))
    assert hot_keys(big, "k", 1).count() == 12_000
    one = spark.range(10_000).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("v"))
    assert hot_keys(one, "k", 2).first()._buckets == 5000
    small = spark.createDataFrame([(1, "x")], "k2 long, w string")
    assert salted_join(one, small, "k", "k2", rows_per_task=2).count() == 10_000


def test_features_with_split_customers(spark):
    od = D(2000, 6, 30)
    rows = [(7, 10, 100, 1000 + i % 50, od.fromordinal(od.toordinal() - i % 40), 1, float(i)) for i in range(2000)] + [(1, 10, 100, 1000, od, 1, 2.0)]
    cohort = history_offers(history(spark, [(7, 0, od), (1, 0, od), (2, 0, od)]), offers(spark, OFFERS))
    facts = purchase_facts(tx(spark, rows))
    split = lookback_features(cohort, facts, rows_per_task=100)
    assert split.exceptAll(lookback_features(cohort, facts, rows_per_task=10 ** 9)).count() == 0 and split.count() == 3


def test_salted_left_join_keeps_unmatched(spark):
    from revisit.operators.skew import salted_join
    big = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    small = spark.createDataFrame([(1, "x")], "k2 long, w string")
    out = salted_join(big, small, "k", "k2", how="left", rows_per_task=1).collect()
    assert sorted((r.v, r.w) for r in out) == [("a", "x"), ("b", "x"), ("c", None)]


def test_date_bounds_when_no_offer_dates(spark):
    from revisit.operators.lookback import cohort_date_bounds
    o = offers(spark, OFFERS)
    h = history(spark, [(1, 0, None), (2, 0, None)])
    t = tx(spark, [(1, 10, 100, 1000, D(2000, 1, 1), 1, 1.0)])
    bounds = cohort_date_bounds(h, 180)
    out = lookback_features(history_offers(h, o), purchase_facts(t, date_bounds=bounds)).collect()
    assert len(out) == 2
    assert all(r.has_bought_brand_q_180 == 0 and r.never_bought_brand == 1 and r.visits_30 == 0 for r in out)


def test_hot_customer_is_bounded_before_the_join(spark):
    """A customer with a third of all lines reaches the cohort join as one
    row per day and product; features are unchanged."""
    import random
    rnd = random.Random(11)
    od = D(2000, 6, 30)
    offer_rows = [(0, 10, 100, 1000, 1.0), (1, 20, 100, 2000, 2.0)]
    rows = []
    for i in range(6000):
        cid = 7 if i % 3 == 0 else rnd.randint(1, 300)        # customer 7 holds a third
        day = od.fromordinal(od.toordinal() - rnd.randint(0, 59))
        rows.append((cid, rnd.choice([10, 20, 30]), rnd.choice([100, 200]), rnd.choice([1000, 2000, 3000]),
                     day, rnd.randint(1, 3), float(rnd.randint(1, 500))))
    t = tx(spark, rows)
    o = offers(spark, offer_rows)
    facts = purchase_facts(t)
    hot_lines = sum(1 for r in rows if r[0] == 7)
    hot_days = len({r[1:5] for r in rows if r[0] == 7})
    hot_facts = facts.where(F.col("id") == 7).count()
    assert hot_lines >= 2000 and hot_facts == hot_days < hot_lines
    h = history(spark, [(c, c % 2, od) for c in range(1, 301)])
    cohort = history_offers(h, o)
    got = lookback_features(cohort, facts, windows=(30, 60)).where(F.col("id") == 7).collect()[0]
    lines7 = [r for r in rows if r[0] == 7 and 0 <= (od - r[4]).days <= 30 and r[2] == 100]
    assert got.has_bought_company_q_30 == sum(r[5] for r in lines7)
