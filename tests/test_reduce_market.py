"""Reduction, key lists and market features on hand-made rows."""

from helpers import D, offers, tx
from revisit.operators.keys import offer_keys, offer_productids
from revisit.operators.market import competition, product_share
from revisit.operators.reduce import category_dept_map, reduce_transactions

DAY = D(2000, 1, 1)


def test_reduction_or_of_three_fields(spark):
    o = offers(spark, [(0, 10, 100, 1000, 1.0)])
    t = tx(spark, [(1, 10, 1, 1, DAY, 1, 1.0), (2, 1, 100, 1, DAY, 1, 1.0),
                   (3, 1, 1, 1000, DAY, 1, 1.0), (4, 1, 1, 1, DAY, 1, 1.0),
                   (5, None, None, 1000, DAY, 1, 1.0)])
    kept = sorted(r.id for r in reduce_transactions(t, o).collect())
    assert kept == [1, 2, 3, 5]
    assert reduce_transactions(t, o).columns == t.columns


def test_reduction_with_one_offer_and_with_none(spark):
    t = tx(spark, [(1, 10, 1, 1, DAY, 1, 1.0)])
    assert reduce_transactions(t, offers(spark, [(0, 10, 100, 1000, 1.0)])).count() == 1
    assert reduce_transactions(t, offers(spark, [])).count() == 0


def test_reduction_plan_is_broadcast_hash_no_nested_loop(spark):
    o = offers(spark, [(0, 10, 100, 1000, 1.0)])
    t = tx(spark, [(1, 10, 1, 1, DAY, 1, 1.0)])
    plan = reduce_transactions(t, o)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "BroadcastHashJoin" in plan


def test_offer_keys_and_productids(spark):
    o = offers(spark, [(0, 10, 100, 1000, 1.0), (1, 10, 200, None, 2.0)])
    keys = {(r.key_field, r.key_value) for r in offer_keys(o).collect()}
    assert keys == {("category", "10"), ("company", "100"), ("company", "200"), ("brand", "1000")}
    ids = {r.productid for r in offer_productids(o).collect()}
    assert ids == {"10 100 1000", None}


def test_product_share_and_competition(spark):
    o = offers(spark, [(0, 10, 100, 1000, 1.0), (1, 20, 100, 3000, 2.0), (2, 30, 5, 5, 3.0)])
    t = tx(spark, [
        (1, 10, 100, 1000, DAY, 1, 6.0), (2, 10, 100, 1000, DAY, 1, 2.0),
        (3, 10, 200, 2000, DAY, 1, 2.0), (4, 10, None, 2000, DAY, 1, 50.0),
        # category 20: spend sums to zero (a return)
        (5, 20, 100, 3000, DAY, 1, 5.0), (6, 20, 300, 3000, DAY, 1, -5.0),
        (7, 99, 100, 1000, DAY, 1, 1.0),
    ])
    share = {r.productid: r.marketshare_in_cat for r in product_share(t, o).collect()}
    assert share == {"10 100 1000": 0.5, "20 100 3000": 0.5}   # offer 2's product never sold
    comp = {r.category: (r.competing_products_in_cat, r.marketshare_dominant_prod_in_cat)
            for r in competition(t, o).collect()}
    assert comp[10] == (2, 50.0 / 60.0)       # null company not counted as a product
    assert comp[20] == (2, None)              # zero total spend -> null share
    assert 99 not in comp


def test_category_dept_map(spark):
    t = tx(spark, [(1, 10, 1, 1, DAY, 1, 1.0), (2, 10, 1, 1, DAY, 1, 1.0)])
    r = category_dept_map(t).collect()
    assert [(x.dept, x.category, x["count"]) for x in r] == [(1, 10, 2)]


def test_parquet_default_mode_refuses_overwrite(spark, tmp_path):
    import pytest
    from pyspark.errors import AnalysisException

    from revisit.sources.io import write_parquet
    df = tx(spark, [(1, 10, 1, 1, DAY, 1, 1.0)])
    write_parquet(df, str(tmp_path / "t"))
    with pytest.raises(AnalysisException):
        write_parquet(df, str(tmp_path / "t"))
    write_parquet(df, str(tmp_path / "t"), mode="overwrite")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
