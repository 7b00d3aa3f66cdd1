"""Broadcast bound, the paths past it, and stored tables."""

from revisit.operators.sizing import Bounded, broadcast_bounded, within_bound


def test_bound_known_and_counted(spark):
    df = spark.range(50)
    assert within_bound(df, max_rows=50) and not within_bound(df, max_rows=49)
    assert within_bound(df, max_rows=10, known_rows=8)
    assert not Bounded(df, max_rows=10).small
    assert Bounded(df, max_rows=100).small


def test_unbounded_side_is_not_hinted(spark):
    big = spark.range(1000).withColumnRenamed("id", "k")
    small = spark.range(10).withColumnRenamed("id", "k")
    j_small = spark.range(100000).withColumnRenamed("id", "k").join(broadcast_bounded(small, 100), "k")
    assert "BroadcastHashJoin" in j_small._jdf.queryExecution().executedPlan().toString()
    hinted = broadcast_bounded(big, max_rows=100)
    assert hinted is big                       # over the bound: returned unhinted


def test_hot_product_and_coupon_past_the_bound(spark):
    """One company and one coupon with a third of all rows: same rows as by broadcast."""
    from helpers import D, history, offers, tx
    from revisit.operators.enrich import history_offers
    from revisit.operators.reduce import reduce_transactions
    rows = [(i, 10 if i % 3 else 11, 100 if i % 3 else 7, None if i % 5 else 1000, D(2000, 1, 1), 1, 1.0) for i in range(900)]
    o, t = offers(spark, [(0, 11, 200, 3000, 1.0), (1, 50, 100, None, 1.0)]), tx(spark, rows)
    h = history(spark, [(i, 0 if i % 3 else 5, D(2000, 1, 1)) for i in range(300)])
    for f, left in ((reduce_transactions, t), (history_offers, h)):
        near, far = f(left, Bounded(o)), f(left, Bounded(o, max_rows=0))
        assert near.count() == far.count() and near.exceptAll(far).count() == 0
    plan = reduce_transactions(t, Bounded(o, max_rows=0))._jdf.queryExecution().toString()
    assert "_salt" in plan


def test_scratch_needs_a_shared_folder_off_local():
    import types

    import pytest
    from revisit.session import checkpoint_dir
    context = types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, getConf=lambda: {})
    session = types.SimpleNamespace(sparkContext=context, conf={})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(session)


def test_two_folders_in_one_session(spark, small_dir):
    import __spark_entry__ as E
    other = "/root/testdata/sf0.01"
    reduce = E.queries()["reduce_transactions"]
    held = reduce(spark, small_dir)
    counts = [reduce(spark, d).count() for d in (small_dir, other, small_dir, small_dir + "/")]
    assert counts[0] == counts[2] == counts[3] == held.count() != counts[1]
    assert E.entry(spark).count() == 150


def test_unbroadcast_catalogue_gives_same_results(spark, small_dir):
    """Past the broadcast bound every operator runs on shuffle joins and
    returns the same rows."""
    from revisit.operators.assemble import assemble_features
    from revisit.operators.reduce import reduce_transactions
    from revisit.sources.fixtures import load_tables
    tb = load_tables(spark, small_dir, "dense")
    big = Bounded(tb.offers.df, max_rows=0)          # treated as unbounded
    assert not big.small
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        shuffled = assemble_features(tb.transactions, big, tb.history)
        reduced = reduce_transactions(tb.transactions, big)
        plan = shuffled._jdf.queryExecution().executedPlan().toString()
        # only the hot-key lists, bounded by construction, are broadcast
        assert all("_hk_" in line for line in plan.splitlines() if "BroadcastHashJoin" in line)
        assert "BroadcastNestedLoopJoin" not in plan
        rows_s, red_s = shuffled.collect(), reduced.count()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    broadcast = assemble_features(tb.transactions, tb.offers, tb.history)
    assert spark.createDataFrame(rows_s, broadcast.schema).exceptAll(broadcast).count() == 0
    assert len(rows_s) == broadcast.count()
    assert red_s == reduce_transactions(tb.transactions, tb.offers).count()
