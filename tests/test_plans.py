"""Physical-plan properties the design relies on."""

import pytest

import __spark_entry__ as E
from revisit.operators.enrich import history_offers
from revisit.operators.lookback import cohort_date_bounds, lookback_features, purchase_facts
from revisit.sources.fixtures import load_tables

CHEAP = ["offer_keys", "offer_productids", "reduce_transactions", "cat_dept_map", "history_offers",
         "lookback_join", "has_bought_30", "user_spend", "product_share", "competition",
         "assemble_features", "auc_roc"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHEAP)
def test_no_nested_loop_or_cartesian(spark, small_dir, name):
    plan = _plan(E.queries()[name](spark, small_dir))
    assert "BroadcastNestedLoopJoin" not in plan
    assert "CartesianProduct" not in plan


def test_date_prefilter_reaches_parquet_scan(spark, small_dir):
    tb = load_tables(spark, small_dir, "dense")
    facts = purchase_facts(tb.transactions, date_bounds=cohort_date_bounds(tb.history, 180))
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        plan = _plan(facts)
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "purchaseamount" in line]
    pushed = [s[s.index("PushedFilters"):s.index("ReadSchema")] for s in scans]
    assert pushed and all("GreaterThanOrEqual(date," in p and "LessThanOrEqual(date," in p for p in pushed)


def test_facts_are_never_broadcast(spark, small_dir):
    tb = load_tables(spark, small_dir, "dense")
    cohort = history_offers(tb.history, tb.offers, with_productid=True)
    plan = _plan(lookback_features(cohort, purchase_facts(tb.transactions)))
    assert plan.count("SortMergeJoin") == 2 and "SortAggregate" not in plan


def test_assembly_scans_the_lines_twice(spark, small_dir, monkeypatch):
    """Facts and product totals are the only plans that read purchase lines."""
    from revisit.operators import assemble
    tb = load_tables(spark, small_dir, "dense")
    plans = []
    stored = assemble._stored
    monkeypatch.setattr(assemble, "_stored", lambda df: plans.append(_plan(df)) or stored(df))
    out = assemble.assemble_features(tb.transactions, tb.offers, tb.history)
    assert sum("purchaseamount" in line for p in plans + [_plan(out)] for line in p.splitlines() if "FileScan" in line) == 2


def test_facts_are_partially_aggregated_before_shuffle(spark, small_dir):
    tb = load_tables(spark, small_dir, "dense")
    lines = _plan(purchase_facts(tb.transactions)).splitlines()
    first_exchange = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning(id" in line)
    assert "partial_" in lines[first_exchange + 1]
