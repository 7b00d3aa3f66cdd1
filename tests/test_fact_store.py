"""Facts kept up to date, the checked raw load and AUC by group."""

import random

import pytest
from pyspark.sql import functions as F

from helpers import D, tx
from revisit.operators import model as M
from revisit.operators.fact_store import FactStore
from revisit.operators.lookback import purchase_facts
from revisit.sources.raw import HISTORY_TYPES, OFFER_TYPES, load_raw_checked, typed_rows


def lines(n, seed, start=0):
    r = random.Random(seed)
    return [(r.randrange(5), 10, r.randrange(3), 7, D.fromordinal(D(2000, 1, 1).toordinal() + start + r.randrange(10)), r.randrange(4), float(r.randrange(9)))
            for _ in range(n)]


def test_batches_add_up_and_repeat_harmlessly(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "facts"))
    assert store.facts() is None and store.absorbed() == []
    parts = [lines(50, 1), lines(40, 2, 5), [], lines(30, 3, 30)]
    for i, part in enumerate(parts):
        assert store.absorb(f"b{i}", tx(spark, part))
        assert not store.absorb(f"b{i}", tx(spark, part))
    whole = purchase_facts(tx(spark, [x for p in parts for x in p]))
    assert sorted(map(tuple, store.facts().collect())) == sorted(map(tuple, whole.collect()))
    day = D(2000, 1, 31)
    late = store.facts(first=day)
    assert sorted(map(tuple, late.collect())) == sorted(map(tuple, whole.where(F.col("date") >= F.lit(day)).collect()))
    with pytest.raises(ValueError):
        store.absorb("a/b", tx(spark, []))


def test_an_unlisted_batch_is_overwritten(spark, tmp_path):
    """The driver was lost between a batch's facts and its name."""
    store = FactStore(spark, str(tmp_path / "facts"))
    purchase_facts(tx(spark, lines(20, 4))).write.parquet(f"{store.path}/facts/b0")
    assert store.facts() is None
    store.absorb("b0", tx(spark, lines(20, 4)))
    assert store.facts().agg(F.sum("n")).first()[0] == 20


def test_refused_rows(spark, tmp_path):
    rows = spark.createDataFrame([("1", "2000-01-01", "x"), ("one", "2000-01-01", None), (None, "2000-13-01", ""), ("99999999999999999999", None, "f")],
                                 "id string, offerdate string, repeater string")
    good, refused = typed_rows(rows, HISTORY_TYPES, "train history")
    assert [tuple(r) for r in good.collect()] == [(1, D(2000, 1, 1), "x")] and dict(good.dtypes)["id"] == "bigint"
    assert sorted((r["columns"], r["source"]) for r in refused.collect()) == [(["id"], "train history")] * 2 + [(["offerdate"], "train history")]
    texts = {"tx": "id,category,company,brand,date,purchasequantity,purchaseamount\n1,2,3,4,2000-01-01,5,6.5\n1,2,3,4,never,5,6.5\n",
             "offers": "offer,category,company,brand,offervalue\n0,2,3,4,1.5\nx,2,3,4,1.5\n",
             "train": "id,offer,offerdate,repeater\n1,0,2000-02-01,t\n", "test": "id,offer,offerdate\n2,zero,2000-02-01\n3,0,2000-02-01\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    tables, refused = load_raw_checked(spark, *[str(tmp_path / n) for n in texts])
    assert (tables.transactions.count(), tables.offers.df.count(), tables.history.count()) == (1, 1, 2)
    assert sorted(r["source"] for r in refused.collect()) == ["offers", "test history", "transactions"]
    assert dict(tables.offers.df.dtypes)["offervalue"] == OFFER_TYPES["offervalue"]


def test_auc_by_group_equals_counting_pairs(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), r.randrange(2), r.choice([0.1, 0.2, 0.5, None, 3.0, float(r.randrange(50))]), r.randrange(2)) for _ in range(900)]
    rows += [("one", 0, 1.0, 1), ("one", 0, 2.0, 1)]
    df = spark.createDataFrame(rows, "g string, h int, score double, label int").repartition(5)
    for parts in (1, 8):
        got = {(x["g"], x["h"]): (x["auc_roc"], x["n_pos"], x["n_neg"]) for x in M.auc_by_group(df, ["g", "h"], "score", partitions=parts).collect()}
        assert len(got) == 7
        for key, (auc, p, n) in got.items():
            pos, neg = ([s for g, h, s, y in rows if (g, h) == key and s is not None and y == k] for k in (1, 0))
            assert (p, n) == (len(pos), len(neg))
            want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None
            assert auc == pytest.approx(want) if want is not None else auc is None
