"""End-to-end runner on the smallest fixture and on raw CSV inputs."""

import datetime as dt
import random

from revisit.plans.run_all import run_pipeline
from revisit.sources.fixtures import load_tables
from revisit.sources.io import read_csv
from revisit.sources.raw import load_raw

SMALL_PARAMS = {"maxDepth": 2, "maxBins": 16, "maxIter": 3}


def test_pipeline_on_fixture(spark, small_dir, tmp_path):
    tables = load_tables(spark, small_dir, "dense")
    rep = run_pipeline(spark, tables, str(tmp_path / "out"), search=True,
                       grid={"maxDepth": [2], "maxIter": [2, 3]}, folds=2)
    n_hist = tables.history.count()
    feats = spark.read.parquet(rep["paths"]["assemble_features"])
    assert feats.count() == n_hist
    assert len(rep["cv_metrics"]) == 2 and set(rep["params"]) == {"maxDepth", "maxIter"}
    for n in (30, 60, 90, 180):
        assert spark.read.parquet(rep["paths"][f"has_bought_{n}"]).count() == n_hist
    sub = spark.read.option("header", True).csv(rep["paths"]["submission"])
    assert sub.count() == tables.history.where("split = 'test'").count()
    assert 0.5 <= rep["train_auc"] <= 1.0


def test_pipeline_on_raw_csv(spark, tmp_path):
    rnd = random.Random(5)
    d0 = dt.date(2013, 3, 1)
    tx_rows = []
    for cid in range(1, 41):
        for _ in range(30):
            day = d0 - dt.timedelta(days=rnd.randint(0, 200))
            tx_rows.append((cid, 1, rnd.randint(1, 9), rnd.choice([1, 2, 3]), rnd.choice([10, 20]),
                            rnd.choice([100, 200, 300]), str(day), 12, "OZ", rnd.randint(1, 3),
                            round(rnd.uniform(-2, 20), 2)))
    cols = "id chain dept category company brand date productsize productmeasure purchasequantity purchaseamount"
    raw = tmp_path / "raw"
    spark.createDataFrame(tx_rows, cols.split()).coalesce(1).write.option("header", True).csv(str(raw / "tx"))
    spark.createDataFrame([(1, 1, 1, 10, 2.0, 100), (2, 2, 1, 20, 1.5, 200)],
                          "offer category quantity company offervalue brand".split()) \
        .coalesce(1).write.option("header", True).csv(str(raw / "offers"))
    train = [(c, 1, 1 + c % 2, 5, rnd.randint(0, 2), "t" if c % 3 else "f", str(d0)) for c in range(1, 31)]
    train = [(c, ch, o, m, (r if rep == "t" else 0), rep, d) for c, ch, o, m, r, rep, d in train]
    spark.createDataFrame(train, "id chain offer market repeattrips repeater offerdate".split()) \
        .coalesce(1).write.option("header", True).csv(str(raw / "train"))
    spark.createDataFrame([(c, 1, 1 + c % 2, 5, str(d0)) for c in range(31, 41)],
                          "id chain offer market offerdate".split()) \
        .coalesce(1).write.option("header", True).csv(str(raw / "test"))
    tables = load_raw(spark, str(raw / "tx"), str(raw / "offers"), str(raw / "train"), str(raw / "test"))
    assert dict(tables.transactions.dtypes)["date"] == "date"
    spark.createDataFrame([(c, 0.0) for c in (31, 35, 99)], "id long, repeatProbability double") \
        .coalesce(1).write.option("header", True).csv(str(raw / "sample"))
    rep = run_pipeline(spark, tables, str(tmp_path / "out"), search=False, params=SMALL_PARAMS,
                       submission_ids=str(raw / "sample"), store_inputs=True)
    assert spark.read.parquet(rep["paths"]["transactions"]).count() == 40 * 30
    feats = spark.read.parquet(rep["paths"]["assemble_features"])
    assert feats.count() == 40
    assert spark.read.parquet(rep["paths"]["offer_productids"]).count() == 2
    assert feats.where("total_spend_30 > 0").count() > 0
    sub = {r.id: r.repeatProbability for r in read_csv(spark, rep["paths"]["submission"], infer_schema=True).collect()}
    assert sorted(sub) == [31, 35, 99] and sub[99] is None and sub[31] is not None
    assert rep["submission_rows"] == rep["requested_ids"] == 3 and rep["submission_unscored"] == 1


def test_a_killed_run_goes_on(spark, small_dir, tmp_path, monkeypatch):
    from revisit.plans import run_all as R
    tables, out = load_tables(spark, small_dir, "dense"), str(tmp_path / "out")
    kw = {"search": False, "params": SMALL_PARAMS, "resume": "inputs-1"}
    with monkeypatch.context() as m:
        m.setattr(R, "user_spend", lambda *a, **k: 1 / 0)
        try:
            run_pipeline(spark, tables, out, **kw)
            raise AssertionError("the run was to be killed")
        except ZeroDivisionError:
            pass
    with monkeypatch.context() as m:
        m.setattr(R, "purchase_facts", lambda *a, **k: 1 / 0)      # not run again
        rep = run_pipeline(spark, tables, out, **kw)
    assert {"_facts", "has_bought_180"} <= set(rep["resumed"]) and "user_spend" not in rep["resumed"] and "user_spend" in rep["seconds"]
    whole = run_pipeline(spark, tables, str(tmp_path / "whole"), **{**kw, "resume": None})
    for name in ("user_spend", "assemble_features", "predictions"):
        a, b = (spark.read.parquet(r["paths"][name]) for r in (rep, whole))
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    again = run_pipeline(spark, tables, out, **kw)
    assert "model" in again["resumed"] and "predictions" in again["resumed"] and not again["seconds"]
    assert not run_pipeline(spark, tables, out, **{**kw, "resume": "inputs-2"})["resumed"]
