"""Model stage: label mapping, AUC, scoring without labels, keyed submission."""

import random

import pytest

from pyspark.sql import functions as F

from revisit.operators import model as M


def _scored(spark, n=400, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        label = 1.0 if rnd.random() < 0.35 else 0.0
        score = round(rnd.random() + 0.3 * label, 2)   # ties on purpose
        rows.append((i, label, score))
    return spark.createDataFrame(rows, "id long, label double, score double")


def test_rank_sum_auc_equals_evaluator(spark):
    df = _scored(spark)
    mine = M.auc_rank_sum(df, "score", "label", partitions=5).collect()[0]
    ref = M.auc_evaluator(df.withColumnRenamed("score", "repeatProbability"))
    assert abs(mine.auc_roc - ref) < 1e-12
    assert mine.n_pos + mine.n_neg == 400


def test_rank_sum_auc_independent_of_partitions(spark):
    df = _scored(spark, seed=3)
    a = [M.auc_rank_sum(df, "score", "label", partitions=p).collect()[0].auc_roc for p in (1, 3, 16)]
    assert a[0] == a[1] == a[2]


def test_label_is_fixed_mapping(spark):
    df = spark.createDataFrame([("t",), ("t",), ("f",), (None,)], "repeater string")
    out = M.with_label(df)
    assert [r.label for r in out.collect()] == [1.0, 1.0, 0.0, None]
    with pytest.raises(ValueError, match="1 training rows"):
        M.labelled(out)


def test_feature_columns_sorted_and_exclusive():
    import types
    df = types.SimpleNamespace(columns=["id", "zeta", "offer", "alpha", "split", "repeater", "productid"])
    assert M.feature_columns(df) == ["alpha", "zeta"]


def test_fit_score_and_submission(spark):
    rnd = random.Random(1)
    rows = [(i, "train" if i % 5 else "test", float(rnd.random()), float(rnd.random()),
             ("t" if rnd.random() < 0.4 else "f") if i % 5 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, split string, x1 double, x2 double, repeater string")
    cols = ["x1", "x2"]
    train = M.with_label(df.where("split = 'train'"))
    test = df.where("split = 'test'")            # no label column: scoring still works
    model = M.fit(train, cols, params={"maxDepth": 2, "maxBins": 8, "maxIter": 3})
    scored = M.score(model, test)
    assert scored.schema["repeatProbability"].dataType.typeName() == "float"
    ids = test.select("id").union(spark.createDataFrame([(9999,)], "id long"))
    sub = M.submission(ids, scored)
    got = {r.id: r.repeatProbability for r in sub.collect()}
    assert len(got) == 41 and got[9999] is None
    assert all(0.0 <= v <= 1.0 for k, v in got.items() if k != 9999)


def test_cross_validate_small_grid(spark):
    rnd = random.Random(2)
    rows = [(float(rnd.random()), 1.0 if rnd.random() < 0.5 else 0.0) for _ in range(120)]
    df = spark.createDataFrame(rows, "x1 double, label double").withColumn("x2", F.col("x1") * 2)
    _, metrics = M.cross_validate(df, ["x1", "x2"], grid={"maxDepth": [1, 2], "maxIter": [2]},
                                  folds=2, parallelism=2)
    out = metrics.collect()
    assert len(out) == 2 and all(0.0 <= r.avg_auc <= 1.0 for r in out)


def test_folds_do_not_depend_on_the_layout(spark):
    rnd = random.Random(4)
    rows = [("train", i, i % 3, float(rnd.random()), 1.0 if rnd.random() < 0.5 else 0.0) for i in range(300)]
    df = spark.createDataFrame(rows, "split string, id long, offer long, x double, label double")
    seen = []
    for n in (1, 4, 16):
        _, metrics = M.cross_validate(df.repartition(n), ["x"], grid={"maxDepth": [1]}, folds=3)
        seen.append(round(metrics.first().avg_auc, 9))
    assert seen[0] == seen[1] == seen[2]


def test_submission_pairs_on_the_cohort_key(spark):
    scored = spark.createDataFrame([(1, 0, 0.25), (1, 1, 0.5), (2, 0, 0.75)], "id long, offer long, repeatProbability float")
    asked = spark.createDataFrame([(1, 0), (1, 1), (9, 0)], "id long, offer long")
    out = M.submission(asked, scored)
    assert sorted((r.id, r.offer, r.repeatProbability) for r in out.collect() if r.id == 1) == [(1, 0, 0.25), (1, 1, 0.5)]
    check = M.submission_checks(asked, out).first()
    assert (check.n_rows, check.n_requested, check.n_unscored, check.ok) == (3, 3, 1, True)
    by_id = M.submission(asked.select("id"), scored).collect()
    assert sorted(r.repeatProbability for r in by_id if r.id == 1) == [0.5, 0.5]


def test_auc_counts_do_not_overflow(spark):
    df = spark.createDataFrame([(0.0, 1), (1.0, 1)], "s double, label int")
    assert M.auc_rank_sum(df.withColumn("label", F.when(F.col("s") > 0, 1).otherwise(0)), "s").first().auc_roc == 1.0


def test_a_damaged_table_fails_the_checks(spark):
    from revisit.operators.assemble import cohort_row_checks
    h = spark.createDataFrame([("train", 1, 0), ("test", 2, 0)], "split string, id long, offer long")
    good = h.withColumn("has_bought_brand_q_30", F.lit(0)).withColumn("has_bought_brand_a_30", F.lit(0.0)).withColumn("never_bought_brand", F.lit(1))
    bad = good.withColumn("has_bought_brand_a_30", F.col("id") * 1.0)
    ok = {r["check"]: r.ok for r in cohort_row_checks(h, {"good": good, "bad": bad, "short": good.where("id = 1")}).collect()}
    assert ok == {"good": True, "bad": False, "short": False, "duplicate_cohort_keys": True}


def test_grid_points_that_differ_in_rounds_share_a_fit(spark, monkeypatch):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    rnd = random.Random(6)
    rows = [("train", i, 0, float(rnd.random()), 1.0 if rnd.random() < 0.5 else 0.0) for i in range(300)]
    df = spark.createDataFrame(rows, "split string, id long, offer long, x double, label double")
    fits = []
    fit = M.Pipeline._fit
    monkeypatch.setattr(M.Pipeline, "_fit", lambda self, data: fits.append(1) or fit(self, data))
    grid = {"maxDepth": [1, 3], "maxIter": [2, 5]}
    _, metrics = M.cross_validate(df, ["x"], grid=grid, folds=2)
    assert len(fits) == 2 * 2 + 1
    folded = df.withColumn("fold", F.pmod(F.xxhash64("split", "id", "offer", F.lit(M.SEED)), F.lit(2))).coalesce(1).cache()
    for row in metrics.collect():
        auc = [BinaryClassificationEvaluator().evaluate(M.build_pipeline(["x"], maxDepth=row.maxDepth, maxIter=row.maxIter)
               .fit(folded.where(F.col("fold") != k)).transform(folded.where(F.col("fold") == k))) for k in range(2)]
        assert abs(sum(auc) / 2 - row.avg_auc) < 1e-9


def test_a_fit_has_partitions_by_rows(spark, monkeypatch):
    seen = []
    fit = M.Pipeline._fit
    monkeypatch.setattr(M.Pipeline, "_fit", lambda self, data: seen.append(data.rdd.getNumPartitions()) or fit(self, data))
    df = spark.range(400, numPartitions=40).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("label"))
    M.fit(df, ["x"], kind="lr")
    monkeypatch.setattr(M, "ROWS_PER_FIT_PARTITION", 100)
    M.fit(df, ["x"], kind="lr")
    assert seen == [1, 4]
