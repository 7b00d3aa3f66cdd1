"""Model selection, training, scoring and evaluation with Spark ML.

Gradient-boosted trees over the assembled feature table; cross-validated
grid search; scoring of the held-out cohort; AUC-ROC.  Everything runs on
executors: the only values on the driver are the 12 grid metrics.
"""

from __future__ import annotations

import threading

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from revisit.functions.expressions import positive_class_probability
from revisit.operators.assemble import feature_columns
from revisit.operators.sizing import broadcast_bounded

# Fixed values of the reference's model search and final fit.
GRID = {"maxDepth": [2, 4, 6], "maxBins": [20, 60], "maxIter": [10, 20]}
FINAL_PARAMS = {"maxDepth": 6, "maxBins": 20, "maxIter": 20}
NUM_FOLDS = 6
ROWS_PER_MODEL_PARTITION = 500_000
ROWS_PER_FIT_PARTITION = 100_000      # of one fit, which has the cluster for itself
SEED = 0
POSITIVE, NEGATIVE = "t", "f"


def with_label(df: DataFrame) -> DataFrame:
    """``repeater`` 't' -> 1.0, 'f' -> 0.0 (fixed mapping, not frequency
    order); null or any other value keeps a null label."""
    return df.withColumn("label", F.when(F.col("repeater") == POSITIVE, 1.0).when(F.col("repeater") == NEGATIVE, 0.0))


def labelled(train: DataFrame) -> DataFrame:
    """Rows to train on; raises if any has no usable label."""
    unknown = train.where(F.col("label").isNull()).count()
    if unknown:
        raise ValueError(f"{unknown} training rows have neither 't' nor 'f' as repeater")
    return train


def model_input(df: DataFrame, features: list[str]) -> DataFrame:
    """Nulls in feature columns (a product never sold has no share; a
    category without competitors has none) become 0 for the assembler; the
    feature table itself keeps them null."""
    fill = {c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in features}
    return df.withColumns(fill)


def classifier(kind: str = "gbt", seed: int = SEED, **params):
    if kind == "gbt":
        return GBTClassifier(featuresCol="features", labelCol="label", seed=seed, **params)
    if kind == "rf":
        return RandomForestClassifier(featuresCol="features", labelCol="label", seed=seed, **params)
    if kind == "lr":
        return LogisticRegression(featuresCol="features", labelCol="label", **params)
    raise ValueError(f"unknown classifier {kind!r}")


def build_pipeline(features: list[str], kind: str = "gbt", **params) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[assembler, classifier(kind, **params)])


class FirstTrees(Model):
    """The first trees of a fitted boosting pipeline.  Each tree depends only
    on those before it, so they are what a fit with fewer rounds returns."""

    def __init__(self, pipeline: PipelineModel, rounds: int):
        super().__init__()
        self.pipeline, self.rounds = pipeline, rounds

    def _transform(self, dataset: DataFrame) -> DataFrame:
        *before, boosted = self.pipeline.stages
        for stage in before:
            dataset = stage.transform(dataset)
        margin, names = F.lit(0.0), []
        for i, (tree, weight) in enumerate(zip(boosted.trees[:self.rounds], boosted.treeWeights)):
            names.append(f"_tree_{i}")
            dataset = tree.setFeaturesCol(boosted.getFeaturesCol()).setPredictionCol(names[-1]).transform(dataset)
            margin = margin + F.lit(float(weight)) * F.col(names[-1])
        return dataset.withColumn(boosted.getRawPredictionCol(), margin).drop(*names)


class GridPipeline(Pipeline):
    """A pipeline that ends in boosted trees.  Grid points that differ in
    ``maxIter`` alone take one fit, of the most rounds."""

    def fitMultiple(self, dataset: DataFrame, paramMaps):
        rounds = self.getStages()[-1].maxIter
        points: dict[tuple, list[int]] = {}
        for i, m in enumerate(paramMaps):
            points.setdefault(tuple(sorted((p.name, v) for p, v in m.items() if p != rounds)), []).append(i)
        most = {}
        for same in points.values():
            same.sort(key=lambda i: -paramMaps[i].get(rounds, 0))
            most |= dict.fromkeys(same, same[0])
        order = iter(sorted(most, key=lambda i: i != most[i]))       # the fits first
        fitted, locks, lock = {}, {i: threading.Lock() for i in most.values()}, threading.Lock()

        class Models:
            def __iter__(inner):
                return inner

            def __next__(inner):
                with lock:
                    index = next(order)
                longest = most[index]
                with locks[longest]:
                    if longest not in fitted:
                        fitted[longest] = self.fit(dataset, paramMaps[longest])
                whole = fitted[longest]
                same = index == longest or rounds not in paramMaps[index]
                return index, whole if same else FirstTrees(whole, paramMaps[index][rounds])
        return Models()


def cross_validate(train: DataFrame, features: list[str], grid: dict | None = None,
                   folds: int = NUM_FOLDS, parallelism: int | None = None, seed: int = SEED):
    """Grid search with k-fold CV on AUC-ROC.  Returns the fitted
    CrossValidatorModel and a DataFrame of (params..., avg_auc).

    Grid points that differ in ``maxIter`` alone share a fit.  Fits of
    different grid points run concurrently (default: as many as
    the grid has points, up to the cluster's default parallelism); the
    input is persisted for the search, which reads it once per fold and
    grid point, and released afterwards."""
    from pyspark import StorageLevel
    grid = GRID if grid is None else grid
    pipeline = GridPipeline(stages=build_pipeline(features).getStages())
    clf = pipeline.getStages()[-1]
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(clf.getParam(name), values)
    maps = builder.build()
    from revisit.session import default_parallelism
    if parallelism is None:
        parallelism = max(1, min(len(maps), default_parallelism(train.sparkSession)))
    # The fold is a function of the row's key, so neither partition layout nor row order changes a metric.
    keys = [c for c in ("split", "id", "offer") if c in train.columns] or train.columns
    train = train.withColumn("fold", F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(folds)).cast("int"))
    # Few rows need few partitions (each tree level is a job over them); the count follows the rows alone.
    train = train.coalesce(max(1, -(-train.count() // ROWS_PER_MODEL_PARTITION)))
    cv = CrossValidator(estimator=pipeline, estimatorParamMaps=maps,
                        evaluator=BinaryClassificationEvaluator(metricName="areaUnderROC"),
                        numFolds=folds, parallelism=parallelism, seed=seed, foldCol="fold")
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = cv.fit(train)
    finally:
        train.unpersist()
    names = list(grid)
    rows = [tuple(int(m[clf.getParam(n)]) for n in names) + (float(metric),)
            for m, metric in zip(maps, model.avgMetrics)]
    schema = T.StructType([T.StructField(n, T.IntegerType()) for n in names]
                          + [T.StructField("avg_auc", T.DoubleType())])
    return model, train.sparkSession.createDataFrame(rows, schema)


def best_params(cv_model, grid: dict | None = None) -> dict:
    grid = GRID if grid is None else grid
    best = cv_model.bestModel.stages[-1]
    return {n: best.getOrDefault(best.getParam(n)) for n in grid}


def fit(train: DataFrame, features: list[str], params: dict | None = None,
        kind: str = "gbt") -> PipelineModel:
    params = FINAL_PARAMS if params is None and kind == "gbt" else (params or {})
    # Each tree level or step is a job over all partitions, and each of its tasks returns its own histograms.
    train = train.coalesce(max(1, -(-train.count() // ROWS_PER_FIT_PARTITION)))
    return build_pipeline(features, kind, **params).fit(train)


def score(model: PipelineModel, df: DataFrame, keep=("split", "id", "offer")) -> DataFrame:
    """Positive-class probability as ``repeatProbability`` (float)."""
    pred = model.transform(df)
    cols = [c for c in keep if c in df.columns]
    extra = [c for c in ("label",) if c in df.columns]
    return pred.select(*cols, *extra, positive_class_probability("probability").alias("repeatProbability"))


def auc_evaluator(scored: DataFrame, score_col: str = "repeatProbability") -> float:
    ev = BinaryClassificationEvaluator(rawPredictionCol=score_col, labelCol="label",
                                       metricName="areaUnderROC", numBins=0)
    return ev.evaluate(scored.withColumn(score_col, F.col(score_col).cast("double")))


def auc_rank_sum(df: DataFrame, score_col: str, label_col: str = "label",
                 partitions: int | None = None) -> DataFrame:
    """Exact AUC-ROC (ties count one half) as a distributed DataFrame.

    AUC = sum over distinct scores s of pos(s) * (neg_below(s) + neg(s)/2)
          / (P * N).
    ``neg_below`` is a prefix sum over score order, computed without a
    global single-partition window: the distinct scores are cut into score
    ranges (split points from approximate quantiles, computed once; at most
    ``partitions`` values reach the driver), each range gets the negative
    total of the ranges below it (a table of at most ``partitions`` rows),
    and the running sum inside a range is a window partitioned by range.
    The range of a score is a pure function of the score (``Bucketizer``),
    so recomputation after a lost executor assigns it identically.  The
    per-score counts are checkpointed once (reliable checkpoint in the
    shared folder) because both steps read them.  Integer arithmetic up to
    the last division keeps the result exact.
    """
    from pyspark.ml.feature import Bucketizer
    spark = df.sparkSession
    parts = max(1, partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    label = F.col(label_col).cast("long")
    g = (df.where(F.col(score_col).isNotNull())
         .groupBy(F.col(score_col).cast("double").alias("_score"))
         .agg(F.sum(label).alias("_pos"), F.sum(1 - label).alias("_neg")))
    # The per-score counts are read twice (split points, prefix sums): write
    # them once to the shared checkpoint folder instead of recomputing the
    # scoring plan.  At most one row per distinct score.
    from revisit.session import checkpoint_dir
    checkpoint_dir(spark)
    g = g.checkpoint(eager=True)
    probs = [i / parts for i in range(1, parts)]
    cuts = sorted(set(g.approxQuantile("_score", probs, 0.001))) if probs else []
    splits = [float("-inf")] + [c for c in cuts if c not in (float("-inf"), float("inf"))] + [float("inf")]
    if len(splits) < 3:          # a single range
        g = g.withColumn("_range", F.lit(0))
    else:
        g = (Bucketizer(splits=splits, inputCol="_score", outputCol="_bucket").transform(g)
             .withColumn("_range", F.col("_bucket").cast("int")).drop("_bucket"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (g.groupBy("_range").agg(F.sum("_neg").alias("_range_neg"))
               .select("_range", F.coalesce(F.sum("_range_neg").over(before), F.lit(0)).alias("_offset")))
    inside = Window.partitionBy("_range").orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (g.join(F.broadcast(offsets), "_range")
              .withColumn("_below", F.col("_offset") + F.coalesce(F.sum("_neg").over(inside), F.lit(0))))
    num = F.sum(F.col("_pos").cast("decimal(19,0)") * (2 * F.col("_below") + F.col("_neg")).cast("decimal(19,0)"))
    p, n = F.sum("_pos"), F.sum("_neg")
    return ranked.agg(
        (num.cast("double") / (F.lit(2.0) * p.cast("double") * n.cast("double"))).alias("auc_roc"),
        p.cast("long").alias("n_pos"), n.cast("long").alias("n_neg"))


def auc_by_group(df: DataFrame, by: list[str], score_col: str, label_col: str = "label",
                 partitions: int | None = None) -> DataFrame:
    """Exact AUC-ROC (ties count one half) of every group, in one pass.

    The rank sum of ``auc_rank_sum`` with prefix sums per (group, score
    range): score ranges are cut once over all groups' distinct scores, the
    negatives of a group's lower ranges come from a table of at most groups x
    ranges rows, and a window never spans more than one range of one group.  A
    group without both labels has a null AUC; rows without a score are left
    out; null group values are a group.
    """
    from pyspark.ml.feature import Bucketizer
    from revisit.session import checkpoint_dir
    spark = df.sparkSession
    parts = max(1, partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    label = F.col(label_col).cast("long")
    checkpoint_dir(spark)
    g = (df.where(F.col(score_col).isNotNull())
         .groupBy(F.struct(*by).alias("_group"), F.col(score_col).cast("double").alias("_score"))
         .agg(F.sum(label).alias("_pos"), F.sum(1 - label).alias("_neg"))).checkpoint(eager=True)
    cuts = sorted(set(g.approxQuantile("_score", [i / parts for i in range(1, parts)], 0.001))) if parts > 1 else []
    splits = [float("-inf"), *[c for c in cuts if abs(c) != float("inf")], float("inf")]
    ranged = (Bucketizer(splits=splits, inputCol="_score", outputCol="_range").transform(g) if len(splits) > 2
              else g.withColumn("_range", F.lit(0.0)))
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy("_group", "_range").agg(F.sum("_neg").alias("_range_neg"))
               .select("_group", "_range", F.coalesce(F.sum("_range_neg").over(before), F.lit(0)).alias("_offset")))
    inside = Window.partitionBy("_group", "_range").orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_offset") + F.coalesce(F.sum("_neg").over(inside), F.lit(0))
    ranked = ranged.join(broadcast_bounded(offsets), ["_group", "_range"]).withColumn("_below", below)
    num = F.sum(F.col("_pos").cast("decimal(19,0)") * (2 * F.col("_below") + F.col("_neg")).cast("decimal(19,0)"))
    p, n = F.sum("_pos"), F.sum("_neg")
    return ranked.groupBy("_group").agg(
        (num.cast("double") / F.nullif(F.lit(2.0) * p.cast("double") * n.cast("double"), F.lit(0.0))).alias("auc_roc"),
        p.cast("long").alias("n_pos"), n.cast("long").alias("n_neg")).select("_group.*", "auc_roc", "n_pos", "n_neg")


def submission(requested: DataFrame, scored: DataFrame) -> DataFrame:
    """One row per requested row with its score, paired by key.  The key is
    (id, offer) where the request names offers.  A request by id alone takes
    the customer's highest score, since one id may hold several offers."""
    if "offer" in requested.columns:
        scores = scored.groupBy("id", "offer").agg(F.max("repeatProbability").alias("repeatProbability"))
        return requested.select("id", "offer").join(scores.hint("merge"), ["id", "offer"], "left")
    scores = scored.groupBy("id").agg(F.max("repeatProbability").alias("repeatProbability"))
    return requested.select("id").join(scores.hint("merge"), "id", "left")


def submission_checks(requested: DataFrame, result: DataFrame) -> DataFrame:
    """One row: rows asked for and returned, and rows without a score."""
    return result.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("repeatProbability").isNull()).alias("n_unscored")).withColumn(
        "n_requested", requested.select(F.count(F.lit(1))).scalar()).withColumn("ok", F.col("n_rows") == F.col("n_requested"))


__all__ = ["GRID", "FINAL_PARAMS", "with_label", "model_input", "build_pipeline", "cross_validate",
           "best_params", "fit", "score", "auc_evaluator", "auc_rank_sum", "auc_by_group", "submission",
           "feature_columns"]
