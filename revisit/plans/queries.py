"""The query registry: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the reference, run over the whole derived tables.

Fixture per query follows SURVEY section 7.2: ``sparse`` where the
reduction must bite, ``dense`` where exact-product features must be
non-zero.  Decimal money columns are returned as DOUBLE so results
compare value-for-value with the SQL oracle.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from revisit.operators import model as M
from revisit.operators.assemble import assemble_features, cohort_row_checks, feature_matrix_long
from revisit.operators.enrich import history_offers
from revisit.operators.keys import offer_keys, offer_productids
from revisit.functions.expressions import money_scale_of, money_value
from revisit.operators.lookback import (cohort_date_bounds, has_bought, lookback_features, lookback_join,
                                        purchase_facts, user_spend)
from revisit.operators.market import competition, product_share
from revisit.operators.reduce import category_dept_map, reduce_transactions
from revisit.operators.sizing import Bounded
from revisit.operators.skew import hot_keys
from revisit.schemas import USER_WINDOW, WINDOWS, transactions_schema
from revisit.session import session_key
from revisit.sources.fixtures import folder_key, folder_path, load_tables
from revisit.sources.raw import typed_rows
from revisit.sources.io import materialize, read_csv, read_parquet, write_csv, write_parquet


def decimals_to_double(df: DataFrame) -> DataFrame:
    fix = {f.name: F.col(f.name).cast("double") for f in df.schema.fields
           if isinstance(f.dataType, T.DecimalType)}
    return df.withColumns(fix) if fix else df


def _t(spark, sf_dir, fixture="sparse"):
    return load_tables(spark, sf_dir, fixture)


def q_src_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    tb = _t(spark, sf_dir)
    path = folder_path(spark, sf_dir, "csv", uuid.uuid4().hex)
    write_csv(tb.transactions, path)
    schema = transactions_schema(T.StringType(), T.StringType(), T.DecimalType(18, 2))
    return decimals_to_double(read_csv(spark, path, schema))


def q_sink_parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    tb = _t(spark, sf_dir)
    path = folder_path(spark, sf_dir, "parquet", uuid.uuid4().hex)
    write_parquet(reduce_transactions(tb.transactions, tb.offers), path)
    return decimals_to_double(read_parquet(spark, path))


def q_reduce_transactions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reduction run as a Structured Streaming job over the stored
    transactions folder (availableNow trigger), read back from its sink."""
    from revisit.sources.fixtures import fixture_transactions
    from revisit.streaming.reduce_stream import run_reduction
    tb = _t(spark, sf_dir)
    run = f"stream-{uuid.uuid4().hex[:8]}"   # own sink / checkpoint per run
    sink = folder_path(spark, sf_dir, run, "reduced")
    # Stream straight from the stored line items; the fixture's column
    # mapping is applied inside the stream (nothing is copied).
    schema = spark.read.parquet(tb.lines_path).schema
    run_reduction(spark, tb.lines_path, schema, tb.offers, sink,
                  folder_path(spark, sf_dir, run, "checkpoint"),
                  project=lambda df: fixture_transactions(df, tb.fixture))
    return decimals_to_double(read_parquet(spark, sink))


def _every_product(spark, sf_dir, fixture, name="wide"):
    """Every product of a fixture as an offer, numbered in product order."""
    tb = _t(spark, sf_dir, fixture)
    keys = ["category", "company", "brand"]
    products = materialize(tb.transactions.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), folder_path(spark, sf_dir, name, "products"))
    # Number within the first key's groups, moved on by the groups before: no window over all products.
    groups = products.groupBy("category").agg(F.count(F.lit(1)).alias("_size"))
    before = groups.withColumn("_before", F.coalesce(F.sum("_size").over(
        Window.orderBy(F.asc_nulls_last("category")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    order = Window.partitionBy("category").orderBy(*[F.asc_nulls_last(k) for k in keys[1:]])
    return materialize(products.join(before, "category").select(
        (F.row_number().over(order) + F.col("_before") - 1).cast("long").alias("offer"), *keys, F.lit(1.0).alias("offervalue")),
        folder_path(spark, sf_dir, name, "offers"))


def q_reduce_stream_wide(spark, sf_dir):
    """The streaming reduction with every product as an offer, taken past the
    broadcast bound: each micro-batch is reduced by product matching."""
    from revisit.sources.fixtures import fixture_transactions
    from revisit.streaming.reduce_stream import run_reduction
    tb = _t(spark, sf_dir)
    offers = Bounded(_every_product(spark, sf_dir, "sparse", "stream_wide"), max_rows=0)
    run = f"stream-wide-{uuid.uuid4().hex[:8]}"
    sink = folder_path(spark, sf_dir, run, "reduced")
    run_reduction(spark, tb.lines_path, spark.read.parquet(tb.lines_path).schema, offers, sink,
                  folder_path(spark, sf_dir, run, "checkpoint"), project=lambda df: fixture_transactions(df, tb.fixture))
    return decimals_to_double(read_parquet(spark, sink).drop("batch"))


FACT_BATCHES = ("1994-01-01", "1996-07-01")     # days at which the loads of ``facts_incremental`` are cut


def q_facts_incremental(spark, sf_dir):
    """Purchase facts loaded in three day ranges, the second one twice."""
    from revisit.operators.fact_store import FactStore
    tx = _t(spark, sf_dir, "dense").transactions
    store = FactStore(spark, folder_path(spark, sf_dir, "fact_store", uuid.uuid4().hex))
    cuts = [F.lit(d).cast("date") for d in FACT_BATCHES]
    parts = [tx.where(F.col("date") < cuts[0]), tx.where((F.col("date") >= cuts[0]) & (F.col("date") < cuts[1])), tx.where(F.col("date") >= cuts[1])]
    for i in (0, 1, 1, 2):
        store.absorb(f"days-{i}", parts[i])
    facts = store.facts()
    scale = money_scale_of(facts, "a")
    return facts.select("id", "date", "category", "company", "brand", "n", "q", money_value("a", scale).alias("a"))


RAW_KEY_TYPES = {"id": "long", "dept": "int", "date": "date", "purchasequantity": "long", "purchaseamount": "decimal(18,2)"}


def q_load_raw_csv(spark, sf_dir):
    """Transactions as CSV text with unreadable cells (the date of department
    7, the quantity 13), loaded: per department the rows with their types, per
    fault the refused rows."""
    tx = _t(spark, sf_dir).transactions
    path = folder_path(spark, sf_dir, "raw_csv", uuid.uuid4().hex)
    write_csv(tx.withColumn("date", F.when(F.col("dept") == 7, F.lit("7th of May")).otherwise(F.col("date").cast("string")))
              .withColumn("purchasequantity", F.when(F.col("purchasequantity") == 13, F.lit("13x")).otherwise(F.col("purchasequantity").cast("string"))), path)
    rows, refused = typed_rows(spark.read.option("header", True).csv(path), RAW_KEY_TYPES, "transactions")
    loaded = rows.groupBy(F.concat(F.lit("loaded "), F.col("dept").cast("string")).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("purchasequantity").alias("quantity"), F.max("date").alias("last_day"))
    return loaded.unionByName(refused.groupBy(F.concat(F.lit("refused for "), F.array_join("columns", " and ")).alias("part")).agg(
        F.count(F.lit(1)).alias("n")), allowMissingColumns=True)


def q_offer_keys(spark, sf_dir):
    return offer_keys(_t(spark, sf_dir).offers.df)


def q_offer_productids(spark, sf_dir):
    return offer_productids(_t(spark, sf_dir).offers.df)


def q_reduce_transactions(spark, sf_dir):
    tb = _t(spark, sf_dir)
    return decimals_to_double(reduce_transactions(tb.transactions, tb.offers))


def q_cat_dept_map(spark, sf_dir):
    return category_dept_map(_t(spark, sf_dir).transactions)


def q_history_offers(spark, sf_dir):
    tb = _t(spark, sf_dir)
    return history_offers(tb.history, tb.offers)


def q_lookback_join(spark, sf_dir):
    tb = _t(spark, sf_dir)
    reduced = reduce_transactions(tb.transactions, tb.offers)
    return decimals_to_double(lookback_join(reduced, history_offers(tb.history, tb.offers), max(WINDOWS),
                                            hot_from=tb.transactions))


_FACTS: dict = {}


def _facts(spark, sf_dir, fixture="sparse"):
    """Per-day product facts and the hot customers among them, written once
    per input folder and session: every window reads the same table."""
    key = (session_key(spark), folder_key(sf_dir), fixture)
    if key not in _FACTS:
        tb = _t(spark, sf_dir, fixture)
        facts = materialize(purchase_facts(tb.transactions, cohort_date_bounds(tb.history, max(WINDOWS))),
                            folder_path(spark, sf_dir, fixture, "purchase_facts"))
        _FACTS[key] = (facts, hot_keys(facts, "id"))
    return _FACTS[key]


def _has_bought(days: int):
    def run(spark, sf_dir):
        tb = _t(spark, sf_dir)
        facts, hot = _facts(spark, sf_dir)
        return has_bought(history_offers(tb.history, tb.offers), facts, days, hot)
    run.__name__ = f"q_has_bought_{days}"
    return run


def q_user_spend(spark, sf_dir):
    tb = _t(spark, sf_dir, "dense")
    facts, hot = _facts(spark, sf_dir, "dense")
    return user_spend(history_offers(tb.history, tb.offers), facts, hot=hot)


WIDE_WINDOW = 90


def q_has_bought_wide(spark, sf_dir):
    """The 90-day features with every product of the dense fixture as an
    offer: offers numbered in product order, customers dealt over them."""
    tb = _t(spark, sf_dir, "dense")
    offers = _every_product(spark, sf_dir, "dense")
    n = offers.count()
    history = tb.history.withColumn("offer", F.pmod(F.col("id"), F.lit(n)).cast("long"))
    facts, hot = _facts(spark, sf_dir, "dense")
    return has_bought(history_offers(history, Bounded(offers)), facts, WIDE_WINDOW, hot).drop("repeattrips", "repeater")


def q_product_share(spark, sf_dir):
    tb = _t(spark, sf_dir)
    return product_share(tb.transactions, tb.offers)


def q_competition(spark, sf_dir):
    tb = _t(spark, sf_dir)
    return competition(tb.transactions, tb.offers)


def q_assemble_features(spark, sf_dir):
    tb = _t(spark, sf_dir, "dense")
    return assemble_features(tb.transactions, tb.offers, tb.history)


def q_feature_columns(spark, sf_dir):
    """Feature selection by exclusion, sorted, shown as the long-form model
    input matrix over the whole assembled table."""
    tb = _t(spark, sf_dir, "dense")
    return feature_matrix_long(assemble_features(tb.transactions, tb.offers, tb.history))


def q_check_cohort_rows(spark, sf_dir):
    """Row and value invariants of the stored feature tables."""
    tb = _t(spark, sf_dir, "dense")
    cohort = history_offers(tb.history, tb.offers)
    facts, hot = _facts(spark, sf_dir, "dense")
    # All windows and the user columns in one pass, stored once and checked by column group.
    wide = materialize(lookback_features(cohort, facts, hot=hot), folder_path(spark, sf_dir, "checked", uuid.uuid4().hex))
    user = [c for c in wide.columns if c.startswith(("prodid_", "total_spend_", "visits_"))]
    stored = {f"has_bought_{n}": wide.select("id", *[c for c in wide.columns if c.startswith("never_") and n == min(WINDOWS) or c.endswith(f"_{n}") and c not in user])
              for n in WINDOWS}
    stored["user_spend"] = wide.select("id", *user)
    stored["assemble_features"] = _features(spark, sf_dir)
    return cohort_row_checks(tb.history, stored)


def q_auc_roc(spark, sf_dir):
    """AUC-ROC of the 30-day total spend as a score of the training label."""
    tb = _t(spark, sf_dir, "dense")
    train = tb.history.where(F.col("split") == "train")
    facts, hot = _facts(spark, sf_dir, "dense")
    spend = user_spend(history_offers(train, tb.offers), facts, hot=hot)
    scored = M.with_label(spend.join(train.select("split", "id", "offer", "repeater").hint("merge"),
                                     ["split", "id", "offer"]))
    return M.auc_rank_sum(scored, "total_spend_30", "label")


def q_auc_by_group(spark, sf_dir):
    """AUC-ROC of the spend in the offer's category as a score of the training
    label, for every chain and window at once."""
    train = M.with_label(_features(spark, sf_dir).where("split = 'train'"))
    per_window = F.explode(F.array(*[F.struct(F.lit(n).alias("days"), F.col(f"has_bought_category_a_{n}").cast("double").alias("score")) for n in WINDOWS]))
    return M.auc_by_group(train.select("chain", "label", per_window.alias("w")).select("chain", "label", "w.*"), ["chain", "days"], "score")


def q_submission_checks(spark, sf_dir):
    """Rows asked for, written and without a score, of the submission."""
    requested = _features(spark, sf_dir).where("split = 'test'").select("id", "offer")
    return M.submission_checks(requested, q_submission(spark, sf_dir))


# ---- model queries: what SQL can state about them is checked; raw values are tested with fixed seeds ----

_MODEL_MEMO: dict = {}


def _features(spark, sf_dir):
    """The assembled feature table, written once per input folder and session."""
    key = ("features", session_key(spark), folder_key(sf_dir))
    if key not in _MODEL_MEMO:
        tb = _t(spark, sf_dir, "dense")
        _MODEL_MEMO[key] = materialize(assemble_features(tb.transactions, tb.offers, tb.history),
                                       folder_path(spark, sf_dir, "model", "feature_table"))
    return _MODEL_MEMO[key]


def model_tables(spark: SparkSession, sf_dir: str):
    """Stored features with labels, split into train / test."""
    feats = _features(spark, sf_dir)
    cols = M.feature_columns(feats)
    ready = M.model_input(M.with_label(feats), cols)
    train = ready.where(F.col("split") == "train")
    test = ready.where(F.col("split") == "test").drop("label")
    return train, test, cols


def final_model(spark: SparkSession, sf_dir: str):
    """(path, fitted, loaded) of the final GBT (fixed parameters, seed 0),
    fitted once per input folder and session and saved in the shared folder."""
    key = ("model", session_key(spark), folder_key(sf_dir))
    if key not in _MODEL_MEMO:
        from pyspark.ml import PipelineModel
        train, _, cols = model_tables(spark, sf_dir)
        path = folder_path(spark, sf_dir, "model", "gbt_pipeline")
        fitted = M.fit(M.labelled(train), cols)
        fitted.write().overwrite().save(path)
        _MODEL_MEMO[key] = (path, fitted, PipelineModel.load(path))
    return _MODEL_MEMO[key]


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw probabilities of the test cohort by the loaded model."""
    return M.score(final_model(spark, sf_dir)[2], model_tables(spark, sf_dir)[1])


def q_gbt_scores(spark, sf_dir):
    """Per test row: its key, and whether its probability is present and in
    [0, 1] (the value itself is the model's, see ``scored_rows``)."""
    p = F.col("repeatProbability")
    return scored_rows(spark, sf_dir).select("split", "id", "offer", p.isNotNull().alias("scored"),
                                             F.coalesce(p.between(0, 1), F.lit(False)).alias("in_range"))


def q_cv_grid_metrics(spark, sf_dir):
    """All grid points of the search, whether their mean AUC is in [0, 1],
    and how many of them are the chosen parameters."""
    train, _, cols = model_tables(spark, sf_dir)
    search, metrics = M.cross_validate(M.labelled(train), cols)
    best = M.best_params(search)
    chosen = F.lit(True)
    for name, value in best.items():
        chosen = chosen & (F.col(name) == value)
    top = max(search.avgMetrics)
    rows = metrics.select(*best, F.col("avg_auc").between(0, 1).alias("in_range"), (chosen & (F.col("avg_auc") == top)).cast("int").alias("_best"))
    return rows.withColumn("n_best", rows.select(F.sum("_best")).scalar().cast("long")).drop("_best")


def q_model_roundtrip(spark, sf_dir):
    """One row: test rows scored by the fitted and by the loaded pipeline, and
    how many differ, are null or lie outside [0, 1]."""
    _, fitted, loaded = final_model(spark, sf_dir)
    _, test, _ = model_tables(spark, sf_dir)
    a = M.score(fitted, test).withColumnRenamed("repeatProbability", "p")
    b = M.score(loaded, test).withColumnRenamed("repeatProbability", "q")
    both = a.join(b.hint("merge"), ["split", "id", "offer"])
    return both.agg(F.count(F.lit(1)).alias("n_scored"), F.count_if(~F.col("p").eqNullSafe(F.col("q"))).alias("n_differ"),
                    F.count_if(F.col("q").isNull()).alias("n_null"), F.count_if(~F.col("q").between(0, 1)).alias("n_outside"))


def q_submission(spark, sf_dir):
    """Template-driven submission with a deterministic score (share of the
    customer's 30-day spend on the offered product), so that SQL checks every
    value: the template is read from CSV, paired by key, written as CSV and
    read back."""
    features = _features(spark, sf_dir).where("split = 'test'")
    spend = F.col(f"total_spend_{USER_WINDOW}")
    score = F.when(spend > 0, F.col(f"prodid_spend_{USER_WINDOW}") / spend).otherwise(F.lit(0.0)).cast("float")
    scored = features.select("split", "id", "offer", score.alias("repeatProbability"))
    run = folder_path(spark, sf_dir, "submission", uuid.uuid4().hex)
    write_csv(features.select("id", "offer"), f"{run}/template")
    key = [T.StructField("id", T.LongType()), T.StructField("offer", T.LongType())]
    requested = read_csv(spark, f"{run}/template", T.StructType(key))
    write_csv(M.submission(requested, scored), f"{run}/result")
    out = read_csv(spark, f"{run}/result", T.StructType([*key, T.StructField("repeatProbability", T.FloatType())]))
    return out.select("id", "offer", F.round(F.col("repeatProbability").cast("double"), 5).alias("repeatProbability"))


def q_model_compare(spark, sf_dir):
    """Logistic regression, random forest and GBT over the same features: the
    rank-sum AUC on the training rows equals the built-in evaluator's."""
    train, _, cols = model_tables(spark, sf_dir)
    rows = []
    for kind in ("lr", "rf", "gbt"):
        scored = materialize(M.score(M.fit(M.labelled(train), cols, kind=kind), train), folder_path(spark, sf_dir, "compare", uuid.uuid4().hex))
        builtin = M.auc_evaluator(scored)
        rows.append(M.auc_rank_sum(scored, "repeatProbability", "label").select(
            F.lit(kind).alias("classifier"), (F.abs(F.col("auc_roc") - builtin) < 1e-9).alias("agrees"),
            F.col("auc_roc").between(0, 1).alias("in_range")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q = {
        "src_csv_roundtrip": q_src_csv_roundtrip,
        "sink_parquet_roundtrip": q_sink_parquet_roundtrip,
        "offer_keys": q_offer_keys,
        "offer_productids": q_offer_productids,
        "reduce_transactions": q_reduce_transactions,
        "reduce_transactions_stream": q_reduce_transactions_stream,
        "cat_dept_map": q_cat_dept_map,
        "history_offers": q_history_offers,
        "lookback_join": q_lookback_join,
        "reduce_stream_wide": q_reduce_stream_wide,
        "facts_incremental": q_facts_incremental,
        "load_raw_csv": q_load_raw_csv,
    }
    for n in WINDOWS:
        q[f"has_bought_{n}"] = _has_bought(n)
    q.update({
        "has_bought_wide": q_has_bought_wide,
        "user_spend": q_user_spend,
        "product_share": q_product_share,
        "competition": q_competition,
        "assemble_features": q_assemble_features,
        "feature_columns": q_feature_columns,
        "check_cohort_rows": q_check_cohort_rows,
        "auc_roc": q_auc_roc,
        "auc_by_group": q_auc_by_group,
        "submission_checks": q_submission_checks,
        "gbt_scores": q_gbt_scores,
        "cv_grid_metrics": q_cv_grid_metrics,
        "model_roundtrip": q_model_roundtrip,
        "submission": q_submission,
        "model_compare": q_model_compare,
    })
    return q
