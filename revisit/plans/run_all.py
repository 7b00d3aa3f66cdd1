"""End-to-end run: the reference's script order as one Spark application.

    load -> reduce -> features (windows, user, product, competition)
         -> assemble -> model search / fit -> score -> submission

Every stage writes its result as a Parquet (or, for the submission, CSV)
table under ``out_dir``; later stages read those tables back, so a lost
executor or a restarted run re-reads files instead of recomputing the
lineage.  ``out_dir`` should be a shared folder (by default a folder under
the session's ``spark.checkpoint.dir``).

With ``resume`` (a digest of the inputs and settings) a run that was killed
goes on where it stopped: each finished stage leaves a mark with the digest
under ``out_dir/_stages``; a marked stage is read, an unmarked one, and every
stage after it, is written anew.

    python -m revisit.plans.run_all --fixture-dir /root/testdata/sf0.01 --fixture dense
    python -m revisit.plans.run_all --raw transactions.csv offers.csv trainHistory.csv testHistory.csv
"""

from __future__ import annotations

import argparse
import hashlib
import json
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession, functions as F

from revisit.operators import model as M
from revisit.operators.assemble import assemble_features, cohort_row_checks
from revisit.operators.enrich import history_offers
from revisit.operators.keys import offer_productids
from revisit.operators.lookback import cohort_date_bounds, has_bought, purchase_facts, user_spend
from revisit.operators.sizing import Bounded
from revisit.operators.skew import hot_keys
from revisit.operators.market import category_products, competition, product_share
from revisit.operators.reduce import category_dept_map, reduce_transactions
from revisit.schemas import WINDOWS
from revisit.session import get_session, scratch_path
from revisit.sources.fixtures import Tables, load_tables
from revisit.sources.io import read_parquet, write_csv, write_parquet


class StageMarks:
    """Marks of finished stages: a one-row table each, written last."""

    def __init__(self, spark: SparkSession, out: str, digest: str | None):
        self.spark, self.folder, self.digest, self.valid = spark, f"{out}/_stages", digest, digest is not None

    def value(self, stage: str) -> dict | None:
        """What a finished stage left; None from the first unfinished stage on."""
        if not self.valid:
            return None
        try:
            row = self.spark.read.schema("digest string, value string").parquet(f"{self.folder}/{stage}").first()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            row = None
        self.valid = row is not None and row["digest"] == self.digest
        return json.loads(row["value"]) if self.valid else None

    def done(self, stage: str, value: dict | None = None) -> None:
        if self.digest is not None:
            mark = self.spark.createDataFrame([(self.digest, json.dumps(value or {}))], "digest string, value string")
            mark.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{stage}")


def run_pipeline(spark: SparkSession, tables: Tables, out_dir: str, *, grid: dict | None = None,
                 folds: int = M.NUM_FOLDS, search: bool = True, params: dict | None = None,
                 write_intermediates: bool = True, mode: str = "errorifexists",
                 parallelism: int | None = None, submission_ids: str | None = None,
                 store_inputs: bool = False, resume: str | None = None) -> dict:
    """Run every stage; return output paths, timings and metrics.

    ``submission_ids``: optional CSV with an ``id`` column (a submission
    template) naming the customers to score; default: the test cohort.
    ``store_inputs``: first write the inputs as typed Parquet and read them
    back (the load step; use it when the inputs are CSV, so no later stage
    parses text again).
    ``resume``: digest of the inputs and settings; stages that finished under
    the same digest in ``out_dir`` are not run again."""
    out = out_dir.rstrip("/")
    report: dict = {"paths": {}, "seconds": {}, "resumed": []}
    marks = StageMarks(spark, out, resume)
    if resume is not None:
        mode = "overwrite"          # of what an unfinished stage left

    def save(name, df, **kw):
        """``df`` may be a function that gives it, called only if the stage runs."""
        path = f"{out}/{name}"
        report["paths"][name] = path
        if marks.value(name) is not None:
            report["resumed"].append(name)
        else:
            t0 = time.perf_counter()
            write_parquet(df() if isinstance(df, Callable) else df, path, mode=mode, **kw)
            marks.done(name)
            report["seconds"][name] = round(time.perf_counter() - t0, 3)
        return read_parquet(spark, path)

    tx, offers, history = tables.transactions, tables.offers, tables.history
    if store_inputs:
        tx = save("transactions", tx)
        offers = Bounded(save("offers", offers.df))
        history = save("history", history)
    save("reduced_transactions", lambda: reduce_transactions(tx, offers))
    save("cat_dept_map", lambda: category_dept_map(tx))
    save("offer_productids", lambda: offer_productids(offers.df))
    # The two aggregates every feature table derives from, written once.
    facts = save("_facts", lambda: purchase_facts(tx, cohort_date_bounds(history, max(WINDOWS))))
    hot = save("_hot_customers", lambda: hot_keys(facts, "id"))       # counted once, read by every feature table
    cp = save("_category_products", lambda: category_products(tx, offers))
    if write_intermediates:
        cohort = history_offers(history, offers)
        for n in WINDOWS:
            save(f"has_bought_{n}", lambda n=n: has_bought(cohort, facts, n, hot))
        save("user_spend", lambda: user_spend(cohort, facts, hot=hot))
        save("product_share", lambda: product_share(tx, offers, cp))
        save("competition", lambda: competition(tx, offers, cp))
    feats = save("assemble_features", lambda: assemble_features(tx, offers, history, facts=facts, products=cp, hot=hot),
                 partition_by=["split"])

    # One row per history row, consistent values, no repeated cohort key: a violation stops the run.
    checked = {"assemble_features": feats} | ({n: read_parquet(spark, report["paths"][n]) for n in
                                               [f"has_bought_{w}" for w in WINDOWS] + ["user_spend"]} if write_intermediates else {})
    broken = [r.asDict() for r in cohort_row_checks(history, checked).where("not ok").collect()]   # one row per check
    if broken:
        raise ValueError(f"cohort checks failed: {broken}")
    cols = M.feature_columns(feats)
    ready = M.model_input(M.with_label(feats), cols)
    train = M.labelled(ready.where(F.col("split") == "train"))
    test = ready.where(F.col("split") == "test").drop("label")
    chosen = params
    if search and (found := marks.value("search")) is not None:
        report["resumed"].append("search")
        report["cv_metrics"], chosen = found["metrics"], chosen or found["best"]
    elif search:
        t0 = time.perf_counter()
        cv_model, metrics = M.cross_validate(train, cols, grid=grid, folds=folds, parallelism=parallelism)
        report["seconds"]["cross_validate"] = round(time.perf_counter() - t0, 3)
        report["cv_metrics"] = [r.asDict() for r in metrics.collect()]   # one row per grid point
        best = M.best_params(cv_model, grid)
        marks.done("search", {"metrics": report["cv_metrics"], "best": best})
        chosen = chosen or best
    report["params"] = chosen or M.FINAL_PARAMS
    model_path = f"{out}/model"
    if marks.value("model") is not None:
        report["resumed"].append("model")
    else:
        t0 = time.perf_counter()
        model = M.fit(train, cols, params=report["params"])
        (model.write().overwrite() if mode == "overwrite" else model.write()).save(model_path)
        marks.done("model")
        report["seconds"]["fit"] = round(time.perf_counter() - t0, 3)
    report["paths"]["model"] = model_path
    model = PipelineModel.load(model_path)
    report["train_auc"] = M.auc_evaluator(M.score(model, train))
    scored = save("predictions", lambda: M.score(model, test))
    sub_path = f"{out}/submission"
    if submission_ids:
        ids = (spark.read.option("header", True).csv(submission_ids)
               .select(F.col("id").cast("long").alias("id")))
    else:
        ids = test.select("id", "offer")
    write_csv(M.submission(ids, scored), sub_path, mode=mode)
    report["paths"]["submission"] = sub_path
    # Output-length invariant, keyed: one row per requested id; ids without
    # a score are counted rather than silently paired by position.
    sub = spark.read.option("header", True).csv(sub_path)
    check = sub.agg(F.count(F.lit(1)).alias("rows"),
                    F.count_if(F.col("repeatProbability").isNull()).alias("unscored")).first()
    report["submission_rows"], report["submission_unscored"] = check["rows"], check["unscored"]
    report["requested_ids"] = ids.count()
    if report["submission_rows"] != report["requested_ids"]:
        raise ValueError(f"{report['requested_ids']} rows asked for, {report['submission_rows']} written")
    return report


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--fixture-dir", help="folder of the TPC-H-like parquet tables")
    src.add_argument("--raw", nargs="+", metavar="CSV",
                     help="transactions, offers, train history [, test history] CSV paths")
    ap.add_argument("--fixture", default="dense", choices=["sparse", "dense"])
    ap.add_argument("--out", help="output folder (default: under spark.checkpoint.dir)")
    ap.add_argument("--master")
    ap.add_argument("--no-search", action="store_true", help="skip the grid search, use --params")
    ap.add_argument("--params", type=json.loads, help='e.g. {"maxDepth": 6, "maxBins": 20, "maxIter": 20}')
    ap.add_argument("--folds", type=int, default=M.NUM_FOLDS)
    ap.add_argument("--mode", default="errorifexists")
    ap.add_argument("--submission-ids", help="CSV with an id column (submission template)")
    ap.add_argument("--resume", action="store_true", help="go on with the finished stages in --out of a run with the same arguments")
    ap.add_argument("--shuffle-partitions", type=int, help="spark.sql.shuffle.partitions for this run")
    args = ap.parse_args(argv)
    spark = get_session(args.master, shuffle_partitions=args.shuffle_partitions)
    if args.resume and not args.out:
        ap.error("--resume needs --out")
    refused = None
    if args.fixture_dir:
        tables = load_tables(spark, args.fixture_dir, args.fixture)
    else:
        from revisit.sources.raw import load_raw_checked
        tables, refused = load_raw_checked(spark, *args.raw)
    out = args.out or scratch_path(spark, "run_all")
    settings = {k: v for k, v in vars(args).items() if k not in ("resume", "master", "shuffle_partitions", "mode")}
    digest = hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest() if args.resume else None
    report = run_pipeline(spark, tables, out, folds=args.folds, search=not args.no_search,
                          params=args.params, mode=args.mode, submission_ids=args.submission_ids,
                          store_inputs=bool(args.raw), resume=digest)
    if refused is not None:
        write_parquet(refused, f"{out}/refused_rows", mode="overwrite" if args.resume else args.mode)
        counts = read_parquet(spark, f"{out}/refused_rows").groupBy("source", "columns").count().collect()     # one row per fault
        report["refused"] = [r.asDict() for r in counts]
    print(json.dumps(report, default=str))


if __name__ == "__main__":
    main()
