"""Spark session and shared-folder helpers.

Everything that must survive the loss of an executor (materialised
intermediate tables, checkpoints, fitted models) goes under the folder
named by ``spark.checkpoint.dir``.  That setting belongs to the cluster; a
local folder is chosen only when the session has none (tests, laptops).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings the pipeline is designed around.  AQE re-plans joins
# from real sizes, coalesces small shuffle partitions and splits skewed ones.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "revisit", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SCALE_CONF)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and materialised tables.

    Read from the session (``spark.checkpoint.dir`` or the context's
    checkpoint dir).  Only when neither is set -- local runs and tests --
    is a fresh folder created and registered.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a session without a local context (Spark Connect)
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and sc is not None:
        configured = sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        master = sc.master if sc is not None else ""
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share; "
                               "a local folder is only chosen for a local master")
        configured = tempfile.mkdtemp(prefix="revisit-ckpt-")
    if sc is None:
        return configured.rstrip("/")
    sc.setCheckpointDir(configured)
    return (sc.getCheckpointDir() or configured).rstrip("/")


def session_key(spark: SparkSession) -> str:
    """Identifies the running application (for per-session memos)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:
        return str(id(spark))


def default_parallelism(spark: SparkSession, fallback: int = 8) -> int:
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:
        return int(spark.conf.get("spark.default.parallelism", str(fallback)))


_RUN_ID = uuid.uuid4().hex[:12]


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder, unique to this process."""
    base = checkpoint_dir(spark)
    return "/".join([base, f"revisit-{os.getpid()}-{_RUN_ID}", *parts])
