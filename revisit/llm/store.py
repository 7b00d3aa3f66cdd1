"""Intermediate tables in the shared folder, and size-checked semi joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from revisit.session import scratch_path

BROADCAST_IDS = 1_000_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: later jobs start from files that outlive an executor."""
    path = scratch_path(df.sparkSession, "llm", f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hinted_ids(ids: DataFrame, key: str) -> DataFrame:
    """Distinct keys, marked for broadcast when at most ``BROADCAST_IDS`` are proven."""
    ids = ids.select(key).distinct()
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def semi_join(big: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``big`` whose key is in ``ids``: by broadcast when at most
    ``BROADCAST_IDS`` long keys are proven, by a shuffle join otherwise."""
    return big.join(hinted_ids(ids, key), key, "left_semi")


def anti_join(big: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``big`` whose key is not in ``ids`` (a null key stays), likewise."""
    return big.join(hinted_ids(ids, key), key, "left_anti").select(*big.columns)
