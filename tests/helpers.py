"""Hand-made input tables for edge-case tests."""

from __future__ import annotations

import datetime as dt

from revisit.schemas import HISTORY_SCHEMA, offers_schema, transactions_schema

D = dt.date


def tx(spark, rows):
    """rows: (id, category, company, brand, date, qty, amount)."""
    full = [(r[0], 1, r[1], r[2], r[3], r[4], r[5], r[6]) for r in rows]
    return spark.createDataFrame(full, transactions_schema())


def offers(spark, rows):
    """rows: (offer, category, company, brand, offervalue)."""
    return spark.createDataFrame(rows, offers_schema())


def history(spark, rows):
    """rows: (id, offer, offerdate) -> train rows with outcome columns."""
    full = [("train", r[0], 1, r[1], 0, 0, "f", r[2]) for r in rows]
    return spark.createDataFrame(full, HISTORY_SCHEMA)


def by_key(df, key="id"):
    return {r[key]: r.asDict() for r in df.collect()}

