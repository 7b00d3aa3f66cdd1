"""Loader for the original raw inputs: transactions, offers, train and test
history as CSV files with a header row.

The reference infers every schema (one extra full pass over a 20 GB file).
Here the files are read as text and the columns the pipeline uses are cast
to declared types; any other column passes through untouched.  Train and
test histories become one table with a ``split`` column.

A row with a cell that its type cannot hold is refused: it goes to a side
table with the columns at fault instead of ending the load.  Empty cells are
nulls, not faults; declared columns that a file lacks are not checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from revisit.operators.sizing import Bounded
from revisit.sources.fixtures import Tables

# The declared types of the columns the pipeline reads.
TRANSACTION_TYPES = {"id": "long", "dept": "int", "category": "long", "company": "long",
                     "brand": "long", "date": "date", "purchasequantity": "long",
                     "purchaseamount": "decimal(18,2)"}
OFFER_TYPES = {"offer": "long", "category": "long", "company": "long", "brand": "long",
               "offervalue": "double"}
HISTORY_TYPES = {"id": "long", "chain": "int", "offer": "long", "market": "int",
                 "repeattrips": "int", "repeater": "string", "offerdate": "date"}


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def typed_rows(rows: DataFrame, types: dict[str, str], source: str) -> tuple[DataFrame, DataFrame]:
    """(rows with declared types, refused rows as source, columns at fault, the row as JSON)."""
    own = {c: t for c, t in types.items() if c in rows.columns}
    fault = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.lit(c)) for c, t in own.items()]))
    refused = rows.where(F.size(fault) > 0).select(F.lit(source).alias("source"), fault.alias("columns"), F.to_json(F.struct(*rows.columns)).alias("row"))
    return rows.where(F.size(fault) == 0).withColumns({c: F.col(c).try_cast(t) for c, t in own.items()}), refused


def load_raw_checked(spark: SparkSession, transactions: str, offers: str, train_history: str,
                     test_history: str | None = None) -> tuple[Tables, DataFrame]:
    """(tables of the rows that fit their types, refused rows of all files)."""
    tx, refused = typed_rows(_csv(spark, transactions), TRANSACTION_TYPES, "transactions")
    of, bad = typed_rows(_csv(spark, offers), OFFER_TYPES, "offers")
    refused = refused.unionByName(bad)
    history = None
    for split, path in (("train", train_history), ("test", test_history)):
        if path:
            rows, bad = typed_rows(_csv(spark, path), HISTORY_TYPES, f"{split} history")
            rows, refused = rows.withColumn("split", F.lit(split)), refused.unionByName(bad)
            history = rows if history is None else history.unionByName(rows, allowMissingColumns=True)
    order = ["split"] + [c for c in history.columns if c != "split"]
    return Tables(tx, Bounded(of), history.select(*order)), refused


def load_raw(spark: SparkSession, transactions: str, offers: str, train_history: str,
             test_history: str | None = None) -> Tables:
    return load_raw_checked(spark, transactions, offers, train_history, test_history)[0]
