"""History enrichment with offer details (a left join against the bounded
offer catalogue, broadcast)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from revisit.functions.expressions import product_id
from revisit.operators.sizing import as_bounded
from revisit.operators.skew import salted_join


def history_offers(history: DataFrame, offers, with_productid: bool = False,
                   with_offervalue: bool = True) -> DataFrame:
    """history.* plus the offer's category, company, offervalue, brand
    (and productid on request).  A history row whose offer is unknown keeps
    null product columns."""
    offers = as_bounded(offers)
    cols = ["offer", "category", "company"] + (["offervalue"] if with_offervalue else []) + ["brand"]
    detail = offers.hint(offers.df.select(*cols))
    if offers.small:
        out = history.join(detail, "offer", "left")
    else:       # a popular coupon's rows are split over tasks
        out = salted_join(history, detail.withColumnRenamed("offer", "_offer"), "offer", "_offer", how="left")
    out = out.select(*history.columns, *cols[1:])
    if with_productid:
        out = out.withColumn("productid", product_id("category", "company", "brand"))
    return out
