"""Size-checked broadcasting.

A side is broadcast only when its row count has a proven bound: either
known by construction (``known_rows``, e.g. a catalogue cut to its top-k)
or checked here with a bounded count (``limit(max_rows + 1).count()`` never
reads more than ``max_rows + 1`` rows past the plan's own work).  Beyond
the bound the DataFrame is returned unhinted and Spark plans a shuffle
join (AQE may still switch to broadcast from runtime sizes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Largest dimension broadcast by row count.  Offer catalogues hold tens to
# thousands of coupons; anything bigger goes through a shuffle join.
MAX_BROADCAST_ROWS = 100_000


def within_bound(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                 known_rows: int | None = None) -> bool:
    if known_rows is not None:
        return known_rows <= max_rows
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_bounded(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                      known_rows: int | None = None) -> DataFrame:
    return F.broadcast(df) if within_bound(df, max_rows, known_rows) else df


class Bounded:
    """A small DataFrame with its row bound, decided once.

    Operators derive key lists from it (distinct, group-by), which never
    increases the row count, so the same decision holds for every derived
    side.
    """

    def __init__(self, df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                 known_rows: int | None = None):
        self.small = within_bound(df, max_rows, known_rows)
        # A bounded table in one partition: key lists and groupings derived
        # from it then need no further shuffle (one partition satisfies any
        # clustering), and they are broadcast anyway.  ``repartition(1)``
        # moves at most ``max_rows`` rows and, unlike ``coalesce(1)``, leaves
        # the plan that produced the table running in parallel.
        self.df = df.repartition(1) if self.small else df

    def hint(self, derived: DataFrame) -> DataFrame:
        return F.broadcast(derived) if self.small else derived


def as_bounded(offers, max_rows: int = MAX_BROADCAST_ROWS) -> Bounded:
    return offers if isinstance(offers, Bounded) else Bounded(offers, max_rows)
