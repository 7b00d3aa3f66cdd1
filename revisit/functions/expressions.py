"""Column-expression builders shared by the operators.

All of these are built-in Spark SQL expressions, so they stay inside
whole-stage code generation; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def product_id(category, company, brand) -> Column:
    """``"category company brand"``; null if any part is null (SQL CONCAT,
    not concat_ws, which would skip nulls)."""
    parts = [F.col(c) if isinstance(c, str) else c for c in (category, company, brand)]
    return F.concat(parts[0].cast("string"), F.lit(" "), parts[1].cast("string"),
                    F.lit(" "), parts[2].cast("string"))


def days_before(offerdate, date) -> Column:
    """Whole days from ``date`` up to ``offerdate`` (0 on the offer day)."""
    return F.datediff(_col(offerdate), _col(date))


def in_lookback(date, offerdate, days: int) -> Column:
    """``date BETWEEN offerdate - days AND offerdate`` -- both ends inclusive."""
    return _col(date).between(F.date_sub(_col(offerdate), days), _col(offerdate))


def safe_ratio(numerator, denominator) -> Column:
    """Double division that yields null instead of failing on a zero
    denominator (Spark 4 runs ANSI mode)."""
    den = _col(denominator).cast("double")
    return _col(numerator).cast("double") / F.nullif(den, F.lit(0.0))


def sum_if(condition: Column, value) -> Column:
    return F.sum(F.when(condition, _col(value)))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def to_double(column) -> Column:
    return _col(column).cast("double")


def positive_class_probability(probability_col: str = "probability") -> Column:
    """Second element of the ML probability vector, as float (native,
    no Python worker)."""
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col(probability_col))[1].cast("float")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money_units(column, dtype) -> tuple[Column, int]:
    """Money as exact integer units for fast summing.

    A DECIMAL(p, s) with p <= 18 becomes its unscaled value as LONG (cents
    for s = 2): long sums run in generated code, while Spark sums a
    DECIMAL(18,2) in a DECIMAL(28,2) buffer on the slower object path.
    Returns (expression, scale); other types pass through with scale 0.
    """
    from pyspark.sql import types as T
    if isinstance(dtype, T.DecimalType) and dtype.precision <= 18:
        return (_col(column) * F.lit(10 ** dtype.scale)).cast("long"), dtype.scale
    return _col(column), 0


def money_value(units_sum, scale: int) -> Column:
    """Back from summed units to DOUBLE.  The unscaled sum is exact, and one
    correctly rounded division gives the same double as casting the exact
    decimal sum."""
    value = _col(units_sum).cast("double")
    return value / F.lit(float(10 ** scale)) if scale else value


MONEY_SCALE = "money_scale"


def money_scale_of(df, column: str) -> int:
    return int(df.schema[column].metadata.get(MONEY_SCALE, 0))
