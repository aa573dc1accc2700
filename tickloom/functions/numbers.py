"""Number expressions that must survive ANSI mode and missing values."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_number(text: Column) -> Column:
    return text.cast("bigint")


def known(value: Column) -> Column:
    """NaN as null: a comparison with NaN is true in Spark where a missing value must lose."""
    return F.when(~F.isnan(value), value)


def row_max(*values: Column) -> Column:
    return F.greatest(*values)


def row_min(*values: Column) -> Column:
    return F.least(*values)


def half_even(value: Column) -> Column:
    return F.bround(value)


def quotient(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)
