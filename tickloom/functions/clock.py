"""Time expressions: rounding, text, epoch, days and business days."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND_FORMAT = "yyyy-MM-dd HH:mm:ss"


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of the clock reading, alike for both timestamp types."""
    minutes = (F.unix_date(F.to_date(ts)).cast("long") * 24 + F.hour(ts)) * 60 + F.minute(ts)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, SECOND_FORMAT)


def text_timestamp(text: Column) -> Column:
    return F.to_timestamp(text, SECOND_FORMAT)


def round_minute(ts: Column) -> Column:
    """Nearest minute; exact halves go to the even minute (bars use the floor instead)."""
    rest = F.extract(F.lit("SECOND"), ts)
    up = (rest > 30) | ((rest == 30) & (F.minute(ts) % 2 == 1))
    one, none = F.make_dt_interval(mins=F.lit(1)), F.make_dt_interval()
    return ts - F.make_dt_interval(secs=rest) + F.when(up, one).otherwise(none)


def epoch_nanos(ts: Column) -> Column:
    return epoch_micros(ts) * 1000


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def days_after(day: Column, n: int) -> Column:
    return F.date_add(day, n)


def business_days_back(day: Column, n: int) -> Column:
    """`day` minus n working days (Mon-Fri); a weekend counts as the Friday before it, used up.

    Whole weeks are seven calendar days for five working days; what is left crosses at most
    one weekend.
    """
    weekday = F.weekday(day)
    weekend = weekday > 4
    friday = F.when(weekend, F.date_sub(day, weekday - 4)).otherwise(day)
    left = F.when(weekend, F.lit(n - 1)).otherwise(F.lit(n))
    at = F.least(weekday, F.lit(4))
    rest = left % 5
    back = F.floor(left / 5).cast("int") * 7 + rest + F.when(rest > at, 2).otherwise(0)
    return F.date_sub(friday, back.cast("int"))
