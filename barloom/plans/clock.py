"""Time arithmetic that works the same for zoned and zone-less timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_US = 86_400_000_000


def is_time(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType))


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds on a scale that keeps order and differences."""
    t = F.col(name)
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return F.unix_micros(t)
    second = (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("long")
    in_day = (F.hour(t) * 60 + F.minute(t)).cast("long") * 60_000_000 + second
    return F.unix_date(F.to_date(t)).cast("long") * DAY_US + in_day


def plus_micros(t: Column, us: Column) -> Column:
    seconds = (us.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    zero = F.lit(0)
    return t + F.make_dt_interval(zero, zero, zero, seconds)
