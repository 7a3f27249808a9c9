"""Time columns. `ts` is epoch seconds; the session runs in UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.schema import BUCKET_SECONDS, LOCAL_ZONE


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def local_time(ts="ts", tz: str = LOCAL_ZONE) -> Column:
    """Epoch seconds -> wall-clock timestamp of the zone."""
    return F.from_utc_timestamp(F.timestamp_seconds(_col(ts)), tz)


def local_day(ts="ts", tz: str = LOCAL_ZONE) -> Column:
    return F.to_date(local_time(ts, tz))


def local_hour(ts="ts", tz: str = LOCAL_ZONE) -> Column:
    return F.hour(local_time(ts, tz))


def local_text(ts="ts", tz: str = LOCAL_ZONE, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(local_time(ts, tz), fmt)


def day_epoch(day, tz: str = LOCAL_ZONE) -> Column:
    """Epoch seconds of local midnight of a date, date string or date column."""
    day = F.to_date(F.lit(day)) if not isinstance(day, Column) else day
    return F.unix_timestamp(F.to_utc_timestamp(day.cast("timestamp"), tz))


def today_epoch(tz: str = LOCAL_ZONE, days_back: int = 0) -> Column:
    """Local midnight of the current day, or of a day before it."""
    now = F.from_utc_timestamp(F.current_timestamp(), tz)
    return day_epoch(F.date_sub(F.to_date(now), days_back), tz)


def bucket_index(ts="ts", origin=0, seconds: int = BUCKET_SECONDS) -> Column:
    """Index of the fixed-size time bucket counted from an origin."""
    origin = origin if isinstance(origin, Column) else F.lit(origin)
    return F.floor((_col(ts) - origin) / seconds)


def bucket_of_day(ts="ts", tz: str = LOCAL_ZONE, seconds: int = BUCKET_SECONDS) -> Column:
    """Bucket index counted from local midnight (0..287 for five minutes)."""
    return bucket_index(ts, day_epoch(local_day(ts, tz), tz), seconds)


def date_range(spark: SparkSession, start: str, days: int) -> DataFrame:
    """`days` consecutive dates beginning with `start`."""
    first = F.to_date(F.lit(start))
    return spark.range(1).select(
        F.explode(F.sequence(first, F.date_add(first, days - 1))).alias("day"))
