"""Row filters, dimension look-ups and device lists.

Look-ups are plain equi-joins without a hint: Spark broadcasts a dimension
whose size it knows to be under `autoBroadcastJoinThreshold` (a local relation
or a small file) and otherwise sort-merges, where adaptive execution splits a
skewed partition of the sightings side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.clock import local_day, local_hour, local_text
from footfall.functions.strings import vendor_prefix
from footfall.schema import LOCAL_ZONE, RECENT_SECONDS, RSSI_FLOOR


def filter_rssi(s: DataFrame, floor: float = RSSI_FLOOR) -> DataFrame:
    """Keep readings strictly stronger than the floor."""
    return s.where(F.col("rssi") > floor)


def filter_recent(s: DataFrame, as_of, seconds: int = RECENT_SECONDS) -> DataFrame:
    """Keep `as_of - seconds < ts <= as_of`; `as_of` is epoch seconds or a column."""
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return s.where((F.col("ts") > as_of - seconds) & (F.col("ts") <= as_of))


def filter_day(s: DataFrame, day: str, tz: str = LOCAL_ZONE) -> DataFrame:
    """Keep one local date, as a range of epoch seconds so that it is pushed to the scan."""
    start = F.unix_timestamp(F.to_utc_timestamp(F.lit(day).cast("timestamp"), tz))
    end = F.unix_timestamp(F.to_utc_timestamp(F.date_add(F.lit(day), 1).cast("timestamp"), tz))
    return s.where((F.col("ts") >= start) & (F.col("ts") < end))


def filter_day_of_month(s: DataFrame, day: int, tz: str = LOCAL_ZONE) -> DataFrame:
    """Keep readings whose local day of month matches, whatever the month."""
    return s.where(F.dayofmonth(local_day("ts", tz)) == day)


def device_history(s: DataFrame, device: str) -> DataFrame:
    return s.where(F.col("device") == device)


def filter_aps(s: DataFrame, aps: Sequence[str]) -> DataFrame:
    return s.where(F.col("ap").isin(*aps))


def prune(s: DataFrame, days: tuple[str, str] | None = None, aps: Sequence[str] | None = None,
          skip_days: Sequence[str] | None = None) -> DataFrame:
    """Restrict a lake partitioned by (day, ap) to a day range and access points.

    All conditions are on partition columns, so Spark lists only those folders.
    """
    if days:
        s = s.where(F.col("day").between(*[F.lit(d).cast("date") for d in days]))
    if skip_days:
        s = s.where(~F.col("day").isin([F.lit(d).cast("date") for d in skip_days]))
    if aps:
        s = filter_aps(s, aps)
    return s


def site_aps(ap_dim: DataFrame, site_id: int | None = None) -> DataFrame:
    """Access points of a site, of all sites when none is given."""
    dim = ap_dim if site_id is None else ap_dim.where(F.col("site_id") == site_id)
    return dim.select("ap")


def with_site(s: DataFrame, ap_dim: DataFrame, unknown: str = "zero") -> DataFrame:
    """Attach site and side of the access point.

    unknown="zero" keeps readings of unlisted access points as site 0 with no
    side; "drop" removes them.
    """
    dim = ap_dim.select("ap", "site_id", "side")
    if unknown == "drop":
        return s.join(dim, "ap")
    return s.join(dim, "ap", "left").withColumn("site_id", F.coalesce("site_id", F.lit(0)))


def with_four_sides(s: DataFrame, ap_dim: DataFrame) -> DataFrame:
    """Attach site and side, the access points of a side kept apart: the second one's side is outside1 or inside1.

    Access points of a side are numbered in the order of their names, a third one would be outside2. Readings of
    unlisted access points have site 0 and no side.
    """
    number = F.row_number().over(Window.partitionBy("site_id", "side").orderBy("ap")) - 1
    suffix = F.when(number > 0, number.cast("string")).otherwise("")
    return with_site(s, ap_dim.select("ap", "site_id", F.concat("side", suffix).alias("side")))


def with_hour(s: DataFrame, tz: str = LOCAL_ZONE) -> DataFrame:
    return s.withColumn("hour", local_hour("ts", tz))


def with_local_time(s: DataFrame, tz: str = LOCAL_ZONE) -> DataFrame:
    """Formatted local time next to the epoch seconds."""
    return s.withColumn("local_time", local_text("ts", tz))


def with_load_time(df: DataFrame, mon_time: int | None = None) -> DataFrame:
    """Processing time in epoch seconds; an explicit value makes re-runs repeatable."""
    now = F.unix_timestamp(F.current_timestamp()) if mon_time is None else F.lit(mon_time).cast("bigint")
    return df.withColumn("mon_time", now)


def zero_fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.fill(0, list(cols))


def keep_known_vendors(s: DataFrame, oui: DataFrame) -> DataFrame:
    """Keep devices whose vendor prefix is on the allow-list."""
    return s.join(oui, vendor_prefix("device") == oui["prefix"], "left_semi")


def drop_static_devices(s: DataFrame, static_devices: DataFrame) -> DataFrame:
    """Remove always-on devices; the list has one column `device`."""
    return s.join(static_devices, "device", "left_anti")


def dedupe(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct key combinations; map-side combined, unlike a row-keeping dropDuplicates."""
    return df.select(*keys).distinct()


def explode_batch(df: DataFrame, column: str) -> DataFrame:
    """Array of structs -> one distinct row per element."""
    return df.select(F.explode(column).alias("_item")).select("_item.*").distinct()
