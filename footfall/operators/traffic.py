"""Distinct visitors per window, always-on devices, simultaneous presence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.clock import local_day, local_hour
from footfall.operators.flow import window_start
from footfall.schema import ALWAYS_ON_HOURS, DAY_WINDOW_OFFSET, LOCAL_ZONE


def traffic_per_window(s: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Distinct devices per site and tumbling window.

    Spark deduplicates (site, window, device) on the map side first, so neither
    a busy site nor a chatty device concentrates rows in one task.
    """
    return (s.groupBy("site_id", window_start("ts", window).alias("window_start"))
            .agg(F.count_distinct("device").alias("traffic")))


def traffic_per_day(s: DataFrame, offset: str = DAY_WINDOW_OFFSET) -> DataFrame:
    """Distinct devices per site and one-day window that starts at the offset (UTC)."""
    start = F.unix_timestamp(F.window(F.timestamp_seconds("ts"), "1 day", "1 day", offset)["start"])
    return (s.groupBy("site_id", start.alias("window_start"))
            .agg(F.count_distinct("device").alias("traffic")))


def latest_window(traffic: DataFrame) -> DataFrame:
    """Each site's value in its last window."""
    return traffic.groupBy("site_id").agg(
        F.max_by("traffic", "window_start").alias("traffic"),
        F.max("window_start").alias("window_start"))


def hour_coverage(s: DataFrame, per_ap: bool = True, tz: str = LOCAL_ZONE) -> DataFrame:
    """Distinct local hours per device, day (and access point).

    The hours of a day are bits of one integer: a fixed-size buffer that is
    fully combined before the shuffle.
    """
    bits = hour_bits(s, per_ap, tz)
    return bits.withColumn("hours", F.bit_count("bits").cast("bigint")).drop("bits")


def hour_bits(s: DataFrame, per_ap: bool = True, tz: str = LOCAL_ZONE) -> DataFrame:
    """(device, [ap,] day, bits): the local hours of a day as bits, which any two parts of the readings can be OR-ed from."""
    keys = ["device", "ap"] if per_ap else ["device"]
    return (s.withColumn("day", local_day("ts", tz)).withColumn("_hour", local_hour("ts", tz))
            .groupBy(*keys, "day").agg(F.bit_or(F.expr("shiftleft(1L, _hour)")).alias("bits")))


def always_on_devices(s: DataFrame, hours: int = ALWAYS_ON_HOURS, per_ap: bool = True,
                      per_day: bool = True, tz: str = LOCAL_ZONE) -> DataFrame:
    """Devices seen in at least `hours` distinct hours of one day.

    per_ap asks for them at one access point; otherwise at any. With
    per_day=False distinct hours are added up over all days.
    """
    cover = hour_coverage(s, per_ap, tz)
    if not per_day:
        keys = ["device", "ap"] if per_ap else ["device"]
        cover = cover.groupBy(*keys).agg(F.sum("hours").alias("hours"))
    return cover.where(F.col("hours") >= hours).select("device").distinct()


def merge_static_devices(old: DataFrame, today: DataFrame) -> DataFrame:
    """Union of the stored and today's always-on devices."""
    return old.select("device").union(today.select("device")).distinct()


def newly_static_devices(old: DataFrame, today: DataFrame) -> DataFrame:
    """Devices that today's list adds."""
    return today.select("device").distinct().join(old, "device", "left_anti")


def multi_ap_presence(s: DataFrame, n: int = 3) -> DataFrame:
    """(device, ts) heard by at least `n` access points at once."""
    return (s.groupBy("device", "ts").agg(F.count_distinct("ap").alias("aps"))
            .where(F.col("aps") >= n))


def multi_ap_codes(peaks: DataFrame) -> DataFrame:
    """Ordered access-point codes per instant; ambiguous when there is more than one.

    `code` comes with the peaks and numbers the access points of a site, so the
    set per instant is bounded by that number.
    """
    codes = peaks.groupBy("device", "ts").agg(F.sort_array(F.collect_set("code")).alias("_codes"))
    return codes.select("device", "ts", F.array_join("_codes", ",").alias("codes"),
                        (F.size("_codes") > 1).alias("ambiguous"))


def distinct_devices(s: DataFrame) -> DataFrame:
    return s.select("device").distinct()
