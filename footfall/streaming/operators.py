"""Streaming operators: streaming DataFrame -> streaming DataFrame.

Event time is `ts` (epoch seconds). Windows, means and buffers bound their state
with a watermark in append or update mode; how late a sighting may arrive is a
parameter. `running_count` and `stream_moments` keep one row per key for good, and
complete mode keeps every group whatever the watermark is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.schema import IDLE_SECONDS

DELAY = "10 minutes"


def with_event_time(s: DataFrame, delay: str = DELAY) -> DataFrame:
    return s.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", delay)


def new_visitors(s: DataFrame, window: str = "5 minutes", delay: str = DELAY, offset: str | None = None) -> DataFrame:
    """(site_id, device, window): each device once per site and window, as soon as it is seen.

    The keyed state forgets a window when the watermark has passed its end.
    """
    span = F.window("event_time", window, window, offset) if offset else F.window("event_time", window)
    return (with_event_time(s, delay).select("site_id", "device", span.alias("window"))
            .dropDuplicates(["site_id", "device", "window"])
            .select("site_id", "device", "window", F.unix_timestamp("window.start").alias("window_start")))


def stream_traffic(s: DataFrame, window: str = "5 minutes", delay: str = DELAY,
                   offset: str | None = None) -> DataFrame:
    """Distinct devices per site and closed window (append mode).

    Devices are deduplicated in a keyed state of their own, so that no window
    holds a set that grows with its visitors.
    """
    seen = new_visitors(s, window, delay, offset)
    return (seen.groupBy("site_id", "window").agg(F.count("*").alias("traffic"))
            .select("site_id", F.unix_timestamp("window.start").alias("window_start"), "traffic"))


def stream_mean_rssi(s: DataFrame, delay: str = DELAY) -> DataFrame:
    """Rounded mean signal per (device, ts, ap)."""
    return (with_event_time(s, delay).groupBy("device", "event_time", "ap")
            .agg(F.round(F.avg("rssi")).alias("rssi"))
            .select("device", F.unix_timestamp("event_time").alias("ts"), "ap", "rssi"))


def running_count(s: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Running total per key (update or complete mode)."""
    return s.groupBy(*keys).agg(F.count("*").alias("n"))


def buffer_digest(s: DataFrame, idle_seconds: int = IDLE_SECONDS, delay: str = DELAY) -> DataFrame:
    """Per (site, device, access point): span, number and range of the readings up to a silence (append mode).

    The state is of a fixed size whatever the length of the stay; `buffers.device_buffer` holds the readings.
    """
    x = with_event_time(s, delay)
    w = F.session_window("event_time", f"{int(idle_seconds)} seconds")
    return (x.groupBy("site_id", "device", "ap", w.alias("w"))
            .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("readings"),
                 F.min("rssi").alias("min_rssi"), F.max("rssi").alias("max_rssi"))
            .drop("w"))


def stream_moments(s: DataFrame) -> DataFrame:
    """Count, mean and variance per label for `operators.stats.welch` (complete mode; one row per label)."""
    from footfall.operators.stats import group_moments
    return group_moments(s)
