"""Combining and comparing the series of two access points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.clock import local_day
from footfall.operators.clean import filter_aps, filter_rssi, keep_known_vendors
from footfall.schema import LOCAL_ZONE, RSSI_FLOOR


def merge_ap_series(a: DataFrame, b: DataFrame, floor: float = RSSI_FLOOR,
                    oui: DataFrame | None = None) -> DataFrame:
    """Readings of two access points in one series, cleaned; sort it only on output."""
    merged = filter_rssi(a.unionByName(b), floor)
    return merged if oui is None else keep_known_vendors(merged, oui)


def days_on_both(s: DataFrame, a: str, b: str, tz: str = LOCAL_ZONE) -> DataFrame:
    """Local dates with readings at both access points."""
    return (filter_aps(s, [a, b]).groupBy(local_day("ts", tz).alias("day"))
            .agg(F.bool_or(F.col("ap") == a).alias("_a"), F.bool_or(F.col("ap") == b).alias("_b"))
            .where(F.col("_a") & F.col("_b")).select("day"))


def seen_on_one_side(s: DataFrame, a: str, b: str, tz: str = LOCAL_ZONE) -> DataFrame:
    """(device, day) with readings at one of two access points but not at the other."""
    return (filter_aps(s, [a, b]).groupBy("device", local_day("ts", tz).alias("day"))
            .agg(F.count_if(F.col("ap") == a).alias("at_a"), F.count_if(F.col("ap") == b).alias("at_b"))
            .where((F.col("at_a") == 0) | (F.col("at_b") == 0)))


def device_series(s: DataFrame, tz: str = LOCAL_ZONE, partitions: int | None = None) -> DataFrame:
    """Readings ordered per (day, device), each partition sorted for writing.

    Range partitioning on (day, device, ts) splits a device that is too big for
    one partition and still keeps every series contiguous across partitions.
    """
    x = s.withColumn("day", local_day("ts", tz))
    cols = ["day", "device", "ts"]
    x = x.repartitionByRange(partitions, *cols) if partitions else x.repartitionByRange(*cols)
    return x.sortWithinPartitions(*cols)
