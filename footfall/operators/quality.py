"""Checks of sightings against where they were stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.clock import local_day, local_hour
from footfall.operators.sequence import number_rows
from footfall.schema import LOCAL_ZONE


def check_partition_day(s: DataFrame, tz: str = LOCAL_ZONE) -> DataFrame:
    """Readings whose local day differs from the `day` they are filed under, per device and hour."""
    return (s.withColumn("real_day", local_day("ts", tz))
            .where(F.col("real_day") != F.col("day"))
            .groupBy("day", "real_day", local_hour("ts", tz).alias("hour"), "device")
            .agg(F.count("*").alias("n")))


def position_codes(locations: DataFrame, order: str = "line_no") -> DataFrame:
    """Number locations 1..n along an integer column, as zero-padded binary codes.

    The width is the least i >= 1 with 2^i >= n, that is the length of n - 1 in
    binary; for n = 2^i the last code is one digit longer.
    """
    n = locations.agg(F.count("*")).scalar()
    code = F.bin(F.col("number"))
    width = F.length(F.bin(n - 1))
    return (number_rows(locations, [], order=order, out="number", segment=1 << 20)
            .withColumn("code", F.lpad(code, F.greatest(width, F.length(code)), F.lit("0"))))
