"""Entries, exits, net flow and occupancy per site."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.operators.sequence import SEGMENT, in_order


def with_prev(traj: DataFrame, segment: int | None = SEGMENT) -> DataFrame:
    """Time, side and signal of the device's previous point at the same site; sides may have any name."""
    x = in_order(traj.select("device", "ts", "site_id", "rssi", "side"), ["site_id", "device"],
                 prev={"ts_prev": "ts", "side_prev": "side", "rssi_prev": "rssi"}, segment=segment)
    return x.select("device", "ts", "side", "site_id", "rssi", "ts_prev", "side_prev", "rssi_prev")


def side_moves(traj: DataFrame, segment: int | None = SEGMENT) -> DataFrame:
    """Changes of side between consecutive points: outside->inside come, inside->outside go."""
    x = with_prev(traj, segment)
    come = (F.col("side_prev") == "outside") & (F.col("side") == "inside")
    go = (F.col("side_prev") == "inside") & (F.col("side") == "outside")
    return (x.withColumn("move", F.when(come, "come").when(go, "go"))
            .where(F.col("move").isNotNull())
            .select("device", "site_id", "ts_prev", "side_prev", "rssi_prev", "ts", "side", "rssi", "move"))


def adjacent_pairs(traj: DataFrame, max_gap: int = 1800, segment: int | None = SEGMENT) -> DataFrame:
    """Consecutive points of a device at a site, close in time and on different sides."""
    x = with_prev(traj, segment)
    return (x.where((F.col("ts") - F.col("ts_prev") <= max_gap) & (F.col("side") != F.col("side_prev")))
            .select("device", "site_id", "ts_prev", "side_prev", "ts", "side"))


def window_start(ts: str, window: str):
    return F.unix_timestamp(F.window(F.timestamp_seconds(ts), window)["start"])


def come_go_counts(moves: DataFrame, window: str | None = None) -> DataFrame:
    """Entries and exits per site, optionally per tumbling window; one pass for both."""
    keys = ["site_id"]
    if window:
        moves = moves.withColumn("window_start", window_start("ts", window))
        keys.append("window_start")
    return moves.groupBy(*keys).agg(
        F.count_if(F.col("move") == "come").alias("come"),
        F.count_if(F.col("move") == "go").alias("go"))


def join_come_go(come: DataFrame, go: DataFrame, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Combine entry and exit counts that were produced separately; a missing side is 0."""
    return come.join(go, list(keys), "full_outer").na.fill(0, ["come", "go"])


def net_flow(counts: DataFrame) -> DataFrame:
    return counts.withColumn("net", F.col("come") - F.col("go"))


def add_base(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Last published value plus net change per site; either may be missing."""
    return (base.select("site_id", "base").join(delta.select("site_id", "net"), "site_id", "full_outer")
            .select("site_id", (F.coalesce("base", F.lit(0)) + F.coalesce("net", F.lit(0))).alias("value")))


def latest_per_site(results: DataFrame, ties: str = "all", newer_than: int | None = None) -> DataFrame:
    """Rows at the latest publication time of each site.

    ties="all" keeps every row at that time; "one" keeps the largest value.
    The result history is joined back to one row per site.
    """
    if ties == "one":
        latest = results.groupBy("site_id").agg(
            F.max(F.struct("mon_time", "value")).alias("_m"))
        latest = latest.select("site_id", F.col("_m.value").alias("value"), F.col("_m.mon_time").alias("mon_time"))
    else:
        top = results.groupBy("site_id").agg(F.max("mon_time").alias("mon_time"))
        latest = results.join(top, ["site_id", "mon_time"]).select("site_id", "value", "mon_time")
    return latest if newer_than is None else latest.where(F.col("mon_time") > newer_than)


def occupancy(net_by_window: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """People on site after each window: base plus the running sum of net flow.

    The input has one row per (site, window), so a site's history is bounded by
    time, not by the number of sightings.
    """
    w = (Window.partitionBy("site_id").orderBy("window_start")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = net_by_window.withColumn("occupancy", F.sum("net").over(w))
    if base is None:
        return out
    return (out.join(base.select("site_id", "base"), "site_id", "left")
            .withColumn("occupancy", F.col("occupancy") + F.coalesce("base", F.lit(0))).drop("base"))
