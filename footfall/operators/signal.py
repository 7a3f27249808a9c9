"""From raw readings to trajectories: means, local maxima, one point per instant."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.operators.clean import drop_static_devices, filter_rssi, with_site
from footfall.operators.sequence import SEGMENT, in_order
from footfall.schema import RSSI_FLOOR


def mean_rssi(s: DataFrame, keys: Sequence[str] = ("device", "ts", "ap"), rounded: bool = True) -> DataFrame:
    """Mean signal per key, rounded half away from zero to whole dB unless told otherwise."""
    mean = F.avg("rssi")
    return s.groupBy(*keys).agg((F.round(mean) if rounded else mean).alias("rssi"))


def run_mean(s: DataFrame, order: str = "seq", within: Sequence[str] = ("device", "ts"),
             changes: Sequence[str] = ("ap",), floor: float | None = None, segment: int = 1 << 20) -> DataFrame:
    """Mean of consecutive readings; a combination that comes back later starts a run of its own.

    Readings are taken in `order` within `within`, and a run ends where one of
    `changes` does. The defaults suit per-device series in (ts, seq) order: a run
    never spans two instants, so (device, ts) is the key. For the lines of an
    access point's file use within=("ap",), changes=("device", "ts"). Readings
    not above `floor` separate runs but do not count. Rounds half to even.
    """
    runs = in_order(
        s.select(*within, *changes, "rssi", order), list(within), order=order,
        prev={f"_prev_{c}": c for c in changes},
        breaks=lambda p, c: reduce(lambda a, b: a | b, [p(x) != c(x) for x in changes]),
        run="run_seq", shared=["rssi"], segment=segment)
    if floor is not None:
        runs = runs.where(F.col("rssi") > floor)
    return (runs.groupBy(*within, *changes, "run_seq")
            .agg(F.bround(F.avg("rssi")).alias("rssi"), F.count("*").alias("n")))


def with_prev_next_rssi(means: DataFrame, keys: Sequence[str] = ("device", "ap"),
                        segment: int | None = SEGMENT) -> DataFrame:
    """Signal of the previous and the next instant of the same device and access point."""
    return in_order(means, keys, prev={"rssi_prev": "rssi"}, following={"rssi_next": "rssi"},
                    segment=segment)


def rssi_peaks(means: DataFrame, keys: Sequence[str] = ("device", "ap"), endpoints: bool = True,
               segment: int | None = SEGMENT) -> DataFrame:
    """Local maxima of the signal.

    A row counts when it is strictly above both neighbours. With `endpoints`
    the first and last row count when above their only neighbour. A lone row
    and plateaus are no peaks.
    """
    x = with_prev_next_rssi(means, keys, segment)
    up = F.col("rssi") > F.col("rssi_prev")
    down = F.col("rssi") > F.col("rssi_next")
    peak = up & down
    if endpoints:
        peak = peak | (up & F.col("rssi_next").isNull()) | (F.col("rssi_prev").isNull() & down)
    return x.where(peak).drop("rssi_prev", "rssi_next")


def with_prev_side(df: DataFrame) -> DataFrame:
    """Side of the reading before within equal (device, ts, rssi), by side name, site and access point; unlisted ones last.

    A group has one row per access point, so a plain window is bounded.
    """
    w = Window.partitionBy("device", "ts", "rssi").orderBy(F.col("side").asc_nulls_last(), "site_id", "ap")
    return df.withColumn("side_prev", F.lag("side").over(w))


def with_next_rssi(df: DataFrame) -> DataFrame:
    """Next reading within (device, ts), weakest first; equal ones in the reverse of `with_prev_side`'s order."""
    w = Window.partitionBy("device", "ts").orderBy("rssi", F.col("side").desc_nulls_first(), F.col("site_id").desc(), F.col("ap").desc())
    return df.withColumn("rssi_next", F.lead("rssi").over(w))


def _first_of(df, keys, *order):
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def one_ap_per_reading(peaks: DataFrame) -> DataFrame:
    """Of equally strong readings at one instant keep one: `inside`, `outside`, then an unlisted access point."""
    return _first_of(peaks, ["device", "ts", "rssi"], F.col("side").asc_nulls_last(), "site_id", "ap")


def strongest_per_instant(peaks: DataFrame) -> DataFrame:
    """One row per (device, ts): strongest, then inside, outside, unlisted, then lowest site and access point.

    Selecting the top row by this order makes a separate `one_ap_per_reading`
    step unnecessary.
    """
    return _first_of(peaks, ["device", "ts"], F.col("rssi").desc(), F.col("side").asc_nulls_last(), "site_id", *(["ap"] if "ap" in peaks.columns else []))


def strongest_ap(s: DataFrame) -> DataFrame:
    """All means that reach the maximum of their (device, ts); ties are kept.

    Takes `mean_rssi` output, so a group has one row per access point.
    """
    w = Window.partitionBy("device", "ts")
    return (s.withColumn("_max", F.max("rssi").over(w))
            .where(F.col("rssi") == F.col("_max")).drop("_max"))


def inside_wins(peaks: DataFrame, keys: Sequence[str] = ("device", "ts")) -> DataFrame:
    """One row per (device, ts); inside if any access point inside had a peak."""
    return (peaks.groupBy(*keys).agg(F.bool_or(F.col("side") == "inside").alias("inside")))


def trajectory(
    s: DataFrame,
    ap_dim: DataFrame,
    static_devices: DataFrame | None = None,
    floor: float = RSSI_FLOOR,
    with_peaks: bool = True,
    peak_key: str = "ap",
    segment: int | None = SEGMENT,
) -> DataFrame:
    """Readings -> one (device, ts, side, site_id, rssi) point per device and instant.

    peak_key="ap" looks for maxima per access point; "side" looks for them per
    (device, side) over all sites, on the strongest reading of each instant.
    """
    s = filter_rssi(s, floor)
    if static_devices is not None:
        s = drop_static_devices(s, static_devices)
    points = mean_rssi(s)
    if with_peaks and peak_key == "ap":
        points = rssi_peaks(points, segment=segment)
    points = with_site(points, ap_dim)
    if with_peaks and peak_key == "side":
        points = _first_of(points, ["device", "side", "ts"], F.col("rssi").desc(), "site_id", "ap")
        points = rssi_peaks(points.where(F.col("side").isNotNull()), ("device", "side"), segment=segment)
    return strongest_per_instant(points).select("device", "ts", "side", "site_id", "rssi")
