"""Sessions split by silence, visit classification, dwell times, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.clock import bucket_of_day, local_day
from footfall.operators.sequence import SEGMENT, in_order
from footfall.schema import BUCKET_SECONDS, LOCAL_ZONE, PASSER_BY_SECONDS, SLICE_GAP, VISIT_GAP


def instants(s: DataFrame, keys: Sequence[str] = ("device",)) -> DataFrame:
    """One row per key and instant with the number of readings behind it."""
    return s.groupBy(*keys, "ts").agg(F.count("*").alias("readings"))


def sessionize(points: DataFrame, gap: int = SLICE_GAP, keys: Sequence[str] = ("device",),
               order: str = "ts", segment: int | None = SEGMENT) -> DataFrame:
    """Add `session_start`; a new session begins after a silence longer than `gap`.

    `points` has one row per key and instant (see `instants`) and only the
    columns that are needed afterwards.
    """
    rest = [c for c in points.columns if c not in (*keys, order)]
    return in_order(points, list(keys), order=order, breaks=lambda p, c: c(order) - p(order) > gap,
                    run="session_start", shared=rest, segment=segment)


def time_slices(s: DataFrame, gap: int = SLICE_GAP, segment: int | None = SEGMENT) -> DataFrame:
    """Label every reading with its device's session."""
    starts = sessionize(s.select("device", "ts").distinct(), gap, segment=segment)
    return s.join(starts, ["device", "ts"])


def sessions(s: DataFrame, gap: int = SLICE_GAP, segment: int | None = SEGMENT) -> DataFrame:
    """One row per device and session: start, end, seconds, readings."""
    return (sessionize(instants(s), gap, segment=segment)
            .groupBy("device", "session_start")
            .agg(F.max("ts").alias("session_end"), F.sum("readings").alias("readings"))
            .withColumn("seconds", F.col("session_end") - F.col("session_start")))


def short_sessions(found: DataFrame, seconds: int = PASSER_BY_SECONDS, keep_last: bool = True) -> DataFrame:
    """Passers-by: sessions shorter than `seconds`.

    keep_last=False leaves out each device's last session, which may not have
    ended yet when the data was cut.
    """
    short = found.where(F.col("seconds") < seconds)
    if keep_last:
        return short
    last = F.max("session_start").over(Window.partitionBy("device"))
    marked = found.withColumn("_last", last)
    return marked.where((F.col("seconds") < seconds) & (F.col("session_start") < F.col("_last"))).drop("_last")


def classify_visits(points: DataFrame, gap: int = VISIT_GAP, keys: Sequence[str] = ("device",),
                    segment: int | None = SEGMENT) -> DataFrame:
    """Sessions of peak instants -> counts of come, go and stay, and a passer-by flag.

    `points` is `inside_wins` output (boolean `inside`). Only keys with more
    than one instant are classified. Pass keys=("device", "day") and
    segment=None to cut sessions at midnight.
    """
    keys = list(keys)
    x = in_order(points, keys, prev={"ts_prev": "ts", "inside_prev": "inside"},
                 following={"ts_next": "ts"},
                 breaks=lambda p, c: c("ts") - p("ts") > gap, run="session_start", segment=segment)
    x = x.where(F.col("ts_prev").isNotNull() | F.col("ts_next").isNotNull())
    # A change between two points of the same session.
    changed = F.coalesce(
        (F.col("ts") > F.col("session_start")) & (F.col("inside") != F.col("inside_prev")), F.lit(False))
    per = x.withColumn("_changed", changed).groupBy(*keys, "session_start").agg(
        F.count("*").alias("n"),
        F.max("ts").alias("session_end"),
        F.min_by("inside", "ts").alias("first_inside"),
        F.max_by("inside", "ts").alias("last_inside"),
        F.count_if("_changed").alias("_changes"),
        F.max_by("_changed", "ts").alias("_last_changed"),
    )

    n = F.col("n")
    first, last = F.col("first_inside"), F.col("last_inside")
    same = first == last
    crossing = (n > 1) & ~same
    # For three or more points the last step does not count as a change.
    inner_changes = F.col("_changes") - F.when(F.col("_last_changed"), 1).otherwise(0)
    direct = (n == 2) | (inner_changes <= 1)
    left_and_back = (n >= 3) & same & (F.col("_changes") > 0)
    one = lambda cond: F.when(cond, 1).otherwise(0).cast("bigint")
    return per.select(
        *keys, "session_start", "session_end", "n",
        one(crossing & direct & ~first).alias("come"),
        one(crossing & direct & first).alias("go"),
        (one(crossing & ~direct) + one((n > 1) & same & first) + one(left_and_back)).alias("stay"),
        ((n == 1) | (same & ~first)).alias("passer_by"),
    )


def visit_actions(visits: DataFrame, action_dim: DataFrame) -> DataFrame:
    """One row per action of a classified visit, with its code and type: come, go, passer-by, stay, else other."""
    codes = F.array_compact(F.array(*[F.when(hit, F.lit(code)) for hit, code in (
        (F.col("come") > 0, 0), (F.col("go") > 0, 1), (F.col("passer_by"), 2), (F.col("stay") > 0, 3))]))
    codes = F.when(F.size(codes) > 0, codes).otherwise(F.array(F.lit(4)))
    return visits.withColumn("action_code", F.explode(codes)).join(action_dim, "action_code", "left")


def flow_by_bucket(visits: DataFrame, tz: str = LOCAL_ZONE, seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Sum of come - go + stay per bucket of the local day; buckets without visits are 0."""
    spark = visits.sparkSession
    flow = (visits.withColumn("bucket", bucket_of_day("session_start", tz, seconds))
            .groupBy("bucket")
            .agg(F.sum(F.col("come") - F.col("go") + F.col("stay")).alias("flow")))
    buckets = spark.range(86400 // seconds).withColumnRenamed("id", "bucket")
    return buckets.join(flow, "bucket", "left").select("bucket", F.coalesce("flow", F.lit(0)).alias("flow"))


def dwell_time(s: DataFrame, min_hours: int = 1, tz: str = LOCAL_ZONE) -> DataFrame:
    """Seconds and whole hours between first and last sighting per device and local day."""
    span = (s.groupBy("device", local_day("ts", tz).alias("day"))
            .agg((F.max("ts") - F.min("ts")).alias("seconds"))
            .where(F.col("seconds") > 0))
    hours = F.floor(F.col("seconds") / 3600)
    return span.withColumn("hours", hours).withColumn("long_stay", hours >= min_hours)


def interval_buckets(s: DataFrame, segment: int | None = SEGMENT) -> DataFrame:
    """Number of consecutive gaps per device by size: 0s, <1 min, m min.

    Readings of one instant are counted first: k of them make k-1 gaps of zero,
    so the ordered part has one row per instant.
    """
    x = in_order(instants(s), ["device"], prev={"ts_prev": "ts"}, shared=["readings"], segment=segment)
    gap = F.col("ts") - F.col("ts_prev")
    bucket = F.when(gap < 60, F.lit("<1 min")).otherwise(
        F.concat(F.floor(gap / 60).cast("string"), F.lit(" min")))
    parts = F.array(
        F.struct(F.when(F.col("ts_prev").isNotNull(), bucket).alias("bucket"), F.lit(1).cast("bigint").alias("n")),
        F.struct(F.lit("0s").alias("bucket"), (F.col("readings") - 1).alias("n")))
    return (x.select("device", F.explode(parts).alias("_g"))
            .select("device", "_g.*")
            .where(F.col("bucket").isNotNull() & (F.col("n") > 0))
            .groupBy("device", "bucket").agg(F.sum("n").alias("gaps")))


def peak_intervals(points: DataFrame, segment: int | None = SEGMENT) -> DataFrame:
    """Seconds between consecutive peak instants of a device."""
    x = in_order(points.select("device", "ts"), ["device"], prev={"ts_prev": "ts"}, segment=segment)
    return (x.where(F.col("ts_prev").isNotNull())
            .select("device", "ts", (F.col("ts") - F.col("ts_prev")).alias("seconds")))


def duplicate_readings(s: DataFrame) -> DataFrame:
    """Readings that share (device, ts, rssi) with another one; readings without a signal share that.

    A group holds the readings of one device in one second, so a plain window is bounded.
    """
    w = Window.partitionBy("device", "ts", "rssi")
    return s.withColumn("copies", F.count("*").over(w)).where(F.col("copies") > 1)
