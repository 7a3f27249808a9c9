"""Visit records: who is on site, since when, until when."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.operators.clean import filter_recent
from footfall.operators.sequence import in_order
from footfall.schema import RECENT_SECONDS

KEYS = ["device", "site_id"]


def detect_table(s: DataFrame, as_of, seconds: int = RECENT_SECONDS) -> DataFrame:
    """First sighting per (device, site) within the last five minutes."""
    return filter_recent(s, as_of, seconds).groupBy(*KEYS).agg(F.min("ts").alias("ts"))


def new_devices(detect: DataFrame, visits: DataFrame) -> DataFrame:
    return detect.join(visits.select(*KEYS).distinct(), KEYS, "left_anti")


def gone_devices(visits: DataFrame, detect: DataFrame) -> DataFrame:
    return visits.join(detect.select(*KEYS).distinct(), KEYS, "left_anti")


def append_visits(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new)


def open_visits(visits: DataFrame) -> DataFrame:
    """Visits without an end, per site."""
    return visits.where(F.col("end_ts").isNull()).groupBy("site_id").agg(F.count("*").alias("open"))


def update_visits(visits: DataFrame, detect: DataFrame, tick: int, policy: str = "first_visit") -> DataFrame:
    """One step of the tracker: open visits of new devices, end those of absent ones.

    policy="first_visit": a known device never opens a second visit and its end
    is moved to every tick at which it is absent. policy="reopen": an ended
    visit stays as it is and a device that returns opens another one.
    """
    here = detect.select(*KEYS, F.col("ts").alias("_seen"))
    if policy == "first_visit":
        merged = visits.join(here, KEYS, "full_outer")
        return merged.select(
            *KEYS, F.coalesce("start_ts", "_seen").alias("start_ts"),
            F.when(F.col("_seen").isNull(), F.lit(tick).cast("bigint")).otherwise(F.col("end_ts")).alias("end_ts"))
    # Only open visits meet the detect table; there is at most one per key.
    still = visits.where(F.col("end_ts").isNull()).select(*KEYS, "start_ts")
    ended = visits.where(F.col("end_ts").isNotNull()).select(*KEYS, "start_ts", "end_ts")
    merged = still.join(here, KEYS, "full_outer").select(
        *KEYS, F.coalesce("start_ts", "_seen").alias("start_ts"),
        F.when(F.col("_seen").isNull(), F.lit(tick).cast("bigint")).alias("end_ts"))
    return ended.unionByName(merged)


def spanned(origin: int, every: int, seconds: int) -> tuple[Column, Column]:
    """The first and the last tick that a sighting belongs to; none where the last one lies before the first."""
    first = F.greatest(F.lit(0), F.ceil((F.col("ts") - origin) / every))
    return first, F.ceil((F.col("ts") - origin + seconds) / every) - 1


def presence(s: DataFrame, origin: int, every: int, seconds: int = RECENT_SECONDS) -> DataFrame:
    """(device, site, tick) with the first sighting in (tick - seconds, tick].

    Tick k is at `origin + k * every`. A sighting belongs to the ticks in
    [ts, ts + seconds); their number is seconds / every at most, rounded up.
    """
    first, last = spanned(origin, every, seconds)
    return (s.where(last >= first)
            .select(*KEYS, "ts", F.explode(F.sequence(first, last)).alias("tick"))
            .groupBy(*KEYS, "tick").agg(F.min("ts").alias("first_ts")))


def visit_tracker(s: DataFrame, origin: int, every: int, ticks: int | Column,
                  seconds: int = RECENT_SECONDS, policy: str = "first_visit",
                  keys: Sequence[str] = KEYS, segment: int = 1 << 20) -> DataFrame:
    """All visits after ticks 0..ticks, without replaying the ticks one by one.

    A run of consecutive ticks at which a device is present is one stay. With
    policy="reopen" each stay is a visit that ends at the first tick without the
    device. With policy="first_visit" a device has one visit from its first
    stay on; it ends at the latest tick at which the device was absent, and is
    open only if it never was.
    """
    last_tick = F.lit(ticks).cast("bigint") if isinstance(ticks, int) else ticks
    found = stays(s, origin, every, last_tick, seconds, keys=keys, segment=segment)
    if policy == "reopen":
        end = F.when(F.col("run_end") < last_tick, F.lit(origin) + (F.col("run_end") + 1) * every)
        return found.select(*keys, "start_ts", end.alias("end_ts"))
    return with_end(first_visits(found, keys), origin, every, last_tick).select(*keys, "start_ts", "end_ts")


def stays(s: DataFrame, origin: int, every: int, last_tick: Column, seconds: int = RECENT_SECONDS, after: int = -1,
          keys: Sequence[str] = KEYS, segment: int = 1 << 20) -> DataFrame:
    """Runs of consecutive ticks in (after, last_tick] with the device present: first tick `run`, `run_end`, start_ts.

    A sighting stands for its first to its last tick, in one row however many they are. Later sightings have no earlier
    last tick, so a run ends where a first tick lies more than one behind the last tick before it.
    """
    first, last = spanned(origin, every, seconds)
    here = s.select(*keys, "ts", F.greatest(first, F.lit(after + 1)).cast("bigint").alias("tick"), F.least(last, last_tick).cast("bigint").alias("last"))
    here = here.where((F.col("tick") <= F.col("last")) & (F.col("tick") <= last_tick))
    here = here.groupBy(*keys, "tick").agg(F.min("ts").alias("first_ts"), F.max("last").alias("last"))
    runs = in_order(here, list(keys), order="tick", prev={"_before": "last"}, breaks=lambda p, c: c("tick") - p("last") > 1,
                    run="run", shared=["first_ts", "last"], segment=segment)
    return runs.groupBy(*keys, "run").agg(
        F.max("last").alias("run_end"), F.min_by("first_ts", "tick").alias("start_ts"))


def first_visits(found: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per key its start and the ticks `with_end` needs: of the first and the last stay's begin, and the last one's end."""
    return found.groupBy(*keys).agg(
        F.min_by("start_ts", "run").alias("start_ts"), F.min("run").alias("first_run"),
        F.max("run").alias("last_run"), F.max("run_end").alias("run_end"))


def with_end(whole: DataFrame, origin: int, every: int, last_tick: Column) -> DataFrame:
    """Add end_ts: the latest tick without the device, null if it was never absent."""
    at = lambda tick: F.lit(origin) + tick * F.lit(every)
    end = (F.when(F.col("run_end") < last_tick, at(last_tick))
           .when(F.col("first_run") < F.col("last_run"), at(F.col("last_run") - 1)))
    return whole.withColumn("end_ts", end.cast("bigint"))


def carry_first_visits(known: DataFrame, found: DataFrame, after: int, keys: Sequence[str] = KEYS, how: str = "full_outer") -> DataFrame:
    """`first_visits` of the ticks up to `after`, carried on by the stays found in the ticks behind it.

    With how="right" only the keys that have such stays come out.
    """
    new = first_visits(found, keys).select(*keys, *[F.col(c).alias(f"_{c}") for c in ("start_ts", "first_run", "last_run", "run_end")])
    x = known.join(new, list(keys), how)
    # A stay from the first new tick on goes on with the stay that reached the last known one.
    goes_on = (F.col("run_end") == after) & (F.col("_last_run") == after + 1)
    return x.select(*keys, F.coalesce("start_ts", "_start_ts").alias("start_ts"), F.coalesce("first_run", "_first_run").alias("first_run"),
                    F.when(goes_on, F.col("last_run")).otherwise(F.coalesce("_last_run", "last_run")).alias("last_run"),
                    F.coalesce("_run_end", "run_end").alias("run_end"))


def carry_open_visits(still: DataFrame, found: DataFrame, origin: int, every: int, after: int, last_tick: int,
                      keys: Sequence[str] = KEYS) -> DataFrame:
    """Visits open at tick `after` and the stays in (after, last_tick] -> visits, the ones open at last_tick without end."""
    x = still.select(*keys, F.col("start_ts").alias("_start"), F.lit(after + 1).cast("bigint").alias("run")).join(
        found.select(*keys, "run", "run_end", "start_ts"), [*keys, "run"], "full_outer")
    end_tick = F.coalesce(F.col("run_end") + 1, F.lit(after + 1))
    end = F.when(F.col("run_end").isNull() | (F.col("run_end") < last_tick), F.lit(origin) + end_tick * every)
    return x.select(*keys, F.coalesce("_start", "start_ts").alias("start_ts"), end.cast("bigint").alias("end_ts"))
