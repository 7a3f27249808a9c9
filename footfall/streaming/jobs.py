"""Per-batch jobs: each micro-batch runs the batch operators and publishes a version.

The batch id names the version, so a batch that is retried after a failure
replaces its own output and reads the same predecessor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.clock import local_day
from footfall.operators import flow, signal, stats, traffic, visits
from footfall.operators.clean import drop_static_devices, filter_rssi, with_load_time, with_site
from footfall.operators.sequence import in_order
from footfall.schema import IDLE_SECONDS, LOCAL_ZONE, RECENT_SECONDS, RESULT, RSSI_FLOOR, VISIT
from footfall.sinks.log import load_table, save_changes
from footfall.sinks.tables import lines_of, load_all, load_state, one_row, save_state, versions
from footfall.sources.scans import land
from footfall.streaming.buffers import device_buffer, rocksdb_state, session_buffer


def stream_to(df: DataFrame, path: str, checkpoint: str, mode: str = "append",
              trigger: dict | None = None, fmt: str = "parquet"):
    """Start a query into a file or console sink."""
    writer = df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
    if fmt != "console":
        writer = writer.option("path", path)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def each_batch(df: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str,
               mode: str = "append", trigger: dict | None = None):
    """Start a query that hands every micro-batch to `job(batch, batch_id)`."""
    return (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .foreachBatch(job).trigger(**(trigger or {"availableNow": True})).start())


MEANS = "device STRING, ap STRING, ts BIGINT, total DOUBLE, n BIGINT, left_rssi DOUBLE"
HELD = "device STRING, ts BIGINT, ap STRING, rssi DOUBLE"
ENDS = "site_id INT, device STRING, first STRUCT<ts: BIGINT, side: STRING>, last STRUCT<ts: BIGINT, side: STRING>, low STRING, high STRING"
END_KEYS = ["site_id", "device"]
LATE_SECONDS = 600
# Snapshots of a state that a retried batch or a reader may still want.
KEEP_VERSIONS = 20


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """A frame that a batch reads several times: computed once, kept until the block ends."""
    df = df.persist()
    try:
        yield df
    finally:
        df.unpersist()


@contextmanager
def carried_points(batch: DataFrame, batch_id: int, ap_dim: DataFrame, path: str, static_devices: DataFrame | None = None,
                   delay: int = LATE_SECONDS) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Trajectory points over all batches so far: (points that became final with this batch, points that may still change).

    All points that were ever final and those that may change are what `signal.trajectory` gives over all readings so
    far. An instant is final once it lies `delay` seconds behind the newest reading; readings that come later than
    that are dropped, as by a watermark. A peak is known when its right neighbour is final; until then every instant
    that it may win stays open, with the known peaks of other access points. State per (device, ap): the readings
    that are not final and the last final mean with its left neighbour; per open instant its known peaks.
    """
    spark = batch.sparkSession
    means = load_state(spark, f"{path}/_means", before=batch_id, schema=MEANS)
    (newest,) = one_row(means.agg(F.max("ts").alias("ts")), "ts")
    s = filter_rssi(batch, RSSI_FLOOR)
    if static_devices is not None:
        s = drop_static_devices(s, static_devices)
    if newest is not None:
        s = s.where(F.col("ts") >= newest - delay)
    sums = s.groupBy("device", "ap", "ts").agg(F.sum("rssi").alias("total"), F.count("rssi").alias("n"),
                                               F.lit(None).cast("double").alias("left_rssi"))
    known = means.unionByName(sums).groupBy("device", "ap", "ts").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("left_rssi").alias("left_rssi"))
    known = in_order(known.withColumn("rssi", F.round(F.col("total") / F.col("n"))), ["device", "ap"],
                     prev={"rssi_prev": "rssi"}, following={"rssi_next": "rssi", "ts_next": "ts"}, shared=["total", "n", "left_rssi"])
    known = known.withColumn("rssi_prev", F.coalesce("rssi_prev", "left_rssi"))
    with kept(known) as known, ExitStack() as rest:
        (newest,) = one_row(known.agg(F.max("ts").alias("ts")), "ts")
        final = 0 if newest is None else newest - delay
        up, down = F.col("rssi") > F.col("rssi_prev"), F.col("rssi") > F.col("rssi_next")
        first, last = F.col("rssi_prev").isNull(), F.col("rssi_next").isNull()
        peak = F.coalesce((up & down) | (up & last) | (first & down), F.lit(False))
        settled = (F.col("ts") < final) & F.col("ts_next").isNotNull() & (F.col("ts_next") < final)
        held_cols = ["device", "ts", "ap", "rssi"]
        may_win = ~settled & ((F.col("ts") >= final) | first | up)
        still_open = known.where(may_win).select("device", "ts").distinct().withColumn("_open", F.lit(True))
        decided = known.where(settled & peak).select(*held_cols).unionByName(
            load_state(spark, f"{path}/_held", before=batch_id, schema=HELD).select(*held_cols))
        decided = rest.enter_context(kept(decided.join(still_open, ["device", "ts"], "left")))
        held = decided.where("_open").select(*held_cols)
        closed = decided.where("_open IS NULL").select(*held_cols)
        save_state(known.where(~settled).select("device", "ap", "ts", "total", "n", F.col("rssi_prev").alias("left_rssi")),
                   f"{path}/_means", batch_id, KEEP_VERSIONS)
        save_state(held, f"{path}/_held", batch_id, KEEP_VERSIONS)

        def points(peaks: DataFrame) -> DataFrame:
            return signal.strongest_per_instant(with_site(peaks, ap_dim)).select("device", "ts", "side", "site_id", "rssi")

        yield points(closed), points(held.unionByName(known.where(~settled & peak).select(*held_cols)))


def _ends(points: DataFrame) -> DataFrame:
    at = F.struct("ts", "side")
    return points.where(F.col("side").isNotNull()).select(
        "site_id", "device", at.alias("first"), at.alias("last"), F.col("side").alias("low"), F.col("side").alias("high"))


def _merged_ends(ends: DataFrame) -> DataFrame:
    return ends.groupBy("site_id", "device").agg(F.min("first").alias("first"), F.max("last").alias("last"),
                                                 F.min("low").alias("low"), F.max("high").alias("high"))


def occupancy_job(ap_dim: DataFrame, path: str, static_devices: DataFrame | None = None,
                  mon_time: Callable[[int], int] | None = None, carry: bool = False,
                  delay: int = LATE_SECONDS) -> Callable[[DataFrame, int], None]:
    """Trajectories of the batch -> net flow per site -> last published value plus it -> publish.

    Each version holds every site known so far, so the newest one is all the
    next batch has to read.

    With `carry` peaks and moves reach over batches (`carried_points`): each version is the net flow of all readings
    so far, however they are cut into batches. Entries and exits of a device at a site alternate, so its net flow is
    given by the sides of its first and last point; access points need the sides inside and outside, or none.
    """
    if carry and not ap_dim.where(~F.col("side").isin("inside", "outside")).isEmpty():
        raise ValueError("carry needs access points with the sides inside and outside, or none")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        base = load_state(spark, path, before=batch_id, schema=RESULT)
        traj = signal.trajectory(batch, ap_dim, static_devices)
        net = flow.net_flow(flow.come_go_counts(flow.side_moves(traj)))
        value = flow.add_base(base.select("site_id", F.col("value").alias("base")), net)
        now = mon_time(batch_id) if mon_time else None
        save_state(with_load_time(value, now), path, batch_id)

    def run_carried(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with carried_points(batch, batch_id, ap_dim, path, static_devices, delay) as (closed, still_open):
            before = load_table(spark, f"{path}/_ends", END_KEYS, ENDS, before=batch_id)
            with kept(_merged_ends(_ends(closed))) as new:
                met = before.join(new.select(*END_KEYS), END_KEYS, "left_semi")
                save_changes(_merged_ends(met.unionByName(new)), f"{path}/_ends", batch_id, END_KEYS, ENDS)
            now = load_table(spark, f"{path}/_ends", END_KEYS, ENDS, before=batch_id + 1)
            ends = _merged_ends(now.unionByName(_ends(still_open)))
            inside = [(F.col(f"{c}.side") == "inside").cast("bigint") for c in ("last", "first")]
            value = ends.where("low <> high").groupBy("site_id").agg(F.sum(inside[0] - inside[1]).alias("value"))
            save_state(with_load_time(value, mon_time(batch_id) if mon_time else None), path, batch_id)
    return run_carried if carry else run


def stream_occupancy(s: DataFrame, ap_dim: DataFrame, path: str, checkpoint: str,
                     static_devices: DataFrame | None = None, trigger: dict | None = None,
                     mon_time: Callable[[int], int] | None = None, carry: bool = False, delay: int = LATE_SECONDS):
    return each_batch(s, occupancy_job(ap_dim, path, static_devices, mon_time, carry, delay), checkpoint, trigger=trigger)


def trajectory_rows_job(ap_dim: DataFrame, path: str, static_devices: DataFrame | None = None,
                        mon_time: Callable[[int], int] | None = None, carry: bool = False,
                        delay: int = LATE_SECONDS) -> Callable[[DataFrame, int], None]:
    """One row (site_id, value -1, time) per trajectory point of the batch; `load_all` reads those of all batches.

    With `carry` a version has the points that became final with the batch, over all batches (`carried_points`);
    `load_trajectory_rows` reads them and those that may still change.
    """
    def publish(traj: DataFrame, to: str, batch_id: int, keep: int | None = None) -> None:
        rows = traj.select(F.lit(0).alias("site_id"), F.lit(-1).cast("bigint").alias("value"))
        save_state(with_load_time(rows, mon_time(batch_id) if mon_time else None), to, batch_id, keep)

    def run(batch: DataFrame, batch_id: int) -> None:
        publish(signal.trajectory(batch, ap_dim, static_devices), path, batch_id)

    def run_carried(batch: DataFrame, batch_id: int) -> None:
        with carried_points(batch, batch_id, ap_dim, path, static_devices, delay) as (closed, still_open):
            publish(closed, path, batch_id)
            publish(still_open, f"{path}/_open", batch_id, KEEP_VERSIONS)
    return run_carried if carry else run


def load_trajectory_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows that `stream_trajectory_rows` with `carry` has published so far: the final ones and the last open ones."""
    cols = [f.name for f in RESULT]
    return load_all(spark, path, RESULT).select(*cols).unionByName(load_state(spark, f"{path}/_open", schema=RESULT).select(*cols))


def stream_trajectory_rows(s: DataFrame, ap_dim: DataFrame, path: str, checkpoint: str,
                           static_devices: DataFrame | None = None, trigger: dict | None = None,
                           mon_time: Callable[[int], int] | None = None, carry: bool = False, delay: int = LATE_SECONDS):
    return each_batch(s, trajectory_rows_job(ap_dim, path, static_devices, mon_time, carry, delay), checkpoint, trigger=trigger)


VISIT_COLUMNS = ("device", "site_id", "start_ts", "end_ts")
SEEN = "device STRING, site_id INT, ts BIGINT"
FIRST_VISIT = "device STRING, site_id INT, start_ts BIGINT, first_run BIGINT, last_run BIGINT, run_end BIGINT"
TICK = "tick BIGINT, origin BIGINT, every BIGINT"


def visits_job(ap_dim: DataFrame, path: str, seconds: int = RECENT_SECONDS, policy: str = "first_visit",
               every: int = RECENT_SECONDS, origin: int = 0) -> Callable[[DataFrame, int], None]:
    """Visit tracker with ticks at origin + k * every, whatever the batches are.

    A tick is worked off once a sighting at or after it has come, and looks at all sightings of the last `seconds`,
    of earlier batches too. A batch may bring no tick or many. A sighting that comes after its tick counts for the
    ticks still to come. State: sightings that later ticks need, and one row per key (first_visit) or per open visit
    (reopen); visits that are over are appended once. `load_visits` reads the result.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = load_state(spark, f"{path}/tick", before=batch_id, schema=TICK)
        (after,) = one_row(last, "tick")
        after = -1 if after is None else after
        seen = load_state(spark, f"{path}/seen", before=batch_id, schema=SEEN).unionByName(
            with_site(batch, ap_dim, unknown="drop").select("device", F.col("site_id").cast("int").alias("site_id"), "ts")).persist()
        try:
            (newest,) = one_row(seen.agg(F.max("ts").alias("ts")), "ts")
            tick = after if newest is None else max(after, (newest - origin) // every)
            if tick > after:
                found = visits.stays(seen, origin, every, F.lit(tick), seconds, after)
                if policy == "reopen":
                    still = load_state(spark, f"{path}/open", before=batch_id, schema=VISIT)
                    now = visits.carry_open_visits(still, found, origin, every, after, tick).persist()
                    save_state(now.where("end_ts IS NOT NULL"), f"{path}/ended", batch_id)
                    save_state(now.where("end_ts IS NULL"), f"{path}/open", batch_id)
                    now.unpersist()
                else:
                    known = load_table(spark, f"{path}/first", visits.KEYS, FIRST_VISIT, before=batch_id)
                    now = visits.carry_first_visits(known, found, after, how="right")
                    save_changes(now, f"{path}/first", batch_id, visits.KEYS, FIRST_VISIT)
            save_state(seen.where(F.col("ts") > origin + (tick + 1) * every - seconds), f"{path}/seen", batch_id, KEEP_VERSIONS)
            now_at = spark.range(1).select(*[F.lit(v).cast("bigint").alias(n) for v, n in ((tick, "tick"), (origin, "origin"), (every, "every"))])
            save_state(now_at, f"{path}/tick", batch_id, KEEP_VERSIONS)
        finally:
            seen.unpersist()
    return run


def load_visits(spark: SparkSession, path: str) -> DataFrame:
    """Visits that `stream_visits` has published so far, by either policy."""
    tick, origin, every = one_row(load_state(spark, f"{path}/tick", schema=TICK), "tick", "origin", "every")
    first = load_table(spark, f"{path}/first", visits.KEYS, FIRST_VISIT)
    first = visits.with_end(first, origin or 0, every or 1, F.lit(tick).cast("bigint"))
    still = load_state(spark, f"{path}/open", schema=VISIT)
    found = first.select(*VISIT_COLUMNS).unionByName(still.select(*VISIT_COLUMNS))
    if not versions(spark, f"{path}/ended"):
        return found
    return found.unionByName(spark.read.parquet(f"{path}/ended").select(*VISIT_COLUMNS))


def stream_visits(s: DataFrame, ap_dim: DataFrame, path: str, checkpoint: str, seconds: int = RECENT_SECONDS,
                  policy: str = "first_visit", trigger: dict | None = None, every: int = RECENT_SECONDS, origin: int = 0):
    return each_batch(s, visits_job(ap_dim, path, seconds, policy, every, origin), checkpoint, trigger=trigger)


def stream_buffers(s: DataFrame, path: str, checkpoint: str, idle_seconds: int = IDLE_SECONDS, delay: str | None = None,
                   trigger: dict | None = None, long_stays: bool = False):
    """Write the readings of every buffer (`buffers.session_buffer`) once a silence has closed it.

    With `long_stays` a batch only adds its readings to an open buffer (`buffers.device_buffer`). A checkpoint belongs to
    one of the two.
    """
    buffered = device_buffer if long_stays else session_buffer
    with rocksdb_state(s.sparkSession):
        return stream_to(buffered(s, idle_seconds, delay), path, checkpoint, trigger=trigger)


def stream_land(s: DataFrame, path: str, checkpoint: str, tz: str = LOCAL_ZONE, salt: str | None = None,
                trigger: dict | None = None):
    """Append every sighting to the lake, each batch in partitions of its own."""
    def run(batch: DataFrame, batch_id: int) -> None:
        land(batch, path, tz, salt, batch_id=batch_id)
    return each_batch(s, run, checkpoint, trigger=trigger)


def stream_ab_test(s: DataFrame, a, b, path: str, checkpoint: str, trigger: dict | None = None, alpha: float | None = None,
                   most_batches: int | None = None):
    """Publish Welch's t, degrees of freedom and p-value over everything seen so far.

    With `alpha` no further version is published once a p-value lies below it, nor after `most_batches` versions;
    `run_ab_test` stops the query then.
    """
    from footfall.streaming.operators import stream_moments

    def run(batch: DataFrame, batch_id: int) -> None:
        if not _decided(batch.sparkSession, path, batch_id, alpha, most_batches):
            save_state(stats.welch(batch, a, b), path, batch_id)
    return each_batch(stream_moments(s), run, checkpoint, mode="complete", trigger=trigger)


def _decided(spark: SparkSession, path: str, before: int | None, alpha: float | None, most_batches: int | None) -> bool:
    """Whether the versions so far end a test. A decision is read from what is published, so a restart keeps it."""
    done = [v for v in versions(spark, path) if before is None or v < before]
    if not done or (alpha is None and most_batches is None):
        return False
    (p,) = one_row(load_state(spark, path, before=before), "p")
    return (alpha is not None and p is not None and p < alpha) or (most_batches is not None and len(done) >= most_batches)


def run_ab_test(s: DataFrame, a, b, path: str, checkpoint: str, alpha: float = 0.05, most_batches: int | None = None,
                trigger: dict | None = None, poll_seconds: float = 1.0) -> bool:
    """Run `stream_ab_test` until its stop rule holds or its source ends; true if the last p-value lies below `alpha`."""
    spark = s.sparkSession
    if not _decided(spark, path, None, alpha, most_batches):
        test = stream_ab_test(s, a, b, path, checkpoint, trigger, alpha, most_batches)
        while not test.awaitTermination(poll_seconds):
            if _decided(spark, path, None, alpha, most_batches):
                test.stop()  # whatever batch is under way would publish nothing
                break
    (p,) = one_row(load_state(spark, path, schema="t DOUBLE, df DOUBLE, p DOUBLE"), "p")
    return p is not None and p < alpha


def stream_counts(s: DataFrame, keys: Sequence[str], path: str, checkpoint: str, trigger: dict | None = None):
    """Running totals per key as a keyed log: a batch writes the keys it changed. `load_table` reads them."""
    from footfall.streaming.operators import running_count

    counts = running_count(s, keys)

    def run(batch: DataFrame, batch_id: int) -> None:
        save_changes(batch, path, batch_id, keys, counts.schema)
    return each_batch(counts, run, checkpoint, mode="update", trigger=trigger)


def stream_summary(s: DataFrame, cols: Sequence[str], path: str, checkpoint: str, trigger: dict | None = None):
    """Keep `stats.moments` of everything seen so far: each batch adds its own to the last version."""
    def run(batch: DataFrame, batch_id: int) -> None:
        known = load_state(batch.sparkSession, path, before=batch_id, schema=stats.MOMENTS)
        save_state(stats.merged_moments(known.unionByName(stats.moments(batch, cols))), path, batch_id, KEEP_VERSIONS)
    return each_batch(s, run, checkpoint, trigger=trigger)


HOUR_KEYS = ["device", "ap", "day"]
HOUR_BITS = "device STRING, ap STRING, day DATE, bits BIGINT"


def stream_always_on(s: DataFrame, path: str, checkpoint: str, hours: int, tz: str = LOCAL_ZONE, delay: int = LATE_SECONDS,
                     trigger: dict | None = None):
    """Keep the devices seen in at least `hours` hours of one day at one access point; `load_static` reads them.

    State: the hours of each (device, access point, day) as bits, OR-ed per batch, and the list. Days that no reading
    within `delay` seconds of the newest can reach are deleted, so no earlier day is read again.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = load_table(spark, f"{path}/hours", HOUR_KEYS, HOUR_BITS, before=batch_id)
        (newest,) = one_row(batch.agg(F.max("ts").alias("ts")), "ts")
        if newest is None:
            return
        over = F.col("day") < local_day(F.lit(newest - delay), tz)
        # One shuffle brings the batch's hours to the known ones: a key is in the batch or not, and its day over or not.
        both = traffic.hour_bits(batch, tz=tz).withColumn("_new", F.lit(True)).unionByName(known.withColumn("_new", F.lit(False)))
        both = both.groupBy(*HOUR_KEYS).agg(F.bit_or("bits").alias("bits"), F.max("_new").alias("_new"))
        with kept(both.where(F.col("_new") | over)) as now:
            found = now.where(F.col("_new") & (F.bit_count("bits") >= hours)).select("device").distinct()
            listed = load_table(spark, f"{path}/devices", ["device"], "device STRING", before=batch_id)
            save_changes(now.withColumn("_gone", over), f"{path}/hours", batch_id, HOUR_KEYS, HOUR_BITS)
            save_changes(traffic.newly_static_devices(listed, found), f"{path}/devices", batch_id, ["device"], "device STRING")
    return each_batch(s, run, checkpoint, trigger=trigger)


def load_static(spark: SparkSession, path: str) -> DataFrame:
    return load_table(spark, f"{path}/devices", ["device"], "device STRING")


def publish_complete(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Publish the whole result of an aggregation as a version after every batch (complete mode)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        save_state(batch, path, batch_id)
    return each_batch(df, run, checkpoint, mode="complete", trigger=trigger)


LATEST_WINDOWS = "site_id INT, window_start BIGINT, value BIGINT"


def traffic_job(path: str, tz: str = LOCAL_ZONE, mon_time: Callable[[int], int] | None = None) -> Callable[[DataFrame, int], None]:
    """Add a batch of new visitors (site_id, device, window_start) and publish the sites' latest windows of the newest day.

    Visitors are new when they come here, so adding up is enough, and a site's latest window never gets an earlier
    one: the state is one row per site.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = load_state(spark, f"{path}/_latest", before=batch_id, schema=LATEST_WINDOWS)
        new = batch.groupBy("site_id", "window_start").agg(F.count("*").alias("value"))
        now = known.unionByName(new).groupBy("site_id", "window_start").agg(F.sum("value").alias("value"))
        now = now.groupBy("site_id").agg(F.max("window_start").alias("window_start"), F.max_by("value", "window_start").alias("value"))
        save_state(now, f"{path}/_latest", batch_id, KEEP_VERSIONS)
        now = load_state(spark, f"{path}/_latest", before=batch_id + 1)
        today = now.select(F.max(local_day("window_start", tz))).scalar()
        value = now.where(local_day("window_start", tz) == today).select("site_id", "value")
        save_state(with_load_time(value, mon_time(batch_id) if mon_time else None), path, batch_id)
    return run


def refresh_traffic(s: DataFrame, ap_dim: DataFrame, path: str, checkpoint: str, window: str = "5 minutes",
                    trigger: dict | None = None, mon_time: Callable[[int], int] | None = None, delay: int = LATE_SECONDS):
    """Keep the latest visitor counts of all sites up to date, e.g. trigger={"processingTime": "30 seconds"}.

    A keyed state passes each (site, device, window) once and forgets it when the window is over, so a trigger's work
    follows its new readings; nothing is read again. Readings more than `delay` seconds behind the newest may be left out.
    """
    from footfall.streaming.operators import new_visitors

    seen = new_visitors(with_site(filter_rssi(s), ap_dim, unknown="drop"), window, f"{delay} seconds")
    return each_batch(seen, traffic_job(path, mon_time=mon_time), checkpoint, trigger=trigger)


def stream_publish(s: DataFrame, servers: str, topic: str, checkpoint: str,
                   fields=("device", "rssi", "ts", "ap"), trigger: dict | None = None):
    """Send sightings as lines to a Kafka topic; needs the Spark Kafka package on the cluster."""
    return (lines_of(s, fields).writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("topic", topic).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
