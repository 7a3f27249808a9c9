"""Queries that run a stream over the given tables, or write a table and read it back.

Each run works in folders of its own below the session's shared folder. The
stream ends when the available files are read (`availableNow`).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from footfall.functions import clock, strings
from footfall.functions.clock import local_day
from footfall.functions.strings import wire_line
from footfall.operators import clean, order, sessions, signal, stats, traffic
from footfall.plans.jobs import entry_exit_report, peak_instants
from footfall.plans.queries import query
from footfall.plans.tables import EVENT_SCHEMA, TICK, aps, as_sightings, device_of, raw_sightings, sightings, stream_events, table, vendors, wire_lines
from footfall.schema import RESULT
from footfall.session import fresh_path
from footfall.sinks import tables as sinks
from footfall.sinks.log import append_batch, load_table, read_batches
from footfall.sources import dims, scans
from footfall.streaming import jobs, operators
from footfall.streaming.buffers import BUFFERED
from footfall.streaming.sources import file_lines, stream_scans, stream_tail

MON_TIME = 1706659200


def _stream(spark, d, tick=1):
    return as_sightings(stream_events(spark, d), tick)


def _appended(spark, df, name):
    """Run an append-mode stream into parquet and read the result."""
    path = fresh_path(spark, name)
    jobs.stream_to(df, path, fresh_path(spark, "checkpoint")).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def _published(spark, start, name, schema=None):
    """Run a stream that publishes versions and read the last one."""
    path = fresh_path(spark, name)
    start(path, fresh_path(spark, "checkpoint")).awaitTermination()
    return sinks.load_state(spark, path, schema=schema)


@query("stream_traffic", """SELECT * FROM (SELECT site_id, ts // 300 * 300 AS window_start,
    count(DISTINCT device) AS traffic FROM rsite GROUP BY ALL)
    WHERE window_start + 300 <= (SELECT max(ts) - 600 FROM r)""", "rsite")
def _(spark, d):
    s = clean.with_site(_stream(spark, d), aps(spark))
    return _appended(spark, operators.stream_traffic(s), "traffic")


@query("stream_traffic_day", """SELECT * FROM (SELECT site_id, (ts + 28800) // 86400 * 86400 - 28800 AS window_start,
    count(DISTINCT device) AS traffic FROM rsite GROUP BY ALL)
    WHERE window_start + 86400 <= (SELECT max(ts) - 600 FROM r)""", "rsite")
def _(spark, d):
    s = clean.with_site(_stream(spark, d), aps(spark))
    return _appended(spark, operators.stream_traffic(s, "1 day", offset="16 hours"), "traffic-day")


@query("stream_mean_rssi", "SELECT * FROM means WHERE ts <= (SELECT max(ts) - 600 FROM clean)", "means")
def _(spark, d):
    return _appended(spark, operators.stream_mean_rssi(clean.filter_rssi(_stream(spark, d, 21600))), "means")


@query("buffer_digest", """, g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY site_id, device, ap ORDER BY ts, seq) AS gap FROM rsite),
    m AS (SELECT *, sum(CASE WHEN gap <= 9273 THEN 0 ELSE 1 END) OVER (
    PARTITION BY site_id, device, ap ORDER BY ts, seq) AS no FROM g)
    SELECT site_id, device, ap, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS readings, min(rssi) AS min_rssi,
    max(rssi) AS max_rssi FROM m GROUP BY site_id, device, ap, no
    HAVING max(ts) + 9273 <= (SELECT max(ts) - 600 FROM r)""", "rsite")
def _(spark, d):
    return _appended(spark, operators.buffer_digest(clean.with_site(_stream(spark, d), aps(spark))), "buffers")


def _by_slices(spark, d, start, parts=4):
    """Let the stream `start(events)` read the events in several micro-batches, in the order of time."""
    folder, x = fresh_path(spark, "events"), table(spark, d, "events")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    lo, hi = sinks.one_row(x.agg(F.min(at).alias("lo"), F.max(at).alias("hi")), "lo", "hi")
    for i in range(parts if lo is not None else 0):
        part = F.floor((at - lo) * parts / (hi - lo + 1)) == i
        x.where(part).write.mode("append").parquet(folder)
        start(spark.readStream.schema(EVENT_SCHEMA).parquet(folder)).awaitTermination()


@query("running_count", "SELECT device, ap, count(*) AS n FROM r GROUP BY device, ap", "r")
def _(spark, d):
    path, checkpoint = fresh_path(spark, "counts"), fresh_path(spark, "checkpoint")
    _by_slices(spark, d, lambda e: jobs.stream_counts(as_sightings(e, 1), ["device", "ap"], path, checkpoint))
    return load_table(spark, path, ["device", "ap"], "device STRING, ap STRING, n BIGINT")


@query("device_buffer", """, g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY site_id, device, ap ORDER BY ts, seq) AS gap FROM rsite),
    m AS (SELECT *, sum(CASE WHEN gap <= 9273 THEN 0 ELSE 1 END) OVER (
    PARTITION BY site_id, device, ap ORDER BY ts, seq) AS no FROM g),
    b AS (SELECT *, min(ts) OVER w AS first_ts, max(ts) OVER w AS last_ts FROM m WINDOW w AS (PARTITION BY site_id, device, ap, no))
    SELECT site_id, device, ap, first_ts, ts, rssi FROM b WHERE last_ts + 9273 <= (SELECT max(ts) - 600 FROM r)""", "rsite")
def _(spark, d):
    path, checkpoint = fresh_path(spark, "buffers"), fresh_path(spark, "checkpoint")
    _by_slices(spark, d, lambda e: jobs.stream_buffers(clean.with_site(as_sightings(e, 1), aps(spark)), path, checkpoint))
    return spark.read.schema(BUFFERED).parquet(path)


@query("stream_tail", """SELECT device, rssi, ts, ap FROM r, (SELECT min(ts) AS lo, max(ts) AS hi FROM r)
    WHERE floor((ts - lo) * 4 / (hi - lo + 1)) > 0""", "r")
def _(spark, d):
    """The first quarter of the sightings is there before the query starts; it is history."""
    root, path, checkpoint = (fresh_path(spark, n) for n in ("scans", "tail", "checkpoint"))
    s = raw_sightings(spark, d)
    lo, hi = sinks.one_row(s.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")), "lo", "hi")
    for i in range(4 if lo is not None else 0):
        part = s.where(F.floor((F.col("ts") - lo) * 4 / (hi - lo + 1)) == i)
        part.select(wire_line("device", "rssi", "ts").alias("value"), "ap").write.partitionBy("ap").mode("append").text(root)
        jobs.stream_to(stream_tail(spark, root), path, checkpoint).awaitTermination()
    found = spark.read.schema("device STRING, rssi DOUBLE, ts BIGINT, ap STRING").parquet(path)
    return found.withColumn("ap", F.regexp_replace("ap", "^ap=", ""))


@query("stream_occupancy", f"SELECT site_id, come - go AS value, CAST({MON_TIME} AS BIGINT) AS mon_time FROM counts", "counts")
def _(spark, d):
    path, checkpoint = fresh_path(spark, "occupancy"), fresh_path(spark, "checkpoint")
    _by_slices(spark, d, lambda e: jobs.stream_occupancy(
        as_sightings(e, 21600), aps(spark), path, checkpoint, mon_time=lambda _: MON_TIME, carry=True))
    return sinks.load_state(spark, path, schema=RESULT)


@query("stream_trajectory_rows", f"""SELECT 0 AS site_id, CAST(-1 AS BIGINT) AS value,
    CAST({MON_TIME} AS BIGINT) AS mon_time FROM traj""", "traj")
def _(spark, d):
    path, checkpoint = fresh_path(spark, "points"), fresh_path(spark, "checkpoint")
    _by_slices(spark, d, lambda e: jobs.stream_trajectory_rows(
        as_sightings(e, 21600), aps(spark), path, checkpoint, mon_time=lambda _: MON_TIME, carry=True))
    return jobs.load_trajectory_rows(spark, path)


def _visits(spark, d, policy):
    path, checkpoint = fresh_path(spark, "visits"), fresh_path(spark, "checkpoint")
    _by_slices(spark, d, lambda e: jobs.stream_visits(
        as_sightings(e, 1), aps(spark), path, checkpoint, 2 * TICK, policy, every=TICK, origin=1704067200))
    return jobs.load_visits(spark, path)


@query("stream_visits", "SELECT * FROM first_visit", "first_visit")
def _(spark, d):
    return _visits(spark, d, "first_visit")


@query("stream_visits_reopen", "SELECT * FROM reopened", "reopened")
def _(spark, d):
    return _visits(spark, d, "reopen")


@query("refresh_traffic", f"""SELECT site_id, value, CAST({MON_TIME} AS BIGINT) AS mon_time FROM (
    SELECT site_id, ts // 300 * 300 AS w, count(DISTINCT device) AS value FROM rsite WHERE rssi > -90
    AND (ts + 28800) // 86400 = (SELECT max((ts + 28800) // 86400) FROM r) GROUP BY ALL)
    QUALIFY w = max(w) OVER (PARTITION BY site_id)""", "rsite")
def _(spark, d):
    path, checkpoint = fresh_path(spark, "traffic-now"), fresh_path(spark, "checkpoint")
    _by_slices(spark, d, lambda e: jobs.refresh_traffic(as_sightings(e, 1), aps(spark), path, checkpoint, mon_time=lambda _: MON_TIME))
    return sinks.load_state(spark, path, schema=RESULT)


@query("stream_mean_rssi_vendors", """, v AS (SELECT * FROM r WHERE ap IN ('AP0', 'AP1') AND substr(device, 1, 6) IN (SELECT prefix FROM oui))
    SELECT device, ts, ap, round(avg(rssi)) AS rssi FROM v WHERE ts <= (SELECT max(ts) - 600 FROM v) GROUP BY device, ts, ap""", "r", "oui")
def _(spark, d):
    s = clean.keep_known_vendors(clean.filter_aps(_stream(spark, d), ["AP0", "AP1"]), vendors(spark, d))
    return _appended(spark, operators.stream_mean_rssi(s), "vendor-means")


@query("stream_ab_test", """, g AS (SELECT event_type, count(value) AS n, avg(value) AS m, var_samp(value) AS v
    FROM events GROUP BY event_type)
    SELECT round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 4) AS t, round(pow(a.v / a.n + b.v / b.n, 2) /
    (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 4) AS df
    FROM g a, g b WHERE a.event_type = 'purchase' AND b.event_type = 'signup'""", "dim")
def _(spark, d):
    s = stream_events(spark, d).select(F.col("event_type").alias("label"), "value")
    x = _published(spark, lambda p, c: jobs.stream_ab_test(s, "purchase", "signup", p, c), "ab-test")
    return x.select(F.round("t", 4).alias("t"), F.round("df", 4).alias("df"))


@query("stream_scans", "SELECT seq, device, rssi, ts, ap FROM ev WHERE event_type NOT IN ('error', 'signup')", "ev")
def _(spark, d):
    lines = fresh_path(spark, "lines")
    wire_lines(spark, d).write.text(lines)
    return _appended(spark, stream_scans(file_lines(spark, lines), "v5"), "scans")


@query("read_scans", "SELECT device, rssi, ts, ap FROM r", "r")
def _(spark, d):
    lines = fresh_path(spark, "lines")
    sinks.write_lines(raw_sightings(spark, d), lines)
    return scans.read_scans(spark, lines, "v4")


@query("scan_lake", """SELECT device, rssi, ts, ap FROM r WHERE ap IN ('AP1', 'AP5')
    AND ts >= 1704816000 AND ts < 1705680000 AND NOT (ts >= 1705248000 AND ts < 1705334400)""", "r")
def _(spark, d):
    lake = fresh_path(spark, "lake")
    scans.land(raw_sightings(spark, d), lake)
    pruned = clean.prune(scans.read_lake(spark, lake), ("2024-01-10", "2024-01-19"), ["AP1", "AP5"], ["2024-01-15"])
    return pruned.select("device", "rssi", "ts", "ap")


@query("stream_lake", "SELECT device, rssi, ts, ap FROM r", "r")
def _(spark, d):
    lake = fresh_path(spark, "lake")
    jobs.stream_land(_stream(spark, d), lake, fresh_path(spark, "checkpoint")).awaitTermination()
    return scans.read_lake(spark, lake).select("device", "rssi", "ts", "ap")


@query("written_series", """SELECT device, ts, rssi, ap, seq,
    CAST(make_timestamp(((ts + 28800) // 86400) * 86400000000) AS DATE)::VARCHAR AS day FROM r""", "r")
def _(spark, d):
    path = fresh_path(spark, "series")
    sinks.write_device_series(raw_sightings(spark, d), path)
    return spark.read.parquet(path).withColumn("day", F.col("day").cast("string"))


@query("series_table_means", "SELECT device, ts, ap, rssi FROM means", "means")
def _(spark, d):
    """From a bucketed table: the readings are not shuffled again."""
    name = f"series_{uuid.uuid4().hex}"
    sinks.write_series_table(sightings(spark, d), name, 16)
    return signal.mean_rssi(clean.filter_rssi(spark.table(name))).select("device", "ts", "ap", "rssi")


@query("stored_static_devices", "SELECT device FROM static_ap", "static_ap")
def _(spark, d):
    path = fresh_path(spark, "static")
    s = raw_sightings(spark, d)
    first = traffic.always_on_devices(s.where(F.col("ts") < 1705334400), hours=3)
    sinks.save_static_devices(first, path, 0)
    today = traffic.always_on_devices(s.where(F.col("ts") >= 1705334400), hours=3)
    sinks.save_static_devices(traffic.merge_static_devices(sinks.load_state(spark, path), today), path, 1)
    return sinks.load_state(spark, path)


@query("appended_results", """SELECT site_id, value, mon_time FROM (
    SELECT site_id, count(DISTINCT device) AS value, CAST(1 AS BIGINT) AS mon_time FROM site GROUP BY site_id UNION ALL
    SELECT site_id, come - go, CAST(2 AS BIGINT) FROM counts)""", "site", "counts")
def _(spark, d):
    path = fresh_path(spark, "results")
    s = sightings(spark, d)
    seen = clean.with_site(s, aps(spark)).groupBy("site_id").agg(F.count_distinct("device").alias("value"))
    append_batch(clean.with_load_time(seen, 1), path, 0)
    report = entry_exit_report(s, aps(spark), window=None)
    net = report.select("site_id", F.col("net").alias("value"))
    for _ in range(2):  # repeated, it counts once
        append_batch(clean.with_load_time(net, 2), path, 1)
    return read_batches(spark, path, RESULT)


@query("stream_always_on", "SELECT DISTINCT device FROM cover WHERE hours >= 3", "cover")
def _(spark, d):
    path, checkpoint = fresh_path(spark, "always-on"), fresh_path(spark, "checkpoint")
    _by_slices(spark, d, lambda e: jobs.stream_always_on(as_sightings(e, 1), path, checkpoint, hours=3))
    return jobs.load_static(spark, path)


@query("stream_describe", """SELECT 'value' AS "column", CAST(count(value) AS DOUBLE) AS count, round(avg(value), 4) AS mean,
    round(stddev_samp(value), 4) AS stddev, min(value) AS min, max(value) AS max FROM events UNION ALL
    SELECT 'user_id', count(user_id), round(avg(user_id), 4), round(stddev_samp(user_id), 4), min(user_id), max(user_id) FROM events""", "dim")
def _(spark, d):
    path, checkpoint = fresh_path(spark, "summary"), fresh_path(spark, "checkpoint")
    _by_slices(spark, d, lambda e: jobs.stream_summary(e, ["value", "user_id"], path, checkpoint))
    x = stats.described(sinks.load_state(spark, path))
    return x.withColumns({"mean": F.round("mean", 4), "stddev": F.round("stddev", 4)})


# --- files written and read back -------------------------------------------------

@query("scan_files", "SELECT device, rssi, ts, ap FROM r WHERE ap IN ('AP1', 'AP4', 'AP5')", "r")
def _(spark, d):
    """One folder by its path, two by a pattern."""
    root = fresh_path(spark, "scans")
    raw_sightings(spark, d).select(wire_line("device", "rssi", "ts").alias("value"), "ap").write.partitionBy("ap").text(root)
    found = scans.read_scans(spark, f"{root}/ap=AP1").unionByName(scans.read_scans(spark, f"{root}/ap=AP[45]/*"))
    return found.select("device", "rssi", "ts", F.regexp_replace("ap", "^ap=", "").alias("ap"))


@query("read_oui", "SELECT DISTINCT upper(substr(md5(CAST(c_custkey AS VARCHAR)), 1, 6)) AS prefix FROM customer")
def _(spark, d):
    path = fresh_path(spark, "oui")
    table(spark, d, "customer").select(wire_line(device_of("c_custkey"), "c_name").alias("value")).write.text(path)
    return dims.read_oui(spark, path)


@query("read_static_devices", "SELECT device FROM static_ap", "static_ap")
def _(spark, d):
    path = fresh_path(spark, "static")
    sinks.save_static_devices(traffic.always_on_devices(raw_sightings(spark, d), hours=3), path, 4)
    return dims.read_static_devices(spark, path)


@query("read_labelled", "SELECT CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END AS label, l_quantity::DOUBLE AS a, l_tax::DOUBLE AS b FROM lineitem")
def _(spark, d):
    path = fresh_path(spark, "labelled")
    table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int"), "l_quantity", "l_tax").write.csv(path)
    return dims.read_vectors(spark, path, ["a", "b"], "label")


@query("read_corpus", "SELECT p_name AS text FROM part")
def _(spark, d):
    path = fresh_path(spark, "corpus")
    table(spark, d, "part").select("p_name").write.text(path)
    return dims.read_documents(spark, path)


@query("loaded_dims", "SELECT seq, device, site_id, side FROM site", "site")
def _(spark, d):
    """Access points from a CSV file; the actions are the built-in ones."""
    path = fresh_path(spark, "dims")
    aps(spark).withColumn("pos_code", F.lit("0001")).write.option("header", True).csv(path)
    return clean.with_site(sightings(spark, d), dims.load_dims(spark, path)["ap_dim"]).select("seq", "device", "site_id", "side")


@query("exported_csv", "SELECT site_id, ts // 300 * 300 AS window_start, count(DISTINCT device) AS traffic FROM rsite GROUP BY ALL", "rsite")
def _(spark, d):
    path = fresh_path(spark, "csv")
    sinks.export_csv(traffic.traffic_per_window(clean.with_site(raw_sightings(spark, d), aps(spark))), path)
    return spark.read.csv(path, header=True, schema="site_id INT, window_start BIGINT, traffic BIGINT")


@query("bracket_rows", "SELECT device, ap, ts FROM r", "r")
def _(spark, d):
    rows = raw_sightings(spark, d).select(F.format_string("[%s,%s,%s]", "device", "ap", "ts").alias("row"))
    f = rows.select(strings.bracket_fields("row").alias("f"))
    return f.select(F.col("f")[0].alias("device"), F.col("f")[1].alias("ap"), F.col("f")[2].cast("bigint").alias("ts"))


@query("daily_counts", """SELECT CAST(day AS VARCHAR) AS day, count(ts) AS n FROM (SELECT unnest(generate_series(DATE '2024-01-01',
    DATE '2024-01-01' + INTERVAL 59 DAY, INTERVAL 1 DAY))::DATE AS day) LEFT JOIN r ON (ts + 28800) // 86400 = date_diff('day', DATE '1970-01-01', day)
    GROUP BY day""", "r")
def _(spark, d):
    """Sixty days in their order, those without readings too."""
    s = raw_sightings(spark, d)
    n = s.groupBy(local_day("ts").alias("day")).agg(F.count("*").alias("n"))
    days = clock.date_range(spark, "2024-01-01", 60).join(n, "day", "left")
    return order.sorted_output(clean.zero_fill(days, ["n"]), ["day"]).select(F.col("day").cast("string").alias("day"), "n")


@query("four_sides", """SELECT seq, device, site_id, side || CASE WHEN n > 1 THEN CAST(n - 1 AS VARCHAR) ELSE '' END AS side
    FROM s JOIN (SELECT *, row_number() OVER (PARTITION BY site_id, side ORDER BY ap) AS n FROM dim) USING (ap)""", "s", "dim")
def _(spark, d):
    return clean.with_four_sides(sightings(spark, d), aps(spark)).select("seq", "device", "site_id", "side")


@query("visit_actions", """SELECT device, session_start, action_code, action_type FROM (SELECT *, unnest(CASE WHEN len(codes) > 0 THEN codes
    ELSE [4] END) AS action_code FROM (SELECT *, list_filter([CASE WHEN come > 0 THEN 0 END, CASE WHEN go > 0 THEN 1 END, CASE WHEN passer_by THEN 2 END,
    CASE WHEN stay > 0 THEN 3 END], lambda c: c IS NOT NULL) AS codes FROM visits)) JOIN (VALUES (0, '进入大楼'), (1, '离开大楼'), (2, '路人'),
    (3, '在楼内走动'), (4, '其他')) a(action_code, action_type) USING (action_code)""", "visits")
def _(spark, d):
    visits = sessions.classify_visits(peak_instants(sightings(spark, d), aps(spark)), 2 * TICK)
    return sessions.visit_actions(visits, dims.action_dim(spark)).select("device", "session_start", "action_code", "action_type")
