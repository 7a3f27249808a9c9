"""Every operator as a query over the given tables, with the SQL that must agree.

`QUERIES[name]` takes (spark, sf_dir); `ORACLE[name]` is the same result in
DuckDB SQL over views of the tables. A query without SQL is checked by tests.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions import clock, strings
from footfall.operators import clean, flow, order, quality, sequence, sessions, sets, signal, stats, terms, traffic, visits
from footfall.plans import jobs
from footfall.plans.tables import TICK, aps, raw_sightings, sightings, table, vendors, wire_lines
from footfall.session import fresh_path
from footfall.sinks.tables import load_state, register_views, save_static_devices
from footfall.sources import scans

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# Named subqueries of the oracle, each with the ones it builds on.
_CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), """SELECT event_id AS seq, event_type,
        upper(substr(md5(CAST(user_id AS VARCHAR)), 1, 12)) AS device,
        'AP' || CAST(CAST(json_extract_string(props, '$.k') AS INT) % 8 AS VARCHAR) AS ap,
        CAST(-30 - (CAST(floor(value) AS INT) % 70) AS DOUBLE) AS rssi,
        CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events"""),
    "r": (("ev",), "SELECT seq, device, ap, rssi, ts FROM ev"),
    "s": (("ev",), "SELECT seq, device, ap, rssi, ts // 21600 * 21600 AS ts FROM ev"),
    "dim": ((), """SELECT * FROM (VALUES
        ('AP0', 1, 'outside'), ('AP1', 1, 'inside'), ('AP2', 2, 'outside'), ('AP3', 2, 'inside'),
        ('AP4', 3, 'outside'), ('AP5', 3, 'inside'), ('AP6', 3, 'outside'), ('AP7', 3, 'inside')
        ) AS t(ap, site_id, side)"""),
    "clean": (("s",), "SELECT * FROM s WHERE rssi > -90"),
    "means": (("clean",), "SELECT device, ts, ap, round(avg(rssi)) AS rssi FROM clean GROUP BY device, ts, ap"),
    "near": (("means",), """SELECT *, lag(rssi) OVER w AS rssi_prev, lead(rssi) OVER w AS rssi_next
        FROM means WINDOW w AS (PARTITION BY device, ap ORDER BY ts)"""),
    "peaks": (("near",), """SELECT device, ts, ap, rssi FROM near WHERE (rssi > rssi_prev AND rssi > rssi_next)
        OR (rssi > rssi_prev AND rssi_next IS NULL) OR (rssi_prev IS NULL AND rssi > rssi_next)"""),
    "ipeaks": (("near",), "SELECT device, ts, ap, rssi FROM near WHERE rssi > rssi_prev AND rssi > rssi_next"),
    "lpeaks": (("peaks", "dim"), "SELECT device, ts, ap, rssi, site_id, side FROM peaks JOIN dim USING (ap)"),
    "traj": (("lpeaks",), """SELECT device, ts, side, site_id, rssi FROM lpeaks QUALIFY
        row_number() OVER (PARTITION BY device, ts ORDER BY rssi DESC, side, site_id) = 1"""),
    "prevs": (("traj",), """SELECT *, lag(ts) OVER w AS ts_prev, lag(side) OVER w AS side_prev,
        lag(rssi) OVER w AS rssi_prev FROM traj WINDOW w AS (PARTITION BY site_id, device ORDER BY ts)"""),
    "moves": (("prevs",), """SELECT device, site_id, ts_prev, side_prev, rssi_prev, ts, side, rssi,
        CASE WHEN side = 'inside' THEN 'come' ELSE 'go' END AS move FROM prevs WHERE side <> side_prev"""),
    "counts": (("moves",), """SELECT site_id, count(*) FILTER (move = 'come') AS come,
        count(*) FILTER (move = 'go') AS go FROM moves GROUP BY site_id"""),
    "wcounts": (("moves",), """SELECT site_id, ts // 86400 * 86400 AS window_start,
        count(*) FILTER (move = 'come') AS come, count(*) FILTER (move = 'go') AS go FROM moves GROUP BY ALL"""),
    "site": (("s", "dim"), "SELECT s.*, site_id, side FROM s JOIN dim USING (ap)"),
    "rsite": (("r", "dim"), "SELECT r.*, site_id, side FROM r JOIN dim USING (ap)"),
    "oui": ((), """SELECT DISTINCT upper(substr(md5(CAST(c_custkey AS VARCHAR)), 1, 6)) AS prefix
        FROM customer WHERE c_acctbal > 3000"""),
    "cover": (("r",), """SELECT device, ap, (ts + 28800) // 86400 AS day,
        count(DISTINCT (ts + 28800) // 3600) AS hours FROM r GROUP BY ALL"""),
    "dcover": (("r",), """SELECT device, (ts + 28800) // 86400 AS day,
        count(DISTINCT (ts + 28800) // 3600) AS hours FROM r GROUP BY ALL"""),
    "static": (("dcover",), "SELECT device FROM dcover GROUP BY device HAVING sum(hours) >= 24"),
    "static_ap": (("cover",), "SELECT DISTINCT device FROM cover WHERE hours >= 3"),
    "inst": (("s",), "SELECT device, ts, count(*) AS readings FROM s GROUP BY device, ts"),
    "gaps": (("inst",), """SELECT *, ts - lag(ts) OVER (PARTITION BY device ORDER BY ts) AS gap FROM inst"""),
    "marked": (("gaps",), """SELECT device, ts, readings, max(CASE WHEN gap IS NULL OR gap > 43200 THEN ts END)
        OVER (PARTITION BY device ORDER BY ts) AS session_start FROM gaps"""),
    "sess": (("marked",), """SELECT device, session_start, max(ts) AS session_end,
        CAST(sum(readings) AS BIGINT) AS readings, max(ts) - session_start AS seconds
        FROM marked GROUP BY device, session_start"""),
    "pinst": (("ipeaks", "dim"), """SELECT device, ts, bool_or(side = 'inside') AS inside
        FROM ipeaks JOIN dim USING (ap) GROUP BY device, ts"""),
    "pgaps": (("pinst",), """SELECT *, ts - lag(ts) OVER w AS gap, count(*) OVER (PARTITION BY device) AS total
        FROM pinst WINDOW w AS (PARTITION BY device ORDER BY ts)"""),
    "pmark": (("pgaps",), """SELECT device, ts, inside, max(CASE WHEN gap IS NULL OR gap > 43200 THEN ts END)
        OVER (PARTITION BY device ORDER BY ts) AS session_start FROM pgaps WHERE total > 1"""),
    "pflags": (("pmark",), """SELECT device, session_start, max(ts) AS session_end, count(*) AS n,
        string_agg(CASE WHEN inside THEN 'i' ELSE 'o' END, '' ORDER BY ts) AS flags
        FROM pmark GROUP BY device, session_start"""),
    # Changes are counted on the string of flags: along all but the last one.
    "pchg": (("pflags",), """SELECT *, flags[1] AS f1, flags[-1] AS fn,
        len(list_filter(range(2, n), lambda i: flags[i] <> flags[i - 1])) AS c,
        contains(flags, 'i') AND contains(flags, 'o') AS mixed FROM pflags"""),
    "visits": (("pchg",), """SELECT device, session_start, session_end, n,
        CAST(CASE WHEN n > 1 AND f1 = 'o' AND fn = 'i' AND (n = 2 OR c <= 1) THEN 1 ELSE 0 END AS BIGINT) AS come,
        CAST(CASE WHEN n > 1 AND f1 = 'i' AND fn = 'o' AND (n = 2 OR c <= 1) THEN 1 ELSE 0 END AS BIGINT) AS go,
        CAST(CASE WHEN n > 2 AND f1 <> fn AND c > 1 THEN 1 ELSE 0 END
           + CASE WHEN n > 1 AND f1 = 'i' AND fn = 'i' THEN 1 ELSE 0 END
           + CASE WHEN n > 2 AND f1 = fn AND mixed THEN 1 ELSE 0 END AS BIGINT) AS stay,
        n = 1 OR (f1 = 'o' AND fn = 'o') AS passer_by FROM pchg"""),
    # Ticks every six hours from the first of January; a device is present at a
    # tick if it was seen in the twelve hours up to it.
    "tick": (("r",), "SELECT (max(ts) - 1704067200) // 21600 AS k FROM r"),
    "present": (("rsite", "tick"), """SELECT device, site_id, t AS tick, min(ts) AS first_ts FROM (
        SELECT device, site_id, ts, unnest(range(
            CAST(ceil((ts - 1704067200) / 21600) AS BIGINT),
            CAST(ceil((ts - 1704067200 + 43200) / 21600) AS BIGINT))) AS t FROM rsite)
        WHERE t <= (SELECT k FROM tick) GROUP BY device, site_id, t"""),
    "first_visit": (("present", "tick"), """SELECT f.device, f.site_id, f.start_ts,
        (SELECT max(g) * 21600 + 1704067200 FROM unnest(range(f.t0, (SELECT k FROM tick) + 1)) AS u(g)
         WHERE NOT list_contains(f.ticks, g)) AS end_ts
        FROM (SELECT device, site_id, min(tick) AS t0, list(tick) AS ticks, arg_min(first_ts, tick) AS start_ts
              FROM present GROUP BY device, site_id) f"""),
    "reopened": (("present", "tick"), """SELECT device, site_id, arg_min(first_ts, tick) AS start_ts,
        CASE WHEN max(tick) < (SELECT k FROM tick) THEN (max(tick) + 1) * 21600 + 1704067200 END AS end_ts
        FROM (SELECT *, tick - row_number() OVER (PARTITION BY device, site_id ORDER BY tick) AS island FROM present)
        GROUP BY device, site_id, island"""),
    "detect": (("rsite",), """SELECT device, site_id, min(ts) AS ts FROM rsite
        WHERE ts > 1705320000 - 86400 AND ts <= 1705320000 GROUP BY device, site_id"""),
    "later": (("rsite",), """SELECT device, site_id, min(ts) AS ts FROM rsite
        WHERE ts > 1705406400 - 86400 AND ts <= 1705406400 GROUP BY device, site_id"""),
    "li": ((), """SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag = 'R' AS label,
        l_orderkey, l_linenumber FROM lineitem"""),
    "lstat": ((), """SELECT avg(l_quantity) m1, var_samp(l_quantity) v1, avg(l_extendedprice) m2,
        var_samp(l_extendedprice) v2, avg(l_discount) m3, var_samp(l_discount) v3,
        avg(l_tax) m4, var_samp(l_tax) v4 FROM lineitem"""),
    "scored": (("li", "lstat"), """SELECT li.*, floor((
        -pow(l_quantity - m1, 2) / (2 * v1) - ln(2 * pi() * v1) / 2
        - pow(l_extendedprice - m2, 2) / (2 * v2) - ln(2 * pi() * v2) / 2
        - pow(l_discount - m3, 2) / (2 * v3) - ln(2 * pi() * v3) / 2
        - pow(l_tax - m4, 2) / (2 * v4) - ln(2 * pi() * v4) / 2) * 10000) / 10000 AS score FROM li, lstat"""),
    "rng": (("scored",), "SELECT min(score) AS lo, max(score) AS hi, (max(score) - min(score)) / 1000 AS step FROM scored"),
    "tok": ((), r"""SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents"""),
    "terms": (("tok",), """SELECT doc_id, term, count(*) AS n FROM tok
        WHERE term <> '' AND term NOT IN ('is', 'a', '北方') AND NOT regexp_full_match(term, '.*了')
        GROUP BY doc_id, term"""),
}


def _sql(select: str, *needs: str) -> str:
    """Prefix a SELECT with the named subqueries it needs, in dependency order."""
    order: list[str] = []

    def add(name):
        for n in _CTE[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({_CTE[n][1]})" for n in order) + " " + select if order else select


def query(name: str, select: str | None = None, *needs: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if select is not None:
            ORACLE[name] = _sql(select, *needs)
        return fn
    return register


def _device(user_id: int) -> str:
    return hashlib.md5(str(user_id).encode()).hexdigest()[:12].upper()


# --- readings, filters, look-ups ------------------------------------------------

@query("site_sightings", "SELECT seq, device, ap, rssi, ts, site_id, side FROM site", "site")
def _(spark, d):
    return clean.with_site(sightings(spark, d), aps(spark)).select(
        "seq", "device", "ap", "rssi", "ts", "site_id", "side")


@query("filter_rssi", "SELECT * FROM clean", "clean")
def _(spark, d):
    return clean.filter_rssi(sightings(spark, d))


@query("filter_recent", "SELECT * FROM r WHERE ts > 1705320000 - 86400 AND ts <= 1705320000", "r")
def _(spark, d):
    return clean.filter_recent(raw_sightings(spark, d), 1705320000, 86400)


@query("filter_day", "SELECT * FROM r WHERE ts >= 1705248000 AND ts < 1705334400", "r")
def _(spark, d):
    return clean.filter_day(raw_sightings(spark, d), "2024-01-15")


@query("filter_day_of_month", "SELECT * FROM r WHERE dayofmonth(make_timestamp((ts + 28800) * 1000000)) = 15", "r")
def _(spark, d):
    return clean.filter_day_of_month(raw_sightings(spark, d), 15)


@query("device_history", f"SELECT * FROM r WHERE device = '{_device(8)}'", "r")
def _(spark, d):
    return clean.device_history(raw_sightings(spark, d), _device(8))


@query("filter_aps", "SELECT * FROM r WHERE ap IN ('AP2', 'AP3')", "r")
def _(spark, d):
    return clean.filter_aps(raw_sightings(spark, d), ["AP2", "AP3"])


@query("known_vendors", "SELECT r.* FROM r WHERE substr(device, 1, 6) IN (SELECT prefix FROM oui)", "r", "oui")
def _(spark, d):
    return clean.keep_known_vendors(raw_sightings(spark, d), vendors(spark, d))


@query("local_hours", """SELECT ap, hour(make_timestamp((ts + 28800) * 1000000)) AS hour,
    (ts + 28800) % 86400 // 300 AS bucket, count(*) AS n FROM r GROUP BY ALL""", "r")
def _(spark, d):
    s = clean.with_hour(raw_sightings(spark, d)).withColumn("bucket", clock.bucket_of_day())
    return s.groupBy("ap", F.col("hour").cast("bigint").alias("hour"), "bucket").agg(F.count("*").alias("n"))


@query("local_times", """SELECT seq, strftime(make_timestamp((ts + 28800) * 1000000), '%Y-%m-%d %H:%M:%S') AS local_time
    FROM r""", "r")
def _(spark, d):
    return clean.with_local_time(raw_sightings(spark, d)).select("seq", "local_time")


@query("row_numbers", """SELECT seq, device, row_number() OVER (PARTITION BY device ORDER BY seq) AS number FROM r""", "r")
def _(spark, d):
    s = raw_sightings(spark, d).select("seq", "device")
    return sequence.number_rows(s, ["device"], order="seq", segment=1 << 20)


@query("parse_lines", """SELECT seq, device, rssi, ts, ap FROM ev WHERE event_type NOT IN ('error', 'signup')""", "ev")
def _(spark, d):
    return scans.parse_lines(wire_lines(spark, d), "v5")


@query("malformed_lines", """SELECT CASE event_type WHEN 'error' THEN 'fields' ELSE 'values' END AS reason,
    concat_ws('|', seq, device, CASE event_type WHEN 'signup' THEN 'n/a' END, ts, ap) AS line
    FROM ev WHERE event_type IN ('error', 'signup')""", "ev")
def _(spark, d):
    return scans.malformed_lines(wire_lines(spark, d), "v5")


@query("exploded_batches", "SELECT DISTINCT device, ts, ap, rssi FROM s", "s")
def _(spark, d):
    # One array per (device, ts, ap); a set of whole-dB values, so it is bounded.
    s = sightings(spark, d).groupBy("device", "ts", "ap").agg(
        F.collect_set(F.struct("device", "ts", "ap", "rssi")).alias("batch"))
    return clean.explode_batch(s, "batch")


@query("sql_over_views", """SELECT site_id, count(DISTINCT device) AS devices, max(rssi) AS strongest
    FROM site WHERE rssi > -90 GROUP BY site_id""", "site")
def _(spark, d):
    register_views({"scan_rows": clean.filter_rssi(sightings(spark, d)), "ap_dim": aps(spark)})
    return spark.sql("""SELECT site_id, count(DISTINCT device) AS devices, max(rssi) AS strongest
        FROM scan_rows JOIN ap_dim USING (ap) GROUP BY site_id""")


@query("first_sightings", "SELECT device, arg_min(ap, seq) AS ap, arg_min(ts, seq) AS ts, min(seq) AS seq FROM r GROUP BY device", "r")
def _(spark, d):
    return order.first_by(raw_sightings(spark, d), ["device"], "seq", ["ap", "ts"])


@query("last_sightings", "SELECT device, arg_max(ap, seq) AS ap, arg_max(ts, seq) AS ts, max(seq) AS seq FROM r GROUP BY device", "r")
def _(spark, d):
    return order.last_by(raw_sightings(spark, d), ["device"], "seq", ["ap", "ts"])


@query("strongest_readings", "SELECT rssi, seq, device FROM r ORDER BY rssi DESC, seq LIMIT 2000", "r")
def _(spark, d):
    s = raw_sightings(spark, d).select("rssi", "seq", "device")
    return order.top_rows(s, [F.col("rssi").desc(), "seq"], 2000)


@query("dedupe", "SELECT DISTINCT device, ap, (ts + 28800) // 3600 AS hour_no FROM r", "r")
def _(spark, d):
    s = raw_sightings(spark, d).withColumn("hour_no", clock.bucket_index("ts", -28800, 3600))
    return clean.dedupe(s, ["device", "ap", "hour_no"])


@query("pseudonyms", """SELECT substr(device, 1, 6) || upper(substr(sha256('salt' || device), 1, 32)) AS device,
    count(*) AS n FROM r GROUP BY 1""", "r")
def _(spark, d):
    s = raw_sightings(spark, d).groupBy("device").agg(F.count("*").alias("n"))
    return s.select(strings.pseudonym("device", "salt").alias("device"), "n")


# --- signal and trajectories ----------------------------------------------------

@query("mean_rssi", "SELECT * FROM means", "means")
def _(spark, d):
    return signal.mean_rssi(clean.filter_rssi(sightings(spark, d)))


@query("mean_rssi_all_aps", "SELECT device, ts, round(avg(rssi), 6) AS rssi FROM s GROUP BY device, ts", "s")
def _(spark, d):
    return (signal.mean_rssi(sightings(spark, d), ("device", "ts"), rounded=False)
            .withColumn("rssi", F.round("rssi", 6)))


@query("run_mean", """SELECT device, ts, ap, min(seq) AS run_seq, count(*) AS n, round_even(avg(rssi), 0) AS rssi FROM (
    SELECT *, sum(CASE WHEN ap = p THEN 0 ELSE 1 END) OVER (PARTITION BY device, ts ORDER BY seq) AS run FROM (
    SELECT *, lag(ap) OVER (PARTITION BY device, ts ORDER BY seq) AS p FROM s)) GROUP BY device, ts, ap, run""", "s")
def _(spark, d):
    return signal.run_mean(sightings(spark, d))


@query("run_mean_by_ap", """SELECT ap, device, ts, min(seq) AS run_seq, round_even(avg(rssi) FILTER (rssi > -90), 0) AS rssi,
    count(*) FILTER (rssi > -90) AS n FROM (
    SELECT *, sum(CASE WHEN device = pd AND ts = pt THEN 0 ELSE 1 END) OVER (PARTITION BY ap ORDER BY seq) AS run FROM (
    SELECT *, lag(device) OVER w AS pd, lag(ts) OVER w AS pt FROM s WINDOW w AS (PARTITION BY ap ORDER BY seq)))
    GROUP BY ap, device, ts, run HAVING count(*) FILTER (rssi > -90) > 0""", "s")
def _(spark, d):
    return signal.run_mean(sightings(spark, d), within=("ap",), changes=("device", "ts"), floor=-90)


@query("prev_next_rssi", "SELECT * FROM near", "near")
def _(spark, d):
    return signal.with_prev_next_rssi(signal.mean_rssi(clean.filter_rssi(sightings(spark, d))))


@query("rssi_peaks", "SELECT * FROM peaks", "peaks")
def _(spark, d):
    return signal.rssi_peaks(signal.mean_rssi(clean.filter_rssi(sightings(spark, d))))


@query("interior_peaks", "SELECT * FROM ipeaks", "ipeaks")
def _(spark, d):
    return signal.rssi_peaks(signal.mean_rssi(clean.filter_rssi(sightings(spark, d))), endpoints=False)


def _site_peaks(spark, d):
    return clean.with_site(signal.rssi_peaks(signal.mean_rssi(clean.filter_rssi(sightings(spark, d)))), aps(spark))


@query("prev_side", """SELECT device, ts, rssi, side, site_id, lag(side) OVER (
    PARTITION BY device, ts, rssi ORDER BY side, site_id, ap) AS side_prev FROM lpeaks""", "lpeaks")
def _(spark, d):
    x = signal.with_prev_side(_site_peaks(spark, d))
    return x.select("device", "ts", "rssi", "side", "site_id", "side_prev")


@query("next_rssi", """SELECT device, ts, rssi, ap, lead(rssi) OVER (PARTITION BY device, ts
    ORDER BY rssi, side DESC, site_id DESC, ap DESC) AS rssi_next FROM lpeaks""", "lpeaks")
def _(spark, d):
    return signal.with_next_rssi(_site_peaks(spark, d)).select("device", "ts", "rssi", "ap", "rssi_next")


@query("one_ap_per_reading", """SELECT device, ts, rssi, ap, side, site_id FROM lpeaks QUALIFY row_number() OVER (
    PARTITION BY device, ts, rssi ORDER BY side, site_id, ap) = 1""", "lpeaks")
def _(spark, d):
    return signal.one_ap_per_reading(_site_peaks(spark, d)).select("device", "ts", "rssi", "ap", "side", "site_id")


@query("strongest_ap", """SELECT device, ts, ap, rssi FROM means
    QUALIFY rssi = max(rssi) OVER (PARTITION BY device, ts)""", "means")
def _(spark, d):
    return signal.strongest_ap(signal.mean_rssi(clean.filter_rssi(sightings(spark, d))))


@query("inside_wins", "SELECT * FROM pinst", "pinst")
def _(spark, d):
    return jobs.peak_instants(sightings(spark, d), aps(spark))


@query("trajectory", "SELECT * FROM traj", "traj")
def _(spark, d):
    return signal.trajectory(sightings(spark, d), aps(spark))


@query("trajectory_all_means", """SELECT device, ts, side, site_id, rssi FROM means JOIN dim USING (ap) QUALIFY
    row_number() OVER (PARTITION BY device, ts ORDER BY rssi DESC, side, site_id) = 1""", "means", "dim")
def _(spark, d):
    return signal.trajectory(sightings(spark, d), aps(spark), with_peaks=False)


@query("trajectory_by_side", """, top AS (SELECT device, ts, side, site_id, rssi FROM means JOIN dim USING (ap) QUALIFY
    row_number() OVER (PARTITION BY device, side, ts ORDER BY rssi DESC, site_id, ap) = 1),
    n AS (SELECT *, lag(rssi) OVER w AS p, lead(rssi) OVER w AS f FROM top WINDOW w AS (PARTITION BY device, side ORDER BY ts))
    SELECT device, ts, side, site_id, rssi FROM n WHERE (p IS NOT NULL OR f IS NOT NULL)
    AND rssi > coalesce(p, -1000) AND rssi > coalesce(f, -1000)
    QUALIFY row_number() OVER (PARTITION BY device, ts ORDER BY rssi DESC, side, site_id) = 1""", "means", "dim")
def _(spark, d):
    return signal.trajectory(sightings(spark, d), aps(spark), peak_key="side")


def _stored_static(spark, d):
    """Always-on list as a stored table, the way jobs load it.

    The planner then knows its size before it touches the sightings: a short
    list is broadcast, a long one sort-merged.
    """
    path = fresh_path(spark, "static")
    save_static_devices(traffic.always_on_devices(raw_sightings(spark, d), hours=3), path, 0)
    return load_state(spark, path)


@query("trajectory_without_static", """, c2 AS (SELECT * FROM clean WHERE device NOT IN (SELECT device FROM static_ap)),
    m2 AS (SELECT device, ts, ap, round(avg(rssi)) AS rssi FROM c2 GROUP BY device, ts, ap),
    n2 AS (SELECT *, lag(rssi) OVER w AS p, lead(rssi) OVER w AS f FROM m2 WINDOW w AS (PARTITION BY device, ap ORDER BY ts))
    SELECT device, ts, side, site_id, rssi FROM n2 JOIN dim USING (ap) WHERE (p IS NOT NULL OR f IS NOT NULL)
    AND rssi > coalesce(p, -1000) AND rssi > coalesce(f, -1000)
    QUALIFY row_number() OVER (PARTITION BY device, ts ORDER BY rssi DESC, side, site_id) = 1""",
       "clean", "static_ap", "dim")
def _(spark, d):
    return signal.trajectory(sightings(spark, d), aps(spark), _stored_static(spark, d))


# --- entries, exits, occupancy --------------------------------------------------

def _traj(spark, d):
    return signal.trajectory(sightings(spark, d), aps(spark))


def _moves(spark, d):
    return flow.side_moves(_traj(spark, d))


@query("prev_point", "SELECT * FROM prevs", "prevs")
def _(spark, d):
    return flow.with_prev(_traj(spark, d))


@query("side_moves", "SELECT * FROM moves", "moves")
def _(spark, d):
    return _moves(spark, d)


@query("come_go", "SELECT * FROM counts", "counts")
def _(spark, d):
    return flow.come_go_counts(_moves(spark, d))


@query("net_flow", "SELECT *, come - go AS net FROM counts", "counts")
def _(spark, d):
    return flow.net_flow(flow.come_go_counts(_moves(spark, d)))


@query("come_go_window", "SELECT *, come - go AS net FROM wcounts", "wcounts")
def _(spark, d):
    return jobs.entry_exit_report(sightings(spark, d), aps(spark), window="1 day")


@query("join_come_go", "SELECT site_id, window_start, come, go FROM wcounts", "wcounts")
def _(spark, d):
    m = _moves(spark, d).withColumn("window_start", flow.window_start("ts", "1 day"))
    keys = ["site_id", "window_start"]
    come = m.where(F.col("move") == "come").groupBy(*keys).agg(F.count("*").alias("come"))
    go = m.where(F.col("move") == "go").groupBy(*keys).agg(F.count("*").alias("go"))
    return flow.join_come_go(come, go, keys)


@query("occupancy", """SELECT *, come - go AS net, CAST(sum(come - go) OVER (
    PARTITION BY site_id ORDER BY window_start) AS BIGINT) AS occupancy FROM wcounts""", "wcounts")
def _(spark, d):
    return jobs.occupancy_report(sightings(spark, d), aps(spark), window="1 day")


def _published(spark, d):
    """Daily visitors per site and day as a result history."""
    t = traffic.traffic_per_day(clean.with_site(raw_sightings(spark, d), aps(spark)))
    return t.select("site_id", F.col("traffic").alias("value"), F.col("window_start").alias("mon_time"))


_HISTORY = """, hist AS (SELECT site_id, count(DISTINCT device) AS value,
    (ts + 28800) // 86400 * 86400 - 28800 AS mon_time FROM rsite GROUP BY ALL)"""


@query("latest_per_site", _HISTORY + """ SELECT * FROM hist
    QUALIFY mon_time = max(mon_time) OVER (PARTITION BY site_id)""", "rsite")
def _(spark, d):
    return flow.latest_per_site(_published(spark, d))


@query("latest_per_site_one", _HISTORY + """ SELECT * FROM hist
    QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY mon_time DESC, value DESC) = 1""", "rsite")
def _(spark, d):
    return flow.latest_per_site(_published(spark, d), ties="one", newer_than=1704067200)


@query("add_base", _HISTORY + """, base AS (SELECT site_id, value AS base FROM hist
    QUALIFY mon_time = max(mon_time) OVER (PARTITION BY site_id))
    SELECT site_id, coalesce(base, 0) + coalesce(come - go, 0) AS value
    FROM base FULL JOIN counts USING (site_id)""", "rsite", "counts")
def _(spark, d):
    base = flow.latest_per_site(_published(spark, d)).withColumnRenamed("value", "base")
    return flow.add_base(base, flow.net_flow(flow.come_go_counts(_moves(spark, d))))


@query("adjacent_pairs", """SELECT device, site_id, ts_prev, side_prev, ts, side FROM prevs
    WHERE ts - ts_prev <= 43200 AND side <> side_prev""", "prevs")
def _(spark, d):
    return flow.adjacent_pairs(_traj(spark, d), 43200)


# --- visitors -------------------------------------------------------------------

def _located(spark, d):
    return clean.with_site(raw_sightings(spark, d), aps(spark))


@query("traffic_5min", """SELECT site_id, ts // 300 * 300 AS window_start, count(DISTINCT device) AS traffic
    FROM rsite GROUP BY ALL""", "rsite")
def _(spark, d):
    return traffic.traffic_per_window(_located(spark, d))


@query("traffic_day", """SELECT site_id, (ts + 28800) // 86400 * 86400 - 28800 AS window_start,
    count(DISTINCT device) AS traffic FROM rsite GROUP BY ALL""", "rsite")
def _(spark, d):
    return traffic.traffic_per_day(_located(spark, d))


@query("latest_traffic", """SELECT site_id, traffic, window_start FROM (
    SELECT site_id, ts // 300 * 300 AS window_start, count(DISTINCT device) AS traffic FROM rsite GROUP BY ALL)
    QUALIFY window_start = max(window_start) OVER (PARTITION BY site_id)""", "rsite")
def _(spark, d):
    return traffic.latest_window(traffic.traffic_per_window(_located(spark, d)))


@query("realtime_traffic_job", """SELECT site_id, value, CAST(1706659200 AS BIGINT) AS mon_time FROM (
    SELECT site_id, ts // 300 * 300 AS w, count(DISTINCT device) AS value FROM rsite WHERE rssi > -90 GROUP BY ALL)
    QUALIFY w = max(w) OVER (PARTITION BY site_id)""", "rsite")
def _(spark, d):
    return jobs.realtime_traffic(raw_sightings(spark, d), aps(spark), mon_time=1706659200)


@query("traffic_today_job", """SELECT site_id, count(DISTINCT device) AS value, CAST(1705334400 AS BIGINT) AS mon_time
    FROM rsite WHERE rssi > -90 AND ts >= 1705248000 AND ts < 1705334400 GROUP BY site_id""", "rsite")
def _(spark, d):
    return jobs.traffic_today(raw_sightings(spark, d), aps(spark), "2024-01-15", mon_time=1705334400)


@query("people_on_site_job", """, p AS (SELECT device, site_id, CAST(ceil((ts - 1704067200) / 21600) AS BIGINT) AS k
    FROM rsite WHERE rssi > -90), l AS (SELECT CAST(floor((max(ts) - 1704067200) / 21600) AS BIGINT) AS k FROM r)
    SELECT site_id, count(*) AS value, CAST(1706659200 AS BIGINT) AS mon_time FROM (
    SELECT DISTINCT device, site_id FROM p WHERE k = (SELECT k FROM l)) GROUP BY site_id""", "rsite")
def _(spark, d):
    # With policy "reopen" the open visits are the devices present at the last tick.
    s = raw_sightings(spark, d)
    ticks = F.floor((s.agg(F.max("ts")).scalar() - 1704067200) / TICK)
    return jobs.people_on_site(s, aps(spark), 1704067200, TICK, ticks, TICK, "reopen", mon_time=1706659200)


@query("static_update_job", "SELECT device FROM static_ap UNION SELECT device FROM r WHERE ap = 'AP7' AND rssi > -31",
       "static_ap", "r")
def _(spark, d):
    s = raw_sightings(spark, d)
    stored = s.where((F.col("ap") == "AP7") & (F.col("rssi") > -31)).select("device").distinct()
    return jobs.static_device_update(s, stored, hours=3)


@query("vendor_profile_job", """SELECT device, ap,
    round(CASE WHEN var_pop(rssi) > 0.001 THEN kurtosis_pop(rssi) END, 4) AS kurtosis FROM (
    SELECT device, ts, ap, avg(rssi) AS rssi FROM r WHERE substr(device, 1, 6) IN (SELECT prefix FROM oui) GROUP BY ALL)
    GROUP BY device, ap""", "r", "oui")
def _(spark, d):
    found = jobs.vendor_profile(raw_sightings(spark, d), vendors(spark, d))
    return found.withColumn("kurtosis", F.round("kurtosis", 4))


@query("always_on", "SELECT device FROM static", "static")
def _(spark, d):
    return traffic.always_on_devices(raw_sightings(spark, d), per_ap=False, per_day=False)


@query("always_on_total", "SELECT device FROM dcover GROUP BY device HAVING sum(hours) >= 65", "dcover")
def _(spark, d):
    return traffic.always_on_devices(raw_sightings(spark, d), hours=65, per_ap=False, per_day=False)


@query("always_on_in_a_day", "SELECT DISTINCT device FROM dcover WHERE hours >= 6", "dcover")
def _(spark, d):
    return traffic.always_on_devices(raw_sightings(spark, d), hours=6, per_ap=False, per_day=True)


@query("always_on_per_ap", "SELECT device FROM static_ap", "static_ap")
def _(spark, d):
    return traffic.always_on_devices(raw_sightings(spark, d), hours=3)


@query("drop_static", "SELECT * FROM r WHERE device NOT IN (SELECT device FROM static_ap)", "r", "static_ap")
def _(spark, d):
    return clean.drop_static_devices(raw_sightings(spark, d), _stored_static(spark, d))


def _static_lists(spark, d):
    """Stored list: found in the first half of the month; today's: in the second."""
    s = raw_sightings(spark, d)
    early = traffic.always_on_devices(s.where(F.col("ts") < 1705334400), hours=3)
    return early, traffic.always_on_devices(s.where(F.col("ts") >= 1705334400), hours=3)


@query("merge_static", "SELECT device FROM static_ap", "static_ap")
def _(spark, d):
    return traffic.merge_static_devices(*_static_lists(spark, d))


@query("newly_static", """SELECT DISTINCT device FROM cover WHERE hours >= 3 AND day >= 19738 AND device NOT IN (
    SELECT device FROM cover WHERE hours >= 3 AND day < 19738)""", "cover")
def _(spark, d):
    return traffic.newly_static_devices(*_static_lists(spark, d))


@query("multi_ap", """SELECT device, ts, count(DISTINCT ap) AS aps FROM s GROUP BY device, ts
    HAVING count(DISTINCT ap) >= 3""", "s")
def _(spark, d):
    return traffic.multi_ap_presence(sightings(spark, d))


@query("multi_ap_codes", """SELECT device, ts, string_agg(DISTINCT code, ',' ORDER BY code) AS codes,
    count(DISTINCT code) > 1 AS ambiguous FROM (SELECT device, ts, CAST(CAST(ap[3] AS INT) - 4 AS VARCHAR) AS code
    FROM ipeaks WHERE ap IN ('AP4', 'AP5', 'AP6', 'AP7')) GROUP BY device, ts""", "ipeaks")
def _(spark, d):
    s = clean.filter_aps(sightings(spark, d), ["AP4", "AP5", "AP6", "AP7"])
    peaks = signal.rssi_peaks(signal.mean_rssi(clean.filter_rssi(s)), endpoints=False)
    code = (F.substring("ap", 3, 1).cast("int") - 4).cast("string")
    return traffic.multi_ap_codes(peaks.withColumn("code", code))


@query("distinct_devices", "SELECT DISTINCT device FROM r", "r")
def _(spark, d):
    return traffic.distinct_devices(raw_sightings(spark, d))


@query("seen_on_one_side", """SELECT device, CAST(make_timestamp(((ts + 28800) // 86400) * 86400000000) AS DATE)::VARCHAR AS day,
    count(*) FILTER (ap = 'AP0') AS at_a, count(*) FILTER (ap = 'AP1') AS at_b FROM r WHERE ap IN ('AP0', 'AP1')
    GROUP BY ALL HAVING at_a = 0 OR at_b = 0""", "r")
def _(spark, d):
    return (sets.seen_on_one_side(raw_sightings(spark, d), "AP0", "AP1")
            .withColumn("day", F.col("day").cast("string")))


@query("days_on_both", """SELECT CAST(make_timestamp(day * 86400000000) AS DATE)::VARCHAR AS day FROM (
    SELECT (ts + 28800) // 86400 AS day FROM r WHERE ap = 'AP4' INTERSECT
    SELECT (ts + 28800) // 86400 AS day FROM r WHERE ap = 'AP5')""", "r")
def _(spark, d):
    return (sets.days_on_both(raw_sightings(spark, d), "AP4", "AP5")
            .select(F.col("day").cast("string").alias("day")))


@query("merge_ap_series", """SELECT r.* FROM r WHERE ap IN ('AP6', 'AP7') AND rssi > -90
    AND substr(device, 1, 6) IN (SELECT prefix FROM oui)""", "r", "oui")
def _(spark, d):
    s = raw_sightings(spark, d)
    return sets.merge_ap_series(clean.filter_aps(s, ["AP6"]), clean.filter_aps(s, ["AP7"]), oui=vendors(spark, d))


@query("device_series", """SELECT device, ts, rssi, ap, seq,
    CAST(make_timestamp(((ts + 28800) // 86400) * 86400000000) AS DATE)::VARCHAR AS day FROM r""", "r")
def _(spark, d):
    return sets.device_series(raw_sightings(spark, d)).withColumn("day", F.col("day").cast("string"))


# --- sessions and visits --------------------------------------------------------

@query("sessions", "SELECT * FROM sess", "sess")
def _(spark, d):
    return sessions.sessions(sightings(spark, d), 2 * TICK)


@query("time_slices", """SELECT seq, s.device, s.ts, ap, rssi, session_start FROM s
    JOIN marked ON s.device = marked.device AND s.ts = marked.ts""", "s", "marked")
def _(spark, d):
    return sessions.time_slices(sightings(spark, d), 2 * TICK)


@query("short_sessions", """SELECT device, session_start, session_end, readings, seconds FROM (
    SELECT *, max(session_start) OVER (PARTITION BY device) AS last_start FROM sess)
    WHERE seconds < 6 AND session_start < last_start""", "sess")
def _(spark, d):
    return sessions.short_sessions(sessions.sessions(sightings(spark, d), 2 * TICK), keep_last=False)


@query("visit_classes", "SELECT * FROM visits", "visits")
def _(spark, d):
    return sessions.classify_visits(jobs.peak_instants(sightings(spark, d), aps(spark)), 2 * TICK)


@query("flow_by_bucket", """SELECT bucket, CAST(coalesce(sum(come - go + stay), 0) AS BIGINT) AS flow
    FROM range(288) AS b(bucket) LEFT JOIN visits ON (session_start + 28800) % 86400 // 300 = bucket
    GROUP BY bucket""", "visits")
def _(spark, d):
    return jobs.visit_flow(sightings(spark, d), aps(spark), 2 * TICK)


@query("dwell_time", """SELECT device, CAST(make_timestamp(day * 86400000000) AS DATE)::VARCHAR AS day, seconds,
    seconds // 3600 AS hours, seconds >= 3600 AS long_stay FROM (
    SELECT device, (ts + 28800) // 86400 AS day, max(ts) - min(ts) AS seconds FROM r GROUP BY ALL) WHERE seconds > 0""", "r")
def _(spark, d):
    return sessions.dwell_time(raw_sightings(spark, d)).withColumn("day", F.col("day").cast("string"))


@query("interval_buckets", """SELECT device, bucket, count(*) AS gaps FROM (SELECT device, CASE WHEN gap = 0 THEN '0s'
    WHEN gap < 60 THEN '<1 min' ELSE CAST(gap // 60 AS VARCHAR) || ' min' END AS bucket FROM (
    SELECT device, ts - lag(ts) OVER (PARTITION BY device ORDER BY ts, seq) AS gap FROM s) WHERE gap IS NOT NULL)
    GROUP BY ALL""", "s")
def _(spark, d):
    return sessions.interval_buckets(sightings(spark, d))


@query("peak_intervals", "SELECT device, ts, gap AS seconds FROM pgaps WHERE gap IS NOT NULL", "pgaps")
def _(spark, d):
    return sessions.peak_intervals(jobs.peak_instants(sightings(spark, d), aps(spark)))


@query("duplicate_readings", """SELECT *, count(*) OVER (PARTITION BY device, ts, rssi) AS copies FROM s
    QUALIFY copies > 1""", "s")
def _(spark, d):
    return sessions.duplicate_readings(sightings(spark, d))


@query("detect_table", "SELECT * FROM detect", "detect")
def _(spark, d):
    return visits.detect_table(_located(spark, d), 1705320000, 86400)


def _tracked(spark, d, policy):
    s = _located(spark, d)
    last = s.agg(F.max("ts")).scalar()
    return visits.visit_tracker(s, 1704067200, TICK, F.floor((last - 1704067200) / TICK), 2 * TICK, policy)


@query("visit_tracker_first", "SELECT * FROM first_visit", "first_visit")
def _(spark, d):
    return _tracked(spark, d, "first_visit")


@query("visit_tracker_reopen", "SELECT * FROM reopened", "reopened")
def _(spark, d):
    return _tracked(spark, d, "reopen")


@query("open_visits", "SELECT site_id, count(*) AS open FROM reopened WHERE end_ts IS NULL GROUP BY site_id", "reopened")
def _(spark, d):
    return visits.open_visits(_tracked(spark, d, "reopen"))


def _visit_state(spark, d):
    """Visits after a first tick, and the detect table of a tick one day later."""
    s = _located(spark, d)
    first = visits.detect_table(s, 1705320000, 86400)
    known = first.select("device", "site_id", F.col("ts").alias("start_ts"),
                         F.lit(None).cast("bigint").alias("end_ts"))
    return known, visits.detect_table(s, 1705406400, 86400)


@query("new_devices", "SELECT * FROM later ANTI JOIN detect USING (device, site_id)", "detect", "later")
def _(spark, d):
    known, detect = _visit_state(spark, d)
    return visits.new_devices(detect, known)


@query("gone_devices", """SELECT device, site_id, ts AS start_ts, CAST(NULL AS BIGINT) AS end_ts
    FROM detect ANTI JOIN later USING (device, site_id)""", "detect", "later")
def _(spark, d):
    known, detect = _visit_state(spark, d)
    return visits.gone_devices(known, detect)


@query("update_visits", """SELECT device, site_id, coalesce(a.ts, b.ts) AS start_ts,
    CASE WHEN b.ts IS NULL THEN CAST(1705406400 AS BIGINT) END AS end_ts FROM detect a FULL JOIN later b USING (device, site_id)""",
       "detect", "later")
def _(spark, d):
    known, detect = _visit_state(spark, d)
    return visits.update_visits(known, detect, 1705406400)


@query("append_visits", """SELECT device, site_id, ts AS start_ts, CAST(NULL AS BIGINT) AS end_ts FROM detect UNION ALL
    SELECT device, site_id, ts, NULL FROM later ANTI JOIN detect USING (device, site_id)""", "detect", "later")
def _(spark, d):
    known, detect = _visit_state(spark, d)
    new = visits.new_devices(detect, known).select(
        "device", "site_id", F.col("ts").alias("start_ts"), F.lit(None).cast("bigint").alias("end_ts"))
    return visits.append_visits(known, new)


# --- statistics -----------------------------------------------------------------

@query("rssi_histogram", "SELECT rssi, count(*) AS n FROM s GROUP BY rssi", "s")
def _(spark, d):
    return stats.rssi_histogram(sightings(spark, d))


@query("counts_at_or_below", """SELECT count(*) FILTER (rssi <= -91) AS le_91, count(*) FILTER (rssi <= -90) AS le_90,
    count(*) FILTER (rssi <= -89) AS le_89 FROM s""", "s")
def _(spark, d):
    return stats.counts_at_or_below(sightings(spark, d))


@query("peak_rssi_histogram", """, b AS (SELECT device, rssi, min(rssi) OVER (PARTITION BY device) AS lo,
    max(rssi) OVER (PARTITION BY device) AS hi FROM ipeaks)
    SELECT device, CAST(CASE WHEN hi = lo THEN 5 ELSE least(floor((rssi - lo) * 10 / (hi - lo)), 9) END AS BIGINT) AS bin,
    count(*) AS n FROM b GROUP BY ALL""", "ipeaks")
def _(spark, d):
    return stats.peak_rssi_histogram(
        signal.rssi_peaks(signal.mean_rssi(clean.filter_rssi(sightings(spark, d))), endpoints=False))


@query("rssi_kurtosis", """SELECT device, ap,
    round(CASE WHEN var_pop(rssi) > 0.001 THEN kurtosis_pop(rssi) END, 4) AS kurtosis FROM (
    SELECT device, ts, ap, avg(rssi) AS rssi FROM r GROUP BY ALL) GROUP BY device, ap""", "r")
def _(spark, d):
    return stats.rssi_kurtosis(raw_sightings(spark, d)).withColumn("kurtosis", F.round("kurtosis", 4))


@query("rssi_stddev", "SELECT device, round(stddev_pop(rssi), 6) AS stddev FROM r GROUP BY device", "r")
def _(spark, d):
    return stats.rssi_stddev(raw_sightings(spark, d)).withColumn("stddev", F.round("stddev", 6))


@query("rssi_sum", "SELECT device, ts, sum(rssi) AS rssi_sum FROM s GROUP BY device, ts", "s")
def _(spark, d):
    return stats.rssi_sum(sightings(spark, d))


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("feature_stats", "SELECT " + ", ".join(f"round(avg({c}), 4) AS mean_{c}, round(var_samp({c}), 4) AS var_{c}"
                                             for c in ("l_quantity", "l_discount", "l_tax")) + " FROM lineitem")
def _(spark, d):
    x = stats.feature_stats(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return x.select(*[F.round(c, 4).alias(c) for c in x.columns])


@query("describe", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count({c}) AS DOUBLE) AS count, round(avg({c}), 4) AS mean, "
    f"round(stddev_samp({c}), 4) AS stddev, min({c}) AS min, max({c}) AS max FROM lineitem"
    for c in ("l_quantity", "l_discount", "l_tax")))
def _(spark, d):
    x = stats.describe(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return x.withColumns({"mean": F.round("mean", 4), "stddev": F.round("stddev", 4)})


def _scored(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", *_COLS, (F.col("l_returnflag") == "R").alias("label"))
    x = stats.gaussian_log_density(li, _COLS, stats.feature_stats(li, _COLS))
    # Four digits make the scores equal whatever the order of summation.
    return x.withColumn("score", F.floor(F.col("log_density") * 10000) / 10000).drop("log_density")


@query("gaussian_density", "SELECT l_orderkey, l_linenumber, score FROM scored", "scored")
def _(spark, d):
    return _scored(spark, d).select("l_orderkey", "l_linenumber", "score")


@query("score_range", "SELECT round(lo, 4) AS lo, round(hi, 4) AS hi, round(step, 8) AS step FROM rng", "rng")
def _(spark, d):
    x = stats.score_range(_scored(spark, d))
    return x.select(F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), F.round("step", 8).alias("step"))


@query("threshold_sweep", """SELECT i AS step_no, round(lo + i * step, 6) AS threshold,
    count(*) FILTER (label AND score < lo + i * step) AS tp, count(*) FILTER (label AND score >= lo + i * step) AS fn,
    count(*) FILTER (NOT label AND score < lo + i * step) AS fp
    FROM range(1001) AS g(i), rng, scored GROUP BY ALL""", "scored", "rng")
def _(spark, d):
    return stats.threshold_sweep(_scored(spark, d)).withColumn("threshold", F.round("threshold", 6))


@query("confusion_counts", """SELECT count(*) FILTER (label AND score < -10) AS tp,
    count(*) FILTER (label AND score >= -10) AS fn, count(*) FILTER (NOT label AND score < -10) AS fp FROM scored""",
       "scored")
def _(spark, d):
    return stats.confusion_counts(_scored(spark, d), -10.0)


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("pivot_features", "SELECT user_id, " + ", ".join(
    f"round(coalesce(sum(value) FILTER (event_type = '{t}'), 0), 2) AS \"{t}\"" for t in _TYPES)
    + " FROM events GROUP BY user_id")
def _(spark, d):
    x = stats.pivot_features(table(spark, d, "events"), "user_id", "event_type", "value", _TYPES)
    return x.select("user_id", *[F.round(t, 2).alias(t) for t in _TYPES])


@query("ab_test", """, g AS (SELECT avg(value) FILTER (event_type = 'click') AS ma, var_samp(value) FILTER (event_type = 'click') AS va,
    count(*) FILTER (event_type = 'click') AS na, avg(value) FILTER (event_type = 'view') AS mb,
    var_samp(value) FILTER (event_type = 'view') AS vb, count(*) FILTER (event_type = 'view') AS nb FROM events)
    SELECT round((ma - mb) / sqrt(va / na + vb / nb), 4) AS t,
    round(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)), 4) AS df FROM g""", "dim")
def _(spark, d):
    x = stats.welch(stats.group_moments(table(spark, d, "events"), "event_type", "value"), "click", "view")
    return x.select(F.round("t", 4).alias("t"), F.round("df", 4).alias("df"))


@query("ab_test_p", """, g AS (SELECT event_type, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY event_type),
    w AS (SELECT a.event_type AS a, b.event_type AS b, abs(a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t, pow(a.v / a.n + b.v / b.n, 2) /
    (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)) AS df FROM g a JOIN g b ON a.event_type < b.event_type),
    angle AS (SELECT *, atan(t / sqrt(df)) AS lo FROM w),
    area AS (SELECT a, b, sum(pow(cos(lo + (pi() / 2 - lo) * i / 20000), df - 1) * CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
    * (any_value(pi() / 2 - lo)) AS tail, sum(pow(cos(pi() / 2 * i / 20000), df - 1) * CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
    * pi() / 2 AS whole FROM angle, range(20001) r(i) GROUP BY a, b)
    SELECT a, b, round(tail / whole, 6) AS p FROM area""", "dim")
def _(spark, d):
    """Every two event types; the oracle integrates the density instead."""
    moments = stats.group_moments(table(spark, d, "events"), "event_type", "value")
    kinds = ["click", "error", "purchase", "signup", "view"]
    tests = [stats.welch(moments, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round("p", 6).alias("p"))
             for i, a in enumerate(kinds) for b in kinds[i + 1:]]
    return functools.reduce(lambda x, y: x.unionByName(y), tests)


@query("peak_clusters", """, h AS (SELECT gap AS v, count(*) AS n FROM pgaps WHERE gap IS NOT NULL GROUP BY gap),
    c AS (SELECT v, sum(n) OVER (ORDER BY v) AS n, sum(n * v) OVER (ORDER BY v) AS s, sum(n) OVER () AS nn, sum(n * v) OVER () AS ss,
    lead(v) OVER (ORDER BY v) AS next, min(v) OVER () AS low, max(v) OVER () AS high FROM h),
    cut AS (SELECT * FROM c WHERE next IS NOT NULL ORDER BY s::DOUBLE * s / n + (ss - s)::DOUBLE * (ss - s) / (nn - n) DESC, v LIMIT 1)
    SELECT 0 AS cluster, round(s / n, 6) AS centre, n::BIGINT AS n, low::DOUBLE AS low, v::DOUBLE AS high FROM cut UNION ALL
    SELECT 1, round((ss - s) / (nn - n), 6), (nn - n)::BIGINT, next::DOUBLE, high::DOUBLE FROM cut""", "pgaps")
def _(spark, d):
    found = stats.peak_interval_clusters(sessions.peak_intervals(jobs.peak_instants(sightings(spark, d), aps(spark))))
    return found.withColumn("centre", F.round("centre", 6))


# --- text -----------------------------------------------------------------------

# Entries of the stop list.
_STOP_WORDS = ["is", "a", "北方"]
_STOP_PATTERNS = [".*了"]


def _stop_list(spark):
    words = ", ".join(f"('{w}')" for w in _STOP_WORDS)
    return spark.sql(f"SELECT term FROM VALUES {words} AS t(term)")


@query("document_terms", """SELECT doc_id, CAST(position AS INT) AS position, term FROM (
    SELECT doc_id, unnest(words) AS term, generate_subscripts(words, 1) - 1 AS position FROM (SELECT doc_id,
    regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') AS words FROM documents))
    WHERE term NOT IN ('', 'is', 'a', '北方') AND NOT regexp_full_match(term, '.*了')""")
def _(spark, d):
    return terms.document_terms(table(spark, d, "documents"), _stop_list(spark), _STOP_PATTERNS)


@query("document_term_counts", "SELECT * FROM terms", "terms")
def _(spark, d):
    return terms.document_term_counts(
        terms.document_terms(table(spark, d, "documents"), _stop_list(spark), _STOP_PATTERNS))


@query("term_counts", "SELECT term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM terms GROUP BY term", "terms")
def _(spark, d):
    return terms.term_counts(table(spark, d, "documents"), _stop_list(spark), _STOP_PATTERNS)


# Terms in a fiftieth of the documents are the word list, so its length is bounded by fifty documents' words.
@query("seg_terms", r""", lex AS (SELECT term, sum(n) AS n FROM terms GROUP BY term
        HAVING count(*) * 50 >= (SELECT count(*) FROM documents)),
    size AS (SELECT sum(n) AS total, max(length(term)) AS longest FROM lex),
    runs AS (SELECT run, count(*) AS times FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS run FROM documents) GROUP BY run),
    begin AS (SELECT run, unnest(range(length(run))) AS i FROM runs),
    piece AS (SELECT run, i, j, substr(run, i + 1, j - i) AS term FROM (SELECT run, i,
        unnest(range(i + 1, least(length(run), i + (SELECT longest FROM size)) + 1)) AS j FROM begin)),
    edge AS (SELECT run, i, j, CASE WHEN l.term IS NULL THEN (round(1000000 * ln(total))::BIGINT + 5000000) * 1000 + 1
        ELSE round(1000000 * ln(total / l.n))::BIGINT * 1000 + 1 END AS cost FROM piece LEFT JOIN lex l USING (term), size
        WHERE l.term IS NOT NULL OR j = i + 1),
    into_ AS (SELECT run, j, list({'i': i, 'cost': cost}) AS edges FROM edge GROUP BY run, j),
    way AS (SELECT run, 0 AS j, [0::BIGINT] AS costs, [0::BIGINT] AS starts FROM runs UNION ALL
        SELECT run, way.j + 1, list_append(costs, best.cost), list_append(starts, best.i) FROM way JOIN into_ USING (run),
        LATERAL (SELECT list_min(list_transform(edges, lambda e: {'cost': costs[e.i + 1] + e.cost, 'i': e.i})) AS best) WHERE into_.j = way.j + 1),
    back AS (SELECT run, starts, j AS z, starts[j + 1] AS a FROM way WHERE j = length(run) UNION ALL
        SELECT run, starts, a, starts[a + 1] FROM back WHERE a > 0)
    SELECT term, sum(times)::BIGINT AS n FROM (SELECT substr(run, a + 1, z - a) AS term, times FROM back JOIN runs USING (run)) GROUP BY term""", "terms")
def _(spark, d):
    docs = table(spark, d, "documents")
    counts = terms.term_counts(docs, _stop_list(spark), _STOP_PATTERNS)
    lexicon = counts.where(F.col("docs") * 50 >= docs.select(F.count("*")).scalar())
    found = terms.segmented_terms(docs, terms.segmenter_of(lexicon))
    return found.groupBy("term").agg(F.count("*").alias("n"))


def _synonyms(spark, d):
    """Synonym lines: each brand with the part types sold under it."""
    p = table(spark, d, "part").select(F.lower("p_brand").alias("b"), F.lower("p_type").alias("t")).distinct()
    line = F.array_join(F.concat(F.array("b"), F.array_sort(F.collect_set("t"))), "\t")
    return terms.synonym_heads(p.groupBy("b").agg(line.alias("value")))


@query("synonym_heads", """SELECT term, min(head) AS head FROM (
    SELECT lower(p_type) AS term, lower(p_brand) AS head FROM part UNION ALL
    SELECT lower(p_brand), lower(p_brand) FROM part) GROUP BY term""")
def _(spark, d):
    return _synonyms(spark, d)


@query("synonyms", """, h AS (SELECT lower(p_type) AS term, min(lower(p_brand)) AS head FROM part GROUP BY 1)
    SELECT p_partkey, coalesce(head, lower(p_type)) AS term FROM part LEFT JOIN h ON lower(p_type) = h.term""", "dim")
def _(spark, d):
    used = table(spark, d, "part").select("p_partkey", F.lower("p_type").alias("term"))
    return terms.normalize_synonyms(used, _synonyms(spark, d)).select("p_partkey", "term")


# --- data quality ---------------------------------------------------------------

@query("check_partition_day", """SELECT CAST(make_timestamp(ts // 86400 * 86400000000) AS DATE)::VARCHAR AS day,
    CAST(make_timestamp((ts + 28800) // 86400 * 86400000000) AS DATE)::VARCHAR AS real_day,
    CAST((ts + 28800) % 86400 // 3600 AS BIGINT) AS hour, device, count(*) AS n FROM r
    WHERE ts // 86400 <> (ts + 28800) // 86400 GROUP BY ALL""", "r")
def _(spark, d):
    # Filed by UTC date although the deployment's day is UTC+8.
    filed = raw_sightings(spark, d).withColumn("day", clock.local_day("ts", "UTC"))
    return quality.check_partition_day(filed).select(
        F.col("day").cast("string").alias("day"), F.col("real_day").cast("string").alias("real_day"),
        F.col("hour").cast("bigint").alias("hour"), "device", "n")


@query("position_codes", """SELECT s_name AS location, s_suppkey AS line_no, number, CASE WHEN len(bin(number)) < w
    THEN lpad(bin(number), w, '0') ELSE bin(number) END AS code FROM (
    SELECT s_name, s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS number,
    CAST(len(bin(count(*) OVER () - 1)) AS INT) AS w FROM supplier)""")
def _(spark, d):
    return quality.position_codes(table(spark, d, "supplier").select(
        F.col("s_name").alias("location"), F.col("s_suppkey").alias("line_no")))
