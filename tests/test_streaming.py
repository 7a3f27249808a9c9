"""Streams over several micro-batches against the batch operators."""

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from footfall.operators import clean, flow, signal, traffic, visits
from footfall.schema import RESULT
from footfall.sinks import tables
from footfall.sinks.log import load_table
from footfall.sinks.tables import load_all, load_state, save_state, versions
from footfall.streaming import jobs, operators
from footfall.streaming.sources import file_lines, kafka_lines, stream_scans, stream_table, stream_tail


@pytest.fixture
def drops(spark, tmp_path):
    """Drop groups of (device, ap, rssi, ts) as one file each; read them one file per batch."""
    folder = tmp_path / "drops"
    folder.mkdir()

    def make(*groups):
        for i, group in enumerate(groups):
            path = folder / f"{i:03d}.txt"
            path.write_text("".join(f"{j}|{d}|{r}|{t}|{a}\n" for j, (d, a, r, t) in enumerate(group)) + "broken\n")
            os.utime(path, (1000 + i, 1000 + i))
        return stream_scans(file_lines(spark, str(folder), files_per_trigger=1), "v5")
    return make


def _paths(tmp_path):
    return str(tmp_path / uuid.uuid4().hex), str(tmp_path / uuid.uuid4().hex)


def _appended(spark, df, tmp_path):
    out, cp = _paths(tmp_path)
    jobs.stream_to(df, out, cp).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


GROUPS = ([("A", "O", -50, 10), ("B", "O", -60, 20), ("A", "O", -52, 10)],
          [("A", "I", -40, 290), ("A", "O", -50, 310), ("C", "P", -50, 320)],
          [("Z", "O", -50, 90000)])


def test_traffic(spark, drops, dim, rows, tmp_path):
    s = clean.with_site(drops(*GROUPS), dim)
    assert rows(_appended(spark, operators.stream_traffic(s, delay="0 seconds"), tmp_path)) == [(1, 0, 2), (1, 300, 1), (2, 300, 1)]


def test_mean_rssi(spark, drops, rows, tmp_path):
    got = rows(_appended(spark, operators.stream_mean_rssi(drops(*GROUPS)), tmp_path), "device", "ts", "ap", "rssi")
    assert ("A", 10, "O", -51.0) in got and len(got) == 5


def test_buffer_digest(spark, drops, dim, rows, tmp_path):
    s = clean.with_site(drops([("A", "O", -50, 0)], [("A", "O", -40, 100)], [("A", "O", -60, 900)], [("Z", "I", -50, 90000)]), dim)
    got = rows(_appended(spark, operators.buffer_digest(s, 300), tmp_path), "device", "first_ts", "last_ts", "readings", "max_rssi")
    assert got == [("A", 0, 100, 2, -40.0), ("A", 900, 900, 1, -60.0)]


def test_running_count(spark, drops, rows, tmp_path):
    out, cp = _paths(tmp_path)
    jobs.stream_counts(drops(*GROUPS), ["device"], out, cp).awaitTermination()
    counts = [rows(load_table(spark, out, ["device"], "device STRING, n BIGINT", before=v + 1)) for v in range(3)]
    assert counts == [[("A", 2), ("B", 1)], [("A", 4), ("B", 1), ("C", 1)], [("A", 4), ("B", 1), ("C", 1), ("Z", 1)]]
    assert rows(spark.read.parquet(f"{out}/log/version=1"), "device", "n") == [("A", 4), ("C", 1)]


def _inside_out(start, come):
    """Readings of a device whose points at start+1 and start+4 lie on different sides."""
    first, second = ("O", "I") if come else ("I", "O")
    return [("D", first, -70, start), ("D", first, -40, start + 1), ("D", first, -70, start + 2),
            ("D", second, -70, start + 3), ("D", second, -40, start + 4), ("D", second, -70, start + 5)]


def test_occupancy_adds_up_over_batches(spark, drops, dim, rows, tmp_path):
    s = drops(_inside_out(0, True), _inside_out(100, True), _inside_out(200, False))
    out, cp = _paths(tmp_path)
    jobs.stream_occupancy(s, dim, out, cp, mon_time=lambda b: b).awaitTermination()
    assert versions(spark, out) == [0, 1, 2]
    assert [rows(load_state(spark, out, before=v + 1)) for v in range(3)] == [[(1, 1, 0)], [(1, 2, 1)], [(1, 1, 2)]]
    # repeating a batch changes nothing
    batch = spark.createDataFrame([(0, d, float(r), t, a) for d, a, r, t in _inside_out(200, False)],
                                  "seq BIGINT, device STRING, rssi DOUBLE, ts BIGINT, ap STRING")
    jobs.occupancy_job(dim, out, mon_time=lambda b: b)(batch, 2)
    assert rows(load_state(spark, out)) == [(1, 1, 2)]


def test_visits_over_batches(spark, drops, dim, rows, tmp_path):
    """Many ticks in a batch, batches without a tick, stays across batches: as the batch tracker over everything."""
    groups = ([("A", "O", -50, 10), ("B", "O", -50, 12)], [("B", "O", -50, 60)], [("A", "O", -50, 400), ("C", "P", -50, 1000)],
              [("B", "I", -50, 1010), ("A", "O", -50, 1290), ("A", "I", -50, 1500)], [("C", "P", -50, 1505), ("B", "O", -50, 3000)])
    s = drops(*groups)
    every = spark.createDataFrame([(d, a, float(r), t) for g in groups for d, a, r, t in g], "device STRING, ap STRING, rssi DOUBLE, ts BIGINT")
    for policy in ("first_visit", "reopen"):
        for seconds, tick in ((300, 30), (300, 300)):
            want = visits.visit_tracker(clean.with_site(every, dim), 0, tick, 3000 // tick, seconds, policy)
            out, cp = _paths(tmp_path)
            jobs.stream_visits(s, dim, out, cp, seconds, policy, every=tick).awaitTermination()
            assert rows(jobs.load_visits(spark, out), *jobs.VISIT_COLUMNS) == rows(want, *jobs.VISIT_COLUMNS)
            if (policy, tick) == ("first_visit", 30):
                path = dict((d, e) for d, _, e in rows(jobs.load_visits(spark, out), "device", "start_ts", "end_ts"))
                assert path["A"] == 3000 and path["B"] == 2970


def test_visit_ends_only_after_silence(spark, drops, dim, rows, tmp_path):
    s = drops([("A", "O", -50, 10), ("B", "O", -50, 12)], [("B", "O", -50, 60)])
    out, cp = _paths(tmp_path)
    jobs.stream_visits(s, dim, out, cp, 300, every=30).awaitTermination()
    assert rows(jobs.load_visits(spark, out), "device", "start_ts", "end_ts") == [("A", 10, None), ("B", 12, None)]


def test_trajectory_rows_and_lake(spark, drops, dim, rows, tmp_path):
    s = drops(_inside_out(0, True), _inside_out(100, True))
    out, cp = _paths(tmp_path)
    assert load_all(spark, out, RESULT).count() == 0
    jobs.stream_trajectory_rows(s, dim, out, cp, mon_time=lambda b: b).awaitTermination()
    assert rows(load_all(spark, out, RESULT)) == [(0, -1, 0)] * 2 + [(0, -1, 1)] * 2
    lake, cp = _paths(tmp_path)
    jobs.stream_land(s, lake, cp).awaitTermination()
    assert spark.read.parquet(lake).count() == 12


def test_the_version_before_is_found_without_a_list(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "state")
    for v in (0, 1, 3):
        save_state(spark.range(v + 1), path, v)
    assert load_state(spark, path, before=3).count() == 2  # version 2 is missing
    monkeypatch.setattr(tables, "versions", None)
    assert [load_state(spark, path, before=v).count() for v in (1, 2, 4)] == [1, 2, 4]


def test_tail_takes_new_files(spark, rows, tmp_path):
    root, (out, cp) = tmp_path / "tail", _paths(tmp_path)
    (root / "A1").mkdir(parents=True)
    (root / "A1" / "20170502-0").write_text("D|-40|1\n")
    df = stream_tail(spark, str(root), history=True).selectExpr("device", "ap", "CAST(day AS STRING) AS day", "ts")
    jobs.stream_to(df, out, cp).awaitTermination()
    (root / "A1" / "20170503-0").write_text("D|-40|2\n")
    jobs.stream_to(df, out, cp).awaitTermination()
    assert rows(spark.read.parquet(out)) == [("D", "A1", "2017-05-02", 1), ("D", "A1", "2017-05-03", 2)]


def test_table_stream_and_ab_test(spark, rows, tmp_path):
    folder = str(tmp_path / "t")
    df = spark.createDataFrame([("a", float(i)) for i in range(9)] + [("b", float(i * i)) for i in range(9)],
                               "label STRING, value DOUBLE")
    df.repartition(3).write.parquet(folder)
    out, cp = _paths(tmp_path)
    s = stream_table(spark, folder, df.schema, files_per_trigger=1)
    jobs.stream_ab_test(s, "a", "b", out, cp).awaitTermination()
    from footfall.operators import stats
    want = stats.welch(stats.group_moments(df), "a", "b").first()
    got = load_state(spark, out).first()
    assert (got.t, got.df) == pytest.approx((want.t, want.df))


def test_kafka_needs_its_package(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        kafka_lines(spark, "localhost:1", "topic")


def test_single_batch_equals_batch_operators(spark, drops, dim, rows, tmp_path):
    group = _inside_out(0, True) + _inside_out(100, False)
    s = drops(group)
    out, cp = _paths(tmp_path)
    jobs.stream_occupancy(s, dim, out, cp, mon_time=lambda b: 0).awaitTermination()
    batch = spark.createDataFrame([(d, a, float(r), t) for d, a, r, t in group], "device STRING, ap STRING, rssi DOUBLE, ts BIGINT")
    net = flow.net_flow(flow.come_go_counts(flow.side_moves(signal.trajectory(batch, dim))))
    assert rows(load_state(spark, out), "site_id", "value") == rows(net, "site_id", "net")
    assert traffic.distinct_devices(batch).count() == 1
    assert visits.detect_table(clean.with_site(batch, dim), 105).agg(F.count("*")).first()[0] == 1


def test_refresh_counts_a_device_once_over_batches(spark, drops, dim, rows, tmp_path):
    s = drops([("A", "O", -50, 10), ("B", "O", -50, 20)], [("A", "I", -50, 30), ("C", "O", -50, 40)],
              [("A", "O", -50, 90000)])
    out, cp = _paths(tmp_path)
    jobs.refresh_traffic(s, dim, out, cp, mon_time=lambda b: b).awaitTermination()
    assert [rows(load_state(spark, out, before=v + 1)) for v in range(3)] == [[(1, 2, 0)], [(1, 3, 1)], [(1, 1, 2)]]


@pytest.mark.parametrize("seed, delay", [(1, 0), (2, 600)])
def test_carried_points_do_not_depend_on_the_cuts(spark, dim, sightings, rows, tmp_path, seed, delay):
    """After every batch of a random cut: net flow and number of points are those of all readings so far."""
    rng = random.Random(seed)
    data = [(rng.choice("DE"), rng.choice("OIPJX"), rng.randint(-80, -40), rng.randrange(0, 9000, 30)) for _ in range(400)]
    # out of order by up to `delay` seconds
    data.sort(key=lambda r: r[3] + rng.randint(0, delay))
    cuts = [0, *sorted(rng.sample(range(1, len(data)), 4)), len(data)]
    out, points = _paths(tmp_path)
    occupancy = jobs.occupancy_job(dim, out, mon_time=lambda b: b, carry=True, delay=delay)
    trajectory = jobs.trajectory_rows_job(dim, points, mon_time=lambda b: b, carry=True, delay=delay)
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        for _ in range(2 if i == 2 else 1):  # a batch that is repeated changes nothing
            occupancy(sightings(data[a:b]), i)
            trajectory(sightings(data[a:b]), i)
        traj = signal.trajectory(sightings(data[:b]), dim)
        net = flow.net_flow(flow.come_go_counts(flow.side_moves(traj)))
        assert rows(load_state(spark, out), "site_id", "value") == rows(net, "site_id", "net")
        assert jobs.load_trajectory_rows(spark, points).count() == traj.count()
    assert load_state(spark, f"{out}/_means").count() < len(data) / 2
    assert load_table(spark, f"{out}/_ends", jobs.END_KEYS, jobs.ENDS).count() <= 2 * 2


def test_hours_at_a_null_access_point_add_up_over_batches(spark, tmp_path):
    schema = "device STRING, ap STRING, rssi DOUBLE, ts BIGINT"
    folder, (out, cp) = str(tmp_path / "in"), _paths(tmp_path)
    for rows in ([("A", None, -50.0, 0), ("A", None, -50.0, 3600), ("B", "O", -50.0, 10)], [("A", None, -50.0, 7200), ("B", "O", -50.0, 7200)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        jobs.stream_always_on(stream_table(spark, folder, schema), out, cp, 3).awaitTermination()
    assert [r.device for r in jobs.load_static(spark, out).collect()] == ["A"]


def test_carried_points_share_one_shuffle(spark, dim, tmp_path, monkeypatch):
    """The windows and the summary of the segments read the same shuffle of the readings."""
    made = []
    monkeypatch.setattr(jobs, "in_order", lambda *a, f=jobs.in_order, **k: made.append(f(*a, **k)) or made[-1])
    spark.range(20).selectExpr("'A' AS device", "'O' AS ap", "-50D - id % 3 AS rssi", "id AS ts").write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with jobs.carried_points(spark.read.parquet(str(tmp_path / "in")), 0, dim, str(tmp_path / "out")) as (closed, still_open):
            assert closed.count() + still_open.count() > 0
        plan = made[0]._jdf.queryExecution().executedPlan().toString().splitlines()
        assert sum("REPARTITION_BY_COL" in line and "ReusedExchange" not in line for line in plan) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
