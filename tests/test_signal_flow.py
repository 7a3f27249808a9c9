import pytest
from pyspark.sql import functions as F

from footfall.operators import clean, flow, signal


def test_filter_rssi(sightings, rows):
    s = sightings([("D", "O", v, 0) for v in (-89, -90, -91)])
    assert rows(clean.filter_rssi(s), "rssi") == [(-89.0,)]


def test_mean_rounding(sightings, rows):
    s = sightings([("D", "O", -50, 0), ("D", "O", -51, 0)])
    assert rows(signal.mean_rssi(s), "rssi") == [(-51.0,)]
    assert rows(signal.run_mean(s), "rssi") == [(-50.0,)]


def test_run_mean_restarts_when_the_access_point_returns(sightings, rows):
    s = sightings([("D", "O", -50, 0), ("D", "I", -60, 0), ("D", "O", -70, 0), ("D", "O", -72, 0)])
    for segment in (1, 2, 1 << 20):
        assert rows(signal.run_mean(s, segment=segment), "run_seq", "ap", "rssi", "n") == [
            (0, "O", -50.0, 1), (1, "I", -60.0, 1), (2, "O", -71.0, 2)]


@pytest.mark.parametrize("segment", [2, 30, None])
def test_peaks(sightings, rows, segment):
    s = sightings([("D", "O", v, i) for i, v in enumerate((-60, -50, -70, -70, -40))])
    assert rows(signal.rssi_peaks(s, segment=segment), "ts") == [(1,), (4,)]
    assert rows(signal.rssi_peaks(s, endpoints=False, segment=segment), "ts") == [(1,)]


def test_lone_row_and_plateau_are_no_peaks(sightings, rows):
    assert rows(signal.rssi_peaks(sightings([("D", "O", -50, 0)]))) == []
    assert rows(signal.rssi_peaks(sightings([("D", "O", -50, 0), ("D", "O", -50, 1)]))) == []


@pytest.mark.parametrize("inside, want", [(-40, "inside"), (-60, "outside")])
def test_trajectory_choice(sightings, dim, rows, inside, want):
    low = [("D", ap, -80, t) for ap in ("O", "I") for t in (0, 2)]
    s = sightings([("D", "O", -40, 1), ("D", "I", inside, 1), *low])
    got = rows(signal.trajectory(s, dim), "ts", "side")
    assert [r for r in got if r[0] == 1] == [(1, want)]


def test_moves_and_net_flow(sightings, dim, rows, spark):
    traj = spark.createDataFrame([("D", t, side, 1, -50.0) for t, side in enumerate(
        ["outside", "outside", "inside", "inside", "outside"])],
        "device STRING, ts BIGINT, side STRING, site_id INT, rssi DOUBLE")
    for segment in (1, 2, 100, None):
        assert rows(flow.side_moves(traj, segment), "ts", "move") == [(2, "come"), (4, "go")]
    come = spark.createDataFrame([("A", 2)], "site_id STRING, come BIGINT")
    go = spark.createDataFrame([("B", 1)], "site_id STRING, go BIGINT")
    assert rows(flow.net_flow(flow.join_come_go(come, go)), "site_id", "net") == [("A", 2), ("B", -1)]


def test_latest_per_site_ties(spark, rows):
    r = spark.createDataFrame([(1, 5, 9), (1, 7, 9), (1, 3, 8)], "site_id INT, value BIGINT, mon_time BIGINT")
    assert rows(flow.latest_per_site(r), "value") == [(5,), (7,)]
    assert rows(flow.latest_per_site(r, ties="one"), "value") == [(7,)]
    assert rows(flow.latest_per_site(r, newer_than=9)) == []


def test_unknown_access_points(sightings, dim, rows):
    s = sightings([("D", "?", -50, 0), ("D", "O", -50, 0)])
    assert rows(clean.with_site(s, dim), "ap", "site_id", "side") == [("?", 0, None), ("O", 1, "outside")]
    assert rows(clean.with_site(s, dim, unknown="drop"), "ap") == [("O",)]


def test_occupancy_and_base(spark, rows):
    net = spark.createDataFrame([(1, 0, 2), (1, 300, -1), (2, 0, 4)], "site_id INT, window_start BIGINT, net BIGINT")
    base = spark.createDataFrame([(1, 10)], "site_id INT, base BIGINT")
    assert rows(flow.occupancy(net, base), "site_id", "window_start", "occupancy") == [(1, 0, 12), (1, 300, 11), (2, 0, 4)]
    delta = net.groupBy("site_id").agg(F.sum("net").alias("net"))
    assert rows(flow.add_base(base, delta)) == [(1, 11), (2, 4)]


def test_four_sides(spark, rows):
    """The second access point of a side is kept apart, by the order of names; unlisted ones have no side."""
    from footfall.sources.dims import ap_dim

    dim = ap_dim(spark, [("C", 3, "outside"), ("A", 3, "outside"), ("B", 3, "inside"), ("D", 3, "inside"), ("E", 1, "inside")])
    df = spark.createDataFrame([(x,) for x in "ABCDEX"], "ap STRING")
    assert rows(clean.with_four_sides(df, dim), "ap", "site_id", "side") == [
        ("A", 3, "outside"), ("B", 3, "inside"), ("C", 3, "outside1"), ("D", 3, "inside1"), ("E", 1, "inside"), ("X", 0, None)]


def test_properties_on_given_data(spark):
    """Peaks are means; one point per instant; moves alternate; net = come - go."""
    from footfall.plans.tables import aps, sightings as given
    s = clean.filter_rssi(given(spark, "/root/testdata/sf0.001"))
    means, keys = signal.mean_rssi(s), ["device", "ts", "ap", "rssi"]
    assert signal.rssi_peaks(means).join(means, keys, "left_anti").count() == 0
    traj = signal.trajectory(s, aps(spark)).cache()
    assert traj.count() == traj.select("device", "ts").distinct().count() > 0
    seen = {}
    for r in flow.side_moves(traj).orderBy("site_id", "device", "ts").collect():
        key = (r.site_id, r.device)
        assert seen.get(key) != r.move
        seen[key] = r.move


def test_unlisted_access_point_yields_to_listed_ones(spark, rows):
    from footfall.operators.signal import one_ap_per_reading, strongest_per_instant

    peaks = spark.createDataFrame([("D", 1, "X", -40.0, None, 0), ("D", 1, "I", -40.0, "inside", 1)],
                                  "device STRING, ts BIGINT, ap STRING, rssi DOUBLE, side STRING, site_id INT")
    for f in (one_ap_per_reading, strongest_per_instant):
        assert rows(f(peaks), "ap") == [("I",)]
