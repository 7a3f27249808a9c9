import random

import pytest
from pyspark.sql import functions as F

from footfall.operators import sessions, traffic, visits


@pytest.mark.parametrize("segment", [50, 130, None])
def test_sessionize(sightings, rows, segment):
    s = sightings([("D", "O", -50, t) for t in (0, 120, 241, 400)])
    got = rows(sessions.sessions(s, 120, segment=segment), "session_start", "session_end")
    assert got == [(0, 120), (241, 241), (400, 400)]


VISITS = {
    # flags -> (come, go, stay, passer_by)
    "o": (0, 0, 0, True), "oo": (0, 0, 0, True), "ii": (0, 0, 1, False), "oi": (1, 0, 0, False),
    "io": (0, 1, 0, False), "ioi": (0, 0, 2, False), "iii": (0, 0, 1, False), "ooi": (1, 0, 0, False),
    "oioi": (0, 0, 1, False), "ioo": (0, 1, 0, False), "oio": (0, 0, 1, True), "ooo": (0, 0, 0, True),
}


@pytest.mark.parametrize("segment", [3, 1000, None])
def test_classify_visits(spark, segment):
    points = []
    for flags in VISITS:
        points += [(flags, i, f == "i") for i, f in enumerate(flags)]
        points.append((flags, 90000, False))  # a second, far session: the device has several instants
    df = spark.createDataFrame(points, "device STRING, ts BIGINT, inside BOOLEAN")
    got = {r.device: (r.come, r.go, r.stay, r.passer_by)
           for r in sessions.classify_visits(df, 1800, segment=segment).where("session_start = 0").collect()}
    assert got == VISITS


def test_single_instant_devices_are_not_classified(spark):
    df = spark.createDataFrame([("D", 5, True)], "device STRING, ts BIGINT, inside BOOLEAN")
    assert sessions.classify_visits(df).count() == 0


def test_flow_by_bucket_is_complete(spark, rows):
    df = spark.createDataFrame([("D", 0, True), ("D", 10, True)], "device STRING, ts BIGINT, inside BOOLEAN")
    flow = rows(sessions.flow_by_bucket(sessions.classify_visits(df)))
    assert len(flow) == 288 and sum(r[1] for r in flow) == 1 and flow[96] == (96, 1)  # 08:00 in UTC+8


def test_short_sessions(sightings, rows):
    s = sightings([("D", "O", -50, t) for t in (0, 5, 1000, 1006, 2000)])
    found = sessions.sessions(s, 120)
    assert rows(sessions.short_sessions(found), "session_start") == [(0,), (2000,)]
    assert rows(sessions.short_sessions(found, keep_last=False), "session_start") == [(0,)]


def test_intervals_and_dwell(sightings, rows):
    s = sightings([("D", "O", -50, t) for t in (0, 0, 59, 120)])
    assert rows(sessions.interval_buckets(s), "bucket", "gaps") == [("0s", 1), ("1 min", 1), ("<1 min", 1)]
    d = sightings([("A", "O", -50, 0), ("A", "O", -50, 3599), ("B", "O", -50, 0), ("B", "O", -50, 3600),
                   ("C", "O", -50, 0)])
    assert rows(sessions.dwell_time(d), "device", "hours", "long_stay") == [("A", 0, False), ("B", 1, True)]


def _seen(spark, ticks, every=300):
    return spark.createDataFrame([("D", 1, t * every) for t in ticks], "device STRING, site_id INT, ts BIGINT")


def test_visit_tracker_fixture(spark, rows):
    s = _seen(spark, [0, 1, 3])
    assert rows(visits.visit_tracker(s, 0, 300, 4), "start_ts", "end_ts") == [(0, 1200)]
    assert rows(visits.visit_tracker(s, 0, 300, 4, policy="reopen"), "start_ts", "end_ts") == [(0, 600), (900, 1200)]


@pytest.mark.parametrize("policy", ["first_visit", "reopen"])
@pytest.mark.parametrize("every, segment", [(300, 1 << 20), (100, 4), (450, 7)])
def test_visit_tracker_equals_tick_by_tick(spark, rows, policy, every, segment):
    rnd = random.Random(every)
    data = [(f"d{rnd.randrange(25)}", rnd.randrange(2), rnd.randrange(-200, 6000)) for _ in range(150)]
    s = spark.createDataFrame(data, "device STRING, site_id INT, ts BIGINT")
    last = 5400 // every
    table = {}
    for k in range(last + 1):
        now = k * every
        here = {}
        for dev, site, ts in data:
            if now - 300 < ts <= now:
                here[dev, site] = min(ts, here.get((dev, site), ts))
        for key, ts in here.items():
            stays = table.setdefault(key, [])
            if not stays or (policy == "reopen" and stays[-1][1] is not None):
                stays.append([ts, None])
        for key, stays in table.items():
            if key not in here and (policy == "first_visit" or stays[-1][1] is None):
                stays[-1][1] = now
    want = sorted((*key, a, b) for key, stays in table.items() for a, b in stays
                  for b in [b])
    got = visits.visit_tracker(s, 0, every, last, 300, policy, segment=segment)
    assert rows(got) == sorted(want, key=lambda t: tuple((v is not None, v) for v in t))


@pytest.mark.parametrize("policy", ["first_visit", "reopen"])
def test_stepwise_updates_reach_the_closed_form(spark, rows, policy):
    rnd = random.Random(1)
    s = spark.createDataFrame([(f"d{rnd.randrange(6)}", 1, rnd.randrange(0, 1500)) for _ in range(25)],
                              "device STRING, site_id INT, ts BIGINT")
    state = spark.createDataFrame([], "device STRING, site_id INT, start_ts BIGINT, end_ts BIGINT")
    for k in range(5):
        detect = visits.detect_table(s, k * 300)
        state = visits.update_visits(state, detect, k * 300, policy)
        state = spark.createDataFrame(state.collect(), state.schema)
    assert rows(state) == rows(visits.visit_tracker(s, 0, 300, 4, policy=policy))


def test_always_on(sightings, rows):
    s = sightings([("A", "O", -50, h * 3600 - 28800) for h in range(24)]
                  + [("B", "O", -50, h * 3600 - 28800) for h in range(23)]
                  + [("C", "OI"[h % 2], -50, h * 3600 - 28800) for h in range(24)])
    assert rows(traffic.always_on_devices(s)) == [("A",)]
    assert rows(traffic.always_on_devices(s, per_ap=False)) == [("A",), ("C",)]


def test_traffic_day_splits_at_local_midnight(spark, rows):
    day = 86400
    s = spark.createDataFrame([("D", 1, day + 57599), ("D", 1, day + 57600)], "device STRING, site_id INT, ts BIGINT")
    assert rows(traffic.traffic_per_day(s), "window_start") == [(57600,), (day + 57600,)]
    latest = traffic.latest_window(traffic.traffic_per_window(s))
    assert latest.agg(F.max("window_start")).first()[0] == day + 57600


def test_a_sighting_of_many_ticks_is_one_row(spark, rows):
    """Ticks every 30 seconds, a sighting belongs to 1,000 of them: as by the rows per tick, without making them."""
    s = spark.createDataFrame([("A", 1, t) for t in (0, 5, 31, 29000, 61030, 61031, 95000)] + [("B", 1, 40), ("B", 1, 30041)],
                              "device STRING, site_id INT, ts BIGINT")
    found = visits.stays(s, 0, 30, F.lit(4000), 30000, after=3)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    ticks = {}
    for r in visits.presence(s, 0, 30, 30000).where("tick > 3 AND tick <= 4000").collect():
        ticks.setdefault(r.device, {})[r.tick] = r.first_ts
    want = []
    for device, seen in ticks.items():
        for k in sorted(seen):
            if k - 1 not in seen:
                want.append((device, 1, k, next(e for e in range(k, 5000) if e + 1 not in seen), seen[k]))
    assert rows(found, "device", "site_id", "run", "run_end", "start_ts") == sorted(want)
