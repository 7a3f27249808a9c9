import pytest

from footfall.functions import clock, strings
from footfall.operators import clean, quality
from footfall.schema import RESULT
from footfall.sinks import tables as sinks
from footfall.sources import dims, scans
from footfall.sources.tables import latest_per_site_query


def _lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value STRING")


def test_parse_and_quarantine(spark, rows):
    lines = _lines(spark, "D1|-40|0", "D2|bad|1", "D3|-50", "D4|-60|7|9")
    lines = lines.selectExpr("value", "'A' AS ap")
    assert rows(scans.parse_lines(lines, "scan"), "device", "rssi", "ts", "ap") == [("D1", -40.0, 0, "A")]
    assert rows(scans.malformed_lines(lines, "scan"), "line", "reason") == [
        ("D2|bad|1", "values"), ("D3|-50", "fields"), ("D4|-60|7|9", "fields")]
    # counting must not skip the checks
    assert scans.parse_lines(lines, "scan").count() == 1


@pytest.mark.parametrize("line, good", [
    (" D | -40 | 7 | A ", True), ("|-40|7|A", False), ("D|-40||A", False), ("D|-40|7|", False), ("", False),
    ("D|-40|7.5x|A", False), ("D|-40|7|A|", False)])
def test_parse_edges(spark, line, good):
    lines = _lines(spark, line)
    assert scans.parse_lines(lines).count() == int(good)
    assert scans.malformed_lines(lines).count() == int(not good)


def test_series_layout(spark, rows):
    assert rows(scans.parse_lines(_lines(spark, "D|7|-40|A"), "series"), "device", "ts", "rssi", "ap") == [("D", 7, -40.0, "A")]


def test_read_scans_by_path(spark, rows, tmp_path):
    for ap, day, text in (("A1", "20170502", "D|-40|1\nbad\n"), ("A1", "20170503", "D|-41|2\n"), ("A2", "20170502", "E|-42|3\n")):
        (tmp_path / ap).mkdir(exist_ok=True)
        (tmp_path / ap / day).write_text(text)
    every = scans.read_scans(spark, f"{tmp_path}/*/*")
    got = rows(every.selectExpr("device", "ap", "CAST(day AS STRING) AS day"))
    assert got == [("D", "A1", "2017-05-02"), ("D", "A1", "2017-05-03"), ("E", "A2", "2017-05-02")]
    some = scans.scan_paths(str(tmp_path), ["A1"], ["20170502", "20170503"], skip=["20170503"])
    assert rows(scans.read_scans(spark, some), "ts") == [(1,)]
    assert scans.scan_paths("r/") == ["r/*/*"]


def test_lake_is_pruned_by_partition(spark, rows, sightings, tmp_path):
    s = sightings([("ABCDEF123456", ap, -50, day * 86400) for ap in "OI" for day in range(3)])
    scans.land(s, str(tmp_path / "lake"), salt="pepper")
    pruned = clean.prune(scans.read_lake(spark, str(tmp_path / "lake")), ("1970-01-01", "1970-01-03"), ["O"], ["1970-01-02"])
    assert rows(pruned, "ap", "ts") == [("O", 0), ("O", 172800)]
    device = pruned.first().device
    assert device.startswith("ABCDEF") and "ABCDEF123456" not in device and len(device) == 38
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "ap" in filters and "day" in filters


def test_dimensions_and_lists(spark, rows, tmp_path):
    (tmp_path / "ap.csv").write_text("ap,site_id,side,pos_code\nA,1,outside,0001\nB,1,inside,0010\n")
    loaded = dims.load_dims(spark, str(tmp_path / "ap.csv"))
    assert rows(loaded["ap_dim"]) == [("A", 1, "outside", "0001"), ("B", 1, "inside", "0010")]
    assert rows(loaded["action_dim"], "action_code") == [(i,) for i in range(5)]
    assert rows(clean.site_aps(loaded["ap_dim"], 1)) == [("A",), ("B",)]
    (tmp_path / "oui.txt").write_text("ABCDEF|Vendor\nABCDEF|Vendor\n123456|Other\nshort\n")
    assert rows(dims.read_oui(spark, str(tmp_path / "oui.txt"))) == [("123456",), ("ABCDEF",)]
    assert dims.read_static_devices(spark, str(tmp_path / "none")).count() == 0
    sinks.save_static_devices(spark.createDataFrame([("D",)], "device STRING"), str(tmp_path / "static"), 3)
    assert rows(dims.read_static_devices(spark, str(tmp_path / "static"))) == [("D",)]
    (tmp_path / "stop.txt").write_text("Is\na\n.*x\tregex\nv\tnature\n")
    words, rules = dims.read_stop_list(spark, str(tmp_path / "stop.txt"))
    assert rows(words) == [("a",), ("is",)] and rows(rules) == [(".*x", "regex"), ("v", "nature")]
    (tmp_path / "syn.txt").write_text("b\tx\ty\na\tx\n")
    assert rows(dims.read_synonyms(spark, str(tmp_path / "syn.txt")), "term", "head") == [
        ("a", "a"), ("b", "b"), ("x", "a"), ("y", "b")]
    (tmp_path / "v.csv").write_text("1,0.5,2\n0,1.5,3\n")
    assert rows(dims.read_vectors(spark, str(tmp_path / "v.csv"), ["a", "b"], "label")) == [(0.0, 1.5, 3.0), (1.0, 0.5, 2.0)]
    (tmp_path / "docs.txt").write_text("one\ntwo\n")
    assert rows(dims.read_documents(spark, str(tmp_path / "docs.txt"))) == [("one",), ("two",)]


def test_versioned_state(spark, rows, tmp_path):
    path = str(tmp_path / "state")
    assert sinks.load_state(spark, path) is None
    assert sinks.load_state(spark, path, schema=RESULT).count() == 0
    one = spark.createDataFrame([(1, 5, 9)], RESULT)
    sinks.save_state(one, path, 0)
    # a version may be derived from the one before it
    sinks.save_state(sinks.load_state(spark, path).selectExpr("site_id", "value + 1 AS value", "mon_time"), path, 1)
    sinks.save_state(sinks.load_state(spark, path, before=1).selectExpr("site_id", "value + 1 AS value", "mon_time"), path, 1)
    assert rows(sinks.load_state(spark, path)) == [(1, 6, 9)]
    assert rows(sinks.load_state(spark, path, before=1)) == [(1, 5, 9)]
    (tmp_path / "state" / "version=7").mkdir()  # unfinished
    assert sinks.versions(spark, path) == [0, 1]


def test_lines_csv_and_series(spark, rows, sightings, tmp_path):
    s = sightings([("D", "O", -50, 5), ("D", "I", -51, 4)])
    sinks.write_lines(s, str(tmp_path / "lines"), ("device", "ts"))
    assert rows(spark.read.text(str(tmp_path / "lines"))) == [("D|4",), ("D|5",)]
    sinks.export_csv(s, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    sinks.write_device_series(s, str(tmp_path / "series"))
    assert [r.ts for r in spark.read.parquet(str(tmp_path / "series")).collect()] == [4, 5]


def test_views_and_pushed_query(spark, sightings):
    sinks.register_views({"readings": sightings([("D", "O", -50, 5)])})
    assert spark.sql("SELECT count(*) FROM readings").first()[0] == 1
    # The subquery is plain SQL; run it here on views of the same names.
    r = spark.createDataFrame([(1, 5, 9), (1, 4, 8), (2, 3, 1)], RESULT)
    sinks.register_views({"result_rows": r})
    got = spark.sql(f"SELECT * FROM {latest_per_site_query('result_rows')} ORDER BY site_id").collect()
    assert [tuple(x) for x in got] == [(1, 5), (2, 3)]
    assert spark.sql(f"SELECT * FROM {latest_per_site_query('result_rows', newer_than=1)}").count() == 1


def test_time_columns(spark):
    x = spark.range(1).select(
        clock.day_epoch("2017-05-02").alias("d"),
        clock.bucket_index(clock.F.lit(1493654400 + 601), 1493654400).alias("b"),
        clock.local_text(clock.F.lit(1493654400)).alias("t"),
        (clock.today_epoch() - clock.today_epoch(days_back=1)).alias("day"),
        strings.strip_chars(clock.F.lit("[a,b]"), "[]").alias("s"),
        strings.bracket_fields(clock.F.lit("[a,b]")).alias("f")).first()
    assert (x.d, x.b, x.t, x.day, x.s, x.f) == (1493654400, 2, "2017-05-02 00:00:00", 86400, "a,b", ["a", "b"])
    days = [str(r.day) for r in clock.date_range(spark, "2017-02-27", 3).collect()]
    assert days == ["2017-02-27", "2017-02-28", "2017-03-01"]


@pytest.mark.parametrize("n, width", [(1, 1), (2, 1), (5, 3), (8, 3)])
def test_position_codes(spark, rows, n, width):
    got = rows(quality.position_codes(spark.range(n).selectExpr("id * 10 AS line_no")), "number", "code")
    assert got == [(i, format(i, "b").zfill(width)) for i in range(1, n + 1)]


def test_landing_a_batch_again_replaces_it(spark, rows, sightings, tmp_path):
    lake = str(tmp_path / "lake")
    scans.land(sightings([("D", "O", -50, 5), ("D", "O", -51, 6)]), lake, batch_id=0)
    scans.land(sightings([("E", "O", -52, 7), ("E", "I", -52, 90000)]), lake, batch_id=1)
    scans.land(sightings([("E", "O", -52, 7), ("E", "I", -52, 90000)]), lake, batch_id=1)
    assert rows(scans.read_lake(spark, lake), "device", "ts", "batch") == [
        ("D", 5, 0), ("D", 6, 0), ("E", 7, 1), ("E", 90000, 1)]
    assert rows(scans.read_lake(spark, lake, "1970-01-02"), "ts", "ap") == [(90000, "I")]


def test_series_table_is_read_without_a_shuffle(spark, rows, sightings):
    from footfall.operators import signal

    data = [(f"D{i % 7}", "OI"[i % 2], -40.0 - i % 5, i // 3) for i in range(200)]
    sinks.write_series_table(sightings(data), "series_test", 4)
    means = signal.mean_rssi(spark.table("series_test"))
    assert "Exchange" not in means._jdf.queryExecution().executedPlan().toString()
    assert rows(means) == rows(signal.mean_rssi(sightings(data)))
