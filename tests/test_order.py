import pytest

from footfall.operators import order, signal
from footfall.sources.scans import last_days


def test_first_last_top(spark, rows):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k STRING, t BIGINT, v STRING")
    assert rows(order.first_by(df, ["k"], "t", ["v"]), "k", "v") == [("a", "y"), ("b", "z")]
    assert rows(order.last_by(df, ["k"], "t", ["v"]), "k", "v") == [("a", "x"), ("b", "z")]
    assert [r.t for r in order.top_rows(df, ["t"], 2).collect()] == [1, 2]
    assert [r.t for r in order.sorted_output(df, ["t"]).collect()] == [1, 2, 3]


@pytest.mark.parametrize("segment", [1, 3, 1 << 20])
def test_file_runs_are_cut_by_any_other_device(sightings, rows, segment):
    s = sightings([("D", "O", -50, 0), ("D", "O", -95, 0), ("D", "O", -53, 0), ("E", "O", -95, 0), ("D", "O", -60, 0)])
    got = signal.run_mean(s, within=("ap",), changes=("device", "ts"), floor=-90, segment=segment)
    assert rows(got, "run_seq", "device", "rssi", "n") == [(0, "D", -52.0, 2), (4, "D", -60.0, 1)]


def test_last_days():
    assert last_days("2017-05-02", 3) == ("2017-04-30", "2017-05-02")
