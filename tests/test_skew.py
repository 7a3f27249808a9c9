"""Queries on tables in which one device, one instant and one access point hold a third of all rows."""

import os
import shutil
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from compare import compare, connect

SMALL = "/root/testdata/sf0.001"
NAMES = [
    "net_flow", "come_go_window", "occupancy", "side_moves", "prev_point", "trajectory", "trajectory_by_side",
    "rssi_peaks", "run_mean", "run_mean_by_ap", "row_numbers", "sessions", "time_slices", "short_sessions",
    "visit_classes", "flow_by_bucket", "interval_buckets", "peak_intervals", "duplicate_readings",
    "visit_tracker_first", "visit_tracker_reopen", "traffic_5min", "always_on_per_ap", "drop_static",
    "multi_ap", "peak_rssi_histogram", "latest_per_site", "device_buffer", "stream_traffic", "stream_occupancy",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("skewed"))
    for f in os.listdir(SMALL):
        if f != "events.parquet":
            shutil.copyfile(f"{SMALL}/{f}", f"{folder}/{f}")
    con = connect(SMALL)
    con.execute(f"""COPY (SELECT event_id,
        CASE WHEN event_id % 9 = 0 THEN TIMESTAMP '2024-01-12 03:04:05' ELSE ts END AS ts,
        CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id, event_type, value,
        CASE WHEN event_id % 6 = 0 THEN '{{"k": 5}}' ELSE props END AS props
        FROM events) TO '{folder}/events.parquet' (FORMAT parquet)""")
    return folder


@pytest.fixture(scope="module")
def con(skewed):
    return connect(skewed)


@pytest.mark.parametrize("name", NAMES)
def test_skewed(spark, con, skewed, name):
    ok, note = compare(spark, con, name, skewed)
    assert ok, note


def test_no_task_gets_a_whole_hot_device(spark):
    """The ordered part of a hot device is spread over its segments."""
    from pyspark.sql import functions as F

    from footfall.operators.sequence import in_order
    df = spark.range(40000).select(F.lit("hot").alias("k"), F.col("id").alias("ts"), F.rand(1).alias("v"))
    spread = in_order(df, ["k"], prev={"p": "v"}, segment=1000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == 40000 and max(sizes) < 40000 / 3
