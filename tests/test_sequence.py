"""Segmented operations must equal plain windows whatever the segment length."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from footfall.operators.sequence import in_order, number_rows


def _data(spark, seed=3):
    rnd = random.Random(seed)
    # One key holds a third of all rows.
    out = [("hot", t, float(rnd.randrange(5)), rnd.random() < .5) for t in rnd.sample(range(2000), 400)]
    for k in range(40):
        out += [(f"k{k}", t, float(rnd.randrange(5)), rnd.random() < .5) for t in rnd.sample(range(2000), 20)]
    return spark.createDataFrame(out, "k STRING, ts BIGINT, v DOUBLE, b BOOLEAN")


@pytest.mark.parametrize("segment", [1, 7, 100, 1999, 10**6])
def test_neighbours_and_runs(spark, rows, segment):
    df = _data(spark)
    args = dict(order="ts", prev={"p_ts": "ts", "p_v": "v", "p_b": "b"}, following={"n_v": "v", "n_ts": "ts"},
                breaks=lambda p, c: (c("ts") - p("ts") > 30) | (p("b") != c("b")), run="run")
    assert rows(in_order(df, ["k"], segment=segment, **args)) == rows(in_order(df, ["k"], segment=None, **args))


@pytest.mark.parametrize("segment", [3, 100, 10**6])
def test_numbering(spark, rows, segment):
    df = _data(spark).select("k", "ts")
    w = Window.partitionBy("k").orderBy("ts")
    assert rows(number_rows(df, ["k"], segment=segment)) == rows(df.withColumn("number", F.row_number().over(w)))
    whole = number_rows(df.select("ts").distinct(), [], segment=segment)
    expected = sorted({r.ts for r in df.collect()})
    assert rows(whole) == [(t, i + 1) for i, t in enumerate(expected)]


def test_null_values_are_not_taken_for_missing_neighbours(spark, rows):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 13, None), ("a", 14, 1.0)],
                               "k STRING, ts BIGINT, v DOUBLE")
    got = rows(in_order(df, ["k"], prev={"p": "v"}, following={"n": "v"}, segment=10), "ts", "p", "n")
    assert got == [(1, None, 5.0), (2, None, None), (13, 5.0, 1.0), (14, None, None)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.integers(0, 60), min_size=1, max_size=15), st.integers(1, 20), st.integers(0, 12))
def test_any_key_any_segment(spark, rows, times, segment, gap):
    df = spark.createDataFrame([("a", t) for t in times], "k STRING, ts BIGINT")
    got = rows(in_order(df, ["k"], prev={"p": "ts"}, breaks=lambda p, c: c("ts") - p("ts") > gap,
                        run="run", segment=segment), "ts", "p", "run")
    want, last, start = [], None, None
    for t in sorted(times):
        start = t if last is None or t - last > gap else start
        want.append((t, last, start))
        last = t
    assert got == want


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_extra_shuffle_of_the_large_side(spark):
    """Without broadcasting: inside one (keys, segment) shuffle, sort, window, join and window again."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = _data(spark).where("v >= 0")
        plan = _physical(in_order(df, ["k"], prev={"p": "v"}, breaks=lambda p, c: c("ts") - p("ts") > 3, segment=50))
        # large side, summary per key, summary per (key, segment); the second
        # read of the large side reuses the first shuffle
        assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 4
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
