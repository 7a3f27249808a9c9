"""Keyed logs and committed batches over many versions; the jobs that use them."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from footfall.operators import clean
from footfall.plans.jobs import realtime_traffic
from footfall.schema import RESULT
from footfall.sinks import log, tables
from footfall.streaming import jobs
from footfall.streaming.sources import stream_table

SCHEMA = "k STRING, site INT, v BIGINT"
KEYS = ["k", "site"]


def changes(spark, data):
    return spark.createDataFrame(data, SCHEMA + ", _gone BOOLEAN").coalesce(1)


def test_log_over_many_versions(spark, rows, tmp_path):
    """Inserts, changes, deletions, null keys, a repeated version; folders stay few, and a reader outlives a compaction."""
    path, rng, want = str(tmp_path / "log"), random.Random(4), {}
    readers = []
    for v in range(24):
        batch = {}
        for _ in range(4):
            key = (rng.choice(["a", "b", "c", "d", None]), rng.randint(0, 1))
            batch[key] = None if rng.random() < 0.3 else v * 10 + rng.randint(0, 9)
        for _ in range(2 if v in (5, 6) else 1):  # version 5 is the first compaction
            log.save_changes(changes(spark, [(*k, x, x is None) for k, x in batch.items()]), path, v, KEYS, SCHEMA, every=6, keep=2)
        want |= batch
        now = sorted((*k, x) for k, x in want.items() if x is not None and k[0] is not None)
        if v % 3 == 2:
            got = log.load_table(spark, path, KEYS, SCHEMA)
            assert rows(got.where("k IS NOT NULL")) == now
            assert got.where("k IS NULL").count() == sum(k[0] is None and x is not None for k, x in want.items())
        if v == 9:
            readers.append((log.load_table(spark, path, KEYS, SCHEMA), got.where("false"), now))
        if v == 14:  # after the next compaction
            assert rows(readers[0][0].where("k IS NOT NULL")) == readers[0][2]
        assert len(tables.versions(spark, f"{path}/base")) <= 2 and len(tables.versions(spark, f"{path}/log")) <= 12
    assert log.load_table(spark, str(tmp_path / "none"), KEYS, SCHEMA).count() == 0


def test_log_writes_only_what_changed(spark, tmp_path):
    path = str(tmp_path / "log")
    big = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(1).alias("site"), F.col("id").alias("v"))
    log.save_changes(big, path, 0, KEYS, SCHEMA)
    log.save_changes(changes(spark, [("k7", 1, -1, False)]), path, 1, KEYS, SCHEMA)
    assert spark.read.parquet(f"{path}/log/version=1").count() == 1
    assert log.load_table(spark, path, KEYS, SCHEMA).where("v < 0").count() == 1
    assert log.load_table(spark, path, KEYS, SCHEMA, before=1).where("v < 0").count() == 0


def test_a_batch_that_failed_before_its_commit_counts_once(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "results")
    batches = [spark.createDataFrame([(i, i * 10, 5)], RESULT) for i in range(3)]
    assert log.read_batches(spark, path, RESULT).count() == 0
    log.append_batch(batches[0], path, 0)
    with monkeypatch.context() as m:
        m.setattr(log, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            log.append_batch(batches[1], path, 1)
    assert rows(log.read_batches(spark, path, RESULT)) == [(0, 0, 5)]
    for _ in range(2):
        log.append_batch(batches[1], path, 1)
    log._commit(spark, path, 1, "another")  # a slower attempt of the same batch
    log.append_batch(batches[2].limit(0), path, 2)
    assert rows(log.read_batches(spark, path, RESULT)) == [(0, 0, 5), (1, 10, 5)]


def test_snapshots_are_retired(spark, tmp_path):
    path = str(tmp_path / "state")
    for v in range(6):
        tables.save_state(spark.range(v), path, v, keep=3)
    assert tables.versions(spark, path) == [3, 4, 5] and tables.load_state(spark, path).count() == 5


def test_refresh_over_many_batches(spark, dim, rows, tmp_path):
    """Each version equals the batch job over all readings so far; the state stays one row per site."""
    rng = random.Random(8)
    data = sorted(((rng.choice("ABCDE"), rng.choice("OIPJX"), float(rng.randint(-95, -40)), 90_000 + rng.randrange(0, 4000)) for _ in range(150)), key=lambda r: r[3])
    data += [("Z", "P", -50.0, 200_000)]
    schema = "device STRING, ap STRING, rssi DOUBLE, ts BIGINT"
    folder, out, cp = (str(tmp_path / uuid.uuid4().hex) for _ in range(3))
    cuts = [0, 20, 21, 60, 90, 150, 151]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        spark.createDataFrame(data[a:b], schema).coalesce(1).write.mode("append").parquet(folder)
        jobs.refresh_traffic(stream_table(spark, folder, schema), dim, out, cp, mon_time=lambda b: 0).awaitTermination()
        so_far = spark.createDataFrame(data[:b], schema)
        day = clean.filter_rssi(so_far).agg(F.max(F.col("ts") + 28800)).first()[0] // 86400
        want = realtime_traffic(so_far.where((F.col("ts") + 28800) / 86400 >= day), dim, mon_time=0)
        assert rows(tables.load_state(spark, out), "site_id", "value") == rows(want, "site_id", "value")
        assert tables.load_state(spark, f"{out}/_latest").count() <= 2


def test_ab_test_stops(spark, tmp_path):
    """By its p-value, for good; by the number of versions; not at all where the groups are alike."""
    def run(second, name, **rule):
        folder, out, cp = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "cp"))
        schema = "label STRING, value DOUBLE"
        for i in range(5):
            part = [("a", float(j % 7)) for j in range(20)] + [("b", second(j)) for j in range(20)]
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        s = stream_table(spark, folder, schema, files_per_trigger=1)
        found = [jobs.run_ab_test(s, "a", "b", out, cp, poll_seconds=0.1, **rule) for _ in range(2)]
        assert found[0] == found[1]
        return found[0], len(tables.versions(spark, out))

    assert run(lambda j: float(j % 7) + 9, "far") == (True, 1)
    assert run(lambda j: float(j % 7), "alike", most_batches=3) == (False, 3)
    assert run(lambda j: float(j % 7), "whole") == (False, 5)


def test_always_on_day_by_day(spark, rows, tmp_path):
    """After each batch the list equals the batch operator over all readings; bits of days that are over are gone."""
    from footfall.operators import traffic

    rng = random.Random(3)
    data = sorted(((rng.choice("ABCD"), rng.choice("OI"), -50.0, rng.randrange(0, 4 * 86400)) for _ in range(260)), key=lambda r: r[3])
    schema = "device STRING, ap STRING, rssi DOUBLE, ts BIGINT"
    folder, out, cp = (str(tmp_path / uuid.uuid4().hex) for _ in range(3))
    for a, b in ((0, 70), (70, 140), (140, 260)):
        spark.createDataFrame(data[a:b], schema).coalesce(1).write.mode("append").parquet(folder)
        jobs.stream_always_on(stream_table(spark, folder, schema), out, cp, hours=7).awaitTermination()
        assert rows(jobs.load_static(spark, out)) == rows(traffic.always_on_devices(spark.createDataFrame(data[:b], schema), hours=7))
        left = log.load_table(spark, f"{out}/hours", jobs.HOUR_KEYS, jobs.HOUR_BITS)
        assert left.select("day").distinct().count() == 1 and left.count() <= 8
    assert jobs.load_static(spark, out).count() > 0


@pytest.mark.parametrize("cuts", [(0, 40), (0, 1, 2, 40), (0, 13, 13, 29, 40)])
def test_moments_do_not_depend_on_the_cuts(spark, cuts):
    from footfall.operators import stats

    rng = random.Random(1)
    data = [(1e9 + rng.random(), float(i) if i % 3 else None, None) for i in range(40)]
    schema = "a DOUBLE, b DOUBLE, c DOUBLE"
    known = spark.createDataFrame([], stats.MOMENTS)
    for x, y in zip(cuts, cuts[1:]):
        known = stats.merged_moments(known.unionByName(stats.moments(spark.createDataFrame(data[x:y], schema), ["a", "b", "c"])))
    got = {r["column"]: r for r in stats.described(known).collect()}
    for r in stats.describe(spark.createDataFrame(data, schema), ["a", "b", "c"]).collect():
        for c in ("count", "mean", "stddev", "min", "max"):
            assert got[r["column"]][c] == (None if r[c] is None else pytest.approx(r[c], rel=1e-7))
