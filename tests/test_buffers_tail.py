"""Buffers of readings against a plain version, and the source that follows growing files."""

import random
import uuid

import pandas as pd
import pytest

from footfall.streaming import buffers, jobs, tail
from footfall.streaming.sources import stream_tail, tail_lines


def plain_buffers(readings, idle, watermark):
    """[(site, device, ap, first, ts, rssi)] of buffers whose idle time is over at the watermark."""
    out, by = [], {}
    for site, device, ap, ts, rssi in readings:
        by.setdefault((site, device, ap), []).append((ts, rssi))
    for key, found in by.items():
        found.sort()
        runs = [[found[0]]]
        for a, b in zip(found, found[1:]):
            if b[0] - a[0] > idle:
                runs.append([])
            runs[-1].append(b)
        out += [(*key, r[0][0], t, x) for r in runs if r[-1][0] + idle <= watermark for t, x in r]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_buffers_over_random_batches(spark, tmp_path, seed):
    """Readings out of order within the delay, equal times, gaps just at the idle time, restarts between batches."""
    rng = random.Random(seed)
    data = [(1, rng.choice(["A", "B", None]), "O", rng.randrange(1000, 20_000, 50), float(-rng.randint(40, 60))) for _ in range(150)]
    data += [(2, "C", "P", t, -50.0) for t in (1000, 1300, 1601, 1901)]
    data.sort(key=lambda r: r[3] + rng.randint(0, 199))
    data.append((9, "Z", "O", 30_000, -50.0))
    schema = "site_id INT, device STRING, ap STRING, ts BIGINT, rssi DOUBLE"
    folder, out, cp = (str(tmp_path / uuid.uuid4().hex) for _ in range(3))
    for i in range(3):
        part = data[len(data) * i // 3:len(data) * (i + 1) // 3]
        spark.createDataFrame([*part, (1, "N", "O", None, -1.0)], schema).coalesce(1).write.mode("append").parquet(folder)
        s = spark.readStream.schema(schema).parquet(folder)
        jobs.stream_buffers(s, out, cp, 300, "200 seconds").awaitTermination()
    got = sorted((tuple(r) for r in spark.read.schema(buffers.BUFFERED).parquet(out).collect()), key=str)
    assert got == plain_buffers(data, 300, 30_000 - 200)
    assert len({r[3] for r in got if r[0] == 2}) == 2  # the gap of 301 seconds parts them, that of 300 does not


@pytest.mark.parametrize("long_stays", [False, True])
def test_buffers_need_no_python_unless_stays_are_long(spark, tmp_path, long_stays):
    schema = "site_id INT, device STRING, ap STRING, ts BIGINT, rssi DOUBLE"
    data = [(1, "A", "O", 20, -51.0), (1, "A", "O", 20, None), (1, "A", "O", 10, -52.0), (1, "A", "O", 31, -53.0), (1, "B", "O", 9000, -50.0)]
    folder, out, cp = (str(tmp_path / uuid.uuid4().hex) for _ in range(3))
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(folder)
    q = jobs.stream_buffers(spark.readStream.schema(schema).parquet(folder), out, cp, 10, "200 seconds", long_stays=long_stays)
    q.awaitTermination()
    ran = {op["operatorName"] for p in q.recentProgress for op in p["stateOperators"]}
    assert any("Pandas" in name for name in ran) == long_stays, ran
    got = [tuple(r) for r in spark.read.schema(buffers.BUFFERED).parquet(out).coalesce(1).collect()]
    buffer = [(1, "A", "O", 10, 10, -52.0), (1, "A", "O", 10, 20, None), (1, "A", "O", 10, 20, -51.0)]
    assert [r for r in got if r[3] == 10] == buffer and len(got) == 4


class Handle:
    """Lists and timers of one key, in memory."""

    def __init__(self):
        self.lists, self.timers = {}, set()

    def getListState(self, name, schema):
        held = self.lists.setdefault(name, [])

        class State:
            def get(self):
                return iter(list(held))

            def appendList(self, rows):
                held.extend(rows)

            def put(self, rows):
                held[:] = rows

            def clear(self):
                held.clear()
        return State()

    def registerTimer(self, t):
        assert t not in self.timers
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.remove(t)


def test_a_late_reading_joins_two_buffers_and_long_ones_come_in_pieces():
    handle, p = Handle(), buffers.IdleBuffer(10, piece=4)
    p.init(handle)

    def put(*ts):
        assert list(p.handleInputRows((1, "A", "O"), iter([pd.DataFrame({"ts": ts, "rssi": [-1.0] * len(ts)})]), None)) == []

    def fire(ms):
        handle.timers.remove(ms)
        info = type("Info", (), {"getExpiryTimeInMs": lambda self: ms})()
        return list(p.handleExpiredTimer((1, "A", "O"), None, info))

    put(0, 5)
    put(20, 100)
    assert handle.timers == {15_000, 30_000, 110_000}
    put(12)
    assert handle.timers == {30_000, 110_000}
    frames = fire(30_000)
    assert [f["ts"].tolist() for f in frames] == [[0, 5, 12, 20]] and handle.lists["readings"] == [(100, -1.0)]
    put(*range(101, 110))
    assert [f["ts"].tolist() for f in fire(119_000)] == [[100, 101, 102, 103], [104, 105, 106, 107], [108, 109]]
    assert handle.lists == {"readings": [], "spans": []} and not handle.timers


def follow(spark, df, tmp_path, name):
    out, cp = str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-cp")
    jobs.stream_to(df, out, cp).awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(df.schema).parquet(out).collect())


def test_tail_follows_open_files(spark, tmp_path):
    """History is skipped, lines without their break are held back, each start goes on where the last one ended."""
    root = tmp_path / "scans"
    (root / "A1").mkdir(parents=True)
    (root / "A2").mkdir()

    def run():
        df = stream_tail(spark, str(root)).selectExpr("device", "rssi", "ts", "ap", "CAST(day AS STRING) AS day")
        return follow(spark, df, tmp_path, "tail")

    with open(root / "A1" / "20240115", "wb", buffering=0) as f:
        f.write(b"OLD|-40|1\nHALF|-4")
        assert run() == []
        f.write(b"1|2\nNEW|-42|3\r\nbroken\nOPEN|-43")
        (root / "A2" / "20240116").write_bytes(b"B|-50|9\n")
        (root / "A2" / ".20240116.crc").write_bytes(b"X|-50|9\n")
        first = [("B", -50.0, 9, "A2", "2024-01-16"), ("HALF", -41.0, 2, "A1", "2024-01-15"), ("NEW", -42.0, 3, "A1", "2024-01-15")]
        assert run() == first
        assert run() == first  # nothing new, nothing twice
        f.write(b"|4\n")
        assert run() == sorted([*first, ("OPEN", -43.0, 4, "A1", "2024-01-15")])
    (root / "A2" / "20240116").write_bytes(b"C|-1|1\n")  # replaced by a shorter one
    assert run() == sorted([*first, ("OPEN", -43.0, 4, "A1", "2024-01-15"), ("C", -1.0, 1, "A2", "2024-01-16")])


def test_tail_names_and_history(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    (root / "20240115").write_text("a\nb\n")
    (root / "20240116").write_text("c\n")
    assert [r[2] for r in follow(spark, tail_lines(spark, str(root), "20240115*", history=True), tmp_path, "h")] == ["a", "b"]
    assert follow(spark, tail_lines(spark, str(tmp_path / "none")), tmp_path, "n") == []


@pytest.mark.parametrize("stretch, block", [(1, 1), (7, 3), (64, 16), (1 << 20, 1 << 20)])
def test_stretches_cover_every_line_once(tmp_path, monkeypatch, stretch, block):
    monkeypatch.setattr(tail, "BLOCK", block)
    rng = random.Random(stretch)
    lines = ["x" * rng.choice([0, 1, 5, 40]) + "é" * rng.randint(0, 2) for _ in range(60)]
    data = "".join(f"{x}\n" for x in lines).encode()
    (tmp_path / "f").write_bytes(data + b"rest")
    reader = tail.TailReader({"path": str(tmp_path), "stretch": stretch})
    end = reader.latestOffset()
    assert list(end.values()) == [len(data)] and reader.initialOffset() == end
    for begin in (0, len(lines[0].encode()) + 1, len(data)):
        parts = reader.partitions({p: begin for p in end}, end)
        got = sorted((s, v) for p in parts for b in reader.read(p) for s, v in zip(b["start"].to_pylist(), b["value"].to_pylist()))
        assert [v for _, v in got] == data[begin:].decode().split("\n")[:-1]
        assert all(data[s:].startswith(v.encode() + b"\n") for s, v in got)
