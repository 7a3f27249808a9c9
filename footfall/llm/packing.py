"""Best-fit packing of token pieces into sequences: best-two-fit.

A bin is opened with the longest piece left and filled greedily, each time with the longest piece that fits. If a gap
remains, the bin's smallest piece is exchanged for the two unpacked pieces that fill the expanded gap most tightly.

What a bin holds depends on lengths only. So the plan is made on the driver from the number of pieces of each length
(at most `capacity` numbers, whatever the corpus): a way to fill a bin is repeated as often as the counts allow. Tasks
then number the pieces of each length and look up their place in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import rows_of, stored
from footfall.llm.word_bpe import WordEncoder

CAPACITY = 4096
BUCKET_PIECES = 100_000
_PIECES = "doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT"


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(bins, [(length, pieces per bin), ..]), ..] that uses exactly `counts` pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = []
    sizes = np.arange(capacity + 1)
    while (open_ := int(np.max(np.where(left > 0, sizes, 0)))) > 0:
        one: dict[int, int] = {}

        def take(length: int, n: int, one: dict[int, int] = one) -> None:
            one[length] = one.get(length, 0) + n
            left[length] -= n

        take(open_, 1)
        gap = capacity - open_
        while gap and (fit := int(np.max(np.where(left[:gap + 1] > 0, sizes[:gap + 1], 0)))):
            n = min(int(left[fit]), gap // fit)
            take(fit, n)
            gap -= fit * n
        small = min(one)
        if gap and len(one) > 1 and (two := _two(left, gap + small, small)):
            take(small, -1)
            if not one[small]:
                del one[small]
            for length in two:
                take(length, 1)
        for length, n in one.items():
            left[length] += n
        times = min(int(left[length]) // n for length, n in one.items())
        for length, n in one.items():
            left[length] -= times * n
        plan.append((times, sorted(one.items(), reverse=True)))
    return plan


def _two(left: np.ndarray, room: int, small: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum that is at most room and over small."""
    room = min(room, len(left) - 1)
    sizes = np.arange(room + 1)
    floor = np.maximum.accumulate(np.where(left[:room + 1] > 0, sizes, 0))
    first = sizes[(left[:room + 1] > 0) & (sizes > 0)]
    second = floor[room - first]
    alone = (second == first) & (left[first] < 2)
    second = np.where(alone, floor[first - 1], second)
    total = np.where(second > 0, first + second, 0)
    if not len(total) or total.max() <= small:
        return None
    best = int(np.argmax(total))
    return int(first[best]), int(second[best])


def slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first number, pieces per bin, first bin, offset), by length and number."""
    rows, given, bins = [], {}, 0
    for times, bin_ in plan:
        offset = 0
        for length, n in bin_:
            rows.append((length, given.get(length, 0), n, bins, offset))
            given[length] = given.get(length, 0) + times * n
            offset += length * n
        bins += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, vocabulary_path: str, end_id: int | None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of the pieces; null text counts as empty."""
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    end = [] if end_id is None else [end_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(shared.value)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"].to_pylist()), strict=True):
                raw = np.append(ids, end).astype("<u4").tobytes()
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at:at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            if rows:
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(
                    names[:5 + keep_ids], columns[:5 + keep_ids], types[:5 + keep_ids], strict=True)})

    return rows_of(docs).mapInArrow(run, _PIECES + ", ids BINARY" * keep_ids)


def pack(docs: DataFrame, vocabulary_path: str, end_id: int | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset. Only documents longer than capacity are cut.

    Repeated rows are packed each; a document without ids (no end_id, no text) has no piece; an empty table gives none.
    """
    cut = stored(pieces(docs, vocabulary_path, end_id, capacity, keep_ids), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # (length, first number) in one key; numbers stay below 2 ** 40
    table = slots(best_two_fit(counts, capacity))
    shared = docs.sparkSession.sparkContext.broadcast((table[:, 0] << 40 | table[:, 1], table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = shared.value
        for batch in batches:
            length, number = batch["length"].to_numpy(), batch["number"].to_numpy()
            _, first, per_bin, bin_, offset = rows[np.searchsorted(keys, length << 40 | number, "right") - 1].T
            out = {c: batch[c] for c in names}
            out["sequence_id"] = pa.array(bin_ + (number - first) // per_bin, pa.int64())
            out["offset"] = pa.array(offset + (number - first) % per_bin * length, pa.int64())
            yield pa.RecordBatch.from_pydict(out)

    names = cut.columns
    numbered = _numbered(cut, sum(counts.values()))
    return numbered.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
                               + ", sequence_id BIGINT, offset BIGINT")


def _numbered(cut: DataFrame, total: int) -> DataFrame:
    """The pieces with `number`, 0, 1, .. within their length. Numbers are given per bucket of bounded size."""
    buckets = -(-total // BUCKET_PIECES) or 1
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    base = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("base"))
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    own = cut.withColumn("place", place.cast("long"))
    return own.join(base, ["length", "bucket"]).withColumn("number", F.col("base") + F.col("place") - 1).drop("bucket", "base", "place")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids of each sequence, from pack(.., keep_ids=True)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.transform(parts, lambda p: p["ids"]), F.lit(b""), lambda a, b: F.concat(a, b))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
