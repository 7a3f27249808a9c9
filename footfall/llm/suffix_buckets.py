"""Suffix dedup by bucket refinement: remove what starts, as a string of `LENGTH` bytes, in an earlier document too.

Positions are put into buckets by a q-gram, buckets are refined by sorting on identifiers of what lies at other
offsets, and only buckets that stay undecided are refined again; what is known of one member serves all that sort equal.

1. The bucket of a string is the smallest-hashing `GRAM`-byte gram within it, so neighbouring strings share one: a run.
   About one in sixteen positions starts a run.
2. Within a bucket, runs are sorted by an identifier of their bytes. A run that sorts equal to one of an earlier
   document goes as a whole, a bucket of one class keeps its first, and only the first runs of buckets with several
   classes stay undecided: the ends of repeated passages.
3. These are refined by the identifiers of each of their strings.

Texts are kept in chunks; what travels between chunks and buckets are packed arrays, a few bytes per run. Identifiers are 64-bit
hashes; classes of a bucket compare by 48 bits of theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import rows_of, stored
from footfall.llm.shingles import _BACK, _STEP, _TABLE, _powers, mixed

LENGTH, GRAM = 50, 20
CHUNK_BYTES = 1 << 21
# Bytes of text whose runs one task of step 2 sorts.
BUCKET_BYTES = 1 << 25
_BLOCK = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)
_LAST = np.int64(2 ** 63 - 1)
_CHUNK = "chunk BIGINT, doc_ids ARRAY<BIGINT>, sizes ARRAY<INT>, data BINARY"


def _chunks(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[bytes] = []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "chunk": pa.array([at], pa.int64()), "doc_ids": pa.array([ids], pa.list_(pa.int64())),
                "sizes": pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), "data": pa.array([b"".join(texts)], pa.binary())})

        held = 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text.encode())
                held += len(texts[-1])
                if held >= CHUNK_BYTES:
                    yield row()
                    ids, texts, held, at = [], [], 0, at + 1
        if ids:
            yield row()

    return rows_of(docs).mapInArrow(run, _CHUNK)


class Hashes:
    """Hashes of any stretch of a byte string, from running sums."""

    def __init__(self, data: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * _powers(_STEP, max(len(data) - 1, 0))[:len(data)])])
        self.back = _powers(_BACK, len(data))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.back[start])

    def all(self, start: int, stop: int, size: int) -> np.ndarray:
        return mixed((self.sums[start + size:stop + size] - self.sums[start:stop]) * self.back[start:stop])


class Runs:
    """The runs of a chunk: strings first..last (starts) of document `doc` around the gram at `at`."""

    def __init__(self, sizes: np.ndarray, raw: bytes, length: int, gram: int):
        self.data = np.frombuffer(raw, np.uint8)
        self.ends = np.cumsum(sizes, dtype=np.int64)
        self.length = length
        self.hashes = Hashes(self.data)
        n = max(len(self.data) - length + 1, 0)
        at = np.empty(n, np.int64)
        for begin in range(0, n, _BLOCK):  # the place within a block breaks ties: leftmost
            end = min(begin + _BLOCK, n)
            grams = self.hashes.all(begin, end + length - gram, gram)
            low = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
            step, window = 1, length - gram + 1
            while 2 * step <= window:
                low = np.minimum(low[:-step], low[step:])
                step *= 2
            low = np.minimum(low[:end - begin], low[window - step:window - step + end - begin])
            at[begin:end] = (low & _PLACE).astype(np.int64) + begin
        starts = np.arange(n)
        doc = np.searchsorted(self.ends, starts, "right")
        valid = starts + length <= self.ends[doc] if n else np.zeros(0, bool)
        starts, at, doc = starts[valid], at[valid], doc[valid]
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        self.first, self.at, self.doc = starts[first], at[first], doc[first]
        self.last = starts[np.append(first[1:], len(starts)) - 1] if len(starts) else starts
        self.bucket = mixed(self.hashes.of(self.at, self.at + gram) ^ np.uint64(0xA0761D6478BD642F))
        self.region = mixed(self.hashes.of(self.first, self.last + length) + (self.at - self.first).astype(np.uint64)
                            ^ mixed((self.last - self.first).astype(np.uint64)))

    def part(self, parts: int) -> np.ndarray:
        return (self.bucket % np.uint64(parts)).astype(np.int64)


def _each(batches: Iterator[pa.RecordBatch], length: int, gram: int):
    """Chunk rows with their runs and doc_ids (null: after all others)."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.array([_LAST if i is None else i for i in row["doc_ids"]], np.int64)
            yield row, ids, Runs(np.array(row["sizes"], np.int64), row["data"], length, gram)


def _entries(chunks: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    """Per chunk and part of the buckets: packed (bucket, region, document) of its runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids, runs in _each(batches, length, gram):
            part = runs.part(parts)
            out = []
            for p in np.unique(part):
                mine = part == p
                docs, count = np.unique(runs.doc[mine], return_counts=True)
                out.append((row["chunk"], int(p), (runs.bucket[mine] >> np.uint64(32)).astype("<u4").tobytes(),
                            (runs.region[mine] >> np.uint64(32)).astype("<u4").tobytes(), runs.region[mine].astype("<u2").tobytes(),
                            ids[docs].astype("<i8").tobytes(), count.astype("<u4").tobytes()))
            if out:
                names = ["chunk", "part", "bucket", "high", "low", "docs", "counts"]
                types = [pa.int64(), pa.int32()] + [pa.binary()] * 5
                yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(names, zip(*out, strict=True), types, strict=True)})

    return chunks.mapInArrow(run, "chunk BIGINT, part INT, bucket BINARY, high BINARY, low BINARY, docs BINARY, counts BINARY")


def _decide(entries: DataFrame) -> DataFrame:
    """Per chunk and part one byte per run: 0 stays, 1 goes, 2 undecided."""
    def refine(table: pa.Table) -> pa.Table:
        x = {c: table[c].to_pylist() for c in table.column_names}
        bucket, high, low = (np.frombuffer(b"".join(x[c]), t) for c, t in (("bucket", "<u4"), ("high", "<u4"), ("low", "<u2")))
        region = high.astype(np.uint64) << np.uint64(16) | low
        doc = np.repeat(np.frombuffer(b"".join(x["docs"]), "<i8"), np.frombuffer(b"".join(x["counts"]), "<u4"))
        order = np.lexsort((doc, region, bucket))
        b, r, d = bucket[order], region[order], doc[order]
        new_bucket = np.concatenate([[True], b[1:] != b[:-1]])
        new_class = new_bucket | np.concatenate([[True], r[1:] != r[:-1]])
        of_class = np.cumsum(new_class) - 1
        first_doc = d[new_class]
        of_bucket = (np.cumsum(new_bucket) - 1)[new_class]
        starts = np.flatnonzero(np.concatenate([[True], of_bucket[1:] != of_bucket[:-1]]))
        open_ = np.minimum.reduceat(first_doc, starts) < np.maximum.reduceat(first_doc, starts)
        state = np.empty(len(d), np.uint8)
        state[order] = np.where(d > first_doc[of_class], 1, np.where(open_[of_bucket][of_class], 2, 0))
        cuts = np.cumsum([0] + [len(v) // 4 for v in x["bucket"]])
        return pa.table({"chunk": pa.array(x["chunk"], pa.int64()), "part": pa.array(x["part"], pa.int32()),
                         "state": pa.array([state[a:z].tobytes() for a, z in zip(cuts, cuts[1:], strict=False)], pa.binary())})

    return entries.groupBy("part").applyInArrow(refine, "chunk BIGINT, part INT, state BINARY")


def _states(row: dict, runs: Runs, parts: int) -> np.ndarray:
    part = runs.part(parts)
    out = np.zeros(len(part), np.uint8)
    for s in row["states"] or []:
        out[part == s["part"]] = np.frombuffer(s["state"], np.uint8)
    return out


def _open_runs(base: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    """The undecided runs with their bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids, runs in _each(batches, length, gram):
            which = np.flatnonzero(_states(row, runs, parts) == 2)
            if len(which):
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(runs.bucket[which].view(np.int64)), "chunk": pa.array(np.full(len(which), row["chunk"], np.int64)),
                    "run": pa.array(which, pa.int32()), "doc": pa.array(ids[runs.doc[which]]),
                    "bytes": pa.array([row["data"][a:z + length] for a, z in zip(runs.first[which], runs.last[which], strict=True)], pa.binary())})

    return base.mapInArrow(run, "bucket BIGINT, chunk BIGINT, run INT, doc BIGINT, bytes BINARY")


def _refine_strings(rows: DataFrame, length: int) -> DataFrame:
    """chunk, run, mask: a bit for each string of the run that an earlier document has."""
    def decide(table: pa.Table) -> pa.RecordBatch:
        raw = table["bytes"].to_pylist()
        sizes = np.array([len(r) for r in raw], np.int64)
        hashes = Hashes(np.frombuffer(b"".join(raw), np.uint8))
        count = sizes - length + 1
        of = np.repeat(np.arange(len(raw)), count)
        place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        start = (np.cumsum(sizes) - sizes)[of] + place
        key = mixed(hashes.of(start, start + length) ^ table["bucket"].to_numpy().view(np.uint64)[of])
        doc = table["doc"].to_numpy()[of]
        order = np.lexsort((doc, key))
        k, d = key[order], doc[order]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        gone = np.empty(len(of), bool)
        gone[order] = d > d[new][np.cumsum(new) - 1]
        mask = np.bitwise_or.reduceat(gone.astype(np.int64) << place, np.cumsum(count) - count)
        return pa.RecordBatch.from_pydict({"chunk": table["chunk"].combine_chunks(), "run": table["run"].combine_chunks(), "mask": pa.array(mask)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= 50_000:
                table = pa.Table.from_batches(held)
                bucket = table["bucket"].to_numpy()
                whole = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
                if whole:
                    yield decide(table.slice(0, whole))
                    held = table.slice(whole).to_batches()
        if held:
            yield decide(pa.Table.from_batches(held))

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "chunk BIGINT, run INT, mask BIGINT")


def _removed(base: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, runs in _each(batches, length, gram):
            state = _states(row, runs, parts)
            gone = np.zeros(len(runs.data) + 1, np.int32)
            whole = state == 1
            np.add.at(gone, runs.first[whole], 1)
            np.add.at(gone, runs.last[whole] + length, -1)
            for m in row["masks"] or []:
                bits = np.flatnonzero((m["mask"] >> np.arange(64)) & 1) + runs.first[m["run"]]
                np.add.at(gone, bits, 1)
                np.add.at(gone, bits + length, -1)
            cover = np.cumsum(gone)[:-1] > 0
            out = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
            for doc_id, size, end in zip(row["doc_ids"], row["sizes"], runs.ends, strict=True):
                mine = cover[end - size:end]
                out["doc_id"].append(doc_id)
                out["n_bytes"].append(size)
                out["n_removed"].append(int(mine.sum()))
                out["n_spans"].append(int(mine[:1].sum()) + int((mine[1:] & ~mine[:-1]).sum()))
                out["kept"].append(runs.data[end - size:end][~mine].tobytes())
            types = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True)})

    return base.mapInArrow(run, "doc_id BIGINT, n_bytes BIGINT, n_removed BIGINT, n_spans BIGINT, kept BINARY")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every row of docs.

    A byte goes if a string of `length` bytes over it also starts in a document with a smaller doc_id. Null texts
    count as empty. Rows with one doc_id do not remove from each other; a null doc_id comes after all others. Texts
    shorter than `length` stay. An empty table gives no rows. At most 64 strings share a gram: length - gram < 64.
    """
    chunks = stored(_chunks(docs), "chunks", "zstd")
    total = chunks.select(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, s: a + s).alias("n")).agg(F.sum("n")).first()[0] or 0
    parts = total // BUCKET_BYTES + 1
    state = stored(_decide(_entries(chunks, parts, length, gram)), "run-states", "zstd")
    states = state.groupBy("chunk").agg(F.collect_list(F.struct("part", "state")).alias("states"))
    # one shuffle of the chunks serves the undecided runs and the removal (Spark reuses the exchange)
    base = chunks.join(states, "chunk", "left").select("chunk", "doc_ids", "sizes", "data", "states")
    masks = _refine_strings(_open_runs(base, parts, length, gram), length).where("mask != 0")
    masks = masks.groupBy("chunk").agg(F.collect_list(F.struct("run", "mask")).alias("masks"))
    return _removed(base.join(masks, "chunk", "left"), parts, length, gram)
