"""Token ids in files: canonical length-limited Huffman codes from global counts, independent blocks.

`write` tokenises documents, counts ids over all of them, builds one canonical code and writes two tables below a
folder: `codes` (one row) and `blocks`. A block holds consecutive documents in ascending doc_id order: their ids, and
counts, the code words of their tokens, and the bit offset of every `STEP`-th token. `read` decodes blocks on their
own: between checkpoints, all stretches of a block advance together through the decoding table.

What reaches the driver is one count per id of the vocabulary, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.llm.common import rows_of, stored
from footfall.llm.word_bpe import WordEncoder
from footfall.session import fresh_path

BLOCK_TOKENS = 1 << 18
STEP = 256
MAX_BITS = 16
# Small batches of texts are joined up to so many bytes before they are encoded.
JOINED_BYTES = 3 << 20
_BLOCKS = ("part INT, block INT, before BIGINT, tokens BIGINT, doc_ids ARRAY<BIGINT>, n_tokens ARRAY<INT>, "
           "checkpoints BINARY, payload BINARY")


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bits per id of the best prefix code with at most max_bits, by package-merge; 0 for ids that do not occur."""
    counts = np.asarray(counts, np.int64)
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids do not fit {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    weights, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(max_bits - 1):
        pairs = weights[:len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        weights = both[at]
        is_leaf.append(at < len(leaves))
    take = 2 * len(leaves) - 2
    for level in reversed(is_leaf):
        n = int(level[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code words in order of (length, id)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    bits = lengths[order].astype(np.int64)
    top = int(bits[-1]) if len(bits) else 0
    codes = np.zeros(len(lengths), np.uint32)
    ends = np.cumsum(1 << (top - bits))
    codes[order] = (np.concatenate([[0], ends[:-1]]) >> (top - bits)) if len(bits) else 0
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(width, ids, bits): the next `width` bits of a stream look up an id and the length of its code word."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    width = int(lengths.max()) if len(order) else 1
    spans = 1 << (width - lengths[order].astype(np.int64))
    ids, bits = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.uint8)
    n = int(spans.sum())
    ids[:n], bits[:n] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return width, ids, bits


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, step: int = STEP) -> tuple[bytes, bytes]:
    """(checkpoints, payload) of a run of ids; code words are at most 24 bits long."""
    bits = lengths[ids].astype(np.int64)
    start = np.cumsum(bits) - bits
    total = int(start[-1] + bits[-1]) if len(ids) else 0
    word = codes[ids].astype(np.uint32) << (32 - bits - (start & 7)).astype(np.uint32)
    byte = start >> 3
    out = np.zeros(total // 8 + 8, np.float64)
    for k in range(4):  # code words do not overlap, so sums are the same as or
        out += np.bincount(byte + k, (word >> np.uint32(24 - 8 * k)) & np.uint32(255), len(out))
    return start[::step].astype("<u8").tobytes(), out.astype(np.uint8)[:(total + 7) // 8].tobytes()


def unpack_bits(n: int, checkpoints: bytes, payload: bytes, table, step: int = STEP) -> np.ndarray:
    """The n ids of a block."""
    width, ids, bits = table
    if n == 0:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    word = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
    out = np.zeros((step, len(at)), np.uint32)
    last = len(word) * 8 - 8
    for k in range(step):
        look = (word[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - width)
        out[k] = ids[look]
        at = np.minimum(at + bits[look], last)  # the last stretch runs on past its end
    return out.T.reshape(-1)[:n]


def joined(batches: Iterator[pa.RecordBatch], column: str, most: int = JOINED_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end once `column` has `most` bytes: what batches share is then looked up less often."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch[column].nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def tokenised(docs: DataFrame, vocabulary: str, end_id: int | None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian, 16 bits where the vocabulary allows, else 32); null text counts as empty."""
    kind = id_type(vocabulary)
    end = [] if end_id is None else [end_id]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(shared.value)
        for batch in joined(batches, "text"):
            ids = [np.append(x, end).astype(kind) for x in encoder.encode(batch["text"].to_pylist())]
            if ids:
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_tokens": pa.array([len(x) for x in ids], pa.int32()),
                                                  "ids": pa.array([x.tobytes() for x in ids], pa.binary())})

    return rows_of(docs).mapInArrow(run, "doc_id BIGINT, n_tokens INT, ids BINARY")


def id_type(vocabulary: str) -> str:
    return "<u2" if WordEncoder.of(vocabulary).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def id_counts(tokens: DataFrame, kind: str) -> np.ndarray:
    """Occurrences of each id: summed per task, then over tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            some = np.bincount(np.frombuffer(b"".join(batch["ids"].to_pylist()), kind))
            if len(some) > len(total):
                some, total = total, some
            total[:len(some)] += some
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "n": pa.array(total[ids], pa.int64())})

    rows = tokens.select("ids").mapInArrow(run, "id BIGINT, n BIGINT").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def write(docs: DataFrame, vocabulary_path: str, end_id: int | None = None, path: str | None = None) -> str:
    """Write all documents; returns the folder. Rows with one doc_id are ordered by their ids, null doc_ids come first.

    Ids of a document end with end_id, if given; an empty table gives files without blocks.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = f.read()
    path = path or fresh_path(spark, "llm-token-files")
    kind = id_type(vocabulary)
    tokens = stored(tokenised(docs, vocabulary, end_id), "tokens", "zstd")
    lengths = code_lengths(id_counts(tokens, kind))
    codes = canonical_codes(lengths)
    spark.createDataFrame([(bytearray(lengths.tobytes()), STEP)], "lengths BINARY, step INT").coalesce(1).write.parquet(f"{path}/codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        ids: list = []

        def flush() -> pa.RecordBatch:
            nonlocal block, before
            marks, payload = pack_bits(np.concatenate(ids), lengths, codes)
            n = [len(x) for x in ids]
            row = {"part": [part], "block": [block], "before": [before], "tokens": [sum(n)],
                   "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())), "n_tokens": pa.array([n], pa.list_(pa.int32())),
                   "checkpoints": [marks], "payload": [payload]}
            block, before = block + 1, before + sum(n)
            return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v, t) for (k, v), t in zip(
                row.items(), [pa.int32(), pa.int32(), pa.int64(), pa.int64(), None, None, pa.binary(), pa.binary()], strict=True)})

        held = 0
        for batch in batches:
            for doc_id, raw in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                doc_ids.append(doc_id)
                ids.append(np.frombuffer(raw, kind))
                held += len(ids[-1])
                if held >= BLOCK_TOKENS:
                    yield flush()
                    doc_ids, ids, held = [], [], 0
        if doc_ids:
            yield flush()

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n_tokens", "ids")
    ordered.select("doc_id", "ids").mapInArrow(run, _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of all documents; start: ids of all before it."""
    head = spark.read.schema("lengths BINARY, step INT").parquet(f"{path}/codes").first()
    lengths, step = np.frombuffer(bytes(head.lengths), np.uint8), head.step
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    # one row per written part
    parts = blocks.groupBy("part").agg(F.sum("tokens").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths)
        for batch in batches:
            for row in range(batch.num_rows):
                x = {c: batch[c][row].as_py() for c in ("start", "tokens", "doc_ids", "n_tokens", "checkpoints", "payload")}
                ids = unpack_bits(x["tokens"], x["checkpoints"], x["payload"], table, step).astype("<u4")
                ends = np.cumsum(x["n_tokens"], dtype=np.int64)
                starts = ends - x["n_tokens"]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(x["doc_ids"], pa.int64()), "start": pa.array(starts + x["start"], pa.int64()),
                    "n_tokens": pa.array(x["n_tokens"], pa.int64()),
                    "ids": pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())})

    placed = blocks.join(base, "part").select((F.col("base") + F.col("before")).alias("start"), "tokens", "doc_ids", "n_tokens",
                                              "checkpoints", "payload")
    return placed.mapInArrow(run, "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids BINARY")
