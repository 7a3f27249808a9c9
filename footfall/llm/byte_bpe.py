"""Byte-level BPE with the tiktoken library and a local rank file.

Texts longer than `CHUNK` characters are cut before encoding where no match of the pattern can reach across: between
a character that is no white space and a space, tab or line break. Runs of white space too long for the library's regular
expression engine are one match each and are merged directly. Ids decode to raw bytes, which need not be UTF-8.

The pattern is a parameter, but the safe cuts assume that no match has white space after another character, as in
the patterns of public rank files. The rank file is read on the driver and sent to the tasks; a vocabulary has a
fixed size that does not grow with the corpus.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from footfall.llm.common import rows_of

CHUNK = 1 << 16
LONG_SPACE = 5000
# White_Space of Unicode; fixed values.
_SPACE = "\t-\r \x85\xa0  -     　"
_CUT = re.compile(r"(?<=\S)(?=[ \t\n])")
_RUN = re.compile(f"[{_SPACE}]{{{LONG_SPACE},}}")
_CODECS: dict[bytes, Codec] = {}


class Codec:
    """Encoder and decoder of one vocabulary; one per Python worker."""

    def __init__(self, ranks: bytes, pattern: str):
        pairs = (line.split() for line in ranks.splitlines() if line)
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, special_tokens={},
                                          mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in pairs})

    @staticmethod
    def of(ranks: bytes, pattern: str) -> Codec:
        key = hashlib.sha256(ranks + pattern.encode()).digest()
        if key not in _CODECS:
            _CODECS[key] = Codec(ranks, pattern)
        return _CODECS[key]

    def encode(self, text: str, chunk: int = CHUNK) -> list[int]:
        if len(text) <= chunk:
            return self._encode(text)
        ids: list[int] = []
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + chunk) if at + chunk < len(text) else None
            end = cut.start() if cut else len(text)
            ids += self._encode(text[at:end])
            at = end
        return ids

    def _encode(self, text: str) -> list[int]:
        ids: list[int] = []
        at = 0
        for run in _RUN.finditer(text) if len(text) >= LONG_SPACE else ():
            # a run before another character leaves its last space to the next match
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids += self.encoding.encode_ordinary(text[at:run.start()])
            ids += self.encoding._encode_single_piece(text[run.start():end])
            at = end
        return ids + self.encoding.encode_ordinary(text[at:])

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


def _mapped(docs: DataFrame, ranks_path: str, pattern: str, columns, schema: str) -> DataFrame:
    """Rows made by columns(codec, batch columns) -> dict of lists."""
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks.value, pattern)
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(columns(codec, batch.to_pydict()))

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids of every row; null text counts as empty and has no ids. Extra columns are left out."""
    def columns(codec: Codec, x: dict) -> dict:
        ids = pa.array([codec.encode(t) for t in x["text"]], pa.list_(pa.int32()))
        return {"doc_id": pa.array(x["doc_id"], pa.int64()), "ids": ids}
    return _mapped(rows_of(docs), ranks_path, pattern, columns, "doc_id BIGINT, ids ARRAY<INT>")


def decode(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, bytes of rows (doc_id, ids); null ids give null."""
    def columns(codec: Codec, x: dict) -> dict:
        raw = [None if ids is None else codec.decode(ids) for ids in x["ids"]]
        return {"doc_id": pa.array(x["doc_id"], pa.int64()), "bytes": pa.array(raw, pa.binary())}
    return _mapped(tokens.select("doc_id", "ids"), ranks_path, pattern, columns, "doc_id BIGINT, bytes BINARY")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, so that no ids leave the task.

    Every row gives one row, repeated ones too; an empty or null text has no tokens; an empty table gives no rows.
    """
    def columns(codec: Codec, x: dict) -> dict:
        out: dict = {"doc_id": pa.array(x["doc_id"], pa.int64()), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in x["text"]:
            ids = codec.encode(text)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return out
    return _mapped(rows_of(docs), ranks_path, pattern, columns,
                   "doc_id BIGINT, n_tokens BIGINT, ids_sha256 STRING, decoded_sha256 STRING")
