"""Exact dedup: deterministic block naming.

A text is cut into blocks of fixed size. Distinct blocks are sorted and get an integer name; adjacent names of a
document are paired, distinct pairs sorted and named again, until one name is left per document. Two documents with
the same number of blocks and the same name have the same bytes: names stand for contents, never for digests.

Blocks are routed by a 64-bit digest; that two blocks of one digest differ is found when the distinct contents are
named, and such digests are named by content. A group of copies of any size is one row per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import hex_sha, rows_of, stored, unused

BLOCK_BYTES = 16384
_KEY = ("doc_id", "text_sha256", "n_blocks")


def _blocks(docs: DataFrame, size: int, digest) -> DataFrame:
    """(doc_id, text_sha256, n_blocks, pos, h, block); an empty text has one empty block."""
    raw = docs.select("doc_id", F.col("text").cast("binary").alias("raw"))
    n = F.greatest(F.lit(1), F.ceil(F.length("raw") / F.lit(size))).cast("int")
    cut = raw.select("doc_id", hex_sha(F.col("raw")).alias("text_sha256"), n.alias("n_blocks"), "raw",
                     F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    cut = cut.select("doc_id", "text_sha256", "n_blocks", "pos",
                     F.substring("raw", F.col("pos") * size + 1, F.lit(size)).alias("block"))
    return cut.withColumn("h", digest(F.col("block")))


def _named(distinct: DataFrame, *order: str) -> DataFrame:
    """Integer names in sorted order: the task in the high bits, the place among its sorted rows in the low ones."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, size: int = BLOCK_BYTES, digest=F.xxhash64) -> DataFrame:
    """One row per row of docs: doc_id, text_sha256, n_blocks, name. Equal texts, and only they, share the last two.

    `digest` maps a block to a long and only routes. Null text counts as empty. Rows that repeat a doc_id with the
    same text are named alike; with another text they are separate.
    """
    docs = rows_of(docs)
    blocks = _blocks(docs, size, digest)
    names = stored(_named(blocks.groupBy("h", "block").agg(F.count("*").alias("copies")), "h", "block"), "block-names")
    # stored, so that the join below has two plain shuffles, of which Spark can split a hot digest
    per_digest = stored(names.groupBy("h").agg(F.count("*").alias("contents"), F.min("name").alias("name")), "digests")
    # repeated rows of one document and text would pair with each other: one of them is named
    at = blocks.select("doc_id", "text_sha256", "n_blocks", "pos", "h").distinct()
    level = at.join(per_digest, "h").where("contents = 1").select(*_KEY, "pos", "name")
    mixed = per_digest.where("contents > 1").select("h")
    if not mixed.isEmpty():
        mixed = names.join(mixed, "h").select("h", "block", "name")
        level = level.unionByName(blocks.join(mixed, ["h", "block"]).select(*_KEY, "pos", "name").distinct())
    level = stored(level.withColumn("left", F.col("n_blocks")), "block-level")
    out = level.where("left = 1").select(*_KEY, "name")
    left = level.agg(F.max("left")).first()[0] or 1
    while left > 1:
        pairs = _pairs(level.where("left > 1"))
        pair_names = stored(_named(pairs.groupBy("a", "b").agg(F.count("*").alias("copies")), "a", "b"), "pair-names")
        level = stored(pairs.join(pair_names, ["a", "b"]).select(*_KEY, "pos", "left", "name"), "pair-level")
        out = out.unionByName(level.where("left = 1").select(*_KEY, "name"))
        left = (left + 1) // 2
    return out


def _pairs(level: DataFrame) -> DataFrame:
    """Names two by two, -1 where there is no second one; `left` counts what the document has after this level."""
    second = F.col("pos") % 2 == 1
    return (level.groupBy(*_KEY, F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(F.max(F.when(~second, F.col("name"))).alias("a"),
                 F.coalesce(F.max(F.when(second, F.col("name"))), F.lit(-1)).alias("b"),
                 F.max(F.ceil(F.col("left") / 2)).cast("int").alias("left")))


def exact_dedup(docs: DataFrame, size: int = BLOCK_BYTES, digest=F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row; of equal texts the largest doc_id stays.

    A repeated row counts in group_size and is reported like its twin. A null doc_id stays only when no other row has
    its text, keep_id is then null. Empty and null texts form one group. An empty table gives no rows.
    """
    ids = stored(identities(docs, size, digest), "identities")
    rows = rows_of(docs).select("doc_id", hex_sha("text").alias("text_sha256"))
    counted = rows.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("times"))
    same = counted["doc_id"].eqNullSafe(ids["doc_id"]) & (counted["text_sha256"] == ids["text_sha256"])
    known = stored(counted.join(ids, same).select(counted["doc_id"], counted["text_sha256"], "times", "n_blocks", "name"),
                   "named-documents")
    groups = stored(known.groupBy("n_blocks", "name")
                    .agg(F.max("doc_id").alias("keep_id"), F.sum("times").alias("group_size")), "groups")
    out = known.join(groups, ["n_blocks", "name"])
    return (out.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    "text_sha256"))


def keep_last_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id stays, with all their columns; of rows that repeat a doc_id and text one remains."""
    def one(doc_id, sha):
        return F.concat_ws(":", sha, doc_id.cast("string"))

    key = unused(docs, "one")
    kept = exact_dedup(docs).where("kept").select(one(F.col("doc_id"), F.col("text_sha256")).alias(key))
    sha = hex_sha(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    out = docs.withColumn(key, one(F.col("doc_id"), sha)).dropDuplicates([key])
    return out.join(kept, key, "left_semi").drop(key)
