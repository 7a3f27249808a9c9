"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of docs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import block_naming, jaccard_join, packing, secret_ledger, toxicity
from footfall.llm.common import session, stored, table

END_ID = 1


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts as toxic go."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id stays."""
    session(spark)
    return block_naming.keep_last_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by five-word shingle similarity of 0.8 or more the smallest doc_id stays.

    Rows are told apart by a 64-bit hash of doc_id and text, so an id may come with several texts and ids may be null:
    of a component the row with the smallest (doc_id, hash) stays, null ids last. Rows equal in both stay or go
    together; texts without words stay.
    """
    session(spark)
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    found = jaccard_join.jaccard_components(docs.select(key.alias("doc_id"), "text"), size=5, percent=80)
    found = stored(found.select(F.col("doc_id").alias("_key"), "component_id").distinct(), "near-components")
    several = found.where("_key <> component_id").select("component_id").distinct()
    ids = docs.select(key.alias("_key"), "doc_id").distinct()
    members = stored(found.join(several, "component_id").join(ids, "_key").select(
        "component_id", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key").alias("row")), "near-members")
    kept = members.groupBy("component_id").agg(F.min("row").alias("kept"))
    gone = stored(members.join(kept, "component_id").where("row._key <> kept._key").select(F.col("row._key").alias("_gone")).distinct(), "near-copies")
    return docs.join(gone, key == gone["_gone"], "left_anti")


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; n_chars follows. No document goes."""
    session(spark)
    return secret_ledger.redacted(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    session(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)
