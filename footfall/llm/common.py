"""Helpers the document operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.session import configure, fresh_path

# Python workers get batches of at most so many rows, so that a batch of long texts stays small.
BATCH_ROWS = 256
# Whether Spark deletes the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(spark: SparkSession) -> SparkSession:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of any documents frame; null text counts as empty, further columns are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df below the shared folder and read it back: cuts the lineage, survives lost executors.

    What the write shuffled is deleted at its end, as no other execution reads it.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, f"llm-{name}")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def hex_sha(c: Column | str) -> Column:
    """Lowercase hex SHA-256 of a text column's UTF-8 bytes or of a binary column."""
    return F.sha2(F.col(c) if isinstance(c, str) else c, 256)


def unused(df: DataFrame, name: str) -> str:
    """A name for a helper column that no column of df has in any case: `name` behind enough underscores."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
