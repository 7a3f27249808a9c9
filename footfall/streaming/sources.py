"""Streaming readers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.sources.scans import ap_from_path, day_from_path, parse_lines
from footfall.streaming.tail import TailSource


def kafka_lines(spark: SparkSession, servers: str, topics: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """Message values of Kafka topics; needs the Spark Kafka package on the cluster."""
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("subscribe", topics).options(**dict(options or {})))
    return reader.load().select(F.col("value").cast("string").alias("value"))


def file_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None,
               latest_first: bool = False) -> DataFrame:
    """Lines of text files dropped into a folder, with their path."""
    reader = spark.readStream.option("recursiveFileLookup", True).option("latestFirst", latest_first)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("path"))


def stream_scans(lines: DataFrame, layout: str = "v5") -> DataFrame:
    """Wire lines -> sightings; the parser is the batch one."""
    return parse_lines(lines.select("value"), layout)


def tail_lines(spark: SparkSession, root: str, names: str = "*", history: bool = False) -> DataFrame:
    """(path, start, value): lines appended to the files below a folder, with the byte each begins at.

    Lines that exist when the query first starts are skipped, unless `history` is set; a line counts once its line
    break is there. `names` limits the files, e.g. "20240115*".
    """
    spark.dataSource.register(TailSource)
    return spark.readStream.format(TailSource.name()).option("names", names).option("history", history).load(root)


def stream_tail(spark: SparkSession, root: str, names: str = "*", history: bool = False) -> DataFrame:
    """Follow `<root>/<ap>/<yyyyMMdd...>` files that grow or appear: new lines with their access point and day."""
    lines = tail_lines(spark, root, names, history)
    return parse_lines(lines.select("value", ap_from_path(F.col("path")).alias("ap"),
                                    day_from_path(F.col("path")).alias("day")), "scan")


def stream_table(spark: SparkSession, folder: str, schema, name_filter: str | None = None,
                 files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)
