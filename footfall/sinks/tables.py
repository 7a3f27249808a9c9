"""Batch writers.

Every writer is a plain Spark write: tasks commit their own files or their own
transaction, so a lost executor only repeats its tasks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.strings import wire_line
from footfall.operators.sets import device_series


def append_results(df: DataFrame, path: str) -> None:
    """Append (site_id, value, mon_time) rows to a parquet table; `log.append_batch` appends a batch once if retried."""
    df.write.mode("append").parquet(path)


def append_results_jdbc(df: DataFrame, url: str, table: str, batch_size: int = 1000,
                        isolation: str = "READ_COMMITTED", properties: Mapping[str, str] | None = None) -> None:
    """Append rows to a database table, one transaction with batched inserts per partition."""
    (df.write.mode("append").option("batchsize", batch_size).option("isolationLevel", isolation)
     .jdbc(url, table, properties=dict(properties or {})))


def save_state(df: DataFrame, path: str, version: int, keep: int | None = None) -> None:
    """Write a snapshot as a version of its own; nothing that may be in use is overwritten.

    Repeating a version replaces it, so a retried micro-batch is harmless. With `keep` the versions before the last so
    many are deleted.
    """
    df.write.mode("overwrite").parquet(f"{path}/version={int(version)}")
    if keep is not None:
        fs, old = _folder(df.sparkSession, f"{path}/version={int(version) - keep}")
        if fs.exists(old):
            fs.delete(old, True)


def _folder(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop knows them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _complete(spark: SparkSession, path: str, version: int) -> bool:
    fs, mark = _folder(spark, f"{path}/version={version}/_SUCCESS")
    return fs.exists(mark)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Completed versions of a state, oldest first."""
    fs, root = _folder(spark, path)
    if not fs.exists(root):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(root)]
    found = sorted(int(n.split("=", 1)[1]) for n in names if n.startswith("version="))
    return [v for v in found if _complete(spark, path, v)]


def load_state(spark: SparkSession, path: str, before: int | None = None, schema=None) -> DataFrame | None:
    """Latest completed snapshot, optionally of a version lower than `before`; None if there is none.

    The version right before is looked up directly, so a batch that follows on another one lists no history.
    """
    if before and _complete(spark, path, before - 1):
        return spark.read.parquet(f"{path}/version={before - 1}")
    found = [v for v in versions(spark, path) if before is None or v < before]
    if not found:
        return None if schema is None else spark.createDataFrame([], schema)
    return spark.read.parquet(f"{path}/version={found[-1]}")


def load_all(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all versions, for jobs that publish what each batch adds."""
    if not versions(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path).drop("version")


def save_static_devices(df: DataFrame, path: str, version: int) -> None:
    """Write the always-on list as a new version; `load_state` reads it back."""
    save_state(df.select("device"), path, version)


def write_device_series(s: DataFrame, path: str, mode: str = "append") -> None:
    """Per-device ordered series, partitioned by day.

    Files hold many devices in (device, ts) order, so one device is a narrow
    row-group range instead of a file of its own.
    """
    device_series(s).write.mode(mode).partitionBy("day").parquet(path)


def write_series_table(s: DataFrame, table: str, buckets: int, mode: str = "overwrite") -> None:
    """Per-device series as a catalog table, bucketed by device and sorted within the buckets.

    What groups readings by device (means, and what is built on them) reads such a table without shuffling it. Take
    as many buckets as the readings need tasks; a device lies in one bucket, so this suits devices that are heard a
    few times a second, not a key with a large share of all rows.
    """
    (s.repartition(buckets, "device").write.mode(mode).format("parquet").bucketBy(buckets, "device").sortBy("device", "ts")
     .saveAsTable(table))


def lines_of(s: DataFrame, fields=("device", "rssi", "ts", "ap")) -> DataFrame:
    """Rows -> `|`-separated lines in a column `value`, ready for a text or Kafka sink."""
    return s.select(wire_line(*fields).alias("value"))


def publish_lines(s: DataFrame, servers: str, topic: str, fields=("device", "rssi", "ts", "ap")) -> None:
    """Send lines to a Kafka topic; needs the Spark Kafka package on the cluster."""
    (lines_of(s, fields).write.format("kafka").option("kafka.bootstrap.servers", servers)
     .option("topic", topic).save())


def write_lines(s: DataFrame, path: str, fields=("device", "rssi", "ts", "ap"), mode: str = "append") -> None:
    lines_of(s, fields).write.mode(mode).text(path)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header, one part file per task."""
    df.write.mode(mode).option("header", True).csv(path)


def register_views(frames: Mapping[str, DataFrame]) -> None:
    """Expose DataFrames to SQL text under the given names."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def one_row(df: DataFrame, *cols: str) -> tuple:
    """Values of a one-row result, e.g. a maximum; never for row sets."""
    row = df.select(*[F.col(c) for c in cols]).limit(1).collect()
    return tuple(row[0]) if row else tuple(None for _ in cols)
