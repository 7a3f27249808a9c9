"""Keyed tables as logs of changes, and appends that count once.

A keyed table is a folder `base` of whole snapshots and a folder `log` with the rows that each version changed; rows
with `_gone` delete their key. A batch writes what it changed. Every so many versions the log is folded into a new
snapshot, and snapshots and log entries that no reader of the newer ones needs are deleted, so the number of folders
stays bounded. Readers that began with the snapshot before are not disturbed. Repeating a version replaces it.

Appended batches become visible by a commit file of their own, created once, that names the folder with their rows. A
batch that failed between writing and committing leaves a folder nobody reads; its repetition writes another one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from py4j.protocol import Py4JJavaError

from footfall.sinks.tables import _folder, save_state, versions

EVERY, KEEP = 20, 2


def _typed(schema) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def delete_versions(spark: SparkSession, path: str, below: int) -> None:
    """Delete the versions of a state that are lower than `below`."""
    for v in versions(spark, path):
        if v < below:
            fs, folder = _folder(spark, f"{path}/version={v}")
            fs.delete(folder, True)


def load_table(spark: SparkSession, path: str, keys: Sequence[str], schema, before: int | None = None,
               snapshot_before: int | None = None) -> DataFrame:
    """The rows of a keyed table after all versions, or after those lower than `before`.

    `snapshot_before` has it read from an earlier snapshot and the log behind it.
    """
    schema = _typed(schema)
    names = schema.names

    def known(folder: str, limit: int | None) -> list[int]:
        return [v for v in versions(spark, f"{path}/{folder}") if limit is None or v < limit]

    bases = known("base", before if snapshot_before is None else snapshot_before)
    base = bases[-1] if bases else -1
    logged = T.StructType([*schema.fields, T.StructField("_gone", T.BooleanType())])
    parts = []
    if bases:
        whole = spark.read.schema(schema).parquet(f"{path}/base/version={base}")
        parts.append(whole.withColumn("_gone", F.lit(False)).withColumn("_version", F.lit(base)))
    parts += [spark.read.schema(logged).parquet(f"{path}/log/version={v}").withColumn("_version", F.lit(v)) for v in known("log", before) if v > base]
    if not parts:
        return spark.createDataFrame([], schema)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    if len(parts) > 1:
        rest = [c for c in names if c not in keys]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest, "_gone"), "_version").alias("_last")).select(*keys, "_last.*")
    return rows.where(~F.col("_gone")).select(*names)


def save_changes(df: DataFrame, path: str, version: int, keys: Sequence[str], schema, every: int = EVERY, keep: int = KEEP) -> None:
    """Log the rows of `df` as what a version changed: one row per key, deleted keys with a true `_gone`.

    With every `every`-th version the table is folded into a snapshot; `keep` snapshots, two or more, and what follows
    on the oldest of them stay.
    """
    spark, schema = df.sparkSession, _typed(schema)
    if "_gone" not in df.columns:
        df = df.withColumn("_gone", F.lit(False))
    save_state(df.select(*schema.names, F.coalesce("_gone", F.lit(False)).alias("_gone")), f"{path}/log", version)
    if (version + 1) % every == 0:
        whole = load_table(spark, path, keys, schema, version + 1, snapshot_before=version)
        save_state(whole, f"{path}/base", version)
        kept = versions(spark, f"{path}/base")[-keep:]
        if len(kept) == keep:  # so a version that is repeated still finds the snapshot before its own
            delete_versions(spark, f"{path}/base", kept[0])
            delete_versions(spark, f"{path}/log", kept[0] + 1)


def _commit(spark: SparkSession, path: str, batch: int, folder: str) -> None:
    """Name the folder of a batch, unless the batch has been committed already."""
    fs, mark = _folder(spark, f"{path}/_commits/{batch}")
    try:
        out = fs.create(mark, False)
    except (Py4JJavaError, PySparkException):
        if fs.exists(mark):
            return
        raise
    out.write(bytearray(f"{folder}\n".encode()))
    out.close()


def append_batch(df: DataFrame, path: str, batch: int) -> None:
    """Append the rows of a batch; repeating a committed batch changes nothing, repeating a failed one adds it once."""
    spark = df.sparkSession
    fs, mark = _folder(spark, f"{path}/_commits/{batch}")
    if fs.exists(mark):
        return
    folder = f"batch-{batch}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    _commit(spark, path, batch, folder)


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all committed batches; their folders' names are all that the driver reads."""
    fs, commits = _folder(spark, f"{path}/_commits")
    if not fs.exists(commits):
        return spark.createDataFrame([], _typed(schema))
    names = [r.value for r in spark.read.text(f"{path}/_commits").where("value <> ''").collect()]
    if not names:
        return spark.createDataFrame([], _typed(schema))
    return spark.read.schema(_typed(schema)).parquet(*[f"{path}/{n}" for n in names])
