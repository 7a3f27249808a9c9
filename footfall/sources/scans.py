"""Scan lines -> sightings, and the sightings lake.

Lines are split and cast explicitly rather than by the CSV reader, whose
DROPMALFORMED mode checks only the columns a query happens to use.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.clock import local_day
from footfall.functions.strings import pseudonym
from footfall.schema import LAYOUTS, LOCAL_ZONE

_TYPES = {"device": "string", "rssi": "double", "ts": "bigint", "ap": "string", "seq": "bigint"}


def ap_from_path(path: Column | None = None) -> Column:
    """Access point of a file stored as `.../<ap>/<day>`."""
    path = F.col("_metadata.file_path") if path is None else path
    return F.element_at(F.split(path, "/"), -2)


def day_from_path(path: Column | None = None) -> Column:
    path = F.col("_metadata.file_path") if path is None else path
    return F.try_to_date(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^(\d{8})", 1), "yyyyMMdd")


def split_lines(lines: DataFrame, layout: str = "v4", value: str = "value") -> DataFrame:
    """Typed fields of every line plus `reason`: null for a good line.

    reason is "fields" for a wrong field count and "values" for a field that is
    empty or does not cast. Other columns of the input are kept.
    """
    names = LAYOUTS[layout]
    rest = [c for c in lines.columns if c not in (value, *names)]
    # The one-element explode makes the fields an attribute of their own: filters
    # on them stay above it, and every line is split once.
    x = lines.select(*rest, F.col(value).alias("line"))
    x = x.select("*", F.explode(F.array(F.split("line", r"\|", -1))).alias("_f"))
    # `get` gives null instead of an error beyond the end of the array.
    cells = [F.trim(F.get("_f", F.lit(i))) for i in range(len(names))]
    typed = [F.when(c != "", c) if _TYPES[n] == "string" else c.try_cast(_TYPES[n])
             for n, c in zip(names, cells)]
    x = x.select(*rest, "line", F.size("_f").alias("_n"), *[c.alias(n) for n, c in zip(names, typed)])
    bad_value = F.lit(False)
    for n in names:
        bad_value = bad_value | F.col(n).isNull()
    reason = F.when(F.col("_n") != len(names), "fields").when(bad_value, "values")
    return x.withColumn("reason", reason).drop("_n")


def parse_lines(lines: DataFrame, layout: str = "v4", value: str = "value") -> DataFrame:
    """Good lines only, as typed columns."""
    return split_lines(lines, layout, value).where(F.col("reason").isNull()).drop("line", "reason")


def malformed_lines(lines: DataFrame, layout: str = "v4", value: str = "value") -> DataFrame:
    """The complement of `parse_lines`: bad lines with the reason."""
    return split_lines(lines, layout, value).where(F.col("reason").isNotNull()).select("line", "reason")


def read_scans(spark: SparkSession, paths: str | Sequence[str], layout: str = "scan") -> DataFrame:
    """Scan files, one per access point and day; wildcards allowed.

    With the "scan" layout access point and day come from the path.
    """
    lines = spark.read.text(paths)
    if layout == "scan":
        lines = lines.select("value", ap_from_path().alias("ap"), day_from_path().alias("day"))
    return parse_lines(lines, layout)


def scan_paths(root: str, aps: Iterable[str] = (), days: Iterable[str] = (), skip: Iterable[str] = ()) -> list[str]:
    """Paths of the given access points and days (yyyyMMdd); empty means all."""
    skip = set(skip)
    day_part = [d for d in days if d not in skip] or ["*"]
    return [f"{root.rstrip('/')}/{ap}/{day}" for ap in (list(aps) or ["*"]) for day in day_part]


def last_days(as_of: str, days: int) -> tuple[str, str]:
    """First and last date of the `days` days that end with `as_of`, for `prune`."""
    end = date.fromisoformat(as_of)
    return str(end - timedelta(days=days - 1)), str(end)


def land(s: DataFrame, path: str, tz: str = LOCAL_ZONE, salt: str | None = None, mode: str = "append",
         batch_id: int | None = None) -> None:
    """Write sightings as parquet partitioned by (day, ap).

    The rebalance hint groups rows by folder and lets adaptive execution cut a
    busy access point into several tasks of the advisory size and put quiet
    ones together. A `salt` replaces device ids by pseudonyms before storing.
    With a `batch_id` the batch has partitions of its own (day, batch, ap), and
    landing it again replaces them.
    """
    if salt is not None:
        s = s.withColumn("device", pseudonym("device", salt))
    s = s.withColumn("day", local_day("ts", tz))
    folders = ["day", "ap"]
    if batch_id is not None:
        s, folders, mode = s.withColumn("batch", F.lit(batch_id).cast("bigint")), ["day", "batch", "ap"], "overwrite"
    (s.hint("rebalance", F.col("day"), F.col("ap")).write.mode(mode)
     .option("partitionOverwriteMode", "dynamic" if batch_id is not None else "static")
     .partitionBy(*folders).parquet(path))


def read_lake(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """The landed sightings; narrow them with `operators.clean.prune`.

    With a `day` only that folder is listed, however many others there are.
    """
    if day is None:
        return spark.read.parquet(path)
    return spark.read.option("basePath", path).parquet(f"{path}/day={day}")
