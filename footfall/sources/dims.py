"""Dimension and list readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.schema import ACTION_DIM, ACTIONS, AP_DIM, STATIC_DEVICES
from footfall.sinks.tables import load_state


def read_ap_dim(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header: ap, site_id, side, pos_code."""
    return spark.read.csv(path, schema=AP_DIM, header=True)


def _literal(value) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def ap_dim(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Access-point dimension from (ap, site_id, side) rows.

    Built as an inline table, whose exact size the planner knows.
    """
    values = ", ".join("(" + ", ".join(_literal(v) for v in r[:3]) + ")" for r in rows)
    return spark.sql(f"SELECT ap, CAST(site_id AS INT) AS site_id, side FROM VALUES {values} AS t(ap, site_id, side)")


def action_dim(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Action codes, from a CSV with header or the built-in list."""
    if path:
        return spark.read.csv(path, schema=ACTION_DIM, header=True)
    return spark.createDataFrame(ACTIONS, ACTION_DIM)


def load_dims(spark: SparkSession, ap_path: str, action_path: str | None = None) -> dict[str, DataFrame]:
    return {"ap_dim": read_ap_dim(spark, ap_path), "action_dim": action_dim(spark, action_path)}


def read_oui(spark: SparkSession, path: str) -> DataFrame:
    """Vendor allow-list: the first six characters of each line's first field."""
    first = F.split(F.col("value"), r"\|")[0]
    return (spark.read.text(path).select(F.substring(F.trim(first), 1, 6).alias("prefix"))
            .where(F.length("prefix") == 6).distinct())


def read_static_devices(spark: SparkSession, path: str) -> DataFrame:
    """Stored always-on devices: the newest version, or a plain parquet folder; empty if there is none."""
    stored = load_state(spark, path)
    if stored is not None:
        return stored
    try:
        return spark.read.schema(STATIC_DEVICES).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATIC_DEVICES)


def read_stop_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Stop list -> (words, rules).

    A line is a word, or `value<TAB>kind` with kind "nature" or "regex".
    """
    parts = F.split(F.col("value"), "\t")
    lines = spark.read.text(path).select(F.trim(parts[0]).alias("term"), F.trim(F.get(parts, F.lit(1))).alias("kind"))
    lines = lines.where(F.col("term") != "")
    return (lines.where(F.col("kind").isNull()).select(F.lower("term").alias("term")).distinct(),
            lines.where(F.col("kind").isNotNull()))


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    from footfall.operators.terms import synonym_heads
    return synonym_heads(spark.read.text(path))


def read_vectors(spark: SparkSession, path: str, cols: Sequence[str], label: str | None = None) -> DataFrame:
    """Numeric CSV -> double columns; with `label` the first column is the label."""
    names = ([label] if label else []) + list(cols)
    return spark.read.csv(path, schema=", ".join(f"`{n}` DOUBLE" for n in names))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Text corpus, one document per line."""
    return spark.read.text(path).withColumnRenamed("value", "text")
