"""Result tables in a database."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def latest_per_site_query(table: str, value: str = "value", newer_than: int | None = None) -> str:
    """Subquery for the rows at each site's latest time, to run inside the database."""
    floor = f" WHERE m.last_time > {int(newer_than)}" if newer_than is not None else ""
    return (f"(SELECT r.site_id, r.{value} AS base FROM {table} r JOIN "
            f"(SELECT site_id, MAX(mon_time) AS last_time FROM {table} GROUP BY site_id) m "
            f"ON r.site_id = m.site_id AND r.mon_time = m.last_time{floor}) latest")


def read_jdbc_latest(spark: SparkSession, url: str, table: str, value: str = "value",
                     newer_than: int | None = None, properties: Mapping[str, str] | None = None) -> DataFrame:
    """Last published value per site as (site_id, base); the database does the grouping."""
    return spark.read.jdbc(url, latest_per_site_query(table, value, newer_than), properties=dict(properties or {}))
