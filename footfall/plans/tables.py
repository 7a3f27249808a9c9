"""The given tables read as sightings, dimensions and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions.strings import wire_line
from footfall.session import configure
from footfall.sources.dims import ap_dim

# Readings fall into ticks of this length where several must share an instant.
TICK = 21600

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

# Access points AP0..AP7: three sites, even numbers outside, odd inside.
SITE_OF = [1, 1, 2, 2, 3, 3, 3, 3]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def device_of(user_id: str):
    return F.upper(F.substring(F.md5(F.col(user_id).cast("string")), 1, 12))


def as_sightings(events: DataFrame, tick: int = TICK, keep: tuple[str, ...] = ()) -> DataFrame:
    """events -> (seq, device, ap, rssi, ts); tick=1 keeps the event's own second."""
    k = F.get_json_object("props", "$.k").cast("int")
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    return events.select(
        *keep,
        F.col("event_id").alias("seq"),
        device_of("user_id").alias("device"),
        F.concat(F.lit("AP"), (k % 8).cast("string")).alias("ap"),
        (F.lit(-30) - F.floor("value").cast("int") % 70).cast("double").alias("rssi"),
        (F.floor(second / tick) * tick).alias("ts") if tick > 1 else second.alias("ts"))


def sightings(spark: SparkSession, sf_dir: str, tick: int = TICK) -> DataFrame:
    return as_sightings(table(spark, sf_dir, "events"), tick)


def raw_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings(spark, sf_dir, 1)


def aps(spark: SparkSession) -> DataFrame:
    return ap_dim(spark, [(f"AP{i}", site, "inside" if i % 2 else "outside") for i, site in enumerate(SITE_OF)])


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow-list: vendor prefixes of the devices of customers in credit."""
    c = table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 3000)
    return c.select(F.substring(device_of("c_custkey"), 1, 6).alias("prefix")).distinct()


def wire_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as five-field wire lines in `value`.

    Events of type error lack a field and signups carry a signal that is not a
    number, so that the parser has something to refuse.
    """
    x = as_sightings(table(spark, sf_dir, "events"), 1, keep=("event_type",))
    rssi = (F.when(F.col("event_type") == "signup", F.lit("n/a"))
            .otherwise(F.col("rssi").cast("int").cast("string")))
    whole = wire_line("seq", "device", rssi, "ts", "ap")
    short = wire_line("seq", "device", "ts", "ap")
    return x.select(F.when(F.col("event_type") == "error", short).otherwise(whole).alias("value"))


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream.

    The bracket makes the path a pattern, which the streaming reader needs in
    order to accept a table that is a single file; a folder matches as well.
    """
    return configure(spark).readStream.schema(EVENT_SCHEMA).parquet(f"{sf_dir}/events.parque[t]")
