"""Tables of the test data as points and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _nanos(ts: str):
    """Nanoseconds of a timestamp without zone, counted from the epoch in the session's zone, which should be UTC."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})") * 1000


def events_points(spark: SparkSession, sf_dir: str, by: str = "event_type", since: str | None = None, until: str | None = None) -> DataFrame:
    """Events as points. Bounds on ``ts`` are given apart, as those on a derived time don't reach the files."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if since:
        events = events.where(F.col("ts") >= F.to_timestamp_ntz(F.lit(since)))
    if until:
        events = events.where(F.col("ts") < F.to_timestamp_ntz(F.lit(until)))
    return events.select(F.col(by).cast("string").alias("uuid"), _nanos("ts").alias("time"), "value", F.col("event_id").alias("seq"))


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select(F.col("l_suppkey").cast("string").alias("uuid"), _nanos("cast(l_shipdate as timestamp_ntz)").alias("time"), F.col("l_extendedprice").cast("double").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


def customer_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    rows = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    tags = F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment")
    notes = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("region"), "r_name")).otherwise(F.create_map().cast("map<string,string>"))
    return rows.select(F.col("c_custkey").cast("string").alias("uuid"), F.lower(F.concat_ws("/", "r_name", "n_name")).alias("collection"), tags.alias("tags"), notes.alias("annotations"), F.lit(1).cast("long").alias("annotation_version"))
