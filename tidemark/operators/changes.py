"""Time ranges that changed between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import validate
from ..functions.time import align
from ..schema import MAX_TIME, MIN_TIME


def coalesce_ranges(ranges: DataFrame, pw: int = 44) -> DataFrame:
    """Half-open ranges (uuid, start, end) as disjoint ones: those that touch or overlap become one.

    Ranges are ordered within buckets of 2 ** pw of a stream, so one long stream is many tasks. How far the buckets before
    reach, and where the last island of them began, comes from one row for each bucket."""
    rows = ranges.select("uuid", "start", "end", align("start", pw).alias("bucket"))
    within, across = Window.partitionBy("uuid", "bucket").orderBy("start", "end"), Window.partitionBy("uuid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    far = rows.groupBy("uuid", "bucket").agg(F.max("end").alias("far")).withColumn("carry", F.max("far").over(across)).drop("far")
    reach = F.greatest(F.max("end").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.col("carry"))  # skips nulls
    marked = rows.join(far, ["uuid", "bucket"]).withColumn("reach", reach)
    marked = marked.withColumn("head", F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), F.col("start"))).drop("carry", "reach")
    last = marked.groupBy("uuid", "bucket").agg(F.max("head").alias("last")).withColumn("before", F.max("last").over(across)).drop("last")
    own = F.last("head", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    named = marked.join(last, ["uuid", "bucket"]).withColumn("island", own).withColumn("island", F.coalesce("island", "before"))
    return named.groupBy("uuid", "island").agg(F.max("end").alias("end")).select("uuid", F.col("island").alias("start"), "end")


def changed_buckets(log: DataFrame, pw: int) -> DataFrame:
    """Distinct buckets of 2 ** pw that hold a point of ``log``, as ranges."""
    return log.select("uuid", align("time", pw).alias("start")).distinct().withColumn("end", _after(F.col("start"), pw))


def _after(start: Column, pw: int) -> Column:
    """The end of a bucket of 2 ** pw. That of the upper half of all longs isn't a long, and is the largest one instead."""
    if pw < 63:
        return start + (1 << pw)
    return F.when(start < 0, 0).otherwise((1 << 63) - 1).cast("long")


def changes(log: DataFrame, deletes: DataFrame, from_major: int, to_major: int | None, resolution: int) -> DataFrame:
    """Ranges touched by versions above ``from_major`` up to ``to_major`` (None: latest, with the buffer), by inserts or
    deletes, in buckets of 2 ** resolution. Buckets are made distinct before they are ordered."""
    validate.point_width(resolution)
    validate.versions(from_major, to_major)
    new = F.coalesce("version_major", F.lit((1 << 63) - 1)) > from_major
    if to_major is not None:
        new &= F.col("version_major") <= to_major
    pw = resolution
    removed = deletes.where(new).where("start < end").select("uuid", align(F.greatest(F.col("start"), F.lit(MIN_TIME)), pw).alias("start"), _after(align(F.least(F.col("end"), F.lit(MAX_TIME)) - 1, pw), pw).alias("end"))
    return coalesce_ranges(changed_buckets(log.where(new), pw).unionByName(removed))
