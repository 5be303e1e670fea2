"""Range scans, snapshots of versions, merges of committed and buffered points, and checks of new points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import validate
from ..schema import MAX_TIME, MIN_TIME


def raw_values(points: DataFrame, start: int, end: int, ordered: bool = True) -> DataFrame:
    """Points with start <= time < end, duplicates kept, by stream, time and arrival."""
    validate.time_range(start, end)
    found = points.where((F.col("time") >= start) & (F.col("time") < end))
    return found.orderBy("uuid", "time", "seq") if ordered else found


DELETE_PART = 50


def snapshot(log: DataFrame, deletes: DataFrame, version: int | None = None) -> DataFrame:
    """Points of ``log`` (with version_major) as of a version: those of later versions and those that a later delete
    up to that version covers are left out. An anti join on the stream and a part of time (2 ** 50 ns, 4096 parts in the
    whole domain), with the range as a residual condition: a stream with many points or deletes is many tasks, and a point
    meets only the deletes of its part."""
    if version is not None:
        log, deletes = log.where(F.col("version_major") <= version), deletes.where(F.col("version_major") <= version)
    low, high = F.greatest(F.col("start"), F.lit(MIN_TIME)), F.least(F.col("end"), F.lit(MAX_TIME)) - 1
    parts = F.sequence(F.shiftright(low, DELETE_PART), F.shiftright(high, DELETE_PART))
    gone = deletes.where(low <= high).select(F.col("uuid").alias("d_uuid"), F.col("start").alias("d_start"), F.col("end").alias("d_end"), F.col("version_major").alias("d_version"), F.explode(parts).alias("d_part"))
    hit = (F.col("uuid") == F.col("d_uuid")) & (F.shiftright("time", DELETE_PART) == F.col("d_part")) & (F.col("time") >= F.col("d_start")) & (F.col("time") < F.col("d_end"))
    return log.join(gone, hit & (F.col("d_version") > F.col("version_major")), "left_anti")


def latest(committed: DataFrame, buffered: DataFrame) -> DataFrame:
    """Committed and buffered points together; at equal times committed ones come first, as their seq is smaller."""
    return committed.select("uuid", "time", "value", "seq").unionByName(buffered.select("uuid", "time", "value", "seq"))


def finite(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def reject_code(time: Column | str = "time", value: Column | str = "value") -> Column:
    """The code for which a new point is refused, or null: 413 outside the time domain, 425 for values not finite."""
    time = F.col(time) if isinstance(time, str) else time
    return F.when(time.isNull() | (time < MIN_TIME) | (time >= MAX_TIME - 1), 413).when(~finite(value), 425)
