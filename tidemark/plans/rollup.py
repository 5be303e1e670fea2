"""Materialised partial statistics at several widths, and the choice among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import align
from ..operators import windows
from ..schema import MAX_TIME, MIN_TIME

LEVELS = (30, 36, 42, 48, 54)


def build(points: DataFrame, path: str, levels: tuple[int, ...] = LEVELS) -> None:
    """Partials of each level below ``path``/pw=N, each from the one before, so points are read once."""
    spark = points.sparkSession
    below = None
    for pw in sorted(levels):
        if below is None:
            rows = windows.partials(points, pw)
        else:
            rows = windows.merge(spark.read.parquet(below).withColumn("time", align("time", pw)))
        below = f"{path}/pw={pw}"
        rows.write.mode("overwrite").parquet(below)


def choose(pw: int, levels: tuple[int, ...] = LEVELS) -> int | None:
    """The coarsest level that serves windows of 2 ** pw; None: read points."""
    return max((x for x in levels if x <= pw), default=None)


def aligned_windows(spark: SparkSession, points: DataFrame, path: str, start: int, end: int, pw: int, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    level = choose(pw, levels)
    if level is None:
        return windows.aligned_windows(points, start, end, pw)
    return windows.aligned_from(spark.read.parquet(f"{path}/pw={level}"), level, start, end, pw)


PART = 50


def refreshed(old: DataFrame, points: DataFrame, changed: DataFrame, pw: int) -> DataFrame:
    """Partials after ``changed`` (uuid, start, end: whole buckets of 2 ** pw): rows of those ranges are made anew from
    ``points``, all others kept. Late points and deletes change only what they touch. Rows meet the ranges of their stream
    in their part of time (2 ** 50 ns, or a bucket if that is wider), so one long stream is many tasks."""
    part = max(pw, PART)
    low, high = F.greatest(F.col("start"), F.lit(MIN_TIME)), F.least(F.col("end"), F.lit(MAX_TIME)) - 1
    ranges = changed.where(low <= high).withColumn("part", F.explode(F.sequence(F.shiftright(low, part), F.shiftright(high, part))))
    hit = lambda t: (F.col(f"{t}.uuid") == F.col("c.uuid")) & (F.shiftright(F.col(f"{t}.time"), part) == F.col("c.part")) & (F.col(f"{t}.time") >= F.col("c.start")) & (F.col(f"{t}.time") < F.col("c.end"))
    same = old.alias("o").join(ranges.alias("c"), hit("o"), "left_anti")
    again = points.alias("p").join(ranges.alias("c"), hit("p"), "left_semi")
    return same.select("uuid", "time", "count", "min", "max", "sum").unionByName(windows.partials(again, pw))
