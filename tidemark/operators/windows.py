"""Count, minimum, mean and maximum of points over windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import validate
from ..functions.time import align, window_start
from ..schema import NODE_WIDTHS


def partials(points: DataFrame, pw: int) -> DataFrame:
    """uuid, time, count, min, max, sum of each non-empty bucket of 2 ** pw; partial sums go before the one shuffle."""
    rows = points.select("uuid", align("time", pw).alias("time"), "value")
    return rows.groupBy("uuid", "time").agg(F.count("value").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.sum("value").alias("sum"))


def merge(parts: DataFrame) -> DataFrame:
    """Partials of the same stream and time as one; those with count 0 are neutral."""
    parts = parts.where("count > 0")
    return parts.groupBy("uuid", "time").agg(F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"))


def finish(parts: DataFrame) -> DataFrame:
    return parts.select("uuid", "time", "min", (F.col("sum") / F.col("count")).alias("mean"), "max", "count")


def aligned_windows(points: DataFrame, start: int, end: int, pw: int) -> DataFrame:
    """Windows [k * 2 ** pw, (k + 1) * 2 ** pw) between start and end, both moved down to the grid; empty ones are left
    out."""
    start, end = validate.aligned_range(start, end, pw)
    return finish(partials(points.where((F.col("time") >= start) & (F.col("time") < end)), pw))


def aligned_from(rollup: DataFrame, rollup_pw: int, start: int, end: int, pw: int) -> DataFrame:
    """:func:`aligned_windows` from partials of narrower buckets, which nest in the windows."""
    start, end = validate.aligned_range(start, end, pw)
    if rollup_pw > pw:
        raise EngineError(415, f"a rollup of {rollup_pw} can't serve {pw}")
    inside = rollup.where((F.col("time") >= start) & (F.col("time") < end)).withColumn("time", align("time", pw))
    return finish(merge(inside.select("uuid", "time", "count", "min", "max", "sum")))


def node_width(depth: int) -> int:
    return next((p for p in NODE_WIDTHS if p >= depth), NODE_WIDTHS[-1])


def grid(streams: DataFrame, start: int, width: int, n: int, step: int = 4096) -> DataFrame:
    """uuid and time of n windows for each stream, whatever n: each level makes at most ``step`` rows of one, so no long
    array is held, and leaves none that lie behind the end."""
    rows, unit = streams.select("uuid", F.lit(0).cast("long").alias("i")), 1
    while unit * step < n:
        unit *= step
    while unit:
        count = F.least(F.lit(step), F.expr(f"({n}L - i + {unit - 1}L) div {unit}L"))  # of the rows that start before the end
        rows = rows.select("uuid", "i", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("k")).select("uuid", (F.col("i") + F.col("k") * unit).alias("i"))
        unit //= step
    return rows.select("uuid", (F.lit(start) + F.col("i") * width).alias("time"))


def windows(points: DataFrame, start: int, end: int, width: int, depth: int = 0, streams: DataFrame | None = None) -> DataFrame:
    """All windows of ``width`` from ``start``, holes with zeros. With ``depth`` a point counts in the window that holds
    the start of its node of at least that width. ``streams`` (uuid) defaults to those in ``points``."""
    end = validate.window_range(start, end, width, depth)
    n = (end - start) // width
    inside = points.where((F.col("time") >= start) & (F.col("time") < end))
    if depth:
        inside = inside.withColumn("time", F.greatest(align("time", node_width(depth)), F.lit(start)))
    found = inside.select("uuid", window_start("time", start, width).alias("time"), "value").groupBy("uuid", "time").agg(F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max"), F.count("value").alias("count"))
    names = (points if streams is None else streams).select("uuid").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return grid(names, start, width, n).join(found, ["uuid", "time"], "left").select("uuid", "time", zero("min").cast("double").alias("min"), zero("mean").cast("double").alias("mean"), zero("max").cast("double").alias("max"), zero("count").cast("long").alias("count"))
