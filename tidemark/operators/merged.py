"""Several streams side by side, merged on time: one row for each (time, k-th occurrence)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import fixed6, rfc3339

# Headings.
TIME, HUMAN = "Timestamp (ns)", "Human-Readable Time (UTC)"
STATS = ("Min", "Mean", "Max", "Count")


def _heads(labels: list[str], version: int | None) -> list[str]:
    return [f"{x}, ver. {version}" if version else x for x in labels]


def _finish(rows: DataFrame, values: list) -> DataFrame:
    return rows.select(F.col("time"), "occ", F.col("time").cast("string").alias(TIME), rfc3339("time").alias(HUMAN), *values)


def csv_raw(points: DataFrame, streams: list[tuple[str, str]], version: int | None = None, keep_keys: bool = False) -> DataFrame:
    """Raw values of ``streams`` (uuid, label), texts with six decimals, blank where a stream has no point. A full
    outer merge as one grouped pivot; streams are numbered, so labels may repeat in uuids but not in columns."""
    wanted = points.where(F.col("uuid").isin([u for u, _ in streams]))
    occ = F.row_number().over(Window.partitionBy("uuid", "time").orderBy("seq", "value"))
    rows = wanted.withColumn("occ", occ).groupBy("time", "occ").agg(*[F.max(F.when(F.col("uuid") == u, F.col("value"))).alias(f"v{i}") for i, (u, _) in enumerate(streams)])
    out = _finish(rows, [F.when(F.col(f"v{i}").isNull(), "").otherwise(fixed6(F.col(f"v{i}"))).alias(h) for i, h in enumerate(_heads([x for _, x in streams], version))])
    return out if keep_keys else out.orderBy("time", "occ").drop("time", "occ")


def csv_windows(stats: DataFrame, streams: list[tuple[str, str]], version: int | None = None, keep_keys: bool = False) -> DataFrame:
    """Windows of ``streams`` from aligned_windows or windows, four columns for each stream."""
    wanted = stats.where(F.col("uuid").isin([u for u, _ in streams]))
    rows = wanted.groupBy("time").agg(*[F.max(F.when(F.col("uuid") == u, F.col(c.lower()))).alias(f"{c}{i}") for i, (u, _) in enumerate(streams) for c in STATS]).withColumn("occ", F.lit(1))
    values = []
    for i, h in enumerate(_heads([x for _, x in streams], version)):
        for c in STATS:
            text = F.col(f"{c}{i}").cast("string") if c == "Count" else fixed6(F.col(f"{c}{i}"))
            values.append(F.when(F.col(f"{c}{i}").isNull(), "").otherwise(text).alias(f"{h} ({c})"))
    out = _finish(rows, values)
    return out if keep_keys else out.orderBy("time").drop("time", "occ")


def write_csv(frame: DataFrame, path: str) -> None:
    """CSV files with headings. A frame of :func:`csv_raw` or :func:`csv_windows` is ordered by ranges of time, each of
    which becomes one file; their names are in the order of time."""
    frame.write.option("header", True).csv(path)
