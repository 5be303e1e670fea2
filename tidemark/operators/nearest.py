"""Nearest points and as-of joins. Backward is exclusive (time < probe), forward inclusive (time >= probe)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.time import align
from ..schema import MAX_TIME, MIN_TIME


def nearest(points: DataFrame, time: int, backward: bool) -> DataFrame:
    """uuid, time, value of each stream's nearest point; a stream without one gives no row. One aggregate, no sort.
    At equal times forward takes the first stored, backward the last."""
    if not MIN_TIME <= time < MAX_TIME:
        raise EngineError(413, str(time))
    order, point = F.struct("time", "seq"), F.struct("time", "value")
    if backward:
        found = points.where(F.col("time") < time).groupBy("uuid").agg(F.max_by(point, order).alias("p"))
    else:
        found = points.where(F.col("time") >= time).groupBy("uuid").agg(F.min_by(point, order).alias("p"))
    return found.select("uuid", "p.time", "p.value")


def nearest_join(probes: DataFrame, points: DataFrame, backward: bool, pw: int = 44) -> DataFrame:
    """Columns of ``probes`` (uuid, probe_time and others) with point_time and point_value, null where there is none.
    Null uuids and times match nothing, as in SQL.

    Points and probes are ordered together within buckets of 2 ** pw of a stream, so one long stream is many tasks;
    what a bucket's probes lack comes from the nearest bucket on that side, found among one row for each bucket."""
    names = [c for c in probes.columns if c not in ("uuid", "probe_time")]
    left = probes.select("uuid", F.col("probe_time").alias("time"), F.lit(0).alias("kind"), F.lit(None).cast(points.schema["seq"].dataType).alias("seq"), F.lit(None).cast("struct<time:bigint,value:double>").alias("p"), F.struct("probe_time", *names).alias("probe"))
    right = points.where("uuid is not null and time is not null").select("uuid", "time", F.lit(1).alias("kind"), "seq", F.struct("time", "value").alias("p"), F.lit(None).cast(left.schema["probe"].dataType).alias("probe"))
    both = left.unionByName(right).withColumn("bucket", align("time", pw))
    # forward is backward in descending order: Spark reads a frame that ends with the partition's last row anew for each row
    way, pick = (F.asc, F.max_by) if backward else (F.desc, F.min_by)
    within = Window.partitionBy("uuid", "bucket").orderBy(way("time"), way("kind"), way("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy("uuid").orderBy(way("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    near, far = F.last("p", ignorenulls=True).over(within), F.last("edge", ignorenulls=True).over(across)
    edge = pick("p", F.when(F.col("kind") == 1, F.struct("time", "seq")))
    edges = both.groupBy("uuid", "bucket").agg(edge.alias("edge")).withColumn("far", far).select("uuid", "bucket", "far")
    found = both.withColumn("near", near).where("kind = 0").join(edges, ["uuid", "bucket"], "left")
    best = F.coalesce("near", "far")
    return found.select("uuid", "probe.*", best["time"].alias("point_time"), best["value"].alias("point_value"))
