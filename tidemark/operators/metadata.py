"""Search and counts over stream descriptors (uuid, collection, tags, annotations, annotation_version)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import validate


def lookup_streams(streams: DataFrame, collection: str = "", is_prefix: bool = True, tags: dict[str, str | None] | None = None, annotations: dict[str, str | None] | None = None) -> DataFrame:
    """Streams that match the collection (whole name or prefix of it) and all predicates; None asks that the key exist."""
    validate.predicates({**(tags or {}), **(annotations or {})})
    if not is_prefix:
        validate.collection(collection)
    found = streams.where(F.col("collection").startswith(collection) if is_prefix else F.col("collection") == collection)
    for name, wanted in (("tags", tags), ("annotations", annotations)):
        for k, v in (wanted or {}).items():
            found = found.where(F.map_contains_key(name, F.lit(k)) if v is None else F.col(name)[k] == v)
    return found


def list_collections(streams: DataFrame, prefix: str = "", start_with: str = "", limit: int = 10_000) -> DataFrame:
    """Up to ``limit`` distinct collections with the prefix, ascending from ``start_with``."""
    if not 1 <= limit <= 10_000 or start_with and not start_with.startswith(prefix):
        raise EngineError(421)
    found = streams.where(F.col("collection").startswith(prefix) & (F.col("collection") >= start_with))
    return found.select("collection").distinct().orderBy("collection").limit(limit)


def metadata_usage(streams: DataFrame, prefix: str = "") -> DataFrame:
    """kind (tag or annotation), key and count of streams that have it."""
    found = streams.where(F.col("collection").startswith(prefix))
    keys = lambda kind, c: found.select(F.lit(kind).alias("kind"), F.explode(F.map_keys(c)).alias("key"))
    return keys("tag", "tags").unionByName(keys("annotation", "annotations")).groupBy("kind", "key").agg(F.count("*").alias("count"))


def stream_info(streams: DataFrame, versions: DataFrame, omit_version: bool = False, omit_descriptor: bool = False) -> DataFrame:
    """Descriptors and/or versions (uuid, version_major, version_minor) of streams."""
    if omit_version and omit_descriptor:
        raise EngineError(421)
    if omit_version:
        return streams
    joined = streams.join(versions, "uuid", "left").withColumn("version_major", F.coalesce("version_major", F.lit(10).cast("long"))).withColumn("version_minor", F.coalesce("version_minor", F.lit(0).cast("long")))
    return joined.select("uuid", "version_major", "version_minor") if omit_descriptor else joined


def point_counts(streams: DataFrame, points: DataFrame) -> DataFrame:
    counts = points.groupBy("uuid").agg(F.count("*").alias("points"))
    return streams.join(counts, "uuid", "left").withColumn("points", F.coalesce("points", F.lit(0)).cast("long"))
