"""The engine's calls, over sets of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError
from .functions import validate
from .operators import merged, metadata, nearest, raw, windows
from .plans import rollup
from .sources.store import Store


class Engine:
    """Reads take lists of uuids and a version (None or 0: latest, with the buffer)."""

    VERSION = "1.0"

    def __init__(self, spark: SparkSession, path: str, obliterate_allowed: bool = False) -> None:
        self.spark, self.store = spark, Store(spark, path, obliterate_allowed)

    def _points(self, uuids: list[str], version: int | None, start: int | None = None, end: int | None = None) -> DataFrame:
        known = {r[0] for r in self.store.streams().where(F.col("uuid").isin(uuids)).select("uuid").collect()}
        if set(uuids) - known:
            raise EngineError(404, ", ".join(sorted(set(uuids) - known)))
        self.store.check_version(uuids, version or None)
        return self.store.snapshot(version or None, start, end).where(F.col("uuid").isin(uuids))

    def raw_values(self, uuids: list[str], start: int, end: int, version: int | None = None) -> DataFrame:
        validate.time_range(start, end)
        return raw.raw_values(self._points(uuids, version, start, end), start, end)

    def aligned_windows(self, uuids: list[str], start: int, end: int, pw: int, version: int | None = None) -> DataFrame:
        """Windows of the latest version come from stored partials where there are any (:meth:`build_rollup`), those of a
        past version from points."""
        start, end = validate.aligned_range(start, end, pw)
        points = self._points(uuids, version, start, end)
        stored = None if version else self.store.partials(uuids, start, end, pw)
        if stored:
            return windows.aligned_from(*stored, start, end, pw).orderBy("uuid", "time")
        return windows.aligned_windows(points, start, end, pw).orderBy("uuid", "time")

    def build_rollup(self, levels: tuple[int, ...] = rollup.LEVELS) -> None:
        self.store.build_rollup(levels)

    def windows(self, uuids: list[str], start: int, end: int, width: int, depth: int = 0, version: int | None = None) -> DataFrame:
        validate.window_range(start, end, width, depth)
        streams = self.spark.createDataFrame([(u,) for u in uuids], "uuid string")
        return windows.windows(self._points(uuids, version, start, end), start, end, width, depth, streams).orderBy("uuid", "time")

    def nearest(self, uuid: str, time: int, backward: bool, version: int | None = None):
        """(time, value) of the nearest point; 401 if there is none."""
        found = nearest.nearest(self._points([uuid], version), time, backward).first()
        if found is None:
            raise EngineError(401)
        return found["time"], found["value"]

    def nearest_join(self, probes: DataFrame, backward: bool, version: int | None = None) -> DataFrame:
        return nearest.nearest_join(probes, self.store.snapshot(version or None), backward)

    def changes(self, uuids: list[str], from_major: int, to_major: int | None, resolution: int) -> DataFrame:
        to_major = to_major or None
        validate.versions(max(from_major, 1), to_major)
        self.store.check_version(uuids, to_major)
        return self.store.changes(uuids, max(from_major, 1), to_major, resolution).orderBy("uuid", "start")

    def stream_info(self, uuid: str, omit_version: bool = False, omit_descriptor: bool = False):
        self.store.stream(uuid)
        return metadata.stream_info(self.store.streams().where(F.col("uuid") == uuid), self.store.versions(), omit_version, omit_descriptor).first()

    def create(self, uuid: str, collection: str, tags: dict | None = None, annotations: dict | None = None) -> None:
        self.store.create(uuid, collection, tags, annotations)

    def set_annotations(self, uuid: str, expected: int, updates: dict) -> int:
        return self.store.set_annotations(uuid, expected, updates)

    def list_collections(self, prefix: str = "", start_with: str = "", limit: int = 10_000) -> DataFrame:
        return metadata.list_collections(self.store.streams(), prefix, start_with, limit)

    def lookup_streams(self, collection: str = "", is_prefix: bool = True, tags: dict | None = None, annotations: dict | None = None) -> DataFrame:
        return metadata.lookup_streams(self.store.streams(), collection, is_prefix, tags, annotations).orderBy("collection", "uuid")

    def metadata_usage(self, prefix: str = "") -> DataFrame:
        return metadata.metadata_usage(self.store.streams(), prefix)

    def point_counts(self) -> DataFrame:
        return metadata.point_counts(self.store.streams(), self.store.snapshot())

    def insert(self, uuid: str, points: list[tuple[int, float]]) -> tuple[int, int]:
        self.store.stream(uuid)
        self.store.insert(self.spark.createDataFrame([(uuid, t, float(v)) for t, v in points], "uuid string, time long, value double"))
        return self.version(uuid)

    def insert_frame(self, points: DataFrame) -> None:
        self.store.insert(points)

    def buffered(self, uuids: list[str]) -> DataFrame:
        """Points that no version holds yet."""
        return self.store.buffer().where(F.col("uuid").isin(uuids))

    def flush(self, uuid: str) -> tuple[int, int]:
        self.store.stream(uuid)
        self.store.flush([uuid])
        return self.version(uuid)

    def delete(self, uuid: str, start: int, end: int) -> tuple[int, int]:
        self.store.delete(uuid, start, end)
        return self.version(uuid)

    def copy(self, source: str, target: str, start: int, end: int, delete: bool = False) -> None:
        """Points of one stream inserted into another; with ``delete`` what the target has in that range goes first."""
        if delete:
            self.store.delete(target, start, end)
        points = raw.raw_values(self._points([source], None, start, end), start, end, ordered=False)
        self.store.insert(points.withColumn("uuid", F.lit(target)), limit=None)

    def rename_prefix(self, old: str, new: str) -> int:
        return self.store.rename_prefix(old, new)

    def obliterate_prefix(self, prefix: str) -> int:
        return self.store.obliterate(prefix=prefix)

    def annotate_prefix(self, prefix: str, updates: dict) -> None:
        self.store.annotate_prefix(prefix, updates)

    def vacuum(self, target: str) -> None:
        self.store.vacuum(target)

    def version(self, uuid: str) -> tuple[int, int]:
        row = self.store.versions().where(F.col("uuid") == uuid).first()
        return row["version_major"], row["version_minor"]

    def obliterate(self, uuid: str) -> None:
        self.store.obliterate(uuid)

    def csv(self, streams: list[tuple[str, str]], start: int, end: int, pw: int | None = None, width: int | None = None, version: int | None = None) -> DataFrame:
        uuids = [u for u, _ in streams]
        if width is not None:
            return merged.csv_windows(self.windows(uuids, start, end, width, 0, version), streams, version)
        if pw is not None:
            return merged.csv_windows(self.aligned_windows(uuids, start, end, pw, version), streams, version)
        return merged.csv_raw(self.raw_values(uuids, start, end, version), streams, version)

    def info(self) -> dict[str, str]:
        return {"version": self.VERSION, "spark": self.spark.version, "master": self.spark.sparkContext.master}

    def close(self) -> None:
        """Commit all buffers."""
        self.store.flush()
