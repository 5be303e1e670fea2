"""A versioned store of points on plain Parquet: append-only logs, each step made visible by one append written last.

points    uuid, time, value, row, batch             below points/, in folders by hash of the stream and part of time
inserts   batch, number, uuid, n, batch_key         a batch counts only if listed here; number gives their order
commits   uuid, batch, version_major                which version took a batch; batches without one are the buffer
deletes   uuid, start, end, version_major
streams   seq, op, uuid, collection, tags, annotations, annotation_version   events; the last of a uuid counts
rollups   id, number, uuid, version_major           stored partials, and what of each stream they hold

A stream's version is the largest of its commits and deletes, so a version can't be known without what made it. One
writer at a time. Logs other than points have a row for each stream and batch, not for each point, and are joined and
appended as tables; none is brought to the driver.
"""

from __future__ import annotations

import uuid as ids

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..functions import validate
from ..functions.time import tag_string
from ..operators import changes as change_ops
from ..operators import raw
from ..schema import BUFFER_LIMIT, CREATED_VERSION, MAX_INSERT, STREAMS
from . import shared

SCHEMAS = {
    "points": "uuid string, time long, value double, row long, batch string, uuid_bucket int, time_part long",
    "inserts": "batch string, number long, uuid string, n long, batch_key string",
    "commits": "uuid string, batch string, version_major long",
    "deletes": "uuid string, start long, end long, version_major long",
    "streams": "seq long, op string, uuid string, collection string, tags map<string,string>, annotations map<string,string>, annotation_version long",
    "rollups": "id string, number long, uuid string, version_major long",
}
BUCKETS, PART = 16, 50


def _updated(updates: dict[str, str | None]) -> Column:
    """The column ``annotations`` with keys set or, for None, taken away."""
    kept = F.map_filter("annotations", lambda k, _: ~k.isin(list(updates)) if updates else F.lit(True))
    new = [x for k, v in updates.items() if v is not None for x in (F.lit(k), F.lit(v))]
    return F.map_concat(kept, F.create_map(*new)) if new else kept


class Store:
    def __init__(self, spark: SparkSession, path: str, obliterate_allowed: bool = False) -> None:
        self.spark, self.path, self.obliterate_allowed = spark, path.rstrip("/"), obliterate_allowed

    def create_tables(self, mode: str = "error") -> None:
        """Empty tables. ``mode`` says what becomes of a store that is there: an ``error``, ``ensure`` (kept) or
        ``overwrite``."""
        there = shared.exists(self.spark, f"{self.path}/streams")
        if mode not in ("error", "ensure", "overwrite") or there and mode == "error":
            raise EngineError(421, f"{self.path} {mode}")
        if there and mode == "overwrite":
            shared.remove(self.spark, self.path)
        if not there or mode == "overwrite":
            for name in SCHEMAS:
                self._append(name, self.spark.createDataFrame([], SCHEMAS[name]))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def _append(self, name: str, frame: DataFrame) -> None:
        frame = frame.select(*(F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(SCHEMAS[name])))
        writer = frame.write.mode("append")
        (writer.partitionBy("uuid_bucket", "time_part") if name == "points" else writer).parquet(f"{self.path}/{name}")

    # catalogue

    def streams(self) -> DataFrame:
        return self._last().where("op != 'obliterate'").drop("op")

    def _last(self) -> DataFrame:
        names = ["op", "collection", "tags", "annotations", "annotation_version"]
        last = self.table("streams").groupBy("uuid").agg(F.max_by(F.struct(*names), "seq").alias("s"))
        return last.select("uuid", *(f"s.{c}" for c in names))

    def _event(self, op: str, rows: DataFrame) -> None:
        seq = (self.table("streams").agg(F.max("seq")).first()[0] or 0) + 1
        self._append("streams", rows.withColumn("seq", F.lit(seq)).withColumn("op", F.lit(op)))

    def stream(self, uuid: str):
        row = self.streams().where(F.col("uuid") == uuid).first()
        if row is None:
            raise EngineError(404, uuid)
        return row

    def create(self, uuid: str, collection: str, tags: dict[str, str] | None = None, annotations: dict[str, str] | None = None) -> None:
        tags, annotations = tags or {}, annotations or {}
        validate.collection(collection)
        validate.tags(tags)
        validate.annotations(annotations)
        self.create_all(self.spark.createDataFrame([(uuid, collection, tags, annotations, 1)], STREAMS))

    def create_all(self, streams: DataFrame) -> None:
        """Create any number of streams (uuid, collection, tags, annotations) or none: 407, 408 and 409 for texts that
        aren't allowed, 429 for a uuid that was obliterated, 406 for one in use or a (collection, tags) that is."""
        new = streams.withColumn("annotation_version", F.lit(1)).withColumn("own", tag_string("tags"))
        bad = new.agg(F.max(validate.descriptor_code("collection", "tags", "annotations"))).first()[0]
        if bad:
            raise EngineError(bad)
        known = self._last().select("op", F.col("uuid").alias("known"), F.col("collection").alias("place"), tag_string("tags").alias("own"))
        same_id = new.join(known.drop("own"), F.col("uuid") == F.col("known")).agg(F.max(F.when(F.col("op") == "obliterate", 429).otherwise(406))).first()[0]
        live = known.where("op != 'obliterate'").withColumnRenamed("place", "collection")
        if same_id == 429 or same_id or not new.join(live, ["collection", "own"], "left_semi").isEmpty():
            raise EngineError(same_id or 406)
        twice = [new.groupBy("uuid").count().where("count > 1"), new.groupBy("collection", "own").count().where("count > 1")]
        if any(not x.isEmpty() for x in twice):
            raise EngineError(406)
        self._event("create", new)

    def set_annotations(self, uuid: str, expected: int, updates: dict[str, str | None]) -> int:
        validate.updates(updates)
        row = self.stream(uuid)
        if row["annotation_version"] != expected:
            raise EngineError(423, str(row["annotation_version"]))
        self._annotate(self.streams().where(F.col("uuid") == uuid), updates)
        return expected + 1

    def annotate_prefix(self, prefix: str, updates: dict[str, str | None]) -> None:
        """Set or (None) take away annotations of all streams whose collection has the prefix, as one job."""
        validate.updates(updates)
        self._annotate(self.streams().where(F.col("collection").startswith(prefix)), updates)

    def _annotate(self, streams: DataFrame, updates: dict[str, str | None]) -> None:
        self._event("annotate", streams.withColumn("annotations", _updated(updates)).withColumn("annotation_version", F.col("annotation_version") + 1))

    def rename_prefix(self, old: str, new: str) -> int:
        streams = self.streams()
        mine = streams.where(F.col("collection").startswith(old)).withColumn("collection", F.concat(F.lit(new), F.expr(f"substring(collection, {len(old) + 1})"))).withColumn("annotation_version", F.col("annotation_version") + 1)
        others = streams.where(~F.col("collection").startswith(old)).select("collection", tag_string("tags").alias("t"))
        if not mine.withColumn("t", tag_string("tags")).join(others, ["collection", "t"], "left_semi").isEmpty():
            raise EngineError(406, new)
        found = mine.agg(F.count("*").alias("n"), F.max(validate.collection_code("collection")).alias("code")).first()
        if found["code"]:
            raise EngineError(found["code"], new)
        self._event("rename", mine)
        return found["n"]

    def obliterate(self, uuid: str | None = None, prefix: str | None = None) -> int:
        if not self.obliterate_allowed:
            raise EngineError(431)
        found = self.streams().where(F.col("uuid") == uuid if uuid is not None else F.col("collection").startswith(prefix))
        n = found.count()
        if uuid is not None and not n:
            raise EngineError(404, uuid)
        self._event("obliterate", found)
        return n

    def vacuum(self, target: str) -> "Store":
        """A copy of the store without the points of obliterated streams, and without those no insert lists."""
        gone = self._last().where("op = 'obliterate'").select("uuid")
        copy = Store(self.spark, target, self.obliterate_allowed)
        for name in SCHEMAS:
            rows = self.table(name)
            if name == "points":
                rows = rows.join(self.table("inserts").select("uuid", "batch"), ["uuid", "batch"], "left_semi")
            if name != "rollups":
                copy._append(name, rows if name == "streams" else rows.join(gone, "uuid", "left_anti"))
        copy._append("rollups", self.table("rollups").limit(0))
        return copy

    # points

    def _waiting(self) -> DataFrame:
        return self.table("inserts").join(self.table("commits").select("uuid", "batch"), ["uuid", "batch"], "left_anti")

    def _major(self) -> DataFrame:
        steps = self.table("commits").select("uuid", "version_major").unionByName(self.table("deletes").select("uuid", "version_major"))
        return steps.groupBy("uuid").agg(F.max("version_major").alias("major"))

    def versions(self) -> DataFrame:
        """uuid, version_major and version_minor (points in the buffer) of every stream."""
        buffered = self._waiting().groupBy("uuid").agg(F.sum("n").alias("minor"))
        names = self.streams().select("uuid")
        return names.join(self._major(), "uuid", "left").join(buffered, "uuid", "left").select("uuid", F.coalesce("major", F.lit(CREATED_VERSION)).cast("long").alias("version_major"), F.coalesce("minor", F.lit(0)).cast("long").alias("version_minor"))

    def insert(self, points: DataFrame, batch_key: str | None = None, limit: int | None = MAX_INSERT) -> None:
        """Add points (uuid, time, value) to the buffers of their streams; buffers of 32768 points or more are
        committed. All or nothing. A ``batch_key`` used before adds nothing.

        The points are evaluated once, into a folder of their own; what is checked there is what is stored. Each attempt
        has a batch name of its own, so what a lost attempt left in the log is never seen, and needn't be looked for."""
        key, batch = batch_key or ids.uuid4().hex, ids.uuid4().hex
        if batch_key and not self.table("inserts").where(F.col("batch_key") == key).isEmpty():
            return
        staged = f"{self.path}/staged/{batch}"
        points.select("uuid", "time", "value").withColumn("row", F.monotonically_increasing_id()).write.parquet(staged)
        try:
            rows = self.spark.read.schema("uuid string, time long, value double, row long").parquet(staged)
            per = rows.groupBy("uuid").agg(F.count("*").alias("n"), F.max(raw.reject_code()).alias("code"))
            found = per.join(self.streams().select("uuid", F.lit(True).alias("known")), "uuid", "left").agg(F.max("code").alias("code"), F.max("n").alias("most"), F.bool_or(F.col("known").isNull()).alias("strange")).first()
            if found["code"]:
                raise EngineError(found["code"])
            if limit is not None and (found["most"] or 0) > limit:
                raise EngineError(414)
            if found["strange"]:
                raise EngineError(404)
            if not found["most"]:
                return
            number = (self.table("inserts").agg(F.max("number")).first()[0] or 0) + 1
            placed = rows.withColumn("batch", F.lit(batch)).withColumn("uuid_bucket", F.pmod(F.xxhash64("uuid"), F.lit(BUCKETS))).withColumn("time_part", F.shiftright("time", PART))
            self._append("points", placed.sortWithinPartitions("uuid_bucket", "time_part", "uuid", "time", "row"))
            self._append("inserts", per.select(F.lit(batch).alias("batch"), F.lit(number).alias("number"), "uuid", "n", F.lit(key).alias("batch_key")))
        finally:
            shared.remove(self.spark, staged)
        self._commit(self._waiting().join(self._full(), "uuid", "left_semi"))

    def _full(self) -> DataFrame:
        return self._waiting().groupBy("uuid").agg(F.sum("n").alias("n")).where(F.col("n") >= BUFFER_LIMIT).select("uuid")

    def _commit(self, waiting: DataFrame) -> None:
        new = waiting.join(self._major(), "uuid", "left").select("uuid", "batch", (F.coalesce("major", F.lit(CREATED_VERSION)) + 1).alias("version_major"))
        self._append("commits", new)

    def flush(self, uuids: list[str] | None = None) -> None:
        """Commit buffers: one new version for each stream that has buffered points."""
        waiting = self._waiting()
        self._commit(waiting if uuids is None else waiting.where(F.col("uuid").isin(uuids)))

    def delete(self, uuid: str, start: int, end: int) -> None:
        validate.time_range(start, end)
        self.stream(uuid)
        self.flush([uuid])
        major = self.spark.createDataFrame([(uuid,)], "uuid string").join(self._major(), "uuid", "left")
        self._append("deletes", major.select("uuid", F.lit(start).alias("start"), F.lit(end).alias("end"), (F.coalesce("major", F.lit(CREATED_VERSION)) + 1).alias("version_major")))

    def log(self, start: int | None = None, end: int | None = None) -> DataFrame:
        """Visible points with version_major (null: buffer), of streams that exist. Bounds prune folders by time. ``seq``
        is the order of arrival: the batch's number, then the row's in it."""
        points = self.table("points")
        if start is not None:
            points = points.where((F.col("time") >= start) & (F.col("time_part") >= start >> PART))
        if end is not None:
            points = points.where((F.col("time") < end) & (F.col("time_part") <= end >> PART))
        points = points.join(self.table("inserts").select("uuid", "batch", "number"), ["uuid", "batch"]).join(self.streams().select("uuid"), "uuid", "left_semi")
        return points.join(self.table("commits"), ["uuid", "batch"], "left").select("uuid", "time", "value", F.struct("number", "row").alias("seq"), "version_major")

    def buffer(self) -> DataFrame:
        """Points that no version holds yet."""
        return self.log().where("version_major is null").drop("version_major")

    def snapshot(self, version: int | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        return raw.snapshot(self.log(start, end), self.table("deletes"), version).select("uuid", "time", "value", "seq")

    def check_version(self, uuids: list[str] | None, version: int | None) -> None:
        if version is not None:
            known = self.versions() if uuids is None else self.versions().where(F.col("uuid").isin(uuids))
            top = known.agg(F.min("version_major")).first()[0]
            if top is None or version > top:
                raise EngineError(404, f"version {version}")

    def changes(self, uuids: list[str] | None, from_major: int, to_major: int | None, resolution: int) -> DataFrame:
        log, deletes = self.log(), self.table("deletes")
        if uuids is not None:
            log, deletes = log.where(F.col("uuid").isin(uuids)), deletes.where(F.col("uuid").isin(uuids))
        return change_ops.changes(log, deletes, from_major, to_major, resolution)

    # stored partials

    def build_rollup(self, levels: tuple[int, ...]) -> None:
        """Store partials of all committed points at the given widths; reads take them from then on. What is written
        later, and the buffer, is read from points until the next build."""
        from ..plans import rollup

        name, versions = ids.uuid4().hex, self.versions()
        number = (self.table("rollups").agg(F.max("number")).first()[0] or 0) + 1
        rollup.build(raw.snapshot(self.log().where("version_major is not null"), self.table("deletes")), f"{self.path}/partials/{name}", levels)
        self._append("rollups", versions.select(F.lit(f"{name}:{','.join(map(str, levels))}").alias("id"), F.lit(number).alias("number"), "uuid", "version_major"))

    def partials(self, uuids: list[str], start: int, end: int, pw: int) -> tuple[DataFrame, int] | None:
        """(partials, width) of the coarsest stored level that serves windows of 2 ** pw, brought up to date with what
        changed since it was built; None if there is none. Ranges that changed are made anew from points, and only they
        are read from there: bounds of all that changed prune the points' folders."""
        from ..plans import rollup

        mine = F.col("uuid").isin(uuids)
        built = self.table("rollups").where(mine).groupBy("uuid").agg(F.max_by(F.struct("number", "id", "version_major"), "number").alias("r")).collect()
        last = max((r["r"]["number"], r["r"]["id"]) for r in built)[1] if built else ":"
        name, _, widths = last.partition(":")
        level = rollup.choose(pw, tuple(int(x) for x in widths.split(",") if x))
        if level is None:
            return None
        old = self.spark.read.parquet(f"{self.path}/partials/{name}/pw={level}").where(mine & (F.col("time") >= start) & (F.col("time") < end))
        since = [x for r in built if r["r"]["id"] == last for x in (F.lit(r["uuid"]), F.lit(r["r"]["version_major"]))]
        newer = F.coalesce("version_major", F.lit((1 << 63) - 1)) > F.coalesce(F.create_map(*since)[F.col("uuid")], F.lit(0))
        batches = self.table("inserts").where(mine).join(self.table("commits"), ["uuid", "batch"], "left").where(newer)
        gone = self.table("deletes").where(mine & newer)
        if batches.select("uuid").unionByName(gone.select("uuid")).isEmpty():
            return old, level
        log = self.table("points").where(mine & (F.col("time") >= start) & (F.col("time") < end) & (F.col("time_part") >= start >> PART) & (F.col("time_part") <= end >> PART))
        fresh = log.join(batches.select("uuid", "batch", F.coalesce("version_major", F.lit((1 << 63) - 1)).alias("version_major")), ["uuid", "batch"])
        changed = change_ops.changes(fresh, gone, 0, None, level).where((F.col("start") < end) & (F.col("end") > start))
        low, high = changed.agg(F.min("start"), F.max("end")).first()
        if low is None:
            return old, level
        points = self.snapshot(None, max(low, start), min(high, end)).where(mine)
        return rollup.refreshed(old, points, changed, level), level
