"""Registered queries over the test tables and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import time as times
from ..operators import changes, merged, metadata, nearest, raw, windows
from ..engine import Engine
from ..functions import validate
from ..sources import adapters, shared
from ..streaming import ingest
from . import rollup

S = 10**9
T0 = 1_704_067_200 * S  # 2024-01-01
DAY = 86_400 * S
LO, HI, PW = T0, T0 + 31 * DAY, 41
HOUR6 = 6 * 3600 * S
PROBE = T0 + 15 * DAY
GONE = ("click", 1_704_500_000 * S, 1_705_500_000 * S, 13)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as four versions and more, 2500 events each."""
    return adapters.events_points(spark, sf_dir).withColumn("version_major", F.lit(11).cast("long") + F.floor(F.col("seq") / 2500))


def _deletes(spark: SparkSession) -> DataFrame:
    u, start, end, version = GONE
    return spark.range(1).select(F.lit(u).alias("uuid"), F.lit(start).cast("long").alias("start"), F.lit(end).cast("long").alias("end"), F.lit(version).cast("long").alias("version_major"))


def _round(df: DataFrame) -> DataFrame:
    return df.withColumn("mean", F.round("mean", 6))


def raw_values(spark, sf_dir):
    points = adapters.events_points(spark, sf_dir, since="2024-01-05", until="2024-01-10").where("uuid = 'click'")
    return raw.raw_values(points, T0 + 4 * DAY, T0 + 9 * DAY)


def aligned_windows(spark, sf_dir):
    return _round(windows.aligned_windows(adapters.events_points(spark, sf_dir), LO, HI, PW))


def aligned_windows_rollup(spark, sf_dir):
    parts = windows.partials(adapters.events_points(spark, sf_dir), 35)
    return _round(windows.aligned_from(parts, 35, LO, HI, PW))


def aligned_windows_before_epoch(spark, sf_dir):
    points = adapters.lineitem_points(spark, sf_dir).withColumn("time", F.col("time") - F.lit(30 * 365 * DAY))
    return _round(windows.aligned_windows(points, -(1 << 59), 1 << 60, 54))


def windows_dense(spark, sf_dir):
    return _round(windows.windows(adapters.events_points(spark, sf_dir), LO, LO + 30 * DAY + 5, HOUR6))


def windows_depth(spark, sf_dir):
    return _round(windows.windows(adapters.events_points(spark, sf_dir), LO, LO + 30 * DAY, HOUR6, depth=40))


def nearest_forward(spark, sf_dir):
    return nearest.nearest(adapters.events_points(spark, sf_dir), PROBE, False)


def nearest_backward(spark, sf_dir):
    return nearest.nearest(adapters.events_points(spark, sf_dir), PROBE, True)


def _probes(spark, sf_dir):
    return adapters.events_points(spark, sf_dir).select("uuid", F.col("time").alias("probe_time"), F.col("seq").alias("probe_id"))


def asof_batch_backward(spark, sf_dir):
    return nearest.nearest_join(_probes(spark, sf_dir), adapters.events_points(spark, sf_dir), True)


def asof_batch_forward(spark, sf_dir):
    probes = _probes(spark, sf_dir).withColumn("probe_time", F.col("probe_time") + 1)
    return nearest.nearest_join(probes, adapters.events_points(spark, sf_dir), False)


def changes_between_versions(spark, sf_dir):
    return changes.changes(_log(spark, sf_dir), _deletes(spark), 12, 14, 43)


def range_union(spark, sf_dir):
    rows = adapters.events_points(spark, sf_dir).select("uuid", F.col("time").alias("start"), (F.col("time") + (F.col("seq") % 7) * 900 * S).alias("end"))
    return changes.coalesce_ranges(rows)


def snapshot_at_version(spark, sf_dir):
    return raw.snapshot(_log(spark, sf_dir), _deletes(spark), 13).select("uuid", "time", "value", "seq")


def latest_merge(spark, sf_dir):
    points = adapters.events_points(spark, sf_dir)
    both = windows.partials(points.where("seq % 3 != 0"), PW).unionByName(windows.partials(points.where("seq % 3 = 0"), PW))
    return _round(windows.finish(windows.merge(both)))


def latest_values(spark, sf_dir):
    points = adapters.events_points(spark, sf_dir)
    return raw.latest(points.where("seq % 3 != 0"), points.where("seq % 3 = 0")).orderBy("uuid", "time", "seq")


def csv_raw(spark, sf_dir):
    return merged.csv_raw(adapters.lineitem_points(spark, sf_dir), [("1", "a"), ("2", "b"), ("3", "c")], keep_keys=True)


CSV_TYPES = [("click", "clicks"), ("purchase", "purchases"), ("view", "views")]


def csv_aligned(spark, sf_dir):
    stats = windows.aligned_windows(adapters.events_points(spark, sf_dir), LO, HI, PW)
    return merged.csv_windows(_round(stats), CSV_TYPES, keep_keys=True)


def csv_windows(spark, sf_dir):
    stats = windows.windows(adapters.events_points(spark, sf_dir), LO, LO + 30 * DAY, HOUR6)
    return merged.csv_windows(_round(stats), CSV_TYPES, version=14, keep_keys=True)


def _flat(df: DataFrame) -> DataFrame:
    return df.select("uuid", "collection", F.col("tags")["name"].alias("name"), F.col("tags")["segment"].alias("segment"), F.replace(times.tag_string("tags"), F.lit("\0"), F.lit("|")).alias("tag_string"))


def lookup_streams_exact(spark, sf_dir):
    return _flat(metadata.lookup_streams(adapters.customer_streams(spark, sf_dir), "asia/nation_2", False))


def lookup_streams_prefix(spark, sf_dir):
    return _flat(metadata.lookup_streams(adapters.customer_streams(spark, sf_dir), "a", True))


def lookup_streams_tags(spark, sf_dir):
    return _flat(metadata.lookup_streams(adapters.customer_streams(spark, sf_dir), "a", True, {"segment": "BUILDING", "name": None}, {"region": None}))


def list_collections(spark, sf_dir):
    return metadata.list_collections(adapters.customer_streams(spark, sf_dir), "a", "am", 7)


def metadata_usage(spark, sf_dir):
    return metadata.metadata_usage(adapters.customer_streams(spark, sf_dir), "a")


def stream_point_counts(spark, sf_dir):
    streams = adapters.customer_streams(spark, sf_dir)
    return metadata.point_counts(streams, adapters.events_points(spark, sf_dir, by="user_id")).select("uuid", "collection", "points")


def stream_info(spark, sf_dir):
    points = adapters.events_points(spark, sf_dir, by="user_id").withColumn("version_major", F.lit(11).cast("long") + F.floor(F.col("seq") / 2500))
    versions = points.groupBy("uuid").agg(F.max("version_major").alias("version_major"), F.sum((F.col("seq") % 2500 >= 2490).cast("long")).alias("version_minor"))
    return metadata.stream_info(adapters.customer_streams(spark, sf_dir), versions).select("uuid", "collection", "annotation_version", "version_major", "version_minor")


def insert_validation(spark, sf_dir):
    points = adapters.events_points(spark, sf_dir)
    value = F.when(F.col("seq") % 50 == 1, float("nan")).when(F.col("seq") % 50 == 2, float("inf")).otherwise(F.col("value"))
    time = F.when(F.col("seq") % 50 == 3, (48 << 56) - 1).when(F.col("seq") % 50 == 4, (48 << 56) - 2).otherwise(F.col("time"))
    return points.withColumn("value", value).withColumn("time", time).groupBy(F.coalesce(raw.reject_code(), F.lit(0)).alias("code")).agg(F.count("*").alias("n"))


def incremental_rollup(spark, sf_dir):
    log, pw = _log(spark, sf_dir), 42
    old = windows.partials(raw.snapshot(log, _deletes(spark), 12), pw)
    changed = changes.changes(log, _deletes(spark), 12, None, pw)
    new = rollup.refreshed(old, raw.snapshot(log, _deletes(spark)), changed, pw)
    return _round(windows.finish(new))


# what is written, read back from a store of its own


def _engine(spark, streams: DataFrame) -> Engine:
    engine = Engine(spark, shared.folder(spark, "store"), obliterate_allowed=True)
    engine.store.create_tables()
    engine.store.create_all(streams)
    return engine


def _types(spark, sf_dir):
    none = F.create_map().cast("map<string,string>")
    names = adapters.events_points(spark, sf_dir).select("uuid").distinct()
    return names.select("uuid", F.concat(F.lit("events/"), "uuid").alias("collection"), none.alias("tags"), none.alias("annotations"))


def _events_store(spark, sf_dir) -> tuple[Engine, DataFrame]:
    return _engine(spark, _types(spark, sf_dir)), adapters.events_points(spark, sf_dir)


def _both(engine: Engine) -> DataFrame:
    """Versions of all streams with what the latest version and the buffer hold."""
    counts = engine.store.snapshot().groupBy("uuid").agg(F.count("*").alias("points"), F.sum(F.col("time").cast("decimal(20,0)")).cast("string").alias("times"), F.round(F.sum("value"), 4).alias("total"))
    return engine.store.versions().join(counts, "uuid", "left")


def store_insert_flush(spark, sf_dir):
    """Two inserts, a flush between them, so that the second is in the buffer (or committed as that was full)."""
    engine, points = _events_store(spark, sf_dir)
    engine.store.insert(points.where("seq % 2 = 0"), limit=None)
    engine.store.flush()
    engine.store.flush()
    engine.store.insert(points.where("seq % 2 = 1 and seq <= 20000"), limit=None)
    return _both(engine)


def store_buffer(spark, sf_dir):
    engine, points = _events_store(spark, sf_dir)
    engine.store.insert(points.where("seq % 2 = 0"), limit=None)
    engine.store.flush()
    engine.store.insert(points.where("seq % 2 = 1 and seq <= 20000"), limit=None)
    return engine.store.buffer().select("uuid", "time", "value")


def store_delete_versions(spark, sf_dir):
    """Every version of one stream: as inserted, and after each of two deletes."""
    engine, points = _events_store(spark, sf_dir)
    engine.store.insert(points, limit=None)
    u, start, end, _ = GONE
    engine.delete(u, start, end)
    engine.delete(u, end + 5 * DAY, end + 6 * DAY)
    kept = [engine.store.snapshot(v).where(F.col("uuid") == u).select(F.lit(v).cast("long").alias("version"), "time", "value") for v in (11, 12, 13)]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


def store_close(spark, sf_dir):
    engine, points = _events_store(spark, sf_dir)
    engine.store.insert(points.where("seq % 3 = 0"), limit=None)
    engine.close()
    return _both(engine)


def ingest_exactly_once(spark, sf_dir):
    """Events as a stream, run to the end twice from one checkpoint: the second run adds nothing."""
    engine, points = _events_store(spark, sf_dir)
    source = shared.folder(spark, "source")
    points.where("seq <= 150000").select("uuid", "time", "value").write.parquet(source)
    checkpoint = shared.folder(spark, "ingest")
    for _ in range(2):
        rows = spark.readStream.schema("uuid string, time long, value double").parquet(source)
        ingest.ingest(rows, engine.store, checkpoint).awaitTermination()
    return _both(engine).select("uuid", "version_minor", "points", "times", "total")


def stream_copy(spark, sf_dir):
    """Part of one stream copied over the same part of another."""
    engine, points = _events_store(spark, sf_dir)
    engine.store.insert(points, limit=None)
    engine.copy("click", "view", T0 + 5 * DAY, T0 + 20 * DAY, delete=True)
    return engine.store.snapshot().select("uuid", "time", "value")


def stored_rollup(spark, sf_dir):
    """Windows from stored partials, brought up to date with late points and a delete."""
    engine, points = _events_store(spark, sf_dir)
    engine.store.insert(points.where("seq % 5 != 0"), limit=None)
    engine.close()
    engine.build_rollup((36, 41))
    engine.store.insert(points.where("seq % 5 = 0"), limit=None)
    engine.delete(*GONE[:3])
    uuids = [r[0] for r in engine.store.streams().select("uuid").collect()]
    return _round(engine.aligned_windows(uuids, LO, HI, 43))


def _described(engine: Engine) -> DataFrame:
    tags = F.replace(times.tag_string("tags"), F.lit("\0"), F.lit("|")).alias("tag_string")
    notes = F.replace(times.tag_string("annotations"), F.lit("\0"), F.lit("|")).alias("note_string")
    return engine.store.streams().select("uuid", "collection", "annotation_version", tags, notes)


def store_create(spark, sf_dir):
    return _described(_engine(spark, adapters.customer_streams(spark, sf_dir)))


def store_annotations(spark, sf_dir):
    engine = _engine(spark, adapters.customer_streams(spark, sf_dir))
    engine.annotate_prefix("asia/", {"region": None, "seen": "yes"})
    engine.set_annotations("1", int(engine.stream_info("1")["annotation_version"]), {"note": "one"})
    return _described(engine)


def rename_prefix(spark, sf_dir):
    engine = _engine(spark, adapters.customer_streams(spark, sf_dir))
    engine.rename_prefix("asia/", "east/asia/")
    return _described(engine)


def store_obliterate(spark, sf_dir):
    """What a copy of the store holds after streams are obliterated by prefix."""
    streams = adapters.customer_streams(spark, sf_dir)
    engine = _engine(spark, streams)
    points = adapters.events_points(spark, sf_dir, by="user_id").join(streams.select("uuid"), "uuid", "left_semi")
    engine.store.insert(points, limit=None)
    engine.obliterate_prefix("asia/")
    target = shared.folder(spark, "store")
    engine.vacuum(target)
    copy = Engine(spark, target).store
    left = copy.table("points").groupBy("uuid").agg(F.count("*").alias("points"))
    return copy.streams().select("uuid", "collection").join(left, "uuid", "left").select("uuid", "collection", F.coalesce("points", F.lit(0)).cast("long").alias("points"))


def changes_none(spark, sf_dir):
    """Ranges changed in streams that were never written, between equal versions, and by a delete of all."""
    log, none = _log(spark, sf_dir), _deletes(spark).limit(0)
    whole = _deletes(spark).withColumns({"start": F.lit(LO), "end": F.lit(HI)})
    cases = {"never written": changes.changes(log.limit(0), none, 1, None, 43), "equal versions": changes.changes(log, none, 13, 13, 43), "all deleted": changes.changes(log.limit(0), whole, 12, None, 43)}
    out = [c.agg(F.count("*").alias("ranges"), F.min("start").alias("low"), F.max("end").alias("high")).select(F.lit(k).alias("case"), "ranges", "low", "high") for k, c in cases.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def bucket_bounds(spark, sf_dir):
    start = (T0 >> 49) << 49
    rows = adapters.events_points(spark, sf_dir).withColumn("bucket", times.bucket_index("time", start, 43))
    low, high = times.bucket_bounds("bucket", start, 43)
    return rows.select("seq", "bucket", low.alias("low"), high.alias("high"))


def uuid_forms(spark, sf_dir):
    rows = adapters.events_points(spark, sf_dir).select("seq", F.unhex(F.md5(F.col("seq").cast("string"))).alias("raw"))
    text = times.uuid_text("raw")
    return rows.select("seq", text.alias("uuid"), F.lower(F.hex(times.uuid_bytes(text))).alias("digits"), times.uuid_bytes(F.substring(text, 2, 40)).isNull().alias("refused"))


def rfc3339_parse(spark, sf_dir):
    return adapters.lineitem_points(spark, sf_dir).select("seq", times.parse_rfc3339(times.rfc3339("time")).alias("time"))


def key_validation(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    forms = {"as_is": F.col("p_name"), "folded": F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))), "long": F.repeat(F.lower(F.replace("p_name", F.lit(" "), F.lit("."))), 3)}
    return parts.select("p_partkey", *(validate.key_ok(c).alias(k) for k, c in forms.items()))


def stream_info_parts(spark, sf_dir):
    """Versions only, beside descriptors only."""
    streams = adapters.customer_streams(spark, sf_dir)
    points = adapters.events_points(spark, sf_dir, by="user_id")
    versions = points.groupBy("uuid").agg(F.lit(11).cast("long").alias("version_major"), F.count("*").alias("version_minor"))
    one = metadata.stream_info(streams, versions, omit_descriptor=True)
    two = metadata.stream_info(streams, versions, omit_version=True).select("uuid", "collection", "annotation_version")
    return one.join(two, "uuid").select("uuid", "version_major", "version_minor", "collection", "annotation_version")


def engine_info(spark, sf_dir):
    info = Engine(spark, shared.folder(spark, "store")).info()
    return spark.range(1).select(F.lit(info["version"]).alias("version"), F.lit(bool(info["spark"] and info["master"])).alias("told"))


QUERIES = (
    raw_values, aligned_windows, aligned_windows_rollup, aligned_windows_before_epoch, windows_dense, windows_depth, nearest_forward,
    nearest_backward, asof_batch_backward, asof_batch_forward, changes_between_versions, range_union, snapshot_at_version, latest_merge,
    latest_values, csv_raw, csv_aligned, csv_windows, lookup_streams_exact, lookup_streams_prefix, lookup_streams_tags, list_collections,
    metadata_usage, stream_point_counts, stream_info, insert_validation, incremental_rollup, store_insert_flush, store_buffer,
    store_delete_versions, store_close, ingest_exactly_once, stream_copy, stored_rollup, store_create, store_annotations, rename_prefix,
    store_obliterate, changes_none, bucket_bounds, uuid_forms, rfc3339_parse, key_validation, stream_info_parts, engine_info,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_EV = "SELECT event_type AS uuid, epoch_us(ts) * 1000 AS time, value, event_id AS seq FROM events"
_LI = "SELECT l_suppkey::VARCHAR AS uuid, epoch_us(l_shipdate::TIMESTAMP) * 1000 AS time, l_extendedprice::DOUBLE AS value, l_orderkey * 10 + l_linenumber AS seq FROM lineitem"
_ST = """SELECT c_custkey::VARCHAR AS uuid, lower(r_name || '/' || n_name) AS collection, c_name AS name, c_mktsegment AS segment,
 CASE WHEN c_custkey % 2 = 0 THEN r_name END AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
_STATS = "min(value) AS min, round(sum(value) / count(*), 6) AS mean, max(value) AS max, count(*) AS count"


def _aligned(source: str, pw: int, where: str = "true") -> str:
    return f"SELECT uuid, (time >> {pw}) * (1::BIGINT << {pw}) AS time, {_STATS} FROM ({source}) WHERE {where} GROUP BY ALL"


def _dense(days_end: int, time: str = "time") -> str:
    return f"""WITH e AS ({_EV}), g AS (SELECT uuid, {LO} + i * {HOUR6} AS time FROM (SELECT DISTINCT uuid FROM e), range(120) r(i)),
 a AS (SELECT uuid, {LO} + ((greatest({time}, {LO}) - {LO}) // {HOUR6}) * {HOUR6} AS time, {_STATS} FROM e WHERE time >= {LO} AND time < {days_end} GROUP BY ALL)
 SELECT g.uuid, g.time, coalesce(min, 0) AS min, coalesce(mean, 0) AS mean, coalesce(max, 0) AS max, coalesce(count, 0) AS count FROM g LEFT JOIN a ON g.uuid = a.uuid AND g.time = a.time"""


_LOG = f"SELECT *, 11 + seq // 2500 AS version_major FROM ({_EV})"
_D = f"(uuid = '{GONE[0]}' AND time >= {GONE[1]} AND time < {GONE[2]} AND version_major < {GONE[3]})"
_B43 = 1 << 43
_ISLANDS = """, m AS (SELECT *, max("end") OVER (PARTITION BY uuid ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
 k AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY uuid ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m)
 SELECT uuid, min(start) AS start, max("end") AS "end" FROM k GROUP BY uuid, island"""


def _csv(stats: str, suffix: str) -> str:
    columns = []
    for u, label in CSV_TYPES:
        for c in merged.STATS:
            inner = f"max(CASE WHEN uuid = '{u}' THEN {c.lower()} END)"
            text = f"{inner}::VARCHAR" if c == "Count" else f"format('{{:.6f}}', {inner})"
            columns.append(f"CASE WHEN {inner} IS NULL THEN '' ELSE {text} END AS \"{label}{suffix} ({c})\"")
    names = "', '".join(u for u, _ in CSV_TYPES)
    return f"""SELECT time, 1 AS occ, time::VARCHAR AS "{merged.TIME}", strftime(make_timestamp(time // 1000), '%Y-%m-%dT%H:%M:%SZ') AS "{merged.HUMAN}", {", ".join(columns)}
 FROM ({stats}) WHERE uuid IN ('{names}') GROUP BY time"""


_FLAT = "SELECT uuid, collection, name, segment, 'name|' || name || '|segment|' || segment || '|' AS tag_string FROM ({}) WHERE {}"


_SUMS = "count(*) AS points, sum(time::HUGEINT)::VARCHAR AS times, round(sum(value), 4) AS total"
_NOTED = """SELECT uuid, {} AS collection, {}::BIGINT AS annotation_version, 'name|' || name || '|segment|' || segment || '|' AS tag_string, {} AS note_string FROM ({})"""
_REGION = "coalesce('region|' || region || '|', '')"
_COPIED = f"time >= {T0 + 5 * DAY} AND time < {T0 + 20 * DAY}"


def _written() -> dict[str, str]:
    """SQL of the queries that write."""
    u, gone, later = GONE[0], f"(time >= {GONE[1]} AND time < {GONE[2]})", f"(time >= {GONE[2] + 5 * DAY} AND time < {GONE[2] + 6 * DAY})"
    asia = "starts_with(collection, 'asia/')"
    full = """WITH e AS ({}), n AS (SELECT uuid, sum((seq % 2 = 0)::INT) AS first, sum((seq % 2 = 1 AND seq <= 20000)::INT) AS second FROM e GROUP BY uuid)"""
    start = (T0 >> 49) << 49
    hex_ = "md5(event_id::VARCHAR)"
    return {
        "store_insert_flush": f"""{full.format(_EV)} SELECT n.uuid, (10 + (first > 0)::INT + (second >= 32768)::INT)::BIGINT AS version_major,
 CASE WHEN second >= 32768 THEN 0 ELSE second END::BIGINT AS version_minor, points, times, total FROM n JOIN (SELECT uuid, {_SUMS} FROM e WHERE seq % 2 = 0 OR seq <= 20000 GROUP BY uuid) c ON n.uuid = c.uuid""",
        "store_buffer": f"{full.format(_EV)} SELECT e.uuid, time, value FROM e JOIN n ON e.uuid = n.uuid WHERE second < 32768 AND seq % 2 = 1 AND seq <= 20000",
        "store_delete_versions": f"""WITH e AS (SELECT time, value FROM ({_EV}) WHERE uuid = '{u}') SELECT 11::BIGINT AS version, * FROM e UNION ALL SELECT 12, * FROM e WHERE NOT {gone}
 UNION ALL SELECT 13, * FROM e WHERE NOT {gone} AND NOT {later}""",
        "store_close": f"SELECT uuid, 11::BIGINT AS version_major, 0::BIGINT AS version_minor, {_SUMS} FROM ({_EV}) WHERE seq % 3 = 0 GROUP BY uuid",
        "ingest_exactly_once": f"SELECT uuid, 0::BIGINT AS version_minor, {_SUMS} FROM ({_EV}) WHERE seq <= 150000 GROUP BY uuid",
        "stream_copy": f"SELECT uuid, time, value FROM ({_EV}) WHERE NOT (uuid = 'view' AND {_COPIED}) UNION ALL SELECT 'view', time, value FROM ({_EV}) WHERE uuid = 'click' AND {_COPIED}",
        "stored_rollup": _aligned(_EV, 43, f"time >= ({LO} >> 43) * {_B43} AND time < ({HI} >> 43) * {_B43} AND NOT (uuid = '{u}' AND {gone})"),
        "store_create": _NOTED.format("collection", "1", _REGION, _ST),
        "store_annotations": _NOTED.format("collection", f"1 + ({asia})::INT + (uuid = '1')::INT", f"CASE WHEN uuid = '1' THEN 'note|one|' ELSE '' END || CASE WHEN {asia} THEN 'seen|yes|' ELSE {_REGION} END", _ST),
        "rename_prefix": _NOTED.format(f"CASE WHEN {asia} THEN 'east/' ELSE '' END || collection", f"1 + ({asia})::INT", _REGION, _ST),
        "store_obliterate": f"""SELECT s.uuid, s.collection, coalesce(n, 0)::BIGINT AS points FROM ({_ST}) s LEFT JOIN (SELECT user_id::VARCHAR AS uuid, count(*) AS n FROM events GROUP BY 1) c ON s.uuid = c.uuid
 WHERE NOT starts_with(s.collection, 'asia/')""",
        "changes_none": f"""SELECT 'never written' AS "case", 0::BIGINT AS ranges, NULL::BIGINT AS low, NULL::BIGINT AS high UNION ALL SELECT 'equal versions', 0, NULL, NULL
 UNION ALL SELECT 'all deleted', 1, ({LO} >> 43) * {_B43}, (({HI} - 1) >> 43) * {_B43} + {_B43}""",
        "bucket_bounds": f"WITH b AS (SELECT seq, least(greatest((time - {start}) // {_B43}, 0), 63)::INTEGER AS bucket FROM ({_EV})) SELECT seq, bucket, {start} + bucket::BIGINT * {_B43} AS low, {start} + (bucket::BIGINT + 1) * {_B43} AS high FROM b",
        "uuid_forms": f"SELECT event_id AS seq, md5(event_id::VARCHAR)::UUID::VARCHAR AS uuid, {hex_} AS digits, true AS refused FROM events",
        "rfc3339_parse": f"SELECT seq, time FROM ({_LI})",
        "key_validation": """SELECT p_partkey, regexp_full_match(p_name, '[a-z][a-z0-9_.]*') AND strlen(p_name) <= 63 AS as_is, regexp_full_match(lower(replace(p_name, ' ', '_')), '[a-z][a-z0-9_.]*') AND strlen(p_name) <= 63 AS folded,
 regexp_full_match(lower(replace(p_name, ' ', '.')), '[a-z][a-z0-9_.]*') AND 3 * strlen(p_name) <= 63 AS long FROM part""",
        "stream_info_parts": f"""SELECT s.uuid, CASE WHEN n IS NULL THEN 10 ELSE 11 END::BIGINT AS version_major, coalesce(n, 0)::BIGINT AS version_minor, s.collection, 1::BIGINT AS annotation_version FROM ({_ST}) s
 LEFT JOIN (SELECT user_id::VARCHAR AS uuid, count(*) AS n FROM events GROUP BY 1) c ON s.uuid = c.uuid""",
        "engine_info": f"SELECT '{Engine.VERSION}' AS version, true AS told",
    }


def oracle_sql() -> dict[str, str]:
    raw_columns = ", ".join(f"CASE WHEN max(CASE WHEN uuid = '{i}' THEN value END) IS NULL THEN '' ELSE format('{{:.6f}}', max(CASE WHEN uuid = '{i}' THEN value END)) END AS {c}" for i, c in ((1, "a"), (2, "b"), (3, "c")))
    early = _LI.replace("* 1000 AS time", f"* 1000 - {30 * 365 * DAY} AS time")
    return {
        "raw_values": f"SELECT * FROM ({_EV}) WHERE uuid = 'click' AND time >= {T0 + 4 * DAY} AND time < {T0 + 9 * DAY}",
        "aligned_windows": _aligned(_EV, PW, f"time >= ({LO} >> {PW}) * (1::BIGINT << {PW}) AND time < ({HI} >> {PW}) * (1::BIGINT << {PW})"),
        "aligned_windows_rollup": _aligned(_EV, PW, f"time >= ({LO} >> {PW}) * (1::BIGINT << {PW}) AND time < ({HI} >> {PW}) * (1::BIGINT << {PW})"),
        "aligned_windows_before_epoch": _aligned(early, 54),
        "windows_dense": _dense(LO + 30 * DAY),
        "windows_depth": _dense(LO + 30 * DAY, f"((time >> 44) * {1 << 44})"),
        "nearest_forward": f"SELECT uuid, p.time AS time, p.value AS value FROM (SELECT uuid, arg_min({{'time': time, 'value': value}}, (time, seq)) AS p FROM ({_EV}) WHERE time >= {PROBE} GROUP BY uuid)",
        "nearest_backward": f"SELECT uuid, p.time AS time, p.value AS value FROM (SELECT uuid, arg_max({{'time': time, 'value': value}}, (time, seq)) AS p FROM ({_EV}) WHERE time < {PROBE} GROUP BY uuid)",
        "asof_batch_backward": f"WITH e AS ({_EV}), p AS (SELECT uuid, time AS probe_time, seq AS probe_id FROM e) SELECT p.uuid, probe_time, probe_id, e.time AS point_time, e.value AS point_value FROM p ASOF LEFT JOIN e ON p.uuid = e.uuid AND p.probe_time > e.time",
        "asof_batch_forward": f"WITH e AS ({_EV}), p AS (SELECT uuid, time + 1 AS probe_time, seq AS probe_id FROM e) SELECT p.uuid, probe_time, probe_id, e.time AS point_time, e.value AS point_value FROM p ASOF LEFT JOIN e ON p.uuid = e.uuid AND p.probe_time <= e.time",
        "changes_between_versions": f"""WITH r AS (SELECT DISTINCT uuid, (time >> 43) * {_B43} AS start, (time >> 43) * {_B43} + {_B43} AS "end" FROM ({_LOG}) WHERE version_major > 12 AND version_major <= 14
 UNION ALL SELECT '{GONE[0]}', ({GONE[1]} >> 43) * {_B43}, (({GONE[2]} - 1) >> 43) * {_B43} + {_B43}){_ISLANDS}""",
        "range_union": f"""WITH r AS (SELECT uuid, time AS start, time + (seq % 7) * {900 * S} AS "end" FROM ({_EV})){_ISLANDS}""",
        "snapshot_at_version": f"SELECT uuid, time, value, seq FROM ({_LOG}) WHERE version_major <= 13 AND NOT {_D}",
        "latest_merge": _aligned(_EV, PW),
        "latest_values": _EV,
        "csv_raw": f"""SELECT time, occ::INTEGER AS occ, time::VARCHAR AS "{merged.TIME}", strftime(make_timestamp(time // 1000), '%Y-%m-%dT%H:%M:%SZ') AS "{merged.HUMAN}", {raw_columns}
 FROM (SELECT *, row_number() OVER (PARTITION BY uuid, time ORDER BY seq, value) AS occ FROM ({_LI}) WHERE uuid IN ('1', '2', '3')) GROUP BY time, occ""",
        "csv_aligned": _csv(_aligned(_EV, PW, f"time >= ({LO} >> {PW}) * (1::BIGINT << {PW}) AND time < ({HI} >> {PW}) * (1::BIGINT << {PW})"), ""),
        "csv_windows": _csv(_dense(LO + 30 * DAY), ", ver. 14"),
        "lookup_streams_exact": _FLAT.format(_ST, "collection = 'asia/nation_2'"),
        "lookup_streams_prefix": _FLAT.format(_ST, "starts_with(collection, 'a')"),
        "lookup_streams_tags": _FLAT.format(_ST, "starts_with(collection, 'a') AND segment = 'BUILDING' AND region IS NOT NULL"),
        "list_collections": f"SELECT DISTINCT collection FROM ({_ST}) WHERE starts_with(collection, 'a') AND collection >= 'am' ORDER BY collection LIMIT 7",
        "metadata_usage": f"""WITH s AS (SELECT * FROM ({_ST}) WHERE starts_with(collection, 'a')) SELECT 'tag' AS kind, k AS key, count(*) AS count FROM s, (VALUES ('name'), ('segment')) v(k) GROUP BY k
 UNION ALL SELECT 'annotation', 'region', count(*) FROM s WHERE region IS NOT NULL HAVING count(*) > 0""",
        "stream_point_counts": f"SELECT s.uuid, s.collection, coalesce(n, 0) AS points FROM ({_ST}) s LEFT JOIN (SELECT user_id::VARCHAR AS uuid, count(*) AS n FROM events GROUP BY 1) c ON s.uuid = c.uuid",
        "stream_info": f"""SELECT s.uuid, s.collection, 1::BIGINT AS annotation_version, coalesce(major, 10) AS version_major, coalesce(minor, 0)::BIGINT AS version_minor FROM ({_ST}) s
 LEFT JOIN (SELECT user_id::VARCHAR AS uuid, max(11 + event_id // 2500) AS major, sum((event_id % 2500 >= 2490)::INT) AS minor FROM events GROUP BY 1) c ON s.uuid = c.uuid""",
        "insert_validation": "SELECT CASE WHEN event_id % 50 = 3 THEN 413 WHEN event_id % 50 IN (1, 2) THEN 425 ELSE 0 END AS code, count(*) AS n FROM events GROUP BY 1",
        "incremental_rollup": _aligned(f"SELECT * FROM ({_LOG}) WHERE NOT {_D}", 42),
        **_written(),
    }
