"""Versions, catalogue, streaming and recovery of the store."""

import pytest
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.errors import EngineError
from tidemark.operators import windows
from tidemark.streaming import ingest


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), obliterate_allowed=True)
    e.store.create_tables()
    return e


def code(call):
    with pytest.raises(EngineError) as e:
        call()
    return e.value.code


def test_versions(engine):
    engine.create("u", "c", {"k": "v"})
    assert engine.version("u") == (10, 0)
    assert engine.insert("u", [(100, 100.0)]) == (10, 1)
    assert engine.raw_values(["u"], 0, 200).count() == 1
    assert engine.flush("u") == (11, 0)
    assert engine.flush("u") == (11, 0)
    assert engine.insert("u", [(105, 105.0)]) == (11, 1)
    assert engine.raw_values(["u"], 0, 200).count() == 2
    assert engine.raw_values(["u"], 0, 200, version=11).count() == 1
    assert engine.delete("u", 0, 102) == (13, 0)
    assert [r["time"] for r in engine.raw_values(["u"], 0, 200).collect()] == [105]
    assert engine.raw_values(["u"], 0, 200, version=12).count() == 2
    assert code(lambda: engine.raw_values(["u"], 0, 200, version=14)) == 404
    assert [(r["start"], r["end"]) for r in engine.changes(["u"], 11, None, 3).collect()] == [(0, 112)]
    assert engine.nearest("u", 106, True) == (105, 105.0)
    assert code(lambda: engine.nearest("u", 106, False)) == 401
    assert engine.csv([("u", "label")], 0, 200).collect()[0]["label"] == "105.000000"


def test_insert_checks(engine):
    engine.create("u", "c")
    for value in (float("nan"), float("inf"), float("-inf")):
        assert code(lambda value=value: engine.insert("u", [(1, 1.0), (2, value)])) == 425
    assert code(lambda: engine.insert("u", [((48 << 56) - 1, 1.0)])) == 413
    assert code(lambda: engine.insert("u", [(i, 1.0) for i in range(25_001)])) == 414
    assert code(lambda: engine.insert("x", [(1, 1.0)])) == 404
    assert engine.version("u") == (10, 0)
    assert engine.insert("u", [((48 << 56) - 2, 1.0)]) == (10, 1)


def test_catalogue(engine):
    engine.create("u", "c", {"k": "v"}, {"a": "1"})
    assert code(lambda: engine.create("w", "c", {"k": "v"})) == 406
    assert code(lambda: engine.create("u", "d", {})) == 406
    assert engine.set_annotations("u", 1, {"a": None, "b": "2"}) == 2
    assert code(lambda: engine.set_annotations("u", 1, {})) == 423
    assert engine.stream_info("u")["annotations"] == {"b": "2"}
    assert code(lambda: engine.stream_info("u", True, True)) == 421
    engine.create("w", "cc/x", {"k": "v"})
    assert engine.store.rename_prefix("cc/", "dd/") == 1
    assert [r[0] for r in engine.list_collections().collect()] == ["c", "dd/x"]
    assert code(lambda: engine.list_collections(limit=0)) == 421
    assert {(r["kind"], r["key"]): r["count"] for r in engine.metadata_usage().collect()} == {("tag", "k"): 2, ("annotation", "b"): 1}
    engine.obliterate("u")
    assert code(lambda: engine.stream_info("u")) == 404
    assert code(lambda: engine.create("u", "new")) == 429


def test_vacuum(engine, tmp_path):
    for u in ("u", "w"):
        engine.create(u, u)
        engine.insert(u, [(1, 1.0)])
    engine.obliterate("u")
    copy = engine.store.vacuum(str(tmp_path / "copy"))
    assert copy.table("points").select("uuid").distinct().collect()[0][0] == "w"
    assert copy.snapshot().count() == 1


def test_points_without_manifest_stay_hidden(engine):
    engine.create("u", "c")
    engine.insert("u", [(1, 1.0)])
    lost = engine.store.table("points").withColumn("batch", F.lit("lost")).collect()
    engine.store._append("points", engine.spark.createDataFrame(lost, engine.store.table("points").schema))
    assert engine.raw_values(["u"], 0, 10).count() == 1
    engine.insert("u", [(2, 2.0)])
    assert [r["time"] for r in engine.raw_values(["u"], 0, 10).collect()] == [1, 2]


def test_order_of_arrival_over_many_partitions(engine, spark):
    engine.create("u", "c")
    many = spark.range(300, numPartitions=300).select(F.lit("u").alias("uuid"), F.lit(5).cast("long").alias("time"), F.col("id").cast("double").alias("value"))
    engine.insert_frame(many)
    engine.insert("u", [(5, 1000.0)])
    found = engine.raw_values(["u"], 0, 10)
    assert found.select("seq").distinct().count() == 301
    assert [r["value"] for r in found.collect()] == [*map(float, range(300)), 1000.0]
    assert engine.nearest("u", 6, True) == (5, 1000.0) and engine.nearest("u", 5, False) == (5, 0.0)
    assert engine.buffered(["u"]).count() == 301


def test_a_commit_without_its_successor_costs_no_version(engine):
    """What follows a crash right after the commit: the version is known from the commit itself."""
    engine.create("u", "c")
    engine.insert("u", [(1, 1.0)])
    engine.store._commit(engine.store._waiting())
    assert engine.version("u") == (11, 0)
    engine.insert("u", [(2, 2.0)])
    assert engine.flush("u") == (12, 0) and engine.raw_values(["u"], 0, 9, version=11).count() == 1


def test_bulk_calls_and_modes(engine, spark, tmp_path):
    rows = [(f"u{i}", "c" if i % 2 else "d/x", {"k": str(i)}, {}) for i in range(6)]
    schema = "uuid string, collection string, tags map<string,string>, annotations map<string,string>"
    engine.store.create_all(spark.createDataFrame(rows, schema))
    engine.annotate_prefix("d/", {"a": "1"})
    assert engine.lookup_streams(annotations={"a": "1"}).count() == 3
    engine.annotate_prefix("d/", {"a": None, "b": "2"})
    assert engine.stream_info("u0")["annotations"] == {"b": "2"} and engine.stream_info("u0")["annotation_version"] == 3
    assert engine.rename_prefix("d/", "e/") == 3 and engine.obliterate_prefix("e/") == 3
    for bad, want in (([("u1", "q", {}, {})], 406), ([("u0", "q", {}, {})], 429), ([("n", "c", {"k": "1"}, {})], 406), ([("n", "", {}, {})], 407), ([("n", "q", {"K": "1"}, {})], 408), ([("n", "q", {"k": ""}, {})], 409), ([("n", "q", {}, {}), ("n", "r", {}, {})], 406)):
        assert code(lambda bad=bad: engine.store.create_all(spark.createDataFrame(bad, schema))) == want
    assert code(engine.store.create_tables) == 421
    engine.store.create_tables("ensure")
    assert engine.lookup_streams().count() == 3
    engine.store.create_tables("overwrite")
    assert engine.lookup_streams().count() == 0


def test_copy_with_delete(engine):
    for u in ("u", "w"):
        engine.create(u, u)
    engine.insert("u", [(t, float(t)) for t in range(10)])
    engine.insert("w", [(t, -1.0) for t in range(5, 20)])
    engine.copy("u", "w", 3, 9, delete=True)
    assert [(r["time"], r["value"]) for r in engine.raw_values(["w"], 0, 30).collect()] == [(t, float(t)) for t in range(3, 9)] + [(t, -1.0) for t in range(9, 20)]


def test_windows_from_stored_partials(engine, spark):
    engine.create("u", "c")
    engine.create("w", "d")
    engine.insert("u", [(t, float(t % 17)) for t in range(0, 4000, 3)])
    engine.flush("u")
    engine.build_rollup((2, 6, 9))
    def same():
        for pw in (1, 3, 6, 11):
            a = engine.aligned_windows(["u", "w"], 0, 1 << 13, pw)
            b = windows.aligned_windows(engine.store.snapshot(), 0, 1 << 13, pw).orderBy("uuid", "time")
            assert [tuple(r)[:3] + tuple(r)[4:] for r in a.collect()] == [tuple(r)[:3] + tuple(r)[4:] for r in b.collect()]
    same()
    assert all("/partials/" in f for f in engine.aligned_windows(["u"], 0, 1 << 13, 9).inputFiles())
    engine.insert("u", [(100, 500.0)])
    engine.insert("w", [(7, 1.0)])
    same()
    engine.delete("u", 300, 700)
    same()


def test_csv_files_are_ordered(engine, spark, tmp_path):
    from tidemark.operators import merged

    engine.create("u", "c")
    engine.insert("u", [(t, float(t)) for t in range(500)])
    merged.write_csv(engine.csv([("u", "u")], 0, 1000), str(tmp_path / "csv"))
    lines = [x for p in sorted((tmp_path / "csv").glob("*.csv")) for x in p.read_text().splitlines() if not x.startswith("Timestamp")]
    assert [int(x.split(",")[0]) for x in lines] == list(range(500))


def test_stream_and_rollup(engine, spark, tmp_path):
    engine.create("u", "c")
    src = tmp_path / "in"
    spark.createDataFrame([("u", t, float(t)) for t in range(0, 1000, 7)], "uuid string, time long, value double").write.parquet(str(src))
    def run():
        ingest.ingest(spark.readStream.schema("uuid string, time long, value double").parquet(str(src)), engine.store, str(tmp_path / "ck")).awaitTermination()
    run()
    before = engine.version("u")
    old = windows.partials(engine.store.snapshot(), 5)
    old = spark.createDataFrame(old.collect(), old.schema)
    run()
    assert engine.version("u") == before
    spark.createDataFrame([("u", 3, 500.0)], "uuid string, time long, value double").write.mode("append").parquet(str(src))
    run()
    engine.delete("u", 100, 200)
    new = ingest.refresh_rollup(engine.store, old, before[0], 5)
    want = windows.partials(engine.store.snapshot(), 5)
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, want.collect()))
    engine.store.insert(spark.createDataFrame([("u", 1, 1.0)], "uuid string, time long, value double"), batch_key="again")
    engine.store.insert(spark.createDataFrame([("u", 1, 1.0)], "uuid string, time long, value double"), batch_key="again")
    assert engine.raw_values(["u"], 1, 2).count() == 1
