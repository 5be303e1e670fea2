"""Golden tables and properties of the time-series operators."""

import pytest
from pyspark.sql import functions as F

from tidemark.errors import EngineError
from tidemark.functions import validate
from tidemark.functions.time import rfc3339
from tidemark.operators import changes, merged, metadata, nearest, raw, windows
from tidemark.plans import rollup
from tidemark.schema import MAX_TIME, MIN_TIME, POINTS


def points(spark, rows):
    return spark.createDataFrame([(u, t, float(v), i) for i, (u, t, v) in enumerate(rows)], POINTS)


@pytest.fixture(scope="module")
def dense(spark):
    return points(spark, [("a", t, (t * 7919) % 1000) for t in range(4096)])


@pytest.mark.parametrize(("time", "backward", "want"), [((2 << 56) + 1, True, 2), (2 << 56, True, 1), (2 << 56, False, 2), ((2 << 56) + 1, False, 3), (0, False, 1), ((4 << 56), True, 3), (0, True, None), (4 << 56, False, None)])
def test_nearest(spark, time, backward, want):
    p = points(spark, [("a", i << 56, i) for i in (1, 2, 3)])
    row = nearest.nearest(p, min(time, MAX_TIME - 1), backward).first()
    assert (row and row["value"]) == want
    probes = spark.createDataFrame([("a", time, 1)], "uuid string, probe_time long, id int")
    assert nearest.nearest_join(probes, p, backward).first()["point_value"] == want


def test_nearest_ties(spark):
    p = points(spark, [("a", 5, 1), ("a", 5, 2), ("a", 5, 3)])
    assert nearest.nearest(p, 5, False).first()["value"] == 1
    assert nearest.nearest(p, 6, True).first()["value"] == 3


@pytest.mark.parametrize("backward", [True, False])
def test_nearest_join_brute_force(spark, backward):
    """Ties, empty buckets between, and nulls, which match nothing."""
    rows = [(u, t // 3 * 3 + (t // 40 << 5), t) for u in ("a", "b", None) for t in range(120)] + [("a", None, 1), ("b", None, 2), ("c", None, 3)]
    probes = [(u, t, i) for i, (u, t) in enumerate((u, t) for u in ("a", "b", "c", None) for t in (None, *range(-5, 230)))]
    found = nearest.nearest_join(spark.createDataFrame(probes, "uuid string, probe_time long, id int"), points(spark, rows), backward, pw=3)
    held = [(t, i, float(v), u) for i, (u, t, v) in enumerate(rows) if u is not None and t is not None]
    want = []
    for u, t, i in probes:
        near = [] if t is None else [p for p in held if p[3] == u and (p[0] < t if backward else p[0] >= t)]
        p = (max(near) if backward else min(near)) if near else (None, None, None)
        want.append((i, u, t, p[0], p[2]))
    assert sorted((r["id"], r["uuid"], r["probe_time"], r["point_time"], r["point_value"]) for r in found.collect()) == want


@pytest.mark.parametrize("backward", [True, False])
def test_nearest_join_is_linear(spark, backward):
    """No frame reaches the end of its partition: Spark would read the rest of the bucket, or of the stream, for each row."""
    probes = spark.createDataFrame([("a", 1, 1)], "uuid string, probe_time long, id int")
    plan = nearest.nearest_join(probes, points(spark, [("a", 1, 1)]), backward)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("specifiedwindowframe(rowframe, unboundedpreceding") == 2 and "unboundedfollowing" not in plan


def test_aligned_counts(spark, dense):
    for pw in (0, 3, 11, 12, 60):
        found = windows.aligned_windows(dense, MIN_TIME, MAX_TIME, pw).collect()
        assert len(found) == max(1, 4096 >> pw)
        assert sum(r["count"] for r in found) == 4096
        assert all(r["min"] <= r["mean"] <= r["max"] and r["time"] % (1 << pw) == 0 for r in found)


def test_rollup_equals_raw(spark, dense, tmp_path):
    rollup.build(dense, str(tmp_path / "r"), (2, 6, 9))
    for pw in (1, 3, 9, 20):
        a = windows.aligned_windows(dense, 0, 1 << 20, pw).orderBy("time").collect()
        b = rollup.aligned_windows(spark, dense, str(tmp_path / "r"), 0, 1 << 20, pw, (2, 6, 9)).orderBy("time").collect()
        assert [(r["time"], r["count"], r["min"], r["max"]) for r in a] == [(r["time"], r["count"], r["min"], r["max"]) for r in b]


def test_dense_windows(spark):
    p = points(spark, [("a", i, i) for i in range(50)] + [("a", 100 + i, i) for i in range(50)])
    found = windows.windows(p, -4, 161, 10).orderBy("time").collect()
    assert len(found) == 16
    assert [r["count"] for r in found][:8] == [6, 10, 10, 10, 10, 4, 0, 0]
    assert all(r["min"] == r["mean"] == r["max"] == 0 for r in found if not r["count"])
    empty = windows.windows(p.limit(0), 0, 100, 10, streams=spark.createDataFrame([("x",)], "uuid string"))
    assert empty.count() == 10


def test_windows_agree_with_aligned(spark, dense):
    a = {(r["time"], r["count"], r["max"]) for r in windows.windows(dense, 0, 8192, 512).collect() if r["count"]}
    assert a == {(r["time"], r["count"], r["max"]) for r in windows.aligned_windows(dense, 0, 8192, 9).collect()}


def test_superdense_keeps_all(spark):
    p = points(spark, [("a", 5, i) for i in range(3000)])
    assert raw.raw_values(p, 0, 10).count() == 3000


def test_changes(spark):
    log = points(spark, [("a", 1, 1), ("a", 9, 1), ("a", 17, 1), ("a", 100, 1)]).withColumn("version_major", F.lit(12).cast("long"))
    gone = spark.createDataFrame([("a", 20, 41, 13)], "uuid string, start long, end long, version_major long")
    found = changes.changes(log, gone, 11, 13, 3).orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in found] == [(0, 48), (96, 104)]
    assert changes.changes(log, gone, 13, 13, 3).count() == 0


def test_ranges_nested(spark):
    r = spark.createDataFrame([("a", 0, 100), ("a", 10, 20), ("a", 50, 60), ("a", 100, 110), ("a", 120, 130)], "uuid string, start long, end long")
    assert [(x["start"], x["end"]) for x in changes.coalesce_ranges(r).orderBy("start").collect()] == [(0, 110), (120, 130)]


def test_ranges_over_many_buckets(spark):
    import random

    draw = random.Random(4)
    rows = [(u, t, t + draw.randrange(1, 60)) for u in "ab" for t in (draw.randrange(-3000, 3000) for _ in range(150))] + [("a", -2500, -1200), ("c", 0, 5000), ("c", 4, 5)]
    want = []
    for u, s, e in sorted(rows):
        if want and want[-1][0] == u and s <= want[-1][2]:
            want[-1][2] = max(want[-1][2], e)
        else:
            want.append([u, s, e])
    found = changes.coalesce_ranges(spark.createDataFrame(rows, "uuid string, start long, end long"), 6).orderBy("uuid", "start").collect()
    assert [list(r) for r in found] == want


@pytest.mark.parametrize("pw", [61, 62, 63])
def test_coarsest_changes(spark, pw):
    log = points(spark, [("a", -5, 1), ("a", 7, 1)]).withColumn("version_major", F.lit(12).cast("long"))
    gone = spark.createDataFrame([], "uuid string, start long, end long, version_major long")
    assert [(r["start"], r["end"]) for r in changes.changes(log, gone, 11, None, pw).collect()] == [(-(1 << pw), min(1 << pw, (1 << 63) - 1))]


def test_grid_of_any_size(spark):
    u = spark.createDataFrame([("a",)], "uuid string")
    for n in (1, 3, 4, 5, 16, 17, 63, 65):
        assert sorted(r["time"] for r in windows.grid(u, 10, 7, n, step=4).collect()) == [10 + 7 * i for i in range(n)]
    assert windows.grid(u, 0, 1, 5_000_000).count() == 5_000_000


def test_csv(spark):
    p = points(spark, [("a", 0, 1), ("a", 0, 2), ("b", 0, 3), ("b", 10**9, 4)])
    frame = merged.csv_raw(p, [("a", "x"), ("b", "y")])
    assert frame.columns == ["Timestamp (ns)", "Human-Readable Time (UTC)", "x", "y"]
    assert [tuple(r)[1:] for r in frame.collect()] == [("1970-01-01T00:00:00Z", "1.000000", "3.000000"), ("1970-01-01T00:00:00Z", "2.000000", ""), ("1970-01-01T00:00:01Z", "", "4.000000")]


def test_time_before_epoch(spark):
    assert spark.range(1).select(rfc3339(F.lit(-1).cast("long")).alias("t")).first()["t"] == "1969-12-31T23:59:59Z"


@pytest.mark.parametrize(("collection", "prefix", "tags", "want"), [("col.abc", False, {"foo": None}, 32), ("col.abc", True, {"foo": None}, 64), ("col.abc", False, {"foo": "001"}, 16), ("col.abc", True, {"foo": "001"}, 32), ("col.", True, {"foo": "001", "bar": "003"}, 2), ("col.", True, {"foo": "001", "bar": None}, 32)])
def test_lookup(spark, collection, prefix, tags, want):
    rows = [(f"{c}-{i}", c, {"foo": f"{i % 2:03}", "bar": f"{i:03}"}, {}, 1) for c in ("col.abc", "col.abc.d") for i in range(32)]
    streams = spark.createDataFrame(rows, "uuid string, collection string, tags map<string,string>, annotations map<string,string>, annotation_version long")
    assert metadata.lookup_streams(streams, collection, prefix, tags).count() == want


@pytest.mark.parametrize(("call", "code"), [
    (lambda: validate.time_range(5, 5), 413), (lambda: validate.time_range(MIN_TIME - 1, 0), 413), (lambda: validate.time_range(0, MAX_TIME), 413),
    (lambda: validate.aligned_range(0, 10, 64), 415), (lambda: validate.window_range(0, 10, 0, 0), 415), (lambda: validate.window_range(0, 10, 1, 64), 415),
    (lambda: validate.window_range(0, 10, 11, 0), 413), (lambda: validate.versions(3, 2), 427), (lambda: validate.key("Foo"), 408), (lambda: validate.key("a" * 64), 408),
    (lambda: validate.tag_value(""), 409), (lambda: validate.collection(""), 407),
])
def test_validation(call, code):
    with pytest.raises(EngineError) as e:
        call()
    assert e.value.code == code


def test_aligned_end_may_be_the_last(spark):
    assert validate.aligned_range(0, MAX_TIME, 36) == (0, MAX_TIME)


def test_plans(spark, tmp_path):
    from tidemark.sources import adapters

    df = adapters.events_points(spark, "/root/testdata/sf0.001", since="2024-01-05", until="2024-01-10").where("uuid = 'click'")
    plan = raw.raw_values(df, 0, 1 << 60, ordered=False)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "LessThan(ts" in plan
    stats = windows.aligned_windows(df, 0, 1 << 60, 41)._jdf.queryExecution().executedPlan().toString()
    assert stats.count("Exchange ") == 1
