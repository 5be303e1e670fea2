"""Shared folders, lineage cuts and file access used by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
WORDS = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session, or, only where that is
    unset (tests, local mode), a folder in the warehouse, which is then also set as the checkpoint folder. On a cluster
    it must be set, as the default warehouse is a disk of one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def make_dirs(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below :func:`shared_root`, removed when the driver's Python ends."""
    path = f"{shared_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"

    def clean() -> None:
        with contextlib.suppress(Exception):
            remove(spark, path)

    atexit.register(clean)
    _written.append(path)
    return path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """While this lasts, Spark removes a query's shuffle files once the query has ended. They would else stay until the
    driver happens to collect its garbage, and add up over the steps of an operator. Nothing that ends in a written
    table reads them again; a plan that is run a second time makes them anew."""
    before = spark.conf.get(_CLEANUP, None)
    if before is None:  # a Spark that lacks the setting
        yield
        return
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage ends at files that survive the loss
    of any executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``materialize`` what ``make`` returns, then remove the folders that ``make`` wrote on the way: the result's files
    need none of them. Nothing else that ``make`` returned or kept may be used afterwards."""
    start = len(_written)
    made = make()
    before = _written[start:]
    out = materialize(made, name)
    for path in before:
        remove(out.sparkSession, path)
        _written.remove(path)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def open_store(uri: str):
    """(pyarrow file system, path) of a folder URI, for executor-side readers and writers of binary files."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: where it isn't on PYTHONPATH, send it to the executors as a zip once."""
    import io
    import os
    import tempfile
    import zipfile
    from pathlib import Path

    top = Path(__file__).resolve().parents[1]
    sc = spark.sparkContext
    if str(top.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_tidemark_shipped", False):
        return
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    at = Path(tempfile.mkdtemp()) / f"{top.name}.zip"
    at.write_bytes(out.getvalue())
    sc.addPyFile(str(at))
    sc._tidemark_shipped = True


def freed(function):
    """``function`` over a task's batches; then the worker, which serves other tasks, gives its free memory back."""

    def run(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def in_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` with the package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(freed(function), schema)
