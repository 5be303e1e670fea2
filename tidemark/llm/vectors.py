"""Near-duplicate vectors by a pivot-permutation index: ordered nearest reference vectors, inverted lists, verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, materialize, ship
from .components import connected_components

NEAREST, SHARED, BLOCK, MOST_PIVOTS, PER_PIVOT = 10, 1, 4096, 4096, 100
CELLS, HOMES, CROWD = 8, 8, 8192


def pivot_count(n: int) -> int:
    """Pivots for n different vectors: one for each ``PER_PIVOT``, 64 at least."""
    return max(64, n // PER_PIVOT)


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(big > 0, big, 1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel(), kind))


def _ranked(near: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, the largest first; of values equal but for rounding, the earlier place."""
    near = np.round(near, 9) - np.arange(near.shape[1]) * 1e-14
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)


def _described(names: np.ndarray, pivots: np.ndarray, nearest: int):
    """rep, copies, v and the names of the ``nearest`` pivots in order."""
    unit, k = _unit(pivots), min(nearest, len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                order = _ranked(_unit(_matrix(part.column("v"))) @ unit.T, k)
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("copies"), part.column("v"), _lists(names[order], pa.int64())], names=["rep", "copies", "v", "pivots"])

    return run


def _in_cell(nearest: int):
    """For the vectors of a part of a cell: the nearest of the cell's pivots, with their cosines."""

    def run(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        rows, pivots = rows.combine_chunks(), pivots.combine_chunks().sort_by([("rep", "descending")])
        if not rows.num_rows or not pivots.num_rows:
            return pa.table({"rep": pa.array([], pa.int64()), "near": pa.array([], pa.list_(pa.float64())), "names": pa.array([], pa.list_(pa.int64()))})
        names, unit = pivots.column("rep").to_numpy(), _unit(_matrix(pivots.column("v").combine_chunks()))
        x, step, found = _unit(_matrix(rows.column("v").combine_chunks())), max(1, (1 << 21) // len(names)), []
        for at in range(0, len(x), step):
            near = x[at : at + step] @ unit.T
            order = _ranked(near, min(nearest, len(names)))
            found.append((np.round(np.take_along_axis(near, order, 1), 9), names[order]))
        near, order = (np.concatenate(f) for f in zip(*found, strict=True))
        return pa.table({"rep": rows.column("rep"), "near": _lists(near, pa.float64()), "names": _lists(order, pa.int64())})

    return run


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches by links (i, j)."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        while (root != root[root]).any():
            root = root[root]
        live = root[i] != root[j]
        i, j = i[live], j[live]
    return root


def _compare(threshold: float, shared: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        pivot, one, two = (k.as_py() for k in key)
        rows = rows.combine_chunks().sort_by("rep")
        x, marks = (_unit(_matrix(rows.column("v").combine_chunks())), _matrix(rows.column("pivots").combine_chunks()))
        known, place = np.unique(marks, return_inverse=True)
        has = np.zeros((len(x), len(known)), bool)
        has[np.arange(len(x))[:, None], place.reshape(marks.shape)] = True
        pad = -len(known) % 64
        has, before = (np.packbits(np.pad(m, ((0, 0), (0, pad))), axis=1).view(np.uint64) for m in (has, (known < pivot)[None]))
        block, rep, copies = (rows.column(c).to_numpy() for c in ("block", "rep", "copies"))
        links, pairs = np.zeros(len(x), np.int64), []
        for at in range(0, len(x), 256):
            i, j = np.nonzero(x[at : at + 256] @ x.T >= threshold)
            i += at
            ok = (i != j) & ((block[i] == one) & (block[j] == two) | (block[i] == two) & (block[j] == one))
            i, j = i[ok], j[ok]
            # each pair counts in the list of the first pivot that both share, and there in one pair of blocks
            both = has[i] & has[j]
            ok = (np.bitwise_count(both).sum(1) >= shared) & ~(both & before).any(1)
            i, j = i[ok], j[ok]
            np.add.at(links, i, copies[j])
            pairs.append(np.stack([i, j]))
        pairs = np.concatenate(pairs, 1)
        root = _roots(len(x), *pairs)
        some = links > 0
        return pa.table({"a": rep[some], "b": rep[root[some]], "links": links[some]})

    return run


def _pivots_of(classes: DataFrame, nearest: int) -> tuple[DataFrame, int]:
    """rep, copies, v and pivots (names of the nearest ones in order, the first again where there are fewer) of classes
    with as many numbers each; and how many cells there are. Tables of all sizes go the same way."""
    count = classes.count()
    wanted = pivot_count(count)
    # cells around few pivots hold all pivots; a vector is held against those of its nearest cells
    ranked = classes.withColumn("rank", F.pmod(F.xxhash64("rep"), F.lit(1 << 40)))
    chosen = ranked.orderBy("rank", "rep").limit(min(MOST_PIVOTS, 2 * int(wanted**0.5))).collect()
    names, coarse = np.array([r["rep"] for r in chosen], np.int64), np.array([r["v"] for r in chosen], float)
    near = lambda k: _described(names, coarse, k)
    types = f"rep long, copies long, v {classes.schema['v'].dataType.simpleString()}, pivots array<long>"
    last = max(chosen[-1]["rank"], (1 << 40) * wanted // count)  # a cell's own pivot is one of all
    homes = in_arrow(ranked.where(F.col("rank") <= last).drop("rank"), near(HOMES), types).select("rep", "v", F.explode("pivots").alias("cell"))
    homes = materialize(homes, "vector-cells")
    near_cells = materialize(in_arrow(classes, near(CELLS), types), "vector-visits")
    visits = near_cells.select("rep", "v", F.explode("pivots").alias("cell"))
    parts = materialize(visits.groupBy("cell").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("parts")), "cell-sizes")
    visits = visits.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    many = parts.select(F.col("cell").alias("home"), F.col("parts").alias("many"))
    homes = homes.withColumnRenamed("cell", "home").join(many, "home").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    ship(classes.sparkSession)
    found = visits.select("cell", "part", "rep", "v").groupBy("cell", "part").cogroup(homes.select("home", "piece", "rep", "v").groupBy("home", "piece")).applyInArrow(_in_cell(nearest), "rep long, near array<double>, names array<long>")
    best = found.groupBy("rep").agg(F.flatten(F.collect_list(F.arrays_zip("near", "names"))).alias("all"))  # of CELLS cells
    best = best.select("rep", F.transform(F.slice(F.sort_array(F.array_distinct("all"), asc=False), 1, nearest), lambda p: p["names"]).alias("pivots"))
    best = best.withColumn("pivots", F.concat("pivots", F.array_repeat(F.element_at("pivots", 1), F.lit(nearest) - F.size("pivots"))))
    return classes.join(materialize(best, "vector-pivots"), "rep").select("rep", "copies", "v", "pivots"), len(chosen)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """id, n_links (rows linked directly), component_id (smallest id reachable) and kept of every row.

    Equal vectors form a class that is compared once and counts with its copies. Reference vectors (pivots) are a
    sample of :func:`pivot_count` classes, chosen by hash; each class is described by its ``nearest`` pivots in order and
    enters their inverted lists. Pivots are as many as the classes ask for, so lists stay as long as they are. Whatever
    the table's size, each pivot lies in the ``HOMES`` nearest of the cells around a few of them (``MOST_PIVOTS`` at
    most), and a class is held against the pivots of its ``CELLS`` nearest cells. Within a list, classes that share at
    least ``shared`` pivots are verified by cosine in double precision. A list of more than
    ``BLOCK`` rows, which only a crowd of similar vectors fills, is cut into blocks that meet in pairs, as each of the
    crowd's links counts; no pair of vectors is ever emitted, only link sums and the edges of a spanning forest for each
    pair of blocks.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do vectors of
    different lengths with each other. Rows with equal ids are vectors of their own in n_links and share a component if
    linked. A null id is kept with null component_id and links with nothing. An empty table gives an empty one."""
    kind = vectors.schema[vector_col].dataType.simpleString()  # floats travel as they are and are widened to compare
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind if kind == "array<float>" else "array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.withColumn("ok", F.coalesce(F.col("id").isNotNull() & (F.size("v") > 0) & finite, F.lit(False)))
    classes = materialize(rows.where("ok").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "vector-classes")
    parts = []
    for (dims,) in classes.select(F.size("v")).distinct().collect():  # one for each length of vectors in the table
        described, cells = _pivots_of(classes.where(F.size("v") == dims), nearest)
        told = materialize(described, "described")
        lists = told.select("*", F.explode(F.array_distinct("pivots")).alias("pivot"))
        size = lists.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        long = materialize(size.where("blocks > 1"), "long-lists")
        lists = lists.join(long, "pivot", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
        ship(lists.sparkSession)
        parts.append(lists.groupBy("pivot", "one", "two").applyInArrow(_compare(threshold, min(shared, nearest, cells)), "a long, b long, links long"))
    if not parts:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    found = materialize(found, "vector-links")
    sums = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "rep")
    comp = connected_components(found.select("a", "b")).select(F.col("id").alias("rep"), "component")
    named = classes.join(sums, "rep", "left").join(comp, "rep", "left")
    named = named.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    good = rows.where("ok").join(named, "v").select("id", "n", "c")
    bad = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("c"))
    return good.unionByName(bad).select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept"))
