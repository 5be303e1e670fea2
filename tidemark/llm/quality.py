"""A quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import in_arrow, materialize

FEATURES, BINS, PARTS = 384, 500, 16
_KINDS = np.zeros(256, np.uint8)  # classes of bytes
_KINDS[65:91], _KINDS[97:123], _KINDS[48:58], _KINDS[128:] = 1, 2, 3, 4
_KINDS[[9, 11, 12, 13, 32]], _KINDS[10] = 5, 6
for _i, _c in enumerate(b".,;:!?|*%$#&<>{}[]()/\\=_-\"'@+~^`"):
    _KINDS[_c] = 7 if _c in b".,;:" else 8 if _c in b"!?" else 9 if _c in b"|/\\_=" else 10 if _c in b"*%$#&@+~^" else 11
_N_KINDS = 12


def statistics(column: pa.Array, at: int, to: int) -> np.ndarray:
    """A row of document statistics for each text: sizes, shares of byte classes, shapes and repetition of words."""
    w, rows = tokens.words(column, at, to), to - at
    bounds = tokens.offsets(column)[at : to + 1] - tokens.offsets(column)[at]
    size = np.diff(bounds).astype(float)
    n = np.diff(w.first).astype(float)
    kinds = np.zeros((rows, _N_KINDS))
    total = np.zeros(len(w.data) + 1, np.int64)
    kind = _KINDS[w.data]
    for k in range(_N_KINDS):
        np.cumsum(kind == k, out=total[1:])
        kinds[:, k] = total[bounds[1:]] - total[bounds[:-1]]

    def per_row(x: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0.0], np.cumsum(x, dtype=float)])
        return run[w.first[1:]] - run[w.first[:-1]]

    words, chars = np.maximum(n, 1), np.maximum(size, 1)
    length = (w.end - w.start).astype(float)
    mean = per_row(length) / words
    spread = np.sqrt(np.maximum(per_row(length**2) / words - mean**2, 0))
    caps = np.concatenate([[0], np.cumsum(kind == 1)])
    letters = np.concatenate([[0], np.cumsum((kind == 1) | (kind == 2) | (kind == 4))])
    up, letter = caps[w.end] - caps[w.start], letters[w.end] - letters[w.start]
    ends = kind[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)

    def distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        most = np.zeros(rows)
        begin = np.flatnonzero(new)
        np.maximum.at(most, row[begin], np.diff(np.append(begin, len(h))))
        return np.bincount(row[new], minlength=rows), most

    kinds_of_words, most = distinct(w.row, w.hash)
    pair_row, _ = tokens.shingle_sets(w, 2)
    pairs = np.bincount(pair_row, minlength=rows)
    lines = kinds[:, 6] + 1
    columns = [
        np.log1p(size), np.log1p(n), np.log1p(mean), np.log1p(spread), *(kinds[:, k] / chars for k in range(_N_KINDS)),
        kinds_of_words / words, pairs / np.maximum(n - 1, 1), most / words, np.log1p(kinds_of_words),
        per_row((up == letter) & (letter > 1)) / words, per_row(ends == 7) / words, per_row(ends == 8) / words, per_row(ends >= 9) / words,
        per_row(letter == 0) / words, per_row(length <= 3) / words, per_row(length >= 12) / words, np.log1p(n / lines), np.log1p(np.sqrt(kinds[:, 10] + kinds[:, 9])),
    ]
    return np.stack(columns, 1)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = tokens.plain(batch.column("text"))
        for at, to in tokens.runs(column):
            x = statistics(column, at, to)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), lists], names=["doc_id", "x"])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, the statistics of the whole text (null: empty); its length is the only one without an upper bound."""
    return in_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), _measure, "doc_id long, x array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray
    rate: float

    def waves(self, x: np.ndarray) -> np.ndarray:
        z = np.cos((x - self.mean) / self.scale @ self.turn + self.shift) * np.sqrt(2 / len(self.shift))
        return np.hstack([z, np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), self.rate)
        raw = self.waves(x) @ self.weights[:, 0]
        return np.clip(np.interp(raw, self.knots, self.levels), 0.0, 1.0) if len(self.knots) else np.clip(raw, 0.0, 1.0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _normal(model: Model):
    """Sums of a partition for each of two folds: z'z and z'y of its rows, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(model.shift) + 1
        zz, zy = np.zeros((2, d, d)), np.zeros((2, d))
        for batch in batches:
            if batch.num_rows:
                z, y, fold = model.waves(_matrix(batch.column("x"))), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
                for k in (0, 1):
                    zz[k] += z[fold == k].T @ z[fold == k]
                    zy[k] += z[fold == k].T @ y[fold == k]
        yield pa.RecordBatch.from_arrays([pa.array([zz.tobytes()]), pa.array([zy.tobytes()])], names=["zz", "zy"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the rows of :func:`_normal`, read one after the other; nothing for none."""
    total = None
    for batch in batches:
        for row in range(batch.num_rows):
            one = [np.frombuffer(batch.column(c)[row].as_py()) for c in ("zz", "zy")]
            total = one if total is None else [a + b for a, b in zip(total, one, strict=True)]
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in total], names=["zz", "zy"])


def _raw(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z, fold = model.waves(_matrix(batch.column("x"))), batch.column("fold").to_numpy()
                raw = np.where(fold == 0, z @ model.weights[:, 2], z @ model.weights[:, 1])  # by the other fold's weights
                place = np.clip(np.floor((raw + 0.5) * BINS / 2), 0, BINS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(raw), batch.column("y")], names=["bin", "raw", "y"])

    return run


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: knots (mean x of a pool) and non-descending levels (mean y)."""
    pools: list[list[float]] = []
    for a, b, c in zip(x, y, n, strict=True):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], top, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(measured: DataFrame, labels: DataFrame, ridge: float = 1e-3, seed: int = 7) -> Model:
    """Fit on every row of ``labels`` (doc_id, y from 0 to 1) that has a document; of rows that repeat an id each is
    learnt from. Random cosines approximate a Gaussian kernel over standardised statistics. Every task sums the normal
    equations of its rows, for two folds drawn by the id; ``PARTS`` tasks add those of all others, and the driver adds
    and solves theirs. Calibration pools violators among ``BINS`` bins of the scores that
    each fold's rows get from the other fold. What the driver gets depends on ``PARTS``, ``FEATURES`` and ``BINS`` only.
    Without labelled rows the score is 0.5 for all, with one class its rate."""
    rows = labels.groupBy("doc_id").agg(F.avg("y").alias("y")).where("y is not null")
    rows = measured.join(rows, "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))
    rows = materialize(rows.select("doc_id", "x", F.col("y").cast("double").alias("y"), "fold"), "training")
    moments = rows.select("y", F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.avg("y").alias("rate"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.count("*").alias("n")).orderBy("i").collect()
    empty = np.zeros(0)
    if not moments or moments[0]["lo"] == moments[0]["hi"]:
        return Model(empty, empty, empty, empty, empty, empty, empty, float(moments[0]["rate"]) if moments else 0.5)
    mean, scale = np.array([r["m"] for r in moments]), np.array([max(r["s"], 1e-6) for r in moments])
    rng, d = np.random.default_rng(seed), len(mean)
    model = Model(mean, scale, rng.normal(size=(d, FEATURES)) / np.sqrt(2 * d), rng.uniform(0, 2 * np.pi, FEATURES), empty, empty, empty, moments[0]["rate"])
    sums = in_arrow(rows, _normal(model), "zz binary, zy binary").repartition(PARTS)
    zz, zy = np.zeros((2, FEATURES + 1, FEATURES + 1)), np.zeros((2, FEATURES + 1))
    for a, b in in_arrow(sums, _added, "zz binary, zy binary").toLocalIterator():
        zz += np.frombuffer(a).reshape(zz.shape)
        zy += np.frombuffer(b).reshape(zy.shape)
    n = moments[0]["n"]
    solve = lambda a, b, m: np.linalg.solve(a + ridge * max(m, 1.0) ** 0.5 * np.eye(len(b)), b)
    model.weights = np.stack([solve(zz.sum(0), zy.sum(0), n), solve(zz[0], zy[0], n / 2), solve(zz[1], zy[1], n / 2)], 1)
    bins = in_arrow(rows, _raw(model), "bin int, raw double, y double").groupBy("bin").agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    model.knots, model.levels = isotonic(*(np.array([r[c] for r in bins], float) for c in ("x", "y", "n")))
    return model


def score(measured: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row of :func:`features`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch.column("x"))))], names=["doc_id", "score"])

    return in_arrow(measured, run, "doc_id long, score double")


def held_out(col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 4 == 2, F.lit(False))


def _known(labels: DataFrame) -> DataFrame:
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    return rows.where(~held_out() & F.col("doc_id").isNotNull())


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row. Labels are read only where crc32 of the id as text modulo 4
    isn't 2. Null and empty texts are scored like any other; rows with equal ids each get their own score and are
    each learnt from; a null id is never learnt from and isn't held out. Empty tables give empty ones. Columns other
    than the id and the text are never read."""
    measured = materialize(features(docs, id_col, text_col), "statistics")
    scored = score(measured, fit(measured, _known(labels)))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`classify` predicts as 1, with all their columns. Each row is scored where it lies,
    so rows that share an id, or have none, are judged by their own texts, and no text is shuffled: the statistics of
    whole texts are taken twice, once to learn and once to judge. Null and empty texts are judged like any other; rows
    may repeat; columns may have any names. An empty table gives an empty one."""
    model = fit(materialize(features(docs, id_col, text_col), "statistics"), _known(labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tokens.plain(batch.column(text_col))
            for at, to in tokens.runs(column):
                good = model.score(statistics(column, at, to)) >= threshold
                yield batch.slice(at, to - at).filter(pa.array(good))

    return in_arrow(docs, run, docs.schema)
