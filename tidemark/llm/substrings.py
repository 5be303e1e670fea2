"""Removal of passages that repeat across documents, found by level-wise doubling of word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import in_arrow, materialize, settled


def _sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of every n successive entries, by doubling."""
    width, out = 1, x
    while width * 2 <= n:
        out = best(out[:-width], out[width:])
        width *= 2
    return best(out[: len(x) - n + 1], out[n - width :][: len(x) - n + 1]) if width < n else out


def anchors(w: tokens.Words, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows of ``half`` words that represent the first level: those that are the smallest
    of some half + 1 successive windows of their row, so each window of 2 * half words holds one or more. Where a few words
    come again and again, every turn of them is a smallest one; of those that follow each other in a stretch of half + 1
    words the first and the last are enough, as no run of half + 1 places has one between them and neither of them."""
    rows = np.diff(w.first)
    h = tokens.windows(w.hash, half)
    if len(h) < half + 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = _sliding(h, half + 1, np.minimum)
    room = np.repeat(w.first[1:], rows) - np.arange(len(w.hash))  # words from here to the row's end
    low[room[: len(low)] < 2 * half] = 0
    padded = np.concatenate([np.zeros(half, np.uint64), low, np.zeros(half, np.uint64)])
    high = _sliding(padded, half + 1, np.maximum)[: len(h)]
    at = np.flatnonzero((high == h) & (h > 0))
    at = at[room[at] >= half]
    row, cell = w.row[at], (at - w.first[w.row[at]]) // (half + 1)
    same = (h[at][1:] == h[at][:-1]) & (row[1:] == row[:-1]) & (cell[1:] == cell[:-1])
    inner = np.zeros(len(at), bool)
    inner[1:-1] = same[1:] & same[:-1]
    at = at[~inner]
    return at, h[at]


def _first_level(half: int):
    schema = pa.schema([("id", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("hashes", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tokens.plain(batch.column("text"))
            for a, b in tokens.runs(column):
                w = tokens.words(column, a, b, wide=True)
                at, h = anchors(w, half)
                bounds = pa.array(np.searchsorted(at, w.first), pa.int32())
                both = np.stack([w.hash, w.other], 1)
                digests = [hashlib.blake2b(both[i:j], digest_size=16).digest() for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
                place = (at - w.first[w.row[at]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), batch.column("t").slice(a, b - a), pa.array(np.diff(w.first), pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(bounds, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(place))], schema=schema)

    return run


def _second_level(half: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tokens.plain(batch.column("text"))
            known, lists = batch.column("places").flatten().to_numpy(zero_copy_only=False), batch.column("places").value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists)
            ids, texts = batch.column("id").to_numpy(), batch.column("t").to_numpy()
            for a, b in tokens.runs(column):
                w = tokens.words(column, a, b, wide=True)
                if len(w.hash) < 2 * half:
                    continue
                h = tokens.windows(w.hash, half)
                begin = ends[a:b] - lists[a:b]
                at = np.repeat(w.first[:-1], lists[a:b]) + known[begin[0] : ends[b - 1]]
                marked = np.full(len(h), np.iinfo(np.uint64).max, np.uint64)
                marked[at] = h[at]
                # a full window stands or falls with the smallest of its halves, which is an anchor wherever it occurs
                lead = _sliding(marked, half + 1, np.minimum) == _sliding(h, half + 1, np.minimum)
                room = np.repeat(w.first[1:], np.diff(w.first)) - np.arange(len(w.hash))
                s = np.flatnonzero(lead & (room[: len(lead)] >= 2 * half))
                one, two = (tokens.follow(x[s], x[s + half]) for x in (h, tokens.windows(w.other, half)))
                r = w.row[s]
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(ids[a + r]), pa.array(texts[a + r]), pa.array((s - w.first[r]).astype(np.int32))], names=["k1", "k2", "id", "t", "place"])

    return run


def _cut(window: int, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, whole, places = batch.column("text"), batch.column("whole"), batch.column("places")
            done = []
            for i in range(batch.num_rows):
                found = (texts[i].as_py() or "").encode().split()
                n = len(found)
                starts = places[i].values
                if whole[i].as_py() and n >= window:
                    found = []
                elif starts is not None and len(starts):
                    step = np.zeros(n + 1, np.int32)
                    at = starts.to_numpy()
                    step[at] += 1
                    step[at + window] -= 1
                    keep = np.cumsum(step[:n]) == 0
                    found = [x for x, k in zip(found, keep.tolist(), strict=True) if k]
                done.append((n, n - len(found), b" ".join(found).decode()))
            columns = [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns, *(batch.column(f"carry_{c}") for c in carry)], names=["doc_id", "n_words", "n_removed", "kept_text", *(f"carry_{c}" for c in carry)])

    return run


def _marks(rows: DataFrame, window: int) -> DataFrame:
    """id, t, places (starts of windows to remove) and whole of the rows (id, text, t) that lose words."""
    half = window // 2
    level = in_arrow(rows, _first_level(half), "id long, t long, n long, digest binary, hashes array<long>, places array<int>")
    level = materialize(level.where(f"n >= {window} and id is not null"), "level-1")
    # minima are written before they meet rows again: both sides of a join are plain exchanges then, and Spark can split a hot key
    heads = materialize(level.groupBy("digest").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last").drop("last"), "heads")
    copies = level.select("id", "t", "digest").join(heads, "digest").where("id > head").select("id", "t", F.lit(True).alias("whole")).distinct()
    copies = materialize(copies, "copies")
    own = level.join(copies.select("id", "t"), ["id", "t"], "left_anti").select("id", "t", F.explode(F.arrays_zip("hashes", "places")).alias("x")).select("id", "t", F.col("x.hashes").alias("h"), F.col("x.places").alias("place"))
    shared = own.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("h")
    shared = materialize(shared, "shared-anchors")
    again = own.join(shared, "h", "left_semi").groupBy("id", "t").agg(F.collect_set("place").alias("places"))
    again = materialize(again, "repeated-anchors")
    # no side of the joins with texts has a bound, so none is broadcast, whatever its size here
    level2 = in_arrow(rows.where("id is not null").hint("merge").join(again, ["id", "t"]).select("id", "t", "text", "places"), _second_level(half), "k1 long, k2 long, id long, t long, place int")
    level2 = materialize(level2, "level-2")
    least = level2.groupBy("k1", "k2").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("k1", "k2", "low")
    least = materialize(least, "shared-windows")
    covered = level2.join(least, ["k1", "k2"]).where("id > low").groupBy("id", "t").agg(F.collect_set("place").alias("places"), F.lit(False).alias("whole"))
    return covered.unionByName(copies.withColumn("places", F.lit(None).cast("array<int>")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of every row: the words left once each word is removed that lies in a
    window of ``window`` (even) words whose sequence also starts in a document with a smaller id, joined by one space.

    Level one looks at windows of half that length. Of these, only the anchors (see :func:`anchors`) are dealt by hash;
    every full window holds at least one. Anchors that occur in a single document end there. Level two forms windows of
    twice the length, only where the anchor that leads one is repeated, and takes the smallest id of each by partial minima;
    windows are keyed by 128 bits, two hashes of their words that are independent down to the letters and are mixed in
    full word by word and run by run, so that of 10 ** 14 windows two different ones agree with probability 10 ** -11. Doubling ends at ``window``, as longer repeats consist of such windows.
    A passage that any number of documents share is a skewed join, which Spark splits.

    A document whose whole word sequence equals that of a smaller id takes no part and loses all words if it has at
    least ``window``. Null, empty and blank texts have no words and give an empty kept_text. Rows with equal ids are
    cut one by one and are no sources for each other; a row with a null id loses nothing and is no source. Other
    columns are ignored, but for those named in ``carry``, returned as carry_<name>; an empty table gives an empty one.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be an even number of words")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("t", F.xxhash64("text"))
    marks = settled(lambda: _marks(rows, window), "marks")
    all_rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"carry_{c}") for c in carry)).withColumn("t", F.xxhash64("text")) if carry else rows
    ready = all_rows.hint("merge").join(marks, ["id", "t"], "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    types = "".join(f", carry_{c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return in_arrow(ready, _cut(window, list(carry)), "doc_id long, n_words long, n_removed long, kept_text string" + types)
