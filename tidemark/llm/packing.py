"""Token pieces and their packing into sequences of a fixed length, by patterns fitted to the length histogram."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, materialize, partitions

CACHE = 1 << 19
_ODD = re.compile(r"\s \s|\s \Z")


def _ranks(path: str):
    """A faster encoder with the same ids for words that the cache lacks, built from the tokenizer file itself, and the
    file's special texts; None unless the file is a plain byte-level BPE whose ids are its merge ranks."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    pre, model = told.get("pre_tokenizer") or {}, told["model"]
    special = [t["content"] for t in told.get("added_tokens", [])]
    if model.get("type") != "BPE" or told.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or pre.get("use_regex") is False or model.get("ignore_merges") or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; others follow 255
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    first = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    if [vocab.get(m.replace(" ", "")) for m in first] != list(range(256, 256 + len(first))):
        return None
    # Fixed value: the byte-level pre-tokeniser's pattern.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), special


class _Encoder(dict):
    """Bytes of the token ids of each chunk seen. A chunk is a word with the space before it: the pre-tokeniser never
    joins what comes before such a space with it, so ids of a text are those of its chunks, in order, as long as no
    space stands between two white spaces or, after one, at the end. The cache is emptied when it holds ``CACHE`` chunks. Texts with one of the
    file's special tokens and all texts of other kinds of tokenizer go to the tokenizer as they are."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.model = Tokenizer.from_file(path)
        self.fast, self.special = _ranks(path) or (None, [])

    def ids(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        self[chunk] = found = np.array(self.fast.encode_ordinary(chunk), "<u4").tobytes()
        return found

    def encode(self, text: str) -> bytes:
        if self.fast is None or _ODD.search(text) or any(x in text for x in self.special):
            return self.ids(text)
        if len(self) > CACHE:
            self.clear()
        first, *rest = text.split(" ")
        return self[first] + b"".join([self[" " + x] for x in rest]) if first or rest else b""


_encoders: dict[str, _Encoder] = {}


def _pieces(path: str, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, _Encoder(path))
        close = np.array([end], "<u4").tobytes()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, text in enumerate(batch.column("text")):
                ids = encoder.encode(text.as_py() or "") + close
                n = len(ids) // 4
                at, part = 0, 0
                while at < n:
                    length = n if n <= size else (n - at - 1) % size + 1
                    for x, v in zip(out, (i, part, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])), strict=True):
                        x.append(v)
                    at, part = at + length, part + 1
            if out[0]:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(out[0])), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str, size: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document's ids: the text's by the tokenizer file, then ``end``. Only documents of more than
    ``size`` ids are cut; their first piece takes the odd rest, so all others are full. A null or empty text is the
    single id ``end``. doc_id, piece, start, length, ids_crc32."""
    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_arrow(columns, _pieces(tokenizer, size, end), "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(size: int) -> np.ndarray:
    """All patterns of one, two or three lengths, not descending, that fill ``size``; 0 stands for no document."""
    found = [np.array([[0, 0, size]])]
    x = np.arange(1, size // 2 + 1)
    found.append(np.stack([0 * x, x, size - x], 1))
    for a in range(1, size // 3 + 1):
        b = np.arange(a, (size - a) // 2 + 1)
        found.append(np.stack([0 * b + a, b, size - a - b], 1))
    return np.concatenate(found)


def fit(counts: np.ndarray, shapes: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeat counts x of ``shapes`` that minimise the squared distance of the lengths they use from the
    histogram ``counts``, by multiplicative updates, which keep x non-negative and never increase the distance. Long
    lengths weigh more, as short documents fill gaps later."""
    size = len(counts) - 1
    weight = np.where(np.arange(size + 1) > size // 8, 1.0, 0.1)
    weight[0] = 0
    target = weight * counts
    up = target[shapes].sum(1)
    x = np.where((counts[shapes] > 0) | (shapes == 0), 1.0, 0.0).prod(1) * max(counts[1:].max(), 1) / size
    for _ in range(rounds):
        used = np.zeros(size + 1)
        for j in range(3):
            used += np.bincount(shapes[:, j], x, size + 1)
        down = (weight * used)[shapes].sum(1)
        x *= up / np.maximum(down, 1e-12)
    return x


def plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """(lengths in a sequence, repeats) that use every document of the histogram ``counts`` (by length, 0 unused)."""
    size, left, out = len(counts) - 1, counts.astype(np.int64).copy(), []
    left[0] = 0
    shapes = patterns(size)
    x = fit(counts.astype(float), shapes)
    for i in np.argsort(-x, kind="stable"):
        if x[i] < 0.5:
            break
        shape = [int(v) for v in shapes[i] if v]
        times = min(int(np.floor(x[i] + 1e-6)) or 1, *(int(left[v]) // shape.count(v) for v in shape))
        if times > 0:
            for v in shape:
                left[v] -= times
            out.append((shape, times))
    # what is left, best fit from the longest: kinds of open sequences by the room in them, dealt with in bulk
    rooms: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    for length in range(size, 0, -1):
        todo = int(left[length])
        for room in range(length, size):
            while todo and rooms[room]:
                shape, times = rooms[room].pop()
                used = min(times, todo)
                rooms[room - length].append(([*shape, length], used))
                if times > used:
                    rooms[room].append((shape, times - used))
                todo -= used
        while todo:
            fits = size // length
            full, rest = divmod(todo, fits)
            if full:
                rooms[size - fits * length].append(([length] * fits, full))
            if rest:
                rooms[size - rest * length].append(([length] * rest, 1))
            todo = 0
    return out + [x for room in rooms.values() for x in room]


def slots(packs: list[tuple[list[int], int]], size: int) -> tuple[np.ndarray, ...]:
    """Where the k-th document of a length goes: arrays (key, sequence, offset, step) of runs, sorted by key =
    length << 40 | first rank. Document number k of a run goes to sequence + k // step, at offset + k % step * length."""
    cursor = np.zeros(size + 1, np.int64)
    found, sequence = [], 0
    for shape, times in packs:
        at = 0
        for length in sorted(set(shape), reverse=True):
            same = shape.count(length)
            found.append(((length << 40) | int(cursor[length]), sequence, at, same))
            cursor[length] += same * times
            at += same * length
        sequence += times
    found.sort()
    return tuple(np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def _place(runs: tuple[np.ndarray, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sequence, offset, step = runs
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            mine = (length << 40) | rank
            i = np.searchsorted(key, mine, "right") - 1
            k = mine - key[i]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence[i] + k // step[i]), pa.array(offset[i] + k % step[i] * length)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset, gapless in each sequence.

    The histogram of piece lengths (``size`` numbers, whatever the input) decides on the driver how often each pattern
    of up to three lengths that fills a sequence is used (:func:`fit`, rounded down); what is left goes by best fit
    from the longest. A piece finds its place from its rank among pieces of its length: ranks are counted in salted
    groups first, so the most common length is not one task's work. The plan sent to executors holds at most three runs
    for each of the size ** 2 / 12 patterns and those of the rest, which depend on ``size`` alone.

    Null and empty texts are single pieces of one id; rows with equal ids are packed each; a null id stays null. An
    empty table gives an empty one. Other columns are ignored."""
    salts = 8 * partitions(docs.sparkSession)
    cut = materialize(pieces(docs, tokenizer, size, end, id_col, text_col).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")), "pieces")
    groups = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = np.zeros(size + 1, np.int64)
    for length, n in groups.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[length] = n
    from pyspark.sql import Window

    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    base = materialize(groups.withColumn("base", before).drop("n"), "ranks")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    # ranks grow with the cluster and are dealt like the pieces, so they aren't broadcast, whatever their size here
    ranked = cut.withColumn("k", F.row_number().over(order) - 1).join(base.hint("merge"), ["length", "salt"])
    ranked = ranked.withColumn("rank", (F.col("k") + F.col("base")).cast("long")).drop("k", "base", "salt")
    return in_arrow(ranked, _place(slots(plan(counts), size)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
