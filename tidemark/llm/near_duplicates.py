"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import in_arrow, materialize, settled, ship
from .components import connected_components

BINS, ROWS = 256, 6
BANDS = BINS // ROWS
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
_U = np.uint64


def _probes(bins: int) -> np.ndarray:
    """For each bin, the order in which it looks for a bin to borrow from: a seeded permutation of all bins."""
    rng = np.random.default_rng(20240229)
    return np.stack([rng.permutation(bins) for _ in range(bins)])


_PROBES = _probes(BINS)
_SALT = tokens.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)).reshape(BANDS, ROWS)


def signatures(row: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """Densified one-permutation MinHash of sets given as sorted (row, hash). The top bits of a hash are its bin, so
    the smallest hash of a bin is the first of its run. An empty bin takes the value of the first non-empty bin in its
    own probing order, which is the same for all documents. Rows without hashes stay at the largest value."""
    sig = np.full((rows, BINS), np.iinfo(np.uint64).max, np.uint64)
    place = (hashes >> _U(64 - BINS.bit_length() + 1)).astype(np.int64)
    new = np.ones(len(hashes), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    full = np.zeros((rows, BINS), bool)
    full[row[new], place[new]] = True
    sig[row[new], place[new]] = hashes[new]
    r, b = np.nonzero(~full & full.any(axis=1)[:, None])
    for t in range(BINS):
        if not len(r):
            break
        source = _PROBES[b, t]
        found = full[r, source]
        sig[r[found], b[found]] = sig[r[found], source[found]]
        r, b = r[~found], b[~found]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of ``ROWS`` bins."""
    cut = sig[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
    return tokens.mix((tokens.mix(cut ^ _SALT) * (_SALT | _U(1))).sum(axis=2, dtype=np.uint64))


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tokens.plain(batch.column(1))
            for at, to in tokens.runs(column):
                n = to - at
                row, h = tokens.shingle_sets(tokens.words(column, at, to, lower=True), words)
                count = np.bincount(row, minlength=n)
                ends = np.cumsum(count)
                digests = [hashlib.blake2b(h[e - c : e], digest_size=16).digest() for e, c in zip(ends, count, strict=True)]
                keys = band_keys(signatures(row, h, n)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(count, pa.int64()), pa.array(digests, pa.binary()), lists], schema=_SKETCH)

    return run


def sketches(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the sorted shingle set and the band keys of every document."""
    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_arrow(columns, _sketch(words), "doc_id long, n_shingles long, digest binary, bands array<long>")


class _Sets:
    """The shingle sets of a block of texts, compared by inverted lists of the shingles that several of them have."""

    def __init__(self, text: pa.Array, words: int) -> None:
        self.text, self.words = tokens.plain(text), words
        rows, hashes = [], []
        for at, to in tokens.runs(self.text):
            row, h = tokens.shingle_sets(tokens.words(self.text, at, to, lower=True), words)
            rows.append(row + at)
            hashes.append(h)
        row, (_, code) = np.concatenate(rows), np.unique(np.concatenate(hashes), return_inverse=True)
        self.size = np.bincount(row, minlength=len(text))
        often = np.bincount(code)[code] > 1
        self.row, self.code = row[often], code[often]
        self.first = np.searchsorted(self.row, np.arange(len(text) + 1))
        order = np.argsort(self.code, kind="stable")
        self.owners = self.row[order]
        self.start = np.searchsorted(self.code[order], np.arange(len(code) and code.max() + 2))

    def common(self, x: int) -> np.ndarray:
        """How many shingles each text shares with text ``x``."""
        mine = self.code[self.first[x] : self.first[x + 1]]
        many = self.start[mine + 1] - self.start[mine]
        ends = np.cumsum(many)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[mine] - ends + many, many)
        return np.bincount(self.owners[place], minlength=len(self.size))

    def exact(self, x: int) -> set:
        """The shingles of text ``x`` as words, for the last check of a link."""
        found = self.text[x].as_py().encode().lower().split()
        return set(zip(*(found[k:] for k in range(self.words)), strict=False)) or {tuple(found)}


def _joined(sets: _Sets, group: np.ndarray, scan: np.ndarray, wanted: np.ndarray | None, threshold: int) -> list[tuple[int, int]]:
    """Links (x, y) that join groups (numbers, changed in place). Each x of ``scan`` is held against all texts (with
    ``wanted``: those marked) of other groups. Without it, texts that by their turn are in the group of the first are
    passed over: a link between two of those joins nothing."""
    links: list[tuple[int, int]] = []
    for x in scan:
        if wanted is None and links and group[x] == group[scan[0]]:
            continue
        common, size = sets.common(x), sets.size
        near = (100 * common >= threshold * (size + size[x] - common)) & (common > 0) & (group != group[x])
        if wanted is not None:
            near &= wanted
        own = sets.exact(x) if near.any() else set()
        for y in np.flatnonzero(near):
            if group[y] != group[x]:
                both = len(own & (other := sets.exact(y)))
                if 100 * both >= threshold * (len(own) + len(other) - both):
                    group[group == group[y]] = group[x]
                    links.append((x, y))
    return links


def _pairs(rep: np.ndarray, links: list[tuple[int, int]]) -> pa.Table:
    at = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"a": rep[at[:, 0]], "b": rep[at[:, 1]]})


def _within(threshold: int, words: int):
    """Links within a block of a star: its centre first, then each text that isn't yet joined with it."""

    def run(key: tuple, block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        rep = block.column("rep").to_numpy()
        if len(rep) < 2:
            return _pairs(rep, [])
        sets = _Sets(block.column("text"), words)
        scan = np.lexsort((rep, rep != key[0].as_py()))
        return _pairs(rep, _joined(sets, np.unique(rep, return_inverse=True)[1], scan, None, threshold))

    return run


def _between(threshold: int, words: int):
    """Links between texts of a block and those of other blocks of its star that aren't in the star's main component."""

    def run(key: tuple, block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        rep, guest = block.column("rep").to_numpy(), block.column("guest").to_numpy(zero_copy_only=False)
        if guest.all() or not guest.any():
            return _pairs(rep, [])
        sets = _Sets(block.column("text"), words)
        group = np.unique(block.column("at").to_numpy(), return_inverse=True)[1]
        return _pairs(rep, _joined(sets, group, np.flatnonzero(guest), ~guest, threshold))

    return run


def _in_groups(rows: DataFrame, keys: list[str], function) -> DataFrame:
    ship(rows.sparkSession)
    return rows.groupBy(*keys).applyInArrow(function, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 80, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id and kept of every row of ``docs``.

    Documents whose sets of ``words``-word shingles are equal form a class, named after its smallest id; classes are
    compared by their smallest document. A class is put in one bucket for each of 42 bands of 6 minima, so that a pair
    at the threshold of 0.8 meets in none with probability 3e-6. Each bucket proposes star-shaped edges, from its
    smallest class to each of the others; edges of one centre are one star, whatever number of buckets they come from, so
    a crowd that fills many buckets costs as many edges as it has classes. Any two classes of a bucket are in one star.
    A star's texts are compared on full sets in one place: with the centre first, then each that is still apart with all
    others. Only links that join components leave it, so no pairs of a group are ever emitted and no link is lost.

    A star of more than ``BLOCK`` texts (or ``BLOCK_SHINGLES`` shingles) is dealt in blocks, each with the centre. Of a
    star whose blocks end in different components, those texts outside its main component then visit the other blocks.
    Sets are compared by 64-bit hashes of words; every link that joins two components is confirmed on the words.

    Null, empty and blank texts have no shingles, are linked with nothing and keep their own id. Rows with the same id
    and text count as one document; rows that repeat an id with another text share one component_id. A null id is
    returned with null component_id and kept true. An empty table gives an empty one. Other columns are ignored.
    """
    return settled(lambda: _near_duplicates(docs, id_col, text_col, threshold, words), "near-duplicates")


def _stars(heads: DataFrame) -> DataFrame:
    """c, rep, blk and blocks: the texts of every star, in blocks; the centre is in each block."""
    rows = heads.select("rep", F.explode("bands").alias("key"))
    # written first, so that the join meets two plain exchanges, of which Spark can split a hot key
    star = rows.groupBy("key").agg(F.min("rep").alias("c"), F.max("rep").alias("last")).where("c < last").drop("last")
    met = rows.join(materialize(star, "stars"), "key").select("c", "rep").distinct()
    met = materialize(met.join(heads.groupBy("rep").agg(F.max("n").alias("n")), "rep"), "edges")
    size = met.groupBy("c").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")).where("blocks > 1")
    dealt = met.join(size, "c", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    return materialize(dealt.select("c", "rep", "blocks", F.explode(F.when(F.col("c") == F.col("rep"), every).otherwise(own)).alias("blk")), "dealt-edges")


def _bridges(placed: DataFrame, comp: DataFrame, threshold: int, words: int) -> DataFrame | None:
    """Links between blocks of the stars that still hold several components; None if there are no such stars."""
    rows = placed.where("blocks > 1 and (c != rep or blk = 0)")
    at = rows.select("c", "rep", "blk").join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("at", F.coalesce("component", "rep")).drop("component")
    at = materialize(at, "blocks")
    kinds = at.groupBy("c", "at").agg(F.count("*").alias("m"))
    main = kinds.groupBy("c").agg(F.max_by("at", F.struct("m", "at")).alias("main"), F.count("*").alias("kinds"), F.sum("m").alias("all"), F.max("m").alias("most")).where("kinds > 1")
    main = materialize(main.select("c", "main", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("chunks"), F.ceil(F.col("all") / BLOCK).cast("int").alias("least")), "open-stars")
    if main.isEmpty():
        return None
    both = rows.join(at.select("c", "rep", "blk", "at"), ["c", "rep", "blk"]).join(main, "c")
    hosts = both.select("c", "rep", "text", "at", "blk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("guest"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("blk"))
    guests = both.where("at != main").select("c", "rep", "text", "at", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int").alias("chunk"), F.explode(others).alias("blk"), F.lit(True).alias("guest"))
    return _in_groups(hosts.unionByName(guests), ["c", "blk", "chunk"], _between(threshold, words))


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, threshold: int, words: int) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).where("rep is not null")
    sketch = materialize(sketches(docs, words, id_col, text_col), "sketch")
    filled = sketch.where("n_shingles > 0 and doc_id is not null")
    # written first, so that the join below meets two plain exchanges, of which Spark can split a hot digest's rows
    classes = materialize(filled.groupBy("digest").agg(F.min("doc_id").alias("rep")), "digests")
    named = sketch.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    named = materialize(named.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).alias("rep")), "classes")
    heads = filled.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "digest"], "left_semi").select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "bands")
    dealt = _stars(heads)
    # neither side has a bound, so neither is broadcast, whatever its size here
    placed = materialize(dealt.join(texts.hint("merge"), "rep"), "placed")
    links = materialize(_in_groups(placed, ["c", "blk"], _within(threshold, words)), "links")
    comp = materialize(connected_components(links), "components")
    more = _bridges(placed, comp, threshold, words)
    if more is not None:
        comp = materialize(connected_components(links.unionByName(materialize(more, "bridges"))), "components")
    out = named.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n_shingles", F.col("rep").alias("class_id"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
    repeated = out.groupBy("doc_id").agg(F.min("component_id").alias("low"), F.count("*").alias("times")).where("times > 1").select("doc_id", "low")
    out = out.join(repeated, "doc_id", "left").withColumn("component_id", F.coalesce("low", "component_id")).drop("low")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
