"""Words, word hashes and shingles of whole Arrow string columns, vectorised over their UTF-8 buffers.

A word is a maximal run of bytes other than space and \\x09-\\x0D. All of a text is read, whatever its length; a column
is worked through in runs of rows of about ``SLICE`` bytes, so that memory follows the longest text, not the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with full avalanche (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)  # the first k bytes of eight
_STEPS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
LONG = 256


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seeds: int = 1) -> list[np.ndarray]:
    """One or two independent 64-bit hashes of the byte runs [start, end): eight bytes at a time go into a state that is
    mixed in full after each, so no arithmetic of letters and places is left for two words to agree in. Runs of more
    than ``LONG`` bytes are digested by BLAKE2."""
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    out = [mix(size.astype(np.uint64) + _U(step)) for step in _STEPS[:seeds]]
    live, at = np.flatnonzero(size <= LONG), start
    live = slice(None) if len(live) == len(size) else live
    at, left = start[live], size[live]
    while len(at):
        chunk = eights[at].view(np.uint64).ravel() & _KEEP[np.minimum(left, 8)]
        for h, step in zip(out, _STEPS, strict=False):
            h[live] = mix((h[live] ^ chunk) * _U(step))
        more = np.flatnonzero(left > 8)
        live = more if isinstance(live, slice) else live[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG):
        digest = hashlib.blake2b(data[start[i] : end[i]], digest_size=16).digest()
        for k, h in enumerate(out):
            h[i] = int.from_bytes(digest[8 * k : 8 * k + 8], "little")
    return out


@dataclass
class Words:
    """Words of a run of rows: ``row`` (ascending), ``hash`` (``other``: a second, independent one, if asked for) and byte
    bounds in ``data``; ``first[i]`` is the place of row i's first word, with one more entry at the end."""

    data: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    other: np.ndarray


def runs(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Bounds of successive runs of rows with about ``limit`` bytes each, or one longer row."""
    bounds = offsets(column)
    at, n = 0, len(column)
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def plain(column) -> pa.Array:
    """One chunk of large_string without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    return column.cast(pa.large_string())


def offsets(column: pa.Array) -> np.ndarray:
    buffer = column.buffers()[1]
    if buffer is None or len(column) == 0:
        return np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(buffer, np.int64)[column.offset : column.offset + len(column) + 1]


def words(column: pa.Array, at: int, to: int, lower: bool = False, wide: bool = False) -> Words:
    """Words of rows ``at`` to ``to`` of a column made by :func:`plain`."""
    bounds = offsets(column)[at : to + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[bounds[0] : bounds[-1]] if buffer is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = ~_SPACE[data]
    begins = np.zeros(n + 1, bool)
    begins[bounds[:-1]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | begins[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | begins[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    hashes = word_hashes(data, s, e, 1 + wide)
    first = np.searchsorted(s, bounds)
    row = np.repeat(np.arange(to - at), np.diff(first))
    return Words(data, row, hashes[0], s, e, first, hashes[-1])


def follow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a run from those of its two parts, in order."""
    return mix(a * _U(0x9FB21C651E98DF25) + b)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n successive entries (``len(hashes) - n + 1`` of them), from runs of doubled length: no sum of
    powers, which words in a regular order could defeat."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    run, size, out = hashes, 1, None
    while True:
        if n & size:  # this run, then those shorter ones that are already joined
            out = run if out is None else follow(run[: len(out) - size], out[size:])
        size *= 2
        if size > n:
            return out[:m]
        run = follow(run[: -(size // 2)], run[size // 2 :])


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``n``-word shingles as (row, hash), sorted by both. A row of fewer words has all of them as its only
    shingle, a row without words none."""
    rows, m = len(w.first) - 1, max(len(w.hash) - n + 1, 0)
    count = np.diff(w.first)
    h = w.hash[:m]
    for k in range(1, n):
        h = follow(h, w.hash[k : k + m])
    inside = w.first[1:][w.row[:m]] - np.arange(m) >= n  # others reach into the next row
    row, h = [w.row[:m][inside]], [h[inside]]
    for size in range(1, n):
        short = np.flatnonzero(count == size)
        x = w.hash[w.first[short]]
        for k in range(1, size):
            x = follow(x, w.hash[w.first[short] + k])
        row.append(short)
        h.append(mix(x + _U(size)))
    row, h = np.concatenate(row), np.concatenate(h)
    order = np.lexsort((h, row)) if rows > 1 else np.argsort(h, kind="stable")
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]
