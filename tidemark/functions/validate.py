"""Checks of arguments, in plain Python before a plan is built, and of tables of descriptors as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError
from ..schema import MAX_TIME, MIN_TIME

# Forms of keys and limits of texts.
KEY = re.compile(r"[a-z][a-z0-9_.]*\Z")
KEY_BYTES, VALUE_BYTES = 63, 255


def time_range(start: int, end: int) -> None:
    if start < MIN_TIME or end >= MAX_TIME or start >= end:
        raise EngineError(413, f"[{start}, {end})")


def point_width(pw: int) -> None:
    if not 0 <= pw <= 63:
        raise EngineError(415, str(pw))


def aligned_range(start: int, end: int, pw: int) -> tuple[int, int]:
    point_width(pw)
    start, end = start >> pw << pw, end >> pw << pw
    if start < MIN_TIME or end - 1 >= MAX_TIME or start >= end:
        raise EngineError(413, f"[{start}, {end})")
    return start, end


def window_range(start: int, end: int, width: int, depth: int) -> int:
    """The end, moved down to a whole number of windows."""
    if not 1 <= width <= 1 << 63 or not 0 <= depth <= 63:
        raise EngineError(415)
    if end - start < width:
        raise EngineError(413)
    end -= (end - start) % width
    time_range(start, end)
    return end


def versions(low: int, high: int | None) -> None:
    if high is not None and low > high:
        raise EngineError(427, f"{low} > {high}")


def key(text: str) -> None:
    if not KEY.match(text) or len(text.encode()) > KEY_BYTES:
        raise EngineError(408, text)


def tag_value(text: str) -> None:
    if not 1 <= len(text.encode()) <= VALUE_BYTES or "\0" in text:
        raise EngineError(409, text)


def annotation_value(text: str) -> None:
    if len(text.encode()) > VALUE_BYTES:
        raise EngineError(409, text)


def collection(text: str) -> None:
    try:
        size = len(text.encode())
    except UnicodeEncodeError:
        size = 0
    if not 1 <= size <= VALUE_BYTES or "\0" in text:
        raise EngineError(407, text)


def tags(values: dict[str, str]) -> None:
    for k, v in values.items():
        key(k)
        tag_value(v)


def annotations(values: dict[str, str]) -> None:
    for k, v in values.items():
        key(k)
        annotation_value(v)


def predicates(values: dict[str, str | None]) -> None:
    for k, v in values.items():
        key(k)
        if v is not None:
            annotation_value(v)


def updates(values: dict[str, str | None]) -> None:
    for k, v in values.items():
        key(k)
        if v is not None:
            annotation_value(v)


def _text(col: Column, least: int) -> Column:
    return F.octet_length(col).between(least, VALUE_BYTES) & (F.instr(col, "\0") == 0)


def key_ok(col: Column | str) -> Column:
    """Whether a text may be a key; null may not."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.rlike(f"^{KEY.pattern[:-2]}\\z") & (F.octet_length(col) <= KEY_BYTES), F.lit(False))


def collection_code(col: Column | str) -> Column:
    """407 for a text that can't be a collection, or null."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(~F.coalesce(_text(col, 1), F.lit(False)), 407)


def descriptor_code(collection: str, tags: str, annotations: str) -> Column:
    """The code for which a stream's descriptor is refused, or null."""
    keys = F.forall(F.map_keys(tags), key_ok) & F.forall(F.map_keys(annotations), key_ok)
    good = F.forall(F.map_values(tags), lambda v: F.coalesce(_text(v, 1), F.lit(False))) & F.forall(F.map_values(annotations), lambda v: F.coalesce(F.octet_length(v) <= VALUE_BYTES, F.lit(False)))
    return F.coalesce(collection_code(collection), F.when(~keys, 408), F.when(~good, 409))
