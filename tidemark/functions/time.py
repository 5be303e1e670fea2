"""Column helpers for nanosecond times."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def align(time: Column | str, pw: int) -> Column:
    """Floor to a multiple of 2 ** pw, also below zero."""
    return F.shiftleft(F.shiftright(F.col(time) if isinstance(time, str) else time, pw), pw)


def align_int(time: int, pw: int) -> int:
    return time >> pw << pw


def window_start(time: Column | str, start: int, width: int) -> Column:
    """Start of the window of ``width`` from ``start`` that holds ``time`` >= start."""
    offset = (F.col(time) if isinstance(time, str) else time) - F.lit(start)
    return F.lit(start) + (offset - F.pmod(offset, F.lit(width)))


def rfc3339(time: Column | str) -> Column:
    """UTC time in whole seconds; the session's time zone doesn't matter."""
    time = F.col(time) if isinstance(time, str) else time
    seconds = ((time - F.pmod(time, F.lit(10**9))) / F.lit(10**9)).cast("long")
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return F.date_format(epoch + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_rfc3339(text: Column | str) -> Column:
    return F.unix_micros(F.to_timestamp(text)) * 1000


def fixed6(value: Column | str) -> Column:
    return F.format_string("%f", value)


def tag_string(tags: Column | str) -> Column:
    """Sorted keys and values, each followed by a zero character."""
    entries = F.array_sort(F.map_entries(tags))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("\0"), e["value"], F.lit("\0"))), "")


def bucket_index(time: Column | str, start: Column | int, pw: int, fan: int = 64) -> Column:
    """Which of the ``fan`` buckets of 2 ** pw from ``start`` holds ``time``; times outside count to the nearest one."""
    time, start = F.col(time) if isinstance(time, str) else time, F.lit(start) if isinstance(start, int) else start
    return F.least(F.greatest(F.shiftright(time - start, pw), F.lit(0)), F.lit(fan - 1)).cast("int")


def bucket_bounds(index: Column | str, start: Column | int, pw: int) -> tuple[Column, Column]:
    """Start and end of bucket ``index``."""
    index, start = F.col(index) if isinstance(index, str) else index, F.lit(start) if isinstance(start, int) else start
    low = start + F.shiftleft(index.cast("long"), pw)
    return low, low + F.lit(1 << pw)


def uuid_text(raw: Column | str) -> Column:
    """The text form of 16 bytes: lower-case hex with hyphens."""
    digits = F.lower(F.hex(raw))
    return F.concat_ws("-", *(F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def uuid_bytes(text: Column | str) -> Column:
    """The 16 bytes of a text form; null if it isn't one."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike(r"^(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z"), F.unhex(F.replace(text, F.lit("-"), F.lit(""))))
