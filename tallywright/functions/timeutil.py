"""Times: nanosecond longs are the truth; Spark timestamps (microseconds) only serve display and filters. The session zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 100 ns ticks between 1601 and 1970. Fixed value.
FILETIME_EPOCH = 116444736000000000


#: The last microsecond of the year 9999. Fixed value.
LATEST_US = 253402300799999999


def _floor_div(a: Column, b: int) -> Column:
    """Whole division that rounds down, in longs; doubles would lose the last digits of nanoseconds."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def _iso(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us.cast("long")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def ns_to_iso(ns: Column) -> Column:
    """Seconds-precision ISO text with +00:00. Nanoseconds in a long reach from 1677 to 2262, so that each has one."""
    return _iso(_floor_div(ns.cast("long"), 1000))


def filetime_to_ns(ticks: Column) -> Column:
    """NULL unless positive, and for times after 2262, which nanoseconds in a long can't hold."""
    return F.when(ticks > 0, F.try_multiply(ticks - F.lit(FILETIME_EPOCH), F.lit(100)))


def filetime_to_iso(ticks: Column) -> Column:
    """NULL unless positive; invalid_ns:N after the year 9999."""
    us = _floor_div(ticks.cast("long") - F.lit(FILETIME_EPOCH), 10)
    late = F.concat(F.lit("invalid_ns:"), ((ticks - F.lit(FILETIME_EPOCH)).cast("decimal(24,0)") * 100).cast("decimal(24,0)").cast("string"))
    return F.when((ticks > 0) & (us > LATEST_US), late).when(ticks > 0, _iso(F.least(us, F.lit(LATEST_US))))


def iso_to_ns(text: Column) -> Column:
    """Ten characters are midnight UTC; Z and offsets hold; no zone means UTC; what isn't a time is NULL."""
    full = F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00"))).otherwise(text)
    return F.unix_micros(F.try_to_timestamp(full)) * 1000


def lenient_datetime(text: Column) -> Column:
    """Timestamps from loosely written dates: separators . - / or Korean units, optional 오전/오후 and seconds; else NULL."""
    pattern = r"(\d{4})\s*[.\-/년]\s*(\d{1,2})\s*[.\-/월]\s*(\d{1,2})\s*[.일T]?\s*(?:(오전|오후|AM|PM|am|pm)?\s*(\d{1,2})\s*[:시]\s*(\d{1,2})?\s*분?\s*(?::\s*(\d{1,2}))?)?"
    part = lambda i: F.regexp_extract(text, pattern, i)
    hour = F.when(part(5) == "", F.lit(0)).otherwise(F.nullif(part(5), F.lit("")).try_cast("int"))
    hour = F.when(part(4).isin("오후", "PM", "pm") & (hour < 12), hour + 12).when(part(4).isin("오전", "AM", "am") & (hour == 12), F.lit(0)).otherwise(hour)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    number = lambda i: F.when(part(i) == "", F.lit("0")).otherwise(part(i))
    written = F.concat(part(1), F.lit("-"), two(part(2)), F.lit("-"), two(part(3)), F.lit(" "), two(hour), F.lit(":"), two(number(6)), F.lit(":"), two(number(7)))
    return F.when(part(1) != "", F.try_to_timestamp(written, F.lit("yyyy-MM-dd HH:mm:ss")))


def usn_time(text: Column) -> Column:
    """ISO text from a journal's time cell: FILETIME (hex or decimal), year-first or month-first date and time."""
    t = F.trim(text)
    hexa = F.conv(F.substring(t, 3, 30), 16, 10).try_cast("long")
    ticks = F.when(F.lower(t).startswith("0x"), hexa).otherwise(t.try_cast("long"))
    iso = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})[ T]+(\d{1,2}):(\d{2}):(\d{2})"
    us = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})[ T]+(\d{1,2}):(\d{2}):(\d{2})"

    def of(pattern: str, y: int, m: int, d: int) -> Column:
        part = lambda i: F.lpad(F.regexp_extract(t, pattern, i), 2, "0")
        return F.concat(F.regexp_extract(t, pattern, y), F.lit("-"), part(m), F.lit("-"), part(d), F.lit("T"), part(4), F.lit(":"), part(5), F.lit(":"), part(6), F.lit("+00:00"))

    return F.when(ticks.isNotNull(), filetime_to_iso(ticks)).when(t.rlike(iso), of(iso, 1, 2, 3)).when(t.rlike(us), of(us, 3, 1, 2))
