"""Column builders for times: mixed formats, business days, and the session of a reaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions.text import strip, text_of

ZONE = "Asia/Shanghai"
#: Epochs above this are milliseconds.
MILLIS = 10_000_000_000


def parse_time(raw: Column) -> Column:
    """Timestamp of an epoch, an RFC 2822 date or an ISO date; without an offset it is local to ZONE; null if none."""
    value = strip(text_of(raw))
    number = F.when(value.rlike(r"^\d{9,14}(\.\d+)?$"), value.cast("double"))
    epoch = F.timestamp_micros((F.when(number > MILLIS, number / 1000).otherwise(number) * 1_000_000).cast("long"))
    rfc = F.regexp_replace(value, r"^[A-Za-z]{3},\s*", "")
    with_zone = F.coalesce(F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss zzz")), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss xx")))
    has_offset = value.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")
    plain = F.to_utc_timestamp(F.expr("null").cast("timestamp"), ZONE)
    iso = F.when(has_offset, value.try_cast("timestamp")).when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), F.to_utc_timestamp(value.try_cast("timestamp_ntz").cast("timestamp"), ZONE)).otherwise(plain)
    return F.coalesce(epoch, F.when(value.rlike(r"^[A-Za-z]{3},"), with_zone), iso)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")


def business_day(ts: Column) -> Column:
    """The day in ZONE, which has no daylight saving: eight hours ahead."""
    return F.to_date(ts.cast("timestamp") + F.expr("INTERVAL 8 HOURS"))


def reaction_session(ts: Column) -> Column:
    """The business day, where hours before six belong to the day before."""
    return F.to_date(ts.cast("timestamp") + F.expr("INTERVAL 2 HOURS"))


def local_day_range(first: str, last: str) -> tuple[Column, Column]:
    """[start, end) in UTC of an inclusive range of local days."""
    if not first or not last:
        raise ValueError("both days or neither")
    if first > last:
        raise ValueError("the first day is after the last")
    start = F.to_utc_timestamp(F.lit(first).cast("timestamp"), ZONE)
    end = F.to_utc_timestamp(F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"), ZONE)
    return start, end
