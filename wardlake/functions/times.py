"""Timestamps, dates and deadlines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The timestamp spellings accepted for a checkup, tried in order.
TIMESTAMP_FORMATS = (
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
)

# Default lifetime of a request in days, and the shape of a date.
DEFAULT_REQUEST_DAYS = 30
DATE_SHAPE = r"^\d{4}-\d{2}-\d{2}$"


def iso_timestamp(c: Column) -> Column:
    """ISO 8601 in UTC, with microseconds only when there are any; a text that is no time stays as it is."""
    ts = c.try_cast("timestamp")
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")
    micros = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return F.when(ts.isNull(), c.cast("string")).when(ts == F.date_trunc("second", ts), whole).otherwise(micros)


def birth_date(c: Column, data_type: str = "timestamp") -> Column:
    if data_type == "string":
        parsed = F.date_format(c.try_cast("timestamp"), "yyyy-MM-dd")
        return F.coalesce(parsed, F.nullif(F.substring(c, 1, 10), F.lit("")))
    return F.date_format(c, "yyyy-MM-dd")


def any_date(c: Column, data_type: str = "string") -> Column:
    """Date of a timestamp, or of text in one of the accepted spellings; else NULL."""
    if data_type != "string":
        return c.cast("date")
    parsed = [F.try_to_timestamp(c, F.lit(fmt)).cast("date") for fmt in TIMESTAMP_FORMATS]
    return F.coalesce(*parsed)


def checked_date(c: Column) -> Column:
    """Date written as ``yyyy-MM-dd``; NULL for any other text."""
    return F.when(c.rlike(DATE_SHAPE), F.try_to_date(c, "yyyy-MM-dd"))


def request_expiry(now: Column, days: Column) -> Column:
    lifetime = F.when(days > 0, days).otherwise(F.lit(DEFAULT_REQUEST_DAYS))
    return now + F.make_dt_interval(days=lifetime.cast("int"))


def grant_valid_until(now: Column, status: Column, hours: Column) -> Column:
    return F.when((status == "APPROVED") & (hours > 0), now + F.make_dt_interval(hours=hours.cast("int")))


def effective_status(status: Column, expires_at: Column, now: Column) -> Column:
    return F.when(expires_at < now, F.lit("EXPIRED")).otherwise(status)


def next_run(last_run_end: Column, frequency_seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(last_run_end) + frequency_seconds.cast("long") * 1_000_000)


def duration_label(start: Column, end: Column) -> Column:
    """``42s`` or ``3m 5s``; open jobs are in progress, jobs without a start have none."""
    seconds = F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1_000_000 + F.lit(0.5))
    minutes = F.concat(
        F.floor(seconds / 60).cast("string"), F.lit("m "), F.pmod(seconds, F.lit(60)).cast("string"), F.lit("s")
    )
    return (
        F.when(start.isNull(), F.lit("N/A"))
        .when(end.isNull(), F.lit("In progress…"))
        .when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .otherwise(minutes)
    )
