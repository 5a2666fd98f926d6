"""Column functions on dates, times and durations."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: "Fri May 09 08:14:27 +0000 2026"
LEGACY_STAMP = r"^\w+\s+(\w+)\s+(\d+)\s+(\d+:\d+:\d+)\s+(\S+)\s+(\d+)$"
ISO_STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def parse_legacy_timestamp(col: Column, honour_offset: bool = False) -> Column:
    """Post timestamp; NULL when it does not parse. The UTC offset is ignored
    unless ``honour_offset`` is set."""
    if honour_offset:
        parts = F.regexp_replace(col, LEGACY_STAMP, "$5-$1-$2 $3 $4")
        return F.try_to_timestamp(parts, F.lit("yyyy-MMM-d HH:mm:ss Z"))
    parts = F.regexp_replace(col, LEGACY_STAMP, "$5-$1-$2 $3")
    return F.try_to_timestamp(parts, F.lit("yyyy-MMM-d HH:mm:ss"))


def parse_iso_timestamp(col: Column) -> Column:
    return F.try_to_timestamp(col, F.lit(ISO_STAMP))


def to_iso(col: Column) -> Column:
    return F.date_format(col, ISO_STAMP)


def moment(as_of: datetime | date | str | Column | None) -> Column:
    """The reference time of a calculation: an explicit one, or now."""
    if as_of is None:
        return F.current_timestamp()
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def temporal_features(col: Column, prefix: str) -> dict[str, Column]:
    """Hour, day of week (Sunday = 1), year, month and day, named for the record kind."""
    return {
        f"{prefix}_hour": F.hour(col),
        f"{prefix}_day_of_week": F.dayofweek(col),
        "year": F.year(col),
        "month": F.month(col),
        "day": F.dayofmonth(col),
    }


def week_start(col: Column) -> Column:
    """The Monday of the week."""
    return F.date_trunc("week", col).cast("date")


def duration_seconds(start: Column, end: Column, as_of=None) -> Column:
    """Seconds between two timestamps to one decimal; an open end counts up to ``as_of``."""
    stop = F.coalesce(end, moment(as_of))
    return F.round((F.unix_micros(stop) - F.unix_micros(start)) / F.lit(1e6), 1)


def format_duration(seconds: Column) -> Column:
    """"Xm Ys", or "Ys" below a minute; a dash for NULL."""
    minutes = F.floor(seconds / 60)
    rest = F.floor(seconds - minutes * 60 + F.lit(0.5)).cast("long")
    return (
        F.when(seconds.isNull(), F.lit("—"))
        .when(minutes == 0, F.format_string("%ds", rest))
        .otherwise(F.format_string("%dm %ds", minutes, rest))
    )
