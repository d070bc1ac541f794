"""Calendar buckets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: month label.
MONTH_FORMAT = "yyyy-MM"


def parse_time(text: Column) -> Column:
    """Timestamp from text; an unreadable date gives null instead of an error,
    so one bad post does not fail the job under ANSI mode."""
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def month_bucket(when: Column) -> Column:
    return F.date_format(when, MONTH_FORMAT)


def day_bucket(when: Column) -> Column:
    return F.to_date(when)
