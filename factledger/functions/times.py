"""Instants are epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000


def millis(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def utc_text(c: Column) -> Column:
    return F.date_format(F.timestamp_millis(c), "yyyy-MM-dd")


def day_start(c: Column) -> Column:
    return F.floor(c / DAY).cast("long") * DAY


def days_overdue(review_by: Column, now: Column) -> Column:
    """Whole days since the review was due; null before and at that instant."""
    return F.when(now > review_by, F.floor((now - review_by) / DAY).cast("long"))
