"""Time columns. Naive timestamps are UTC; local days use a named zone."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

LOCAL_ZONE = "America/Denver"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts(value: datetime) -> Column:
    """A literal timestamp without zone."""
    return F.expr(f"timestamp_ntz'{value.isoformat(sep=' ')}'")


def ago(value: datetime, interval: str) -> Column:
    return ts(value) - F.expr(f"interval {interval}")


def micros(c: str | Column) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def seconds_between(later: str | Column, earlier: str | Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def hours_between(later: str | Column, earlier: str | Column) -> Column:
    return seconds_between(later, earlier) / F.lit(3600.0)


def local(c: str | Column, zone: str = LOCAL_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), col(c))


def local_date(c: str | Column, zone: str = LOCAL_ZONE) -> Column:
    return F.to_date(local(c, zone))


def local_week(c: str | Column, zone: str = LOCAL_ZONE) -> Column:
    """Monday of the local week, as a date."""
    return F.to_date(F.date_trunc("week", local_date(c, zone)))


def text(c: str | Column) -> Column:
    """Dates leave the library as ISO text."""
    return col(c).cast("string")
