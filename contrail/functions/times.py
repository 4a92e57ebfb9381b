"""Epoch-second helpers; the session runs in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _c


def as_timestamp(epoch) -> Column:
    return F.timestamp_micros((_c(epoch) * 1_000_000).cast("bigint"))


def hhmm_utc(epoch) -> Column:
    minutes = F.floor(F.pmod(_c(epoch), F.lit(86400.0)) / 60)
    return (F.floor(minutes / 60) * 100 + minutes % 60).cast("int")


def seconds_of_day(epoch) -> Column:
    return F.pmod(_c(epoch), F.lit(86400.0))


def day_type(date) -> Column:
    return F.when(F.weekday(_c(date)) >= 5, F.lit("weekend")).otherwise(F.lit("weekday"))


def tag_mmddyy(date) -> Column:
    return F.date_format(_c(date), "MMddyy")


def tag_yyyymmdd(date) -> Column:
    return F.date_format(_c(date), "yyyyMMdd")


def date_from_mmddyy(tag) -> Column:
    """'060125' is 2025-06-01; the century is fixed to 20xx."""
    t = _c(tag)
    return F.to_date(F.concat(F.lit("20"), F.substring(t, 5, 2), F.substring(t, 1, 4)), "yyyyMMdd")


def in_time_ranges(epoch, ranges: list) -> Column:
    """OR of half-open [start, end) HHMM ranges; start above end wraps midnight."""
    now = hhmm_utc(epoch)
    result = F.lit(False)
    for start, end in ranges:
        inside = (now >= start) & (now < end) if start <= end else (now >= start) | (now < end)
        result = result | inside
    return result
