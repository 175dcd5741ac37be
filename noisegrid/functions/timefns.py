"""Periods of the day, time windows, clocks beyond 24 h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def period_of_hour(hour: Column) -> Column:
    """D from 7 to 19, E from 19 to 22, N else."""
    return F.when((hour >= 7) & (hour < 19), "D").when((hour >= 19) & (hour < 22), "E").when(hour.isNotNull(), "N")


def period_of_clock(clock: Column) -> Column:
    """Of a clock string whose hours may pass 24."""
    return period_of_hour(F.split(clock, ":")[0].try_cast("int") % 24)


def daypart(ts: Column, zone: str) -> Column:
    """Of a UTC timestamp, by the local clock of a zone."""
    return period_of_hour(F.hour(F.from_utc_timestamp(ts, zone)))


def cnel_weight(ts: Column, zone: str) -> Column:
    """Energy weight of an event in the daily level: 1 by day, 3 in the evening, 10 at night."""
    part = daypart(ts, zone)
    return F.when(part == "D", 1.0).when(part == "E", 3.0).when(part == "N", 10.0)


def in_window(ts: Column, start: Column, end: Column) -> Column:
    return (ts >= start) & (ts < end)


def source_year(text: Column) -> Column:
    """The newest year from 1900 to 2099 that a text mentions; null if none."""
    years = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), F.lit(1))
    return F.array_max(F.transform(years, lambda y: y.cast("int")))
