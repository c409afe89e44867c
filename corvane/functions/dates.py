"""Plausible publication dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp_date(value: Column, now: Column, ahead_days: int = 2, floor: str = "1990-01-01 00:00:00") -> Column:
    """The instant where it lies from the floor to ``ahead_days`` after ``now``, both ends included; else null."""
    return F.when(value.between(F.lit(floor).cast("timestamp"), now + F.make_dt_interval(F.lit(ahead_days))), value)


def parse_iso(text: Column) -> Column:
    """ISO date or date-time, Z and offsets allowed, without a zone UTC; null where it isn't one."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d{1,9})?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(t))
