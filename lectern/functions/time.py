"""Periods, fixed windows and schedules."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def period_start(at: str | Column, period: str) -> Column:
    """The day's or month's start; 1970 for a lifetime."""
    if period == "lifetime":
        return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.date_trunc(period, (F.col(at) if isinstance(at, str) else at).cast("timestamp_ntz")).cast("timestamp_ntz")


def next_period(at: str | Column, period: str) -> Column:
    """When the next period starts; never for a lifetime."""
    if period == "lifetime":
        return F.lit(None).cast("timestamp_ntz")
    return period_start(at, period) + F.expr("INTERVAL 1 DAY" if period == "day" else "INTERVAL 1 MONTH")


def fixed_window(at: str | Column, seconds: int) -> Column:
    return F.floor(F.unix_timestamp((F.col(at) if isinstance(at, str) else at).cast("timestamp")) / seconds)


def local_to_utc(at: str | Column, zone: str | Column) -> Column:
    return F.to_utc_timestamp(at, zone)


def next_run_at(after: datetime, kind: str, hour: int, minute: int, weekday: int | None, day: int | None, zone: str) -> datetime:
    """The first run after a UTC instant of a daily, weekly or monthly wall-clock time.

    A time that a change of clocks skips runs as late as the gap is long; of one that comes twice the first counts. A day
    that a month lacks is its last."""
    tz = ZoneInfo(zone)
    local = after.replace(tzinfo=timezone.utc).astimezone(tz)
    for i in range(0, 400):
        d = (local + timedelta(days=i)).date()
        if kind == "weekly" and d.weekday() != weekday:
            continue
        if kind == "monthly":
            last = ((d.replace(day=28) + timedelta(days=4)).replace(day=1) - timedelta(days=1)).day
            if d.day != min(day or 1, last):
                continue
        run = datetime(d.year, d.month, d.day, hour, minute, tzinfo=tz, fold=0).astimezone(timezone.utc).replace(tzinfo=None)
        if run > after:
            return run
    raise ValueError("no run within a year")


@F.pandas_udf(TimestampNTZType())
def next_run(after: pd.Series, kind: pd.Series, hour: pd.Series, minute: pd.Series, weekday: pd.Series, day: pd.Series, zone: pd.Series) -> pd.Series:
    whole = lambda x: None if pd.isna(x) else int(x)
    return pd.Series([None if pd.isna(a) else next_run_at(pd.Timestamp(a).to_pydatetime().replace(tzinfo=None), k, int(h), int(m), whole(w), whole(d), z) for a, k, h, m, w, d, z in zip(after, kind, hour, minute, weekday, day, zone)], dtype="datetime64[us]")
