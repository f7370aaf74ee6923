"""Times relative to one ``as_of`` per job; no function reads the clock."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Feed windows in hours; any other key means no limit.
WINDOWS = {"24h": 24, "7d": 7 * 24, "30d": 30 * 24}


def as_of_like(df: DataFrame, column: str, as_of: datetime) -> Column:
    """``as_of`` in the column's own type, so that filters reach the scan without a cast."""
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(df.schema[column].dataType)


def in_window(df: DataFrame, column: str, as_of: datetime, key: str) -> DataFrame:
    """Rows at or after ``as_of`` minus the window; rows after ``as_of`` stay."""
    if key not in WINDOWS:
        return df
    return df.where(F.col(column) >= as_of_like(df, column, as_of) - F.expr(f"INTERVAL {WINDOWS[key]} HOURS"))


def seconds_between(then: Column, now: Column) -> Column:
    return F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 1_000_000)


def relative_age(then: Column, now: Column) -> Column:
    """``just now`` under a minute (and for the future), else whole minutes, hours or days."""
    s = seconds_between(then, now)
    ago = lambda unit, size: F.concat(F.floor(s / size).cast("string"), F.lit(f"{unit} ago"))
    return F.when(s < 60, "just now").when(s < 3600, ago("m", 60)).when(s < 86400, ago("h", 3600)).when(s.isNotNull(), ago("d", 86400))


def status_label(last_run: Column, now: Column) -> Column:
    return F.coalesce(F.concat(F.lit("Updated "), relative_age(last_run, now)), F.lit("Never run"))


def utc_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def utc_minute(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm")


def month_day(ts: Column) -> Column:
    return F.date_format(ts, "MMM d")


def from_epoch_seconds(c: Column) -> Column:
    return F.timestamp_seconds(c)


def from_iso(c: Column) -> Column:
    """Null where the text is no time."""
    return F.try_to_timestamp(c)
