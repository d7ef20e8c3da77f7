"""Column expressions used by more than one operator. All stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(c: Column | str, digits: int) -> Column:
    """Round half to even on the decimal form of a double (money and display values)."""
    return F.bround(col(c).cast("decimal(28,10)"), digits).cast("double")


def finite(c: Column | str) -> Column:
    """True when the value is neither missing, NaN nor infinite."""
    c = col(c).cast("double")
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf)), F.lit(False))


def all_finite(columns) -> Column:
    """True when ``finite`` holds for all columns, as one short sum: a value times 0 is 0, or else missing or NaN.

    A condition of its own for each of many columns makes a generated method that is too long to be compiled.
    """
    zeros = [col(c).cast("double") * F.lit(0.0) for c in columns]
    return F.coalesce(sum(zeros[1:], zeros[0]) == 0, F.lit(False)) if zeros else F.lit(True)


def plus_minutes(ts: Column | str, minutes: Column | int) -> Column:
    """Timestamp plus a number of minutes."""
    m = F.lit(minutes) if isinstance(minutes, int) else minutes
    return F.timestamp_micros(F.unix_micros(col(ts)) + m.cast("long") * F.lit(60_000_000))


def date_key(ts: Column | str) -> Column:
    """Integer YYYYMMDD of a timestamp."""
    t = col(ts)
    return F.year(t) * 10000 + F.month(t) * 100 + F.dayofmonth(t)


def day_of(ts: Column | str) -> Column:
    return F.to_date(col(ts))


def nan_to_null(c: str) -> Column:
    """Spark sorts NaN above every number, so missing is always null here."""
    return F.when(~F.isnan(F.col(c)), F.col(c))
