"""Miniature frames."""

from datetime import datetime, timedelta

T0 = datetime(2021, 3, 1)


def readings(spark, values, start=T0, step=15, series="A"):
    """Evenly spaced readings of one series."""
    rows = [(series, start + timedelta(minutes=step * i), None if v is None else float(v))
            for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp, kw double")


def at_minutes(spark, minutes, series="A", start=T0):
    rows = [(series, start + timedelta(minutes=m), float(i)) for i, m in enumerate(minutes)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp, kw double")


def raw_hours(spark, rows):
    """Rows of (dt, hr, q1..q4) with line numbers from 2."""
    data = [("A", i + 2, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(
        data, "series_id string, src_row long, dt string, hr double, q1 double, q2 double, q3 double, q4 double")


def column(df, name, order="ts"):
    return [r[name] for r in df.orderBy(order).collect()]
