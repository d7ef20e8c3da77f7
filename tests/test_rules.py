"""Rules that must lose nothing silently: splits, medians, digests, missing series, streamed margins."""

from __future__ import annotations

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattloom.functions.columns import all_finite
from wattloom.operators import impute, split, validate
from wattloom.sources import results
from wattloom.streaming import alerts


def days(spark, *series):
    rows = [(s, int((dt.date.fromisoformat(first) + dt.timedelta(i)).strftime("%Y%m%d")))
            for s, first, n in series for i in range(n)]
    return spark.createDataFrame(rows, "series_id string, date_key int")


def test_split_without_a_date_takes_the_default_of_the_year_or_the_fraction(spark):
    table = days(spark, ("known", "2021-07-01", 40), ("other year", "2023-07-01", 10), ("two years", "2021-12-27", 10))
    got = {(r.series_id, r.split): (r.lo, r.n) for r in split.split_by_date(table).groupBy("series_id", "split")
           .agg(F.min("date_key").alias("lo"), F.count("*").alias("n")).collect()}
    assert got == {("known", "train"): (20210701, 24), ("known", "test"): (20210725, 16),
                   ("other year", "train"): (20230701, 7), ("other year", "test"): (20230708, 3),
                   ("two years", "train"): (20211227, 7), ("two years", "test"): (20220103, 3)}


def test_a_missing_boundary_gives_no_label(spark):
    row = spark.createDataFrame([(20210101, None)], "date_key int, boundary int")
    assert split.label_by_boundary(row).first().split is None


def test_an_empty_part_stops_the_run(spark):
    good = split.boundary_on_days(days(spark, ("a", "2023-01-01", 2)))
    assert split.require_both_parts(good).count() == 2
    for bad in (split.boundary_on_days(days(spark, ("a", "2023-01-01", 1))),
                days(spark, ("a", "2023-01-01", 5)).withColumn("boundary", F.lit(20230106)),
                days(spark, ("a", "2023-01-01", 5)).withColumn("boundary", F.lit(20230101))):
        with pytest.raises(validate.RuleViolation, match="empty"):
            split.require_both_parts(bad)


def test_rows_without_a_series_stop_the_run(spark):
    raw = spark.createDataFrame([("a", "20230101", 0.0, 1.0, 1.0, 1.0, 1.0), (None, "20230101", 1.0, 1.0, 1.0, 1.0, 1.0)],
                                "series_id string, dt string, hr double, q1 double, q2 double, q3 double, q4 double")
    assert validate.ingest(raw.filter("series_id is not null")).count() == 1
    with pytest.raises(validate.RuleViolation, match="missing_series"):
        validate.ingest(raw)


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 20001])
def test_train_median_is_exact(spark, n):
    rng = np.random.default_rng(n)
    rows = pd.DataFrame({"x": rng.normal(size=n), "ties": rng.integers(0, 3, n).astype(float), "none": np.nan})
    df = spark.createDataFrame(rows).withColumn("none", F.lit(None).cast("double")).withColumn("split", F.lit("train"))
    later = spark.createDataFrame([(1e9, 1e9, 1e9, "test")], "x double, ties double, none double, split string")
    got = impute.train_medians(df.unionByName(later), ["x", "ties", "none"])
    assert got.keys() == {"x", "ties"}
    assert got["x"] == pytest.approx(np.median(rows.x), abs=1e-9) and got["ties"] == np.median(rows.ties)


def test_rows_that_differ_have_different_digests(spark):
    df = spark.createDataFrame([(None, "a"), ("", "a"), ("a", ""), ("a", None), ("x|y", "z"), ("x", "y|z"), ("~", "a")],
                               "a string, b string")
    assert results.row_digest(df, ["a", "b"]).select("digest").distinct().count() == 7


@pytest.mark.parametrize("n", [1, 2, 29, 30, 777])
def test_streamed_margin_is_within_one_percent(n):
    errors = np.random.default_rng(n).lognormal(3, 3, n)
    errors[::5] = 0
    bins = alerts.RunningBins(0.9)
    for i, e in enumerate(errors, 1):
        bins.add(e)
        assert bins.quantile() == pytest.approx(np.quantile(errors[:i], 0.9), rel=0.01, abs=alerts.SMALLEST)
    again = alerts.RunningBins(0.9, bins.bins.copy())
    assert (again.quantile(), again.n) == (bins.quantile(), n)


@pytest.mark.parametrize("values", [
    [], [None, float("nan")], [3.0], [1.0, 2.0], [5.0] * 7, [float("inf"), float("-inf"), 1.0], [float("inf")] * 3, [-1.7e308, 1.7e308, 0.0, 1e-300],
    [float(i * 7919 % 1000) / 8 for i in range(1000)], [1e-300 * i for i in range(50)] + [1e300] * 20, [0.0, -0.0, 0.0, -0.0]])
def test_middle_values_are_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    real = sorted(v for v in values if v is not None and v == v)
    want = {"x": (real[(len(real) - 1) // 2], real[len(real) // 2])} if real else {}
    for bins in (3, 4096):
        assert impute.middle_values(df, ["x"], bins) == want


def test_selection_holds_no_distinct_values(spark):
    """Every pass returns at most ``bins`` rows per column, also where all values differ."""
    df = spark.range(200_000).select((F.rand(3) * 1000).alias("x"))
    lo, hi = impute.middle_values(df, ["x"], 64)["x"]
    assert df.filter(F.col("x") < lo).count() == 99_999 and df.filter(F.col("x") <= hi).count() == 100_001


def test_usable_rows_are_checked_by_compiled_code(spark, capsys):
    """The check of all inputs is one short sum: a condition for each column made a method that the JVM does not compile (8,000 bytes)."""
    names = [f"c{i}" for i in range(len(split.REQUIRED))]
    rows = spark.range(9).select("id", *[F.when(F.col("id") == 1, F.lit(None)).when(F.col("id") == 2, F.lit(float("nan")))
                                         .when(F.col("id") == 3, F.lit(float("-inf"))).when(F.col("id") == 4, F.lit(-0.0))
                                         .otherwise(F.lit(1e308)).alias(n) if n == names[-1] else F.lit(1.5).alias(n) for n in names])
    assert [r.id for r in rows.filter(all_finite(names)).orderBy("id").collect()] == [0, 4, 5, 6, 7, 8]
    wide = spark.createDataFrame([tuple([1.0] * len(names))], ", ".join(f"{n} double" for n in names)).repartition("c0").filter(all_finite(names))
    capsys.readouterr()
    spark.conf.set("spark.sql.adaptive.enabled", "false")                  # an adaptive plan shows no code before it ran
    try:
        wide.explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000
