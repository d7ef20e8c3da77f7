"""Quantiles of earlier values against numpy, whatever the blocks and runs."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.operators import order_stats
from wattloom.operators.running import asof_quantile

T0 = datetime(2021, 3, 1)


def test_rank_search_equals_sorting():
    r = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 64, 200):
        times, asked = r.integers(0, 40, n), r.integers(0, 45, 60)
        for inclusive in (False, True):
            for t in asked:
                told = np.flatnonzero(times <= t if inclusive else times < t)
                for rank in range(0, len(told), 5):
                    got = order_stats.rank_search(times, np.array([t]), np.array([rank]), inclusive)
                    assert got[0] == told[rank]


@pytest.mark.parametrize("days, rows, q, inclusive", [(1, 7, 0.5, False), (28, 4096, 0.9, True), (3, 50, 0.9, False), (400, 5, 0.5, True)])
def test_quantile_before(spark, days, rows, q, inclusive):
    r = np.random.default_rng(days)
    data = []
    for series, n in (("A", 900), ("B", 40), ("C", 1)):
        for i in range(n):
            value = None if r.random() < 0.1 else float("nan") if r.random() < 0.02 else float(r.integers(0, 12)) / 4
            data.append((series, T0 + timedelta(hours=int(r.integers(0, 1200))), value))
    asks = [(s, T0 + timedelta(hours=h)) for s in "ABCD" for h in range(-1, 1210, 13)]
    asks += asks[:5] + [("A", None)]
    tells = spark.createDataFrame(data, "k string, t timestamp, value double").repartition(4)
    got = order_stats.quantile_before(tells, spark.createDataFrame(asks, "k string, t timestamp"), ["k"], q, inclusive, days, rows)
    got = {(x.k, x.t): (x.quantile, x.n) for x in got.collect()}
    assert set(got) == {a for a in asks if a[1]}
    for (k, t), (value, n) in got.items():
        told = [v for s, w, v in data if s == k and (w <= t if inclusive else w < t) and v is not None and v == v]
        assert n == len(told)
        assert value == (pytest.approx(np.quantile(told, q)) if told else None)


def test_equals_the_heap_form_on_one_long_series(spark):
    n = 6_000
    df = spark.range(n).select(F.lit("A").alias("k"), F.timestamp_seconds(F.col("id") * 900).alias("t"),
                               (F.hash("id") % 1000 / 8).alias("value"))
    heap = asof_quantile(df.withColumns({"a": F.col("t"), "b": F.col("t")}), ["k"], "a", "b", "value", 0.9, "quantile", "n")
    new = order_stats.quantile_before(df, df, ["k"], 0.9, True, 7, 500)
    assert new.count() == n
    assert new.select("t", "quantile", "n").exceptAll(heap.select("t", "quantile", "n")).count() == 0


def test_no_questions_or_no_values(spark):
    none = spark.createDataFrame([], "k string, t timestamp, value double")
    some = spark.createDataFrame([("A", T0, 1.0)], none.schema)
    assert order_stats.quantile_before(some, none, ["k"], 0.5).count() == 0
    assert [tuple(r) for r in order_stats.quantile_before(none, some, ["k"], 0.5).collect()] == [("A", T0, None, 0)]
