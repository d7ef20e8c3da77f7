"""Streams in many batches against the same rows at once."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.operators import asof
from wattloom.session import shared_folder
from wattloom.streaming import alerts, readings

T0 = datetime(2024, 1, 1)


def in_files(spark, rows, schema, sizes, purpose="parts"):
    """A stream that reads the rows file by file in the given order."""
    path = shared_folder(spark, purpose)
    at = 0
    for n in sizes:
        spark.createDataFrame(rows[at:at + n], schema).coalesce(1).write.mode("append").parquet(path)
        at += n
    assert at == len(rows)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def measured(n, seed=5, series=("a", "b")):
    r = np.random.default_rng(seed)
    return [(s, T0 + timedelta(minutes=15 * i), float(k), None if i % 17 == 0 else float(p))
            for i, (k, p) in enumerate(r.uniform(1, 99, (n, 2))) for s in series]


SCHEMA = "series_id string, ts timestamp, kw double, prediction double"


def threshold(spark, rows, sizes, delay="3 hours"):
    out, counts = readings.run_counted(alerts.stateful_threshold(in_files(spark, rows, SCHEMA, sizes), delay), "threshold",
                                       settings=alerts.THRESHOLD_SETTINGS)
    return sorted(map(tuple, out.collect())), counts


def test_shuffled_batches_equal_one_sorted_batch(spark):
    rows = measured(120)
    near = sorted(rows, key=lambda r: (r[1] + timedelta(minutes=15 * int(np.random.default_rng(hash(str(r)) % 2**32).integers(0, 10)))))
    whole, _ = threshold(spark, rows, [len(rows)])
    parts, counts = threshold(spark, near, [40] * 6)
    assert parts == whole and counts.agg(F.sum("late")).first()[0] == 0
    assert {r[1] for r in whole} == {r[1] for r in rows if r[3] is not None and r[1] <= rows[-1][1] - timedelta(hours=3)}
    # the same as the batch side says of a sorted table, to one per cent
    table = spark.createDataFrame(rows, SCHEMA).withColumns(
        {"target_time": F.col("ts") + F.expr("interval 15 minutes"), "y": F.expr("lead(kw) OVER (PARTITION BY series_id ORDER BY ts)")})
    exact = {(r.series_id, r.ts): r for r in asof.error_margin(asof.annual_peak_to_date(table.filter("y IS NOT NULL"))).collect()}
    for s, ts, _, _, peak, n, margin, *_ in whole:
        r = exact[s, ts]
        assert (peak, n) == (r.annual_peak, r.error_samples)
        assert margin == pytest.approx(r.error_margin, rel=0.01, abs=alerts.SMALLEST)


def test_only_readings_behind_the_watermark_are_late(spark):
    rows = measured(60, series=("a",))
    kept = rows[:4] + rows[5:]
    out, counts = threshold(spark, [*kept[:30], *kept[30:45], rows[4], *kept[45:]], [30, 15, 1, 14], "1 hour")
    assert counts.agg(F.sum("late")).first()[0] == 1
    without, _ = threshold(spark, kept, [len(kept)], "1 hour")
    assert out == without


def test_late_counts_of_150_batches(spark):
    rows = [(1, T0)] + [(2, T0 + timedelta(days=10))] * 2
    for i in range(148):                                            # every fourth of them is ten days late
        rows.append((10 + i, T0 + timedelta(days=10 if i % 4 else 0, minutes=i)))
    stream = in_files(spark, rows, "id long, ts timestamp", [1] * 151)
    out, counts = readings.run_counted(readings.stream_dedup(stream, ("id",), "1 hour"), "many")
    late = counts.agg(F.sum("late"), F.sum("rows"), F.count_if(F.col("rows") > 0)).first()
    assert tuple(late) == (37, 151, 151)
    assert readings.dropped_as_late(counts).first()["late"] == 37
    assert out.count() == 151 - 37 - 1


def test_sliding_windows_of_many_batches(spark):
    rows = [("a", T0 + timedelta(minutes=7 * i), i % 13 + 0.25) for i in range(200)]
    schema = "series_id string, ts timestamp, kw double"
    made = [sorted(map(tuple, readings.run_available(readings.sliding_mean_max(in_files(spark, rows, schema, sizes)), "sliding").collect()))
            for sizes in ([200], [25] * 8)]
    assert made[0] == made[1] and len(made[0]) > 80
    for _, start, end, mean, top in made[0]:
        inside = [k for _, t, k in rows if start <= t < end]
        assert (mean, top) == (pytest.approx(np.mean(inside)), max(inside))


def scored(spark, rows, sizes, out, state, fail=None, **more):
    def score(batch):
        if fail and batch.filter(fail).count():
            raise RuntimeError("no model")
        return batch.withColumn("prediction", F.col("kw") * 2)
    alerts.stream_scoring(in_files(spark, rows, "series_id string, ts timestamp, kw double", sizes), score, out, state, **more)


def test_repeats_in_later_batches_are_scored_once(spark):
    rows = [("a", T0 + timedelta(minutes=15 * i), float(i)) for i in range(40)]
    out = shared_folder(spark, "scored")
    scored(spark, rows + rows[10:20] + rows[:5] + rows[39:], [20, 20, 10, 5, 1], out, shared_folder(spark, "state"))
    got = alerts.read_scored(spark, out)
    assert sorted((r.ts, r.prediction) for r in got.collect()) == [(t, 2 * k) for _, t, k in rows]


def test_a_batch_that_fails_is_not_read_and_runs_again(spark):
    rows = [("a", T0 + timedelta(minutes=15 * i), float(i)) for i in range(30)]
    out, state, path = (shared_folder(spark, x) for x in ("scored", "state", "in"))
    schema = "series_id string, ts timestamp, kw double"
    for at in range(0, 30, 10):
        spark.createDataFrame(rows[at:at + 10], schema).coalesce(1).write.mode("append").parquet(path)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

    def broken(batch):
        if batch.filter("kw >= 20").count():
            batch.limit(3).withColumn("prediction", F.lit(-1.0)).write.mode("overwrite").parquet(f"{out}/rows/batch=2")
            raise RuntimeError("executor lost")
        return batch.withColumn("prediction", F.col("kw") * 2)
    with pytest.raises(Exception, match="executor lost"):
        alerts.stream_scoring(stream(), broken, out, state)
    assert alerts.read_scored(spark, out).count() == 20
    alerts.stream_scoring(stream(), lambda b: b.withColumn("prediction", F.col("kw") * 2), out, state)
    assert sorted((r.ts, r.prediction) for r in alerts.read_scored(spark, out).collect()) == [(t, 2 * k) for _, t, k in rows]


def test_nothing_committed_yet(spark):
    assert alerts.read_scored(spark, shared_folder(spark, "never")) is None
