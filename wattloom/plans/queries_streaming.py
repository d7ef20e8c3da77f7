"""Streaming queries. Each replays a supplied or derived table as a stream until it is used up.

A window appears once the watermark has passed its end, so the SQL twins stop there too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.operators import asof, models
from wattloom.plans import fixtures as x
from wattloom.plans.queries_cost import BANDED
from wattloom.plans.queries_models import usable, usable_sql
from wattloom.plans.registry import REGISTRY
from wattloom.session import shared_folder
from wattloom.streaming import alerts, readings

add = REGISTRY.add


def events(t):
    return readings.stream_readings(t.spark, f"{t.dir}/events.parquet*")


def replay(t, df, purpose: str, files: int | None = None, per_batch: int | None = None):
    """Write a table and read it as a stream."""
    path = shared_folder(t.spark, purpose)
    (df.repartition(files) if files else df).write.parquet(path)
    reader = t.spark.readStream.schema(df.schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(path)


FILES = 4                         # files of a batch where a stream is replayed in parts
PASSED = "(SELECT max(ts) - INTERVAL '10 minutes' FROM events)"


@add("j1_stream_readings", "event_id:i series_id ts:t", None,
     "SELECT event_id, event_type AS series_id, ts FROM events")
def j1(t):
    out = readings.run_available(events(t), "events")
    return out.withColumn("series_id", F.col("event_type"))


@add("j2_tumbling_15m", "series_id ts:t kw:r n_events:i", x.NATURAL,
     f"SELECT * FROM natural_r WHERE ts + INTERVAL '15 minutes' <= {PASSED}")
def j2(t):
    return readings.run_available(readings.tumbling_15m(readings.as_readings(events(t))), "tumbling")


def sliding_sql(minutes: int) -> str:
    return f"""SELECT * FROM (SELECT event_type AS series_id, s AS w_start, s + INTERVAL '{minutes} minutes' AS w_end,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_kw, max(CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE))
  AS max_kw FROM (SELECT *, unnest(generate_series(0, {minutes // 15 - 1})) AS i FROM events),
  LATERAL (SELECT time_bucket(INTERVAL '15 minutes', ts) - to_minutes(15 * i) AS s) GROUP BY 1, 2, 3)
  WHERE w_end <= {PASSED}"""


@add("j3_sliding_2h", "series_id w_start:t w_end:t mean_kw:r4 max_kw:r", None, sliding_sql(120))
def j3(t):
    return readings.run_available(readings.sliding_mean_max(readings.as_readings(events(t))), "sliding")


@add("j3_sliding_4h", "series_id w_start:t w_end:t mean_kw:r4 max_kw:r", None, sliding_sql(240))
def j3_4h(t):
    stream = readings.sliding_mean_max(readings.as_readings(events(t)), "4 hours")
    return readings.run_available(stream, "sliding")


@add("j4_session_segments", "series_id start:t stop:t readings:i", None, f"""SELECT * FROM (SELECT series_id, min(ts) AS
  start, max(ts) + INTERVAL '15 minutes' AS stop, count(*) AS readings FROM (SELECT *, sum(CASE WHEN ts - prev <= INTERVAL
  '15 minutes' THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM
  (SELECT event_type AS series_id, ts, event_id, lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS prev
  FROM events)) GROUP BY series_id, g) WHERE stop <= {PASSED}""")
def j4(t):
    return readings.run_available(readings.session_segments(readings.as_readings(events(t))), "sessions")


@add("j5_stream_dedup", "event_id:i series_id ts:t", None, "SELECT event_id, event_type AS series_id, ts FROM events")
def j5(t):
    """Every event arrives twice and leaves once."""
    twice = t.table("events").select("event_id", F.col("event_type").alias("series_id"), "ts")
    stream = replay(t, twice.unionByName(twice), "twice")
    return readings.run_available(readings.stream_dedup(stream, ("event_id",)), "dedup")


@add("j6_late_data", "on_time:i late:i", None,
     "SELECT count(*) FILTER (WHERE day(ts) >= 16) AS on_time, count(*) FILTER (WHERE day(ts) < 16) AS late FROM events")
def j6(t):
    """The second half of the month arrives first, in two files; the first half is then too late.

    Spark drops a row by the watermark of the batch before the current one, hence two parts.
    """
    path = shared_folder(t.spark, "late")
    e = t.table("events").select("event_id", F.col("event_type").alias("series_id"), "ts")
    day = F.dayofmonth("ts")
    for part in (day.between(16, 24), day >= 25, day < 16):
        e.filter(part).repartition(FILES).write.mode("append").parquet(path)
    stream = t.spark.readStream.schema(e.schema).option("maxFilesPerTrigger", FILES).parquet(path)
    out, counts = readings.run_counted(
        readings.stream_dedup(stream, ("event_id",), "1 hour"), "late-out")
    late = readings.dropped_as_late(counts).first()["late"]
    return out.agg(F.count(F.lit(1)).alias("on_time")).withColumn("late", F.lit(late))


@add("j7_stream_calendar_join", "o_orderkey:i ts:t season band rate:r", BANDED,
     "SELECT *, tariff_rate AS rate FROM priced")
def j7(t):
    rates, bands = t.tariff_dims
    stream = readings.stream_calendar_join(replay(t, t.tariff, "points"), bands, rates, t.holidays)
    return readings.run_available(stream, "priced")


@add("j8_confirm_join", "series_id target_time:t prediction:r actual:r", x.OBSERVED,
     "SELECT f.series_id, f.target_time, f.prediction, o.kw AS actual FROM forecast f JOIN observed o ON "
     "o.series_id = f.series_id AND o.ts = f.target_time")
def j8(t):
    made = replay(t, t.forecast.select("series_id", "target_time", "prediction"), "made")
    real = replay(t, t.observed.select("series_id", "ts", "kw"), "real")
    return readings.run_available(readings.confirm_join(made, real), "confirmed")


J9_PASSED = "(SELECT max(ts) - INTERVAL '10 minutes' FROM observed)"


@add("j9_stateful_threshold", "series_id ts:t annual_peak:r error_samples:i", x.THRESHOLD,
     f"SELECT series_id, ts, annual_peak, error_samples FROM margins WHERE prediction IS NOT NULL AND ts <= {J9_PASSED}")
def j9(t):
    """Peak and sample count equal the batch values; the margin is within 1 % of the exact one (next query)."""
    made = t.observed.select("series_id", "ts", "kw", "prediction")
    return readings.run_available(alerts.stateful_threshold(replay(t, made, "observed")), "threshold",
                                  settings=alerts.THRESHOLD_SETTINGS)


@add("j9_margin_within_one_percent", "series_id n:i close:i", x.THRESHOLD,
     f"SELECT series_id, count(*) AS n, count(*) AS close FROM margins WHERE prediction IS NOT NULL AND ts <= {J9_PASSED} GROUP BY 1")
def j9_margin(t):
    exact = asof.peak_recommendation(t.observed).select("series_id", "ts", F.col("error_margin").alias("exact"))
    near = F.abs(F.col("error_margin") - F.col("exact")) <= 0.01 * F.col("exact") + 0.001
    return (j9(t).join(exact, ["series_id", "ts"]).groupBy("series_id")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(near).alias("close")))


@add("j10_stream_scoring", "series_id ts:t y:r scored rows:i", usable_sql(x.DENSE),
     "SELECT series_id, ts, y, true AS scored, count(*) OVER () AS rows FROM usable WHERE split = 'test'")
def j10(t):
    """Test rows arrive in three batches, a third of them once more in a fourth, and are scored with a stored model, once each."""
    rows = usable(t)
    folder, out = shared_folder(t.spark, "model"), shared_folder(t.spark, "scored")
    models.fit_tree_model(rows.filter("split = 'train'")).save(folder)
    model = models.Forest.load(t.spark, folder)
    test = rows.filter("split = 'test'")
    path = shared_folder(t.spark, "to-score")
    files = max(FILES, t.spark.sparkContext.defaultParallelism)        # of each batch: a batch is written and read by many tasks
    test.repartition(3 * files).write.parquet(path)
    test.filter(F.dayofmonth("ts") % 3 == 0).repartition(files).write.mode("append").parquet(path)
    stream = t.spark.readStream.schema(test.schema).option("maxFilesPerTrigger", files).parquet(path)
    alerts.stream_scoring(stream, lambda b: models.finite_only(models.score_tree_model(model, b)), out,
                          shared_folder(t.spark, "scored-state"))
    done = alerts.read_scored(t.spark, out)
    return done.withColumn("scored", F.col("prediction") >= 0).withColumn("rows", F.lit(done.count()))


@add("j11_alert_once", "series_id ts:t threshold:r1 prediction:r", x.RECOMMEND,
     "SELECT series_id, ts, threshold, prediction FROM rec WHERE prediction >= threshold")
def j11(t):
    states = asof.risk_state(asof.peak_recommendation(t.observed)).select(
        "series_id", "ts", "threshold", "prediction", "at_risk")
    stream = replay(t, states.unionByName(states), "states")
    return readings.run_available(alerts.alert_once(stream), "alerts")
