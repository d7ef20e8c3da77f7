"""Queries over the 15-minute series: features, activity, split, folds and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.functions import fixed_values as fv
from wattloom.operators import features, reshape, split
from wattloom.plans import fixtures as x
from wattloom.plans import preprocess
from wattloom.plans.queries_raw import DROPS, LONG, filled_sql
from wattloom.plans.registry import REGISTRY
from wattloom.session import shared_folder

add = REGISTRY.add
KEY = "series_id ts:t"
LAGS = [f"kw_lag{n}" for n in (1, 2, 3, 4, 8, 96, 672)]
LAG_SQL = ", ".join(f"lag(kw, {n - 1}) OVER w AS kw_lag{n}" for n in (1, 2, 3, 4, 8, 96, 672))


def words(names) -> str:
    return " ".join(f"{n}:r" for n in names)


# -- F: segment features -------------------------------------------------------------------

@add("f1_target_next", f"{KEY} kw:r y:r", x.SEG, f"SELECT *, lead(kw) OVER w AS y FROM seg {x.W}")
def f1(t):
    return features.segment_features(t.readings, ["y"])


@add("f1_target_next_gaps", f"{KEY} kw:r y:r kw_lag2:r", x.NATURAL + ",\n" + x.segmented("natural_r"),
     f"SELECT *, lead(kw) OVER w AS y, lag(kw) OVER w AS kw_lag2 FROM seg {x.W}")
def f1_gaps(t):
    """The same on irregular readings with thousands of segments."""
    return features.segment_features(t.natural, ["y", "kw_lag2"])


@add("f2_lags", f"{KEY} {words(LAGS)}", x.SEG, f"SELECT *, {LAG_SQL} FROM seg {x.W}")
def f2(t):
    return features.segment_features(t.readings, LAGS)


@add("f2_lags_after_cleaning", f"{KEY} kw:r {words(LAGS)}", LONG + ",\n" + x.segmented("long15"),
     f"SELECT *, {LAG_SQL} FROM seg {x.W}")
def f2_clean(t):
    """Lags over the gaps that removed days leave behind."""
    return features.segment_features(reshape.to_15min(t.clean), LAGS)


@add("f3_lag16", f"{KEY} lag16:r", x.SEG, f"SELECT *, lag(kw, 16) OVER w AS lag16 FROM seg {x.W}")
def f3(t):
    return features.segment_features(t.readings, ["lag16"])


@add("f4_slopes", f"{KEY} kw_d1:r kw_d2:r", x.SEG,
     f"SELECT *, kw - lag(kw) OVER w AS kw_d1, lag(kw) OVER w - lag(kw, 2) OVER w AS kw_d2 FROM seg {x.W}")
def f4(t):
    return features.segment_features(t.readings, ["kw_d1", "kw_d2"])


@add("f5_roll_mean", f"{KEY} kw_roll4:r10 kw_roll16:r10 mean_2h:r10 mean_4h:r10", x.SEG,
     f"SELECT series_id, ts, {x.full(4, 'avg')} AS kw_roll4, {x.full(16, 'avg')} AS kw_roll16, "
     f"{x.full(8, 'avg')} AS mean_2h, {x.full(16, 'avg')} AS mean_4h FROM seg")
def f5(t):
    return features.segment_features(t.readings, ["kw_roll4", "kw_roll16", "mean_2h", "mean_4h"])


@add("f6_roll_std4", f"{KEY} kw_std4:r5", x.SEG,
     f"SELECT series_id, ts, {x.full(4, 'stddev_samp')} AS kw_std4 FROM seg")
def f6(t):
    return features.segment_features(t.readings, ["kw_std4"])


@add("f7_delta", f"{KEY} delta_2h:r delta_4h:r", x.SEG,
     f"SELECT *, kw - lag(kw, 8) OVER w AS delta_2h, kw - lag(kw, 16) OVER w AS delta_4h FROM seg {x.W}")
def f7(t):
    return features.segment_features(t.readings, ["delta_2h", "delta_4h"])


@add("f8_roll_max", f"{KEY} max_2h:r max_4h:r", x.SEG,
     f"SELECT series_id, ts, {x.full(8, 'max')} AS max_2h, {x.full(16, 'max')} AS max_4h FROM seg")
def f8(t):
    return features.segment_features(t.readings, ["max_2h", "max_4h"])


@add("f9_calendar_parts", f"{KEY} hour:i quarter:i dow:i", x.NATURAL,
     "SELECT *, hour(ts) AS hour, minute(ts) // 15 AS quarter, isodow(ts) AS dow FROM natural_r")
def f9(t):
    return features.calendar_parts(t.natural)


@add("f10_flags", f"{KEY} is_weekend:i is_day_shift:i", x.DENSE,
     "SELECT *, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend, "
     "CASE WHEN hour(ts) BETWEEN 9 AND 17 THEN 1 ELSE 0 END AS is_day_shift FROM dense")
def f10(t):
    return features.flags(t.readings)


@add("f11_cyclic", f"{KEY} tod_sin:r tod_cos:r dow_sin:r dow_cos:r", x.DENSE,
     """SELECT series_id, ts, sin(2 * pi() * s / 96) AS tod_sin, cos(2 * pi() * s / 96) AS tod_cos,
  sin(2 * pi() * d / 7) AS dow_sin, cos(2 * pi() * d / 7) AS dow_cos
  FROM (SELECT *, hour(ts) * 4 + minute(ts) // 15 AS s, isodow(ts) - 1 AS d FROM dense)""")
def f11(t):
    return features.cyclic(t.readings)


OFF_SQL = ("CASE WHEN isodow(ts) >= 6 OR CAST(ts AS DATE) IN (SELECT date FROM holidays) "
           "THEN 1 ELSE 0 END")


@add("f12_is_off", f"{KEY} is_off:i weekend_only:i", x.DENSE + ",\n" + x.HOLIDAYS,
     f"SELECT *, {OFF_SQL} AS is_off, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS weekend_only FROM dense")
def f12(t):
    plain = features.is_off(t.readings, None).withColumnRenamed("is_off", "weekend_only")
    return features.is_off(plain, t.holidays)


def activity_ctes(source: str) -> str:
    return f"""energy AS (SELECT series_id, CAST(ts AS DATE) AS date, coalesce(sum(kw), 0) AS energy FROM {source}
  GROUP BY 1, 2),
meds AS (SELECT *, median(energy) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING) AS past_median, row_number() OVER (PARTITION BY series_id ORDER BY date) AS rn FROM energy),
act AS (SELECT *, coalesce(energy >= past_median * 0.2::DOUBLE, false) AS active FROM meds),
days AS (SELECT *, rn - 1 - coalesce(max(CASE WHEN active THEN rn END) OVER (PARTITION BY series_id ORDER BY date
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS days_since_active,
  coalesce(CAST(lag(active) OVER (PARTITION BY series_id ORDER BY date) AS INTEGER), 1) AS prev_day_active FROM act)"""


ACT = x.DENSE + ",\n" + activity_ctes("dense")


@add("f13_daily_energy", "series_id date:d energy:r", ACT, "SELECT * FROM energy")
def f13(t):
    return features.daily_energy(t.readings)


@add("f14_day_active", "series_id date:d energy:r past_median:r active", ACT, "SELECT * FROM act")
def f14(t):
    return features.day_active(features.daily_energy(t.readings))


@add("f15_days_since_active", "series_id date:d days_since_active:i", ACT, "SELECT * FROM days")
def f15(t):
    return features.activity(features.day_active(features.daily_energy(t.readings)))


@add("f15_activity_natural", "series_id date:d active days_since_active:i prev_day_active:i",
     x.NATURAL + ",\n" + activity_ctes("natural_r"), "SELECT * FROM days")
def f15_natural(t):
    return features.activity(features.day_active(features.daily_energy(t.natural)))


@add("f16_prev_day_active", f"{KEY} days_since_active:i prev_day_active:i", ACT,
     "SELECT d.series_id, d.ts, days_since_active, prev_day_active FROM dense d JOIN days k "
     "ON k.series_id = d.series_id AND k.date = CAST(d.ts AS DATE)")
def f16(t):
    days = features.activity(features.day_active(features.daily_energy(t.readings)))
    return features.attach_activity(t.readings, days)


DELAYED = [f"{c}_lag4" for c in ("production", "temp", "wind", "humidity", "rain")]


@add("f17_delayed_context", f"{KEY} {words(DELAYED)}", x.SEG,
     "SELECT series_id, ts, " + ", ".join(f"lag({c[:-5]}, 4) OVER w AS {c}" for c in DELAYED) + f" FROM seg {x.W}")
def f17(t):
    return features.segment_features(t.dense, DELAYED)


# -- the whole run -------------------------------------------------------------------------

SEGMENT_SQL = f"""lead(kw) OVER w AS y, {LAG_SQL}, lag(kw, 16) OVER w AS lag16, kw - lag(kw) OVER w AS kw_d1,
  lag(kw) OVER w - lag(kw, 2) OVER w AS kw_d2, {x.full(4, 'avg')} AS kw_roll4, {x.full(16, 'avg')} AS kw_roll16,
  {x.full(4, 'stddev_samp')} AS kw_std4, kw - lag(kw, 8) OVER w AS delta_2h, {x.full(8, 'avg')} AS mean_2h,
  {x.full(8, 'max')} AS max_2h, kw - lag(kw, 16) OVER w AS delta_4h, {x.full(16, 'avg')} AS mean_4h,
  {x.full(16, 'max')} AS max_4h"""
CALENDAR_SQL = f"""hour(ts) AS hour, minute(ts) // 15 AS quarter, isodow(ts) AS dow,
  CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN hour(ts) BETWEEN 9 AND 17 THEN 1 ELSE 0 END AS is_day_shift,
  sin(2 * pi() * (hour(ts) * 4 + minute(ts) // 15) / 96) AS tod_sin,
  cos(2 * pi() * (hour(ts) * 4 + minute(ts) // 15) / 96) AS tod_cos,
  sin(2 * pi() * (isodow(ts) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) AS dow_cos,
  {OFF_SQL} AS is_off, {x.DATE_KEY} AS date_key"""

TABLE_WORDS = (f"{KEY} date_key:i split kw:r y:r {words(LAGS)} lag16:r kw_d1:r kw_d2:r kw_roll4:r10 kw_roll16:r10 "
               "kw_std4:r5 delta_2h:r mean_2h:r10 max_2h:r delta_4h:r mean_4h:r10 max_4h:r hour:i quarter:i dow:i "
               "is_weekend:i is_day_shift:i tod_sin:r tod_cos:r dow_sin:r dow_cos:r is_off:i days_since_active:i "
               "prev_day_active:i production_lag4:r temp_lag4:r wind_lag4:r humidity_lag4:r")

FLAGSHIP = DROPS + f""",
imputed AS (SELECT * REPLACE ({filled_sql('temp')}, {filled_sql('humidity')}) FROM clean),
long_all AS (SELECT series_id, ts + to_minutes(15 * i) AS ts, [q1, q2, q3, q4][i + 1] AS kw, production, temp, wind,
  humidity FROM imputed, (SELECT unnest([0, 1, 2, 3]) AS i)),
""" + x.segmented("long_all") + ",\n" + activity_ctes("long_all") + ",\n" + x.HOLIDAYS + f""",
table_ AS (SELECT s.*, {SEGMENT_SQL}, {CALENDAR_SQL},
  {', '.join(f"lag({c}, 4) OVER w AS {c}_lag4" for c in ('production', 'temp', 'wind', 'humidity'))}
  FROM seg s {x.W}),
""" + x.split_ctes("table_")


@add("flagship_preprocess", TABLE_WORDS, FLAGSHIP,
     "SELECT p.*, k.days_since_active, k.prev_day_active FROM parted p JOIN days k ON k.series_id = p.series_id "
     "AND k.date = CAST(p.ts AS DATE) WHERE y IS NOT NULL")
def flagship(t):
    """Raw hourly rows with planted defects to the labelled feature table, leaks found on the way."""
    return preprocess.preprocess(t.hourly, t.holidays)


def _metrics(step: str, source: str, **cells: str) -> str:
    return "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{step}' AS step, '{name}' AS metric, CAST({c} AS VARCHAR) AS value FROM {source}" for name, c in cells.items()) + ")"


AUDIT_SQL = " UNION ALL ".join([
    _metrics("input", "hourly", rows="count(*)", columns="max(18)"),
    _metrics("bad_dates", "dated WHERE day0 IS NULL", rows="count(*)"),
    _metrics("schema", "dated WHERE day0 IS NOT NULL", rows="count(*)", columns="max(18)", context="max(5)", absent="max('')"),
    _metrics("calendar", "(SELECT 1)", given="max('true')"),
    _metrics("hours", "quality", good_days="count(*) FILTER (WHERE hours_ok)", bad_days="count(*) FILTER (WHERE NOT hours_ok)",
             incomplete_days="count(*) FILTER (WHERE n_rows <> 24)"),
    _metrics("incomplete_kept", "quality WHERE hours_ok AND n_rows <> 24", days="count(*)"),
    _metrics("bad_hour_days", "quality WHERE NOT hours_ok", days="count(*)", rows="coalesce(sum(n_rows), 0)"),
    _metrics("time_axis", "spans_", first="strftime(min(ts), '%Y-%m-%d %H:%M:%S')", last="strftime(max(ts), '%Y-%m-%d %H:%M:%S')",
             rows="count(*)", gaps="count(*) FILTER (WHERE gap > INTERVAL '1 hour')"),
    _metrics("leaks", "drops", dropped="count(*)", columns="string_agg(c, ',' ORDER BY c)", checked="max(10)"),
    _metrics("imputation", "clean JOIN imputed i USING (series_id, ts)", **{
        f"{m}_{c}": v for c in ("production", "temp", "wind", "humidity") for m, v in (
            ("missing", f"count(*) FILTER (WHERE clean.{c} IS NULL)"), ("left", f"count(*) FILTER (WHERE i.{c} IS NULL)"),
            ("filled", f"count(*) FILTER (WHERE clean.{c} IS NULL AND i.{c} IS NOT NULL)"))}),
    _metrics("expansion", "clean", hours="count(*)", intervals="4 * count(*)", per_hour="max(4)"),
    _metrics("segments", "(SELECT series_id, segment, count(*) AS n FROM seg GROUP BY 1, 2)", segments="count(*)", min_rows="min(n)",
             max_rows="max(n)"),
    _metrics("split", "parted", train="count(*) FILTER (WHERE split = 'train')", test="count(*) FILTER (WHERE split = 'test')"),
    _metrics("unlabelled", "parted", dropped="count(*) FILTER (WHERE y IS NULL)", rows="count(*) FILTER (WHERE y IS NOT NULL)")])


@add("a6_run_audit", "step metric value", FLAGSHIP + """,
spans_ AS (SELECT ts, ts - lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS gap FROM clean)""", AUDIT_SQL)
def a6_run(t):
    """The preprocessing run records every rule while it writes the feature table; ``rain`` leaves as a leak of the planted table or stays."""
    out, audit = shared_folder(t.spark, "features"), shared_folder(t.spark, "audit")
    preprocess.run(t.hourly, out, audit, t.holidays)
    return t.spark.read.parquet(f"{audit}/steps").select("step", F.explode("metrics").alias("metric", "value"))


@add("a6_run_features", "split rows:i first:t last:t", FLAGSHIP,
     "SELECT split, count(*) AS rows, min(ts) AS first, max(ts) AS last FROM parted WHERE y IS NOT NULL GROUP BY 1")
def a6_features(t):
    """The feature table that the audited run leaves."""
    made = preprocess.run(t.hourly, shared_folder(t.spark, "features"), shared_folder(t.spark, "audit"), t.holidays)
    return made.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@add("f_all_features", TABLE_WORDS.replace(" split", "") + " rain_lag4:r", x.SEG + ",\n" + activity_ctes("dense") + ",\n"
     + x.HOLIDAYS, f"SELECT s.*, {SEGMENT_SQL}, {CALENDAR_SQL}, days_since_active, prev_day_active, "
     + ", ".join(f"lag({c[:-5]}, 4) OVER w AS {c}" for c in DELAYED)
     + " FROM (SELECT g.*, k.days_since_active, k.prev_day_active FROM seg g JOIN days k ON k.series_id = g.series_id "
       "AND k.date = CAST(g.ts AS DATE)) s " + x.W)
def f_all(t):
    return features.all_features(t.dense, t.holidays)


# -- G1 - G4: split ------------------------------------------------------------------------

@add("g1_date_key", f"{KEY} date_key:i", x.DAILY, f"SELECT *, {x.DATE_KEY} AS date_key FROM daily")
def g1(t):
    return split.with_date_key(t.daily)


@add("g2_split_by_date", f"{KEY} split", x.DAILY,
     f"SELECT *, CASE WHEN {x.DATE_KEY} < 19990701 THEN 'train' ELSE 'test' END AS split FROM daily")
def g2(t):
    return split.split_by_date(split.with_date_key(t.daily), 19990701)


@add("g2_default_boundary", "series_id split n:i", x.TARIFF + f""",
by_year AS (SELECT 'T' || year(ts) AS series_id, {x.DATE_KEY} AS k FROM tariff),
days AS (SELECT series_id, k, row_number() OVER (PARTITION BY series_id ORDER BY k) - 1 AS i,
  count(*) OVER (PARTITION BY series_id) AS n FROM (SELECT DISTINCT series_id, k FROM by_year)),
bounds AS (SELECT series_id, CASE WHEN series_id = 'T2021' THEN 20210725 ELSE max(k) FILTER (i = floor(n * (1 - 0.3::DOUBLE))) END AS b
  FROM days GROUP BY 1)""",
     "SELECT series_id, CASE WHEN k < b THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM by_year "
     "JOIN bounds USING (series_id) GROUP BY 1, 2")
def g2_default(t):
    """Series that lie in one year with a known default boundary; the others by the fraction."""
    rows = t.tariff.withColumn("series_id", F.concat(F.lit("T"), F.year("ts").cast("string")))
    out = split.split_by_date(split.with_date_key(rows))
    return out.groupBy("series_id", "split").agg(F.count(F.lit(1)).alias("n"))


@add("g3_split_by_fraction", f"{KEY} date_key:i split", x.DAILY_PRED, "SELECT * FROM parted")
def g3(t):
    return split.split_by_fraction(split.with_date_key(t.daily))


@add("g4_drop_unlabelled", f"{KEY} y:r", x.SEG,
     f"SELECT * FROM (SELECT *, lead(kw) OVER w AS y FROM seg {x.W}) WHERE y IS NOT NULL")
def g4(t):
    return split.drop_unlabelled(features.segment_features(t.readings, ["y"]))


# -- G5 - G7: usable rows and windows ------------------------------------------------------

LABELLED = LONG + ",\n" + x.segmented("long15") + f""",
lab AS (SELECT series_id, ts, kw, y FROM (SELECT *, lead(kw) OVER w AS y FROM seg {x.W}) WHERE y IS NOT NULL),
""" + x.segmented("lab").replace("stepped", "stepped2").replace("seg AS (", "seg2 AS (").replace(
    "FROM stepped)", "FROM stepped2)") + """,
windows AS (SELECT *, count(kw) OVER (PARTITION BY series_id, segment ORDER BY ts ROWS BETWEEN 95 PRECEDING AND
  CURRENT ROW) = 96 AS window_ok FROM seg2)"""


def labelled(t):
    """Labelled readings after cleaning (two days are missing)."""
    return split.drop_unlabelled(features.segment_features(reshape.to_15min(t.clean), ["y"]))


@add("g6_window_ok", f"{KEY} window_ok", LABELLED, "SELECT * FROM windows")
def g6(t):
    return split.window_ok(labelled(t))


@add("g7_window_vectors", "series_id ts:t n_rows:i width:i first:r last:r total:r", LABELLED + """,
cells AS (SELECT series_id, ts, window_ok, list(kw) OVER (PARTITION BY series_id, segment ORDER BY ts ROWS BETWEEN
  95 PRECEDING AND CURRENT ROW) AS v FROM windows)""",
     "SELECT series_id, ts, 24 AS n_rows, 4 AS width, v[1] AS first, v[96] AS last, list_sum(v) AS total "
     "FROM cells WHERE window_ok")
def g7(t):
    w = F.col("window")
    return split.window_vectors(labelled(t)).select(
        "series_id", "ts", F.size(w).alias("n_rows"), F.size(w[0]).alias("width"), w[0][0].alias("first"),
        w[23][3].alias("last"), F.aggregate(F.flatten(w), F.lit(0.0), lambda a, v: a + v).alias("total"))


USABLE_NULLS = " AND ".join(f"{c} IS NOT NULL" for c in fv.TREE_FEATURES + fv.WEATHER_LAGS if c not in
                            ("hour", "quarter", "dow", "is_weekend", "is_day_shift", "tod_sin", "tod_cos"))


@add("g5_usable_rows", f"{KEY} kw:r y:r", x.SEG + f""",
full_ AS (SELECT series_id, ts, kw, {SEGMENT_SQL}, {', '.join(f"lag({c[:-5]}, 4) OVER w AS {c}" for c in DELAYED)}
  FROM seg {x.W}),
lab AS (SELECT * FROM full_ WHERE y IS NOT NULL),
""" + x.segmented("lab").replace("stepped", "stepped2").replace("seg AS (", "seg2 AS (") + """,
windows AS (SELECT *, count(kw) OVER (PARTITION BY series_id, segment ORDER BY ts ROWS BETWEEN 95 PRECEDING AND
  CURRENT ROW) = 96 AS window_ok FROM seg2)""",
     f"SELECT * FROM windows WHERE window_ok AND {USABLE_NULLS}")
def g5(t):
    table = split.drop_unlabelled(features.all_features(t.dense, t.holidays))
    return split.usable_rows(table)


# -- G8 - G11: folds and jobs --------------------------------------------------------------

FOLDS = x.DAILY_PRED + """,
months AS (SELECT series_id, date_trunc('month', ts) AS first, max(ts) AS last FROM dpred WHERE split = 'train'
  GROUP BY 1, 2),
ends AS (SELECT *, max(last) OVER (PARTITION BY series_id) AS stop FROM months),
folds AS (SELECT series_id, CAST(strftime(first, '%Y%m%d') AS INTEGER) AS lo,
    CAST(strftime(first + INTERVAL 24 DAYS, '%Y%m%d') AS INTEGER) AS hi, strftime(first, '%Y%m%d') AS fold
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY first DESC) AS rn FROM ends
    WHERE first + INTERVAL 24 DAYS <= stop + INTERVAL 1 DAY) WHERE rn <= 4),
jobs AS (SELECT * FROM folds UNION ALL SELECT series_id, min(date_key), NULL, 'test' FROM dpred
  WHERE split = 'test' GROUP BY 1),
evals AS (SELECT d.*, j.fold, j.lo, j.hi FROM dpred d JOIN jobs j ON j.series_id = d.series_id
  AND d.date_key >= j.lo AND (j.hi IS NULL OR d.date_key < j.hi))"""


def jobs(t):
    rows = t.daily_predictions
    return split.eval_jobs(rows, split.forward_folds(rows))


def eval_rows(t):
    return split.job_rows(t.daily_predictions, jobs(t))


@add("g8_forward_folds", "series_id lo:i hi:i fold", FOLDS, "SELECT * FROM folds")
def g8(t):
    return split.forward_folds(t.daily_predictions)


@add("g9_eval_jobs", "series_id fold rows:i first:i last:i", FOLDS,
     "SELECT series_id, fold, count(*) AS rows, min(date_key) AS first, max(date_key) AS last FROM evals GROUP BY 1, 2")
def g9(t):
    return eval_rows(t).groupBy("series_id", "fold").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date_key").alias("first"), F.max("date_key").alias("last"))


@add("g9_train_rows", "series_id fold rows:i", FOLDS,
     "SELECT j.series_id, j.fold, count(*) AS rows FROM dpred d JOIN jobs j ON j.series_id = d.series_id "
     "AND d.date_key < j.lo GROUP BY 1, 2")
def g9_train(t):
    rows = split.job_rows(t.daily_predictions, jobs(t), part="train")
    return rows.groupBy("series_id", "fold").agg(F.count(F.lit(1)).alias("rows"))


@add("g10_train_lookback", "series_id fold lo:i start:i", FOLDS,
     "SELECT series_id, fold, lo, CAST(strftime(strptime(CAST(lo AS VARCHAR), '%Y%m%d') - INTERVAL 3 MONTHS, "
     "'%Y%m%d') AS INTEGER) AS start FROM jobs")
def g10(t):
    return split.train_lookback(jobs(t))


@add("g11_tail_validation", f"{KEY} part", x.OBSERVED,
     """SELECT series_id, ts, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY ts) <=
  floor(0.85::DOUBLE * count(*) OVER (PARTITION BY series_id)) THEN 'fit' ELSE 'validation' END AS part
  FROM observed WHERE split = 'train'""")
def g11(t):
    return split.tail_validation(t.observed.filter("split = 'train'"))
