"""Tariff, wage, staffing and cost queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wattloom.functions import fixed_values as fv
from wattloom.operators import requests, staffing, tariff
from wattloom.plans import fixtures as x
from wattloom.plans import staffing_requests
from wattloom.plans.queries_raw import REQUESTS
from wattloom.plans.registry import REGISTRY
from wattloom.session import stage

add = REGISTRY.add
H = x.half_even_sql
POINT = "o_orderkey:i ts:t"

SEASON = ("CASE WHEN month(ts) IN (6, 7, 8) THEN 'summer' WHEN month(ts) IN (11, 12, 1, 2) THEN 'winter' "
          "ELSE 'spring_autumn' END")
BANDED = x.TARIFF + ",\n" + x.HOLIDAYS + ",\n" + x.BANDS + ",\n" + x.RATES + f""",
seasoned AS (SELECT *, {SEASON} AS season, hour(ts) + minute(ts) / 60 + second(ts) / 3600 AS h,
  CAST(ts AS DATE) IN (SELECT date FROM holidays) AS is_holiday FROM tariff),
banded AS (SELECT s.*, b.band AS base_band, CASE WHEN isodow(ts) = 7 OR is_holiday THEN 'off'
  WHEN isodow(ts) = 6 AND b.band = 'peak' THEN 'mid' ELSE b.band END AS band
  FROM seasoned s JOIN bands b ON b.season = s.season AND s.h >= b.h_start AND s.h < b.h_end),
priced AS (SELECT b.*, r.rate AS tariff_rate FROM banded b JOIN rates r ON r.season = b.season AND r.band = b.band)"""


@add("i1_season", f"{POINT} season", BANDED, "SELECT * FROM seasoned")
def i1(t):
    return tariff.with_season(t.tariff)


@add("i2_load_band", f"{POINT} season band", BANDED, "SELECT * REPLACE (base_band AS band) FROM banded")
def i2(t):
    return tariff.load_band(tariff.with_season(t.tariff), t.tariff_dims[1])


@add("i3_band_override", f"{POINT} season band is_holiday", BANDED, "SELECT * FROM banded")
def i3(t):
    rows = tariff.load_band(tariff.with_season(t.tariff), t.tariff_dims[1])
    return tariff.band_override(tariff.with_holiday(rows, t.holidays))


def priced(t, override=None):
    rates, bands = t.tariff_dims
    return tariff.tariff_at(t.tariff, bands, rates, t.holidays, override)


@add("i4_rate_lookup", f"{POINT} season band tariff_rate:r rate:r", BANDED, "SELECT *, tariff_rate AS rate FROM priced")
def i4(t):
    return priced(t)


@add("i4_rate_override", "season band tariff_rate:r rate:r n:i", BANDED,
     "SELECT season, band, tariff_rate, 120.5 AS rate, count(*) AS n FROM priced GROUP BY 1, 2, 3")
def i4_override(t):
    return priced(t, 120.5).groupBy("season", "band", "tariff_rate", "rate").agg(F.count(F.lit(1)).alias("n"))


@add("i5_hour_wage", f"{POINT} night wage:r", x.TARIFF,
     "SELECT *, hour(ts) >= 22 OR hour(ts) < 6 AS night, CASE WHEN hour(ts) >= 22 OR hour(ts) < 6 THEN 13080 ELSE 8720 "
     "END AS wage FROM tariff")
def i5(t):
    return tariff.hour_wage(t.tariff)


@add("i6_day_type", f"{POINT} day_type", BANDED,
     "SELECT *, CASE WHEN isodow(ts) >= 6 OR is_holiday THEN 'off' ELSE 'work' END AS day_type FROM seasoned")
def i6(t):
    return tariff.day_type(tariff.with_holiday(t.tariff, t.holidays))


# -- staffing ------------------------------------------------------------------------------

HISTORY = x.CLEAN + ",\n" + x.HOLIDAYS + """,
history AS (SELECT series_id, ts, production, staff, CASE WHEN isodow(ts) >= 6 OR CAST(ts AS DATE) IN
    (SELECT date FROM holidays) THEN 'off' ELSE 'work' END AS day_type,
  coalesce(isfinite(staff) AND staff >= 0 AND (production = 0 OR staff > 0), false) AS staff_valid FROM clean)"""
MATCHED = HISTORY + """,
pairs AS (SELECT a.series_id, a.ts, a.day_type, a.production AS target, h.ts AS ref_ts, h.production AS ref_production,
    h.staff AS ref_staff, CAST(ceil(h.staff) AS BIGINT) AS staff_ref,
    count(h.ts) OVER (PARTITION BY a.series_id, a.ts) AS matches,
    row_number() OVER (PARTITION BY a.series_id, a.ts ORDER BY ceil(h.staff), h.production, h.ts DESC) AS rn
  FROM history a LEFT JOIN history h ON h.series_id = a.series_id AND h.day_type = a.day_type AND hour(h.ts) = hour(a.ts)
    AND h.ts < date_trunc('day', a.ts) AND h.staff_valid AND isfinite(h.production) AND h.production >= a.production),
matched AS (SELECT *, CASE WHEN staff_ref IS NULL THEN 'insufficient_data' ELSE 'complete' END AS status
  FROM pairs WHERE rn = 1)"""


def history(t):
    return staffing.staff_validity(tariff.day_type(tariff.with_holiday(t.clean, t.holidays)))


def matched(t, **runs):
    """Every hour asks for its own production: the replay of the whole history."""
    rows = history(t)
    asked = rows.select("series_id", "ts", "day_type", F.col("production").alias("target"))
    return staffing.match_status(staffing.staff_match(asked, rows, **runs))


@add("i7_staff_validity", "series_id ts:t staff:r staff_valid", HISTORY, "SELECT * FROM history")
def i7(t):
    return history(t)


MATCH_WORDS = "series_id ts:t day_type target:r ref_ts:t ref_production:r ref_staff:r staff_ref:r"


@add("i8_staff_match", MATCH_WORDS, MATCHED, "SELECT * FROM matched")
def i8(t):
    return matched(t)


@add("i8_staff_match_salted", MATCH_WORDS, MATCHED, "SELECT * FROM matched")
def i8_salted(t):
    """The same with short runs: questions of one hour are spread over several tasks."""
    return matched(t, run_rows=64)


@add("i9_staff_match_status", "series_id ts:t matches:i status", MATCHED, "SELECT * FROM matched")
def i9(t):
    return matched(t)


# -- cost ----------------------------------------------------------------------------------

COSTED = BANDED + f""",
staffed AS (SELECT *, kw AS prediction, 1 + o_orderkey % 40 AS staff_ref, (o_orderkey % 900) * 3 AS target,
  CASE WHEN hour(ts) >= 22 OR hour(ts) < 6 THEN 13080.0::DOUBLE ELSE 8720.0::DOUBLE END AS wage FROM priced),
parts AS (SELECT *, staff_ref * wage AS labor_, greatest(0, prediction) * tariff_rate AS energy_,
  1444000.0::DOUBLE / (day(last_day(CAST(ts AS DATE))) * 24) AS base_ FROM staffed),
costed AS (SELECT o_orderkey, ts, staff_ref, target, {H('labor_', 2)} AS labor, {H('energy_', 2)} AS energy,
  {H('base_', 2)} AS base_allocated, {H('labor_ + energy_ + base_', 2)} AS total,
  labor_ + energy_ + base_ AS raw_total FROM parts)"""


def costed(t, raw: bool = False):
    key = F.col("o_orderkey")
    rows = tariff.hour_wage(priced(t)).withColumns({
        "prediction": F.col("kw"), "staff_ref": 1 + key % 40, "target": (key % 900 * 3).cast("double")})
    return staffing.interval_cost(rows, raw=raw)


@add("i10_interval_cost", f"{POINT} labor:r2 energy:r2 base_allocated:r2 total:r2", COSTED, "SELECT * FROM costed")
def i10(t):
    return costed(t)


@add("i10_interval_cost_raw", f"{POINT} total:r", COSTED, "SELECT * REPLACE (raw_total AS total) FROM costed")
def i10_raw(t):
    return costed(t, raw=True)


@add("i11_economics", f"{POINT} profit:r2 remainder:r2", COSTED,
     f"SELECT o_orderkey, ts, target * 150 AS profit, {H('target * 150.0::DOUBLE - total', 2)} AS remainder FROM costed")
def i11(t):
    return staffing.economics(costed(t))


ISSUES = x.OBSERVED + """,
asked AS (SELECT series_id, ts AS now, date_trunc('hour', ts + INTERVAL 15 MINUTES) AS hour FROM observed
  WHERE split = 'test'),
issued AS (SELECT a.*, count(f.ts) AS issues, max(f.prediction) AS prediction FROM asked a LEFT JOIN forecast f
  ON f.series_id = a.series_id AND f.target_time = a.hour GROUP BY 1, 2, 3)"""


def issued(t):
    return staffing.issue_selection(t.observed.filter("split = 'test'"), t.forecast)


@add("i12_issue_selection", "series_id now:t hour:t issues:i prediction:r ok", ISSUES,
     "SELECT *, issues = 1 AS ok FROM issued")
def i12(t):
    return issued(t)


@add("i13_replay_target", "series_id now:t hour:t rows:i target:r target_ok", ISSUES + x.CLEAN[len(x.DENSE):],
     "SELECT i.series_id, i.now, i.hour, count(c.ts) AS rows, max(c.production) AS target, count(c.ts) = 1 AS target_ok "
     "FROM issued i LEFT JOIN clean c ON c.series_id = i.series_id AND c.ts = i.hour GROUP BY 1, 2, 3")
def i13(t):
    return staffing.replay_target(issued(t), t.clean)


SCENARIO = x.OBSERVED + ",\n" + REQUESTS + f""",
dayno AS (SELECT series_id, day_key, row_number() OVER (PARTITION BY series_id ORDER BY day_key) - 1 AS dn FROM forecast
  GROUP BY 1, 2),
asked AS (SELECT r.*, 'M' || CAST(request_id // 2880 AS VARCHAR) AS series_id, request_id % 9 AS dn FROM requests r
  WHERE production <= 100000 AND staff >= 0 AND hourly_wage <= 1000000 AND power_factor > 0),
placed AS (SELECT series_id, day_key, prediction, row_number() OVER (PARTITION BY series_id, day_key ORDER BY ts) - 1
  AS cursor FROM forecast),
joined AS (SELECT a.*, p.prediction, p.prediction IS NOT NULL AS found, CASE WHEN p.prediction IS NOT NULL THEN
    greatest(0, p.prediction) * power_factor * 0.25::DOUBLE * energy_rate END AS e,
    CASE WHEN p.prediction IS NOT NULL THEN baseline_staff * hourly_wage * 0.25::DOUBLE END AS lb,
    CASE WHEN p.prediction IS NOT NULL THEN staff * hourly_wage * 0.25::DOUBLE END AS ls
  FROM asked a LEFT JOIN dayno d USING (series_id, dn) LEFT JOIN placed p ON p.series_id = a.series_id
  AND p.day_key = d.day_key AND p.cursor = a.cursor)"""


@add("i14_scenario_cost", "request_id:i found prediction:r energy:r baseline_labor:r baseline_total:r scenario_labor:r "
     "scenario_total:r", SCENARIO,
     f"""SELECT request_id, found, prediction, {H('e', 0)} AS energy, {H('lb', 0)} AS baseline_labor,
  {H('e + lb', 0)} AS baseline_total, {H('ls', 0)} AS scenario_labor, {H('e + ls', 0)} AS scenario_total FROM joined""")
def i14(t):
    valid = requests.accepted(requests.validate_params(t.requests, requests.SCENARIO))
    key = F.col("request_id")
    asked = valid.withColumn("series_id", F.concat(F.lit("M"), F.expr("request_id div 2880").cast("string"))
                             ).withColumn("dn", key % 9)
    days = (t.forecast.select("series_id", "day_key").distinct().withColumn(
        "dn", F.row_number().over(Window.partitionBy("series_id").orderBy("day_key")) - 1))
    return staffing.scenario_cost(asked.join(days, ["series_id", "dn"], "left"), t.forecast)


@add("i15_production_range", "series_id min_production:r max_production:r", x.OBSERVED,
     "SELECT series_id, min(production) AS min_production, max(production) AS max_production FROM forecast GROUP BY 1")
def i15(t):
    return staffing.production_range(t.forecast, ["series_id"])


# -- the whole staffing answer -------------------------------------------------------------

@add("i_staffing_replay", "series_id hour:t band staff_ref:r matches:i status labor:r2 energy:r2 total:r2 remainder:r2",
     MATCHED + x.OBSERVED[len(x.DENSE):] + ",\n" + x.BANDS + ",\n" + x.RATES + f""",
made AS (SELECT series_id, target_time AS hour, prediction FROM forecast WHERE minute(target_time) = 0),
base AS (SELECT m.*, g.prediction, m.ts AS hour_, {SEASON.replace('month(ts)', 'month(m.ts)')} AS season,
  CAST(m.ts AS DATE) IN (SELECT date FROM holidays) AS hol FROM matched m JOIN made g ON g.series_id = m.series_id
  AND g.hour = m.ts),
wb AS (SELECT s.*, CASE WHEN isodow(ts) = 7 OR hol THEN 'off' WHEN isodow(ts) = 6 AND b.band = 'peak' THEN 'mid'
  ELSE b.band END AS band FROM base s JOIN bands b ON b.season = s.season AND hour(ts) >= b.h_start
  AND hour(ts) < b.h_end),
wr AS (SELECT w.*, r.rate, CASE WHEN hour(ts) >= 22 OR hour(ts) < 6 THEN 13080.0::DOUBLE ELSE 8720.0::DOUBLE END AS wage,
  1444000.0::DOUBLE / (day(last_day(CAST(ts AS DATE))) * 24) AS base_ FROM wb w JOIN rates r ON r.season = w.season
  AND r.band = w.band),
tot AS (SELECT *, {H('staff_ref * wage', 2)} AS labor, {H('greatest(0, prediction) * rate', 2)} AS energy,
  {H('staff_ref * wage + greatest(0, prediction) * rate + base_', 2)} AS total FROM wr)""",
     f"SELECT *, ts AS hour, {H('target * 150 - total', 2)} AS remainder FROM tot")
def staffing_replay(t):
    """Forecast of each full hour, its actual production as target, reference staff and cost."""
    rates, bands = t.tariff_dims
    made = t.forecast.filter(F.minute("target_time") == 0).select(
        "series_id", F.col("target_time").alias("ts"), "prediction")
    rows = matched(t).join(made, ["series_id", "ts"])
    priced_rows = tariff.hour_wage(tariff.tariff_at(rows, bands, rates, t.holidays))
    return staffing.economics(staffing.interval_cost(priced_rows)).withColumn("hour", F.col("ts"))


# -- requests with their own prices --------------------------------------------------------

ASKED = x.OBSERVED + MATCHED[len(x.DENSE):] + ",\n" + x.BANDS + ",\n" + x.RATES + ",\n" + REQUESTS + f""",
days2_ AS (SELECT series_id, day_key, row_number() OVER (PARTITION BY series_id ORDER BY day_key) - 1 AS i, count(*) OVER
    (PARTITION BY series_id) AS n_days, any_value(n_rows) AS n_rows
  FROM (SELECT series_id, day_key, count(*) AS n_rows FROM forecast GROUP BY 1, 2) GROUP BY 1, 2),
asked_ AS (SELECT r.request_id, r.series_id, d.day_key, r.cursor, d.n_rows, r.planned_production, r.unit_price, r.day_wage,
    CASE WHEN request_id % 6 = 0 THEN energy_rate END AS energy_rate, CASE WHEN request_id % 10 = 0 THEN 200.0::DOUBLE END AS billing_peak,
    CASE WHEN request_id % 4 = 0 THEN request_id % 97 - 2.0::DOUBLE END AS own
  FROM (SELECT *, 'M' || CAST(request_id // {x.METER_SLOTS} AS VARCHAR) AS series_id FROM requests) r
  LEFT JOIN days2_ d ON d.series_id = r.series_id AND d.i = r.request_id % d.n_days),
reasons_ AS (SELECT *, concat_ws(',', CASE WHEN planned_production IS NULL THEN 'planned_production' END,
    CASE WHEN unit_price < 0 THEN 'unit_price' END, CASE WHEN day_wage <= 0 THEN 'day_wage' END,
    CASE WHEN own < 0 THEN 'rate_table.summer.off' END) AS reasons FROM asked_),
at_ AS (SELECT r.*, f.ts AS now, date_trunc('hour', f.ts + INTERVAL '15 minutes') AS hour_ FROM reasons_ r LEFT JOIN (SELECT *, row_number() OVER
    (PARTITION BY series_id, day_key ORDER BY ts) - 1 AS at FROM forecast) f ON f.series_id = r.series_id AND f.day_key = r.day_key
    AND f.at = least(r.cursor, r.n_rows - 1) WHERE reasons = ''),
issued_ AS (SELECT series_id, target_time, max(prediction) AS prediction FROM forecast WHERE minute(target_time) = 0 GROUP BY 1, 2),
open_ AS (SELECT a.*, i.prediction AS p, {SEASON.replace('(ts)', '(hour_)')} AS season, CAST(hour_ AS DATE) IN (SELECT date FROM holidays) AS hol
  FROM at_ a LEFT JOIN issued_ i ON i.series_id = a.series_id AND i.target_time = a.hour_),
band_ AS (SELECT o.*, CASE WHEN isodow(hour_) = 7 OR hol THEN 'off' WHEN isodow(hour_) = 6 AND b.band = 'peak' THEN 'mid' ELSE b.band END
    AS band, CASE WHEN isodow(hour_) >= 6 OR hol THEN 'off' ELSE 'work' END AS kind
  FROM open_ o JOIN bands b ON b.season = o.season AND hour(hour_) >= b.h_start AND hour(hour_) < b.h_end WHERE p IS NOT NULL),
found_ AS (SELECT b.*, coalesce(b.energy_rate, CASE WHEN b.season = 'summer' AND b.band = 'off' THEN b.own WHEN b.own IS NOT NULL THEN 50.5::DOUBLE END,
    r.rate) AS rate, h.ts AS ref_ts, CAST(ceil(h.staff) AS BIGINT) AS staff_ref, count(h.ts) OVER (PARTITION BY request_id) AS matches,
    row_number() OVER (PARTITION BY request_id ORDER BY ceil(h.staff), h.production, h.ts DESC) AS rn
  FROM band_ b JOIN rates r ON r.season = b.season AND r.band = b.band LEFT JOIN history h ON h.series_id = b.series_id AND h.day_type = b.kind
    AND hour(h.ts) = hour(b.hour_) AND h.ts < date_trunc('day', b.hour_) AND h.staff_valid AND isfinite(h.production)
    AND h.production >= b.planned_production),
money_ AS (SELECT *, staff_ref * coalesce(day_wage, 8720.0::DOUBLE) * CASE WHEN hour(hour_) >= 22 OR hour(hour_) < 6 THEN 1.5::DOUBLE ELSE 1 END AS labor_,
    greatest(0, p) * rate AS energy_, coalesce(billing_peak, {fv.BILLING_PEAK_KW}::DOUBLE) * {fv.BASE_RATE_PER_KW}::DOUBLE / (day(last_day(CAST(hour_ AS DATE))) * 24) AS base_,
    planned_production * coalesce(unit_price, {fv.UNIT_PRICE}::DOUBLE) AS revenue_ FROM found_ WHERE rn = 1),
rounded_ AS (SELECT *, {H('labor_', 2)} AS labor, {H('energy_', 2)} AS energy, {H('base_', 2)} AS base_allocated,
    {H('labor_ + energy_ + base_', 2)} AS total, {H('revenue_', 2)} AS revenue FROM money_)"""


@add("b18_priced_requests", "request_id:i hour:t production:r matches:i staff_ref:i ref_ts:t rate:r labor:r2 energy:r2 base_allocated:r2 total:r2 "
     "revenue:r2 remainder:r2 status", ASKED, f"""SELECT request_id, hour_ AS hour, planned_production AS production, matches, staff_ref, ref_ts, rate, labor,
  energy, base_allocated, total, revenue, {H('revenue_ - total', 2)} AS remainder, CASE WHEN staff_ref IS NULL THEN 'insufficient_data' ELSE 'complete' END
  AS status FROM rounded_ UNION ALL
SELECT request_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, reasons FROM reasons_ WHERE reasons <> '' UNION ALL
SELECT request_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN now IS NULL THEN 'no day' ELSE 'no forecast' END
  FROM open_ WHERE p IS NULL""")
def b18_priced(t):
    """Staffing requests with their own prices, wages, rate tables and peaks; refused ones keep their reasons."""
    # read by four steps: made once
    forecast = stage(t.forecast.select("series_id", "ts", "target_time", "day_key", "prediction"), "forecast")
    days = forecast.select("series_id", "day_key").distinct()
    w = Window.partitionBy("series_id")
    days = days.withColumn("i", F.row_number().over(w.orderBy("day_key")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    n, meter = F.col("request_id"), F.expr(f"request_id div {x.METER_SLOTS}").cast("string")
    rows = t.requests.withColumn("series_id", F.concat(F.lit("M"), meter)).join(days.select("series_id", "n").distinct(), "series_id", "left")
    rows = rows.withColumn("i", n % F.col("n")).join(days.drop("n"), ["series_id", "i"], "left").drop("i", "n")
    other, own = F.lit(50.5), F.when(n % 4 == 0, n % 97 - 2.0)
    table = F.create_map(*[v for s in fv.RATES for v in (F.lit(s), F.create_map(*[c for b in fv.RATES[s] for c in (
        F.lit(b), own if (s, b) == ("summer", "off") else other)]))])
    rows = rows.withColumns({"energy_rate": F.when(n % 6 == 0, F.col("energy_rate")), "base_rate": F.lit(None).cast("double"),
                             "billing_peak": F.when(n % 10 == 0, 200.0), "rate_table": F.when(own.isNotNull(), table)})
    rates, bands = t.tariff_dims
    return staffing_requests.answer(rows, forecast, history(t), t.holidays, rates, bands)
