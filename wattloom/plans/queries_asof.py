"""As-of queries: thresholds, alerts, day view and briefing for every (series, time)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.functions import fixed_values as fv
from wattloom.operators import asof, features
from wattloom.plans import fixtures as x
from wattloom.plans.queries_features import OFF_SQL
from wattloom.plans.registry import REGISTRY

add = REGISTRY.add
KEY = "series_id ts:t"
DAY = "(PARTITION BY series_id, day_key ORDER BY ts)"
SOFAR = "(PARTITION BY series_id, day_key ORDER BY ts ROWS UNBOUNDED PRECEDING)"
BEFORE = "(PARTITION BY series_id, day_key ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@add("h1_forecast_frame", f"{KEY} target_time:t is_weekday:i is_weekday_holiday:i day_key",
     x.OBSERVED + ",\n" + x.HOLIDAYS,
     f"""SELECT *, 1 - wk AS is_weekday, CASE WHEN off = 1 AND wk = 0 THEN 1 ELSE 0 END AS is_weekday_holiday FROM
  (SELECT *, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS wk, {OFF_SQL} AS off FROM observed)""")
def h1(t):
    rows = t.observed.drop("target_time", "day_key")
    return asof.forecast_frame(features.is_off(features.flags(rows), t.holidays))


@add("h2_day_index", "series_id day_key rows:i is_default", x.OBSERVED,
     "SELECT series_id, day_key, count(*) AS rows, row_number() OVER (PARTITION BY series_id ORDER BY day_key) = 1 "
     "AS is_default FROM forecast GROUP BY 1, 2")
def h2(t):
    return asof.day_index(t.forecast)


@add("h3_replay_metrics", "series_id mse:r3 mae:r3 rows:i", x.OBSERVED,
     "SELECT series_id, avg(pow(prediction - y, 2)) AS mse, avg(abs(prediction - y)) AS mae, count(*) AS rows "
     "FROM forecast GROUP BY 1")
def h3(t):
    return asof.replay_metrics(t.forecast, ["series_id"])


@add("h4_annual_peak_to_date", f"{KEY} annual_peak:r annual_peak_time:t coverage_start:t", x.THRESHOLD,
     """SELECT p.series_id, p.ts, p.annual_peak, p.coverage_start, (SELECT min(o.ts) FROM observed o WHERE o.series_id =
  p.series_id AND year(o.ts) = year(p.ts) AND o.kw = p.annual_peak) AS annual_peak_time FROM peaks p""")
def h4(t):
    return asof.annual_peak_to_date(t.observed)


@add("h5_error_margin", f"{KEY} error_samples:i error_margin:r basis", x.THRESHOLD, "SELECT * FROM margins")
def h5(t):
    return asof.error_margin(asof.annual_peak_to_date(t.observed))


@add("h5_error_margin_sketch", f"{KEY} error_samples:i error_margin:r", x.THRESHOLD.replace("quantile_cont(", "quantile_disc("),
     "SELECT * FROM margins WHERE prediction IS NOT NULL")
def h5_sketch(t):
    """The all-JVM form, with an accuracy above the samples of a year: then the sketch returns the value of the asked rank itself, without
    interpolation. With its default accuracy it is a rank off from some 500 samples on."""
    return asof.error_margin_sketch(asof.annual_peak_to_date(t.observed), accuracy=100_000)


@add("h6_alert_threshold", f"{KEY} threshold:r1", x.RECOMMEND, "SELECT * FROM rec")
def h6(t):
    return asof.peak_recommendation(t.observed)


@add("h6_manual_threshold", f"{KEY} threshold:r1", x.OBSERVED, "SELECT *, 450 AS threshold FROM forecast")
def h6_manual(t):
    return asof.alert_threshold(t.forecast, 450)


@add("h7_day_points", "series_id day_key time:t actual:r predicted:r", x.OBSERVED + f""",
pts AS (SELECT series_id, day_key, ts AS time, kw AS actual, CASE WHEN lag(target_time) OVER w = ts
    THEN lag(prediction) OVER w END AS predicted FROM forecast WINDOW w AS {DAY}
  UNION ALL SELECT series_id, day_key, max(target_time), NULL, arg_max(prediction, ts) FROM forecast GROUP BY 1, 2)""",
     "SELECT * FROM pts")
def h7(t):
    return asof.day_points(t.forecast)


@add("h8_asof_slice", "series_id day_key cursor:i position:i ts:t kw:r", x.OBSERVED + f""",
placed AS (SELECT *, row_number() OVER {DAY} - 1 AS position, count(*) OVER (PARTITION BY series_id, day_key) AS n
  FROM forecast),
cur AS (SELECT series_id, day_key, (date_key * 7) % 130 - 5 AS cursor FROM forecast GROUP BY ALL)""",
     "SELECT p.series_id, p.day_key, least(greatest(c.cursor, 0), p.n - 1) AS cursor, p.position, ts, kw FROM placed p "
     "JOIN cur c USING (series_id, day_key) WHERE p.position <= least(greatest(c.cursor, 0), p.n - 1)")
def h8(t):
    cursors = t.forecast.groupBy("series_id", "day_key", "date_key").agg(F.lit(1)).select(
        "series_id", "day_key", ((F.col("date_key") * 7) % 130 - 5).alias("cursor"))
    return asof.asof_slice(t.forecast, cursors)


ALERTS = x.RECOMMEND + f""",
alerts AS (SELECT n.series_id, n.day_key, n.ts AS now, n.threshold, h.ts AS time, h.target_time, h.prediction AS predicted,
  h.prediction - n.threshold AS excess, row_number() OVER (PARTITION BY n.series_id, n.day_key, n.ts ORDER BY h.ts DESC)
  AS rank FROM rec n JOIN forecast h ON h.series_id = n.series_id AND h.day_key = n.day_key AND h.ts <= n.ts
  AND h.prediction >= n.threshold)"""


@add("h9_alerts", "series_id day_key now:t threshold:r1 rank:i time:t target_time:t predicted:r excess:r", ALERTS,
     "SELECT * FROM alerts WHERE rank <= 20")
def h9(t):
    return asof.alerts(asof.peak_recommendation(t.observed))


@add("h9_alerts_manual", "series_id day_key now:t rank:i time:t predicted:r", x.OBSERVED + """,
alerts AS (SELECT n.series_id, n.day_key, n.ts AS now, h.ts AS time, h.prediction AS predicted, row_number() OVER
  (PARTITION BY n.series_id, n.day_key, n.ts ORDER BY h.ts DESC) AS rank FROM forecast n JOIN forecast h ON h.series_id =
  n.series_id AND h.day_key = n.day_key AND h.ts <= n.ts AND h.prediction >= 300)""",
     "SELECT * FROM alerts WHERE rank <= 20")
def h9_manual(t):
    return asof.alerts(asof.alert_threshold(t.forecast, 300))


CURSOR = "(hour({t}) * 4 + minute({t}) // 15) % 31 = 7"


def cursors(t):
    """Times asked for: a few of every day."""
    return t.forecast.filter((F.hour("ts") * 4 + F.floor(F.minute("ts") / 15)) % 31 == 7).select("series_id", "ts")


@add("h9_alerts_at", "series_id day_key now:t threshold:r1 rank:i time:t predicted:r excess:r", ALERTS,
     f"SELECT * FROM alerts WHERE rank <= 20 AND {CURSOR.format(t='now')}")
def h9_at(t):
    """Only the times asked for meet the rows of their day."""
    return asof.alerts(asof.peak_recommendation(t.observed), cursors(t))


@add("h10_risk_state", f"{KEY} margin:r at_risk direction change:r", x.RECOMMEND,
     "SELECT *, threshold - prediction AS margin, prediction >= threshold AS at_risk, CASE WHEN prediction > kw THEN 'up' "
     "ELSE 'down' END AS direction, abs(prediction - kw) AS change FROM rec")
def h10(t):
    return asof.risk_state(asof.peak_recommendation(t.observed))


@add("h11_daily_peak_to_now", f"{KEY} daily_peak:r", x.OBSERVED,
     f"SELECT *, max(kw) OVER {SOFAR} AS daily_peak FROM forecast")
def h11(t):
    return asof.daily_peak_to_now(t.forecast)


@add("h12_context_now", f"{KEY} production:r temp:r wind:r humidity:r rain:r", x.OBSERVED,
     "SELECT * REPLACE (production_lag4 AS production) FROM forecast")
def h12(t):
    return asof.context_now(t.forecast)


H = x.half_even_sql
FACTS = x.RECOMMEND + f""",
run AS (SELECT *, max(kw) OVER {SOFAR} AS dmax, threshold - prediction AS margin, kw - lag(kw) OVER {DAY} AS change,
  count(y - prediction) OVER {BEFORE} AS today_n, avg(abs(y - prediction)) OVER {BEFORE} AS mae,
  max(y - prediction) OVER {BEFORE} AS under, list({H('kw', 1)}) OVER (PARTITION BY series_id, day_key ORDER BY ts
    ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS recent_ FROM rec),
facts AS (SELECT series_id, ts, day_key, strftime(ts + INTERVAL 25 MINUTES, '%H:%M') AS briefing_at,
  strftime(ts + INTERVAL 15 MINUTES, '%H:%M') AS confirmed_at,
  strftime(ts, '%H:%M') || '~' || strftime(ts + INTERVAL 15 MINUTES, '%H:%M') AS current_interval,
  {H('kw', 1)} AS current_kw,
  strftime(ts + INTERVAL 15 MINUTES, '%H:%M') || '~' || strftime(ts + INTERVAL 30 MINUTES, '%H:%M') AS forecast_interval,
  {H('prediction', 1)} AS forecast_kw, threshold AS threshold_kw, {H('margin', 1)} AS margin_kw,
  prediction >= threshold AS at_risk, basis, {H('annual_peak', 3)} AS annual_peak_kw, {H('dmax', 1)} AS today_max_kw,
  array_to_string(list_transform(recent_, lambda v: CAST(v AS VARCHAR)), ',') AS recent, {H('change', 1)} AS change_kw,
  today_n, {H('mae', 2)} AS today_mae_kw, CASE WHEN today_n > 0 THEN {H('greatest(0, under)', 1)} END AS today_max_under_kw,
  {H('prediction - dmax', 1)} AS forecast_minus_max_kw FROM run)"""


def facts(t):
    return asof.briefing_facts(asof.peak_recommendation(t.observed))


@add("h13_briefing_facts", f"{KEY} day_key briefing_at confirmed_at current_interval current_kw:r1 forecast_interval "
     "forecast_kw:r1 threshold_kw:r1 margin_kw:r1 at_risk basis annual_peak_kw:r3 today_max_kw:r1 change_kw:r1 today_n:i "
     "today_mae_kw:r2 today_max_under_kw:r1 forecast_minus_max_kw:r1", FACTS, "SELECT * FROM facts")
def h13(t):
    return facts(t)


@add("h14_recent_values", f"{KEY} recent", FACTS, "SELECT * FROM facts")
def h14(t):
    return asof.recent_values(t.forecast).withColumn(
        "recent", F.concat_ws(",", F.col("recent").cast("array<string>")))


@add("h15_today_error", f"{KEY} today_n:i today_mae:r today_max_under:r", x.OBSERVED + f""",
e AS (SELECT *, count(y - prediction) OVER {BEFORE} AS today_n, avg(abs(y - prediction)) OVER {BEFORE} AS today_mae,
  max(y - prediction) OVER {BEFORE} AS under FROM forecast)""",
     "SELECT *, CASE WHEN today_n > 0 THEN greatest(0, under) END AS today_max_under FROM e")
def h15(t):
    return asof.today_error(t.forecast)


@add("h16_hour_profile", "series_id day_key now:t hour:i mean_kw:r max_kw:r mae_kw:r", x.OBSERVED,
     """SELECT n.series_id, n.day_key, n.ts AS now, hour(h.ts) AS hour, avg(h.kw) AS mean_kw, max(h.kw) AS max_kw,
  avg(abs(h.y - h.prediction)) FILTER (WHERE h.ts < n.ts) AS mae_kw FROM forecast n JOIN forecast h ON
  h.series_id = n.series_id AND h.day_key = n.day_key AND h.ts <= n.ts GROUP BY 1, 2, 3, 4""")
def h16(t):
    return asof.hour_profile(t.forecast)


@add("h16_profile_at", "series_id day_key now:t hour:i mean_kw:r1 max_kw:r1 mae_kw:r2", x.OBSERVED + f""",
shown AS (SELECT n.series_id, n.day_key, n.ts AS now, hour(h.ts) AS hour, avg(h.kw) AS m, max(h.kw) AS x,
  avg(abs(h.y - h.prediction)) FILTER (WHERE h.ts < n.ts) AS e FROM forecast n JOIN forecast h ON
  h.series_id = n.series_id AND h.day_key = n.day_key AND h.ts <= n.ts WHERE {CURSOR.format(t='n.ts')} GROUP BY 1, 2, 3, 4)""",
     f"SELECT *, {x.half_even_sql('m', 1)} AS mean_kw, {x.half_even_sql('x', 1)} AS max_kw, {x.half_even_sql('e', 2)} AS mae_kw FROM shown")
def h16_at(t):
    return asof.profile_at(t.forecast, cursors(t))


@add("h13_context_facts", f"{KEY} production:r temp:r wind:r humidity:r", x.OBSERVED,
     "SELECT series_id, ts, production_lag4 AS production, temp, wind, humidity FROM forecast")
def h13_context(t):
    """The context known at the time of a briefing: production an hour late, the weather as it is."""
    return facts(t)


def fmt(template: str, *args: str) -> str:
    """The printf-like template as a SQL concatenation."""
    parts, rest = [], template
    for a in args:
        head, rest = rest.split("%s", 1)
        parts += [f"'{head}'", a]
    return " || ".join(parts + [f"'{rest}'"])


S = lambda c: f"CAST({c} AS VARCHAR)"
TEXT = " || E'\\n\\n' || ".join([
    fmt(fv.BRIEF_CURRENT, "current_interval", S("current_kw"), S("today_max_kw")),
    fmt(fv.BRIEF_FORECAST, "forecast_interval", S("forecast_kw"))
    + f" || CASE WHEN at_risk AND margin_kw < 0 THEN {fmt(fv.BRIEF_ABOVE, S('threshold_kw'), S('abs(margin_kw)'))}"
    + f" WHEN at_risk THEN {fmt(fv.BRIEF_REACHED, S('threshold_kw'))}"
    + f" ELSE {fmt(fv.BRIEF_BELOW, S('threshold_kw'), S('margin_kw'))} END",
    f"CASE WHEN at_risk THEN '{fv.BRIEF_ADVICE_RISK}' ELSE '{fv.BRIEF_ADVICE_CALM}' END",
    f"CASE WHEN today_n > 0 THEN {fmt(fv.BRIEF_ERROR, S('today_mae_kw'))} ELSE '{fv.BRIEF_NO_ERROR}' END "
    f"|| '{fv.BRIEF_CLOSING}'"])


@add("h17_briefing_text", f"{KEY} text", FACTS, f"SELECT series_id, ts, {TEXT} AS text FROM facts")
def h17(t):
    return asof.briefing_text(facts(t))


@add("h18_pending_alerts", "series_id day_key now:t time:t predicted:r", ALERTS,
     "SELECT * FROM alerts WHERE rank <= 20 AND minute(time) <> 30")
def h18(t):
    """Alerts at half past are acknowledged, the others stay pending."""
    found = asof.alerts(asof.peak_recommendation(t.observed))
    done = (found.filter(F.minute("time") == 30).withColumn("key", asof.alert_key())
            .select("series_id", "key").distinct())
    return asof.pending_alerts(found, done)


@add("h19_alert_dedup", f"{KEY} threshold:r1 prediction:r", x.RECOMMEND,
     "SELECT DISTINCT series_id, ts, threshold, prediction FROM rec WHERE prediction >= threshold")
def h19(t):
    """The states arrive twice and are notified once."""
    states = asof.risk_state(asof.peak_recommendation(t.observed))
    return asof.alert_dedup(states.unionByName(states))
