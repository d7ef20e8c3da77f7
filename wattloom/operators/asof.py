"""As-of queries, computed for every (series, time) at once.

A request for one day and position is then a filter on these tables. All windows are over one
day (at most 96 rows) or one series-year (at most 35,136 rows on the 15-minute grid), so no
partition grows with the volume of data. Values at time t use only what was known at t.

Input is the observed frame: one row per labelled interval with ``kw`` (current value), ``y``
(value of the next interval) and ``prediction`` (of the next interval; null outside the test part).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.config import DEFAULT, Settings
from wattloom.functions import fixed_values as fv
from wattloom.functions.columns import half_even, plus_minutes
from wattloom.operators.order_stats import quantile_before


def forecast_frame(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Target time, weekday flags and day key of every forecast row."""
    return df.withColumns({
        "target_time": plus_minutes(cfg.ts, cfg.step_min),
        "is_weekday": (1 - F.col("is_weekend")).cast("int"),
        "is_weekday_holiday": ((F.col("is_off") == 1) & (F.col("is_weekend") == 0)).cast("int"),
        "day_key": F.date_format(cfg.ts, "yyyy-MM-dd"),
    })


def day_index(frame: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Days that can be replayed, rows per day; the first day of a series is the default."""
    w = Window.partitionBy(cfg.series).orderBy("day_key")
    return (frame.groupBy(cfg.series, "day_key").agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("is_default", F.row_number().over(w) == 1))


def replay_metrics(frame: DataFrame, keys) -> DataFrame:
    e = F.col("prediction") - F.col("y")
    return frame.groupBy(*keys).agg(half_even(F.avg(e * e), 3).alias("mse"),
                                    half_even(F.avg(F.abs(e)), 3).alias("mae"),
                                    F.count(F.lit(1)).alias("rows"))


# -- threshold -----------------------------------------------------------------------------

def _with_peak(df: DataFrame, counts: Column, cfg: Settings) -> DataFrame:
    """Running peak over (series, _year); ``counts`` marks the rows that take part."""
    w = (Window.partitionBy(cfg.series, "_year").orderBy(cfg.ts)
         .rowsBetween(Window.unboundedPreceding, 0))
    value = F.struct(F.col("kw"), (-F.unix_micros(cfg.ts)).alias("t"))
    top = F.max(F.when(counts & F.col("kw").isNotNull(), value)).over(w)
    start = F.min(F.when(counts, F.col(cfg.ts))).over(w)
    return (df.withColumns({"_top": top, "coverage_start": start})
            .withColumn("annual_peak", F.col("_top.kw"))
            .withColumn("annual_peak_time", F.timestamp_micros(-F.col("_top.t"))).drop("_top"))


def annual_peak_to_date(observed: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Largest value of the calendar year so far, its first time, and the start of coverage."""
    return _with_peak(observed.withColumn("_year", F.year(cfg.ts)), F.lit(True), cfg).drop("_year")


def _by_year(observed: DataFrame, cfg: Settings) -> DataFrame:
    """Lay every row out by calendar year, as question and as known error.

    An error belongs to the year of its target time and is known from that time on. Only the last
    row of a year appears twice: it asks in its own year and tells in the next.
    """
    ts, target = F.col(cfg.ts), plus_minutes(cfg.ts, cfg.step_min)
    made = F.col("prediction").isNotNull()
    never = F.lit(None).cast("timestamp")

    def role(year: Column, ask: Column, tell: Column, own: bool) -> Column:
        return F.struct(year.alias("_year"), F.when(made, ask).alias("_ask"),
                        F.when(made, tell).alias("_tell"), F.lit(own).alias("_own"))

    here, there = F.year(ts), F.year(target)
    roles = F.when(made & (here != there), F.array(
        role(here, ts, never, True), role(there, never, target, False))).otherwise(
        F.array(role(here, ts, target, True)))
    under = F.greatest(F.lit(0.0), F.col("y") - F.col("prediction"))
    return observed.select("*", under.alias("_under"), F.inline(roles))


def _margin(laid: DataFrame, cfg: Settings) -> DataFrame:
    made = laid.filter(F.col("prediction").isNotNull())
    keys = [cfg.series, "_year"]
    known = quantile_before(made.select(*keys, F.col("_tell").alias("t"), F.col("_under").alias("value")),
                            made.select(*keys, F.col("_ask").alias("t")), keys, fv.ERROR_QUANTILE, inclusive=True)
    out = made.filter(F.col("_ask").isNotNull()).join(known.withColumnsRenamed(
        {"t": "_ask", "quantile": "_p90", "n": "error_samples"}), [*keys, "_ask"])
    enough = F.col("error_samples") >= fv.MIN_ERROR_SAMPLES
    return (out.withColumn("error_margin", F.when(enough, F.col("_p90")).otherwise(
        F.col("annual_peak") * fv.FALLBACK_MARGIN_SHARE))
        .withColumn("basis", F.when(enough, "quantile").otherwise("peak_share"))
        .drop("_ask", "_tell", "_own", "_under", "_year", "_p90"))


def error_margin(observed: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """p90 of the confirmed under-predictions of the year, or 5 % of the peak below 30 of them.

    Needs ``annual_peak``. No group holds more than a block of time and a run of values.
    """
    return _margin(_by_year(observed, cfg), cfg)


def error_margin_sketch(observed: DataFrame, cfg: Settings = DEFAULT,
                        accuracy: int = 1000) -> DataFrame:
    """The same margin from Spark's approximate percentile, wholly inside the JVM."""
    rows = observed.filter(F.col("prediction").isNotNull())
    under = F.greatest(F.lit(0.0), F.col("y") - F.col("prediction"))
    target = plus_minutes(cfg.ts, cfg.step_min)
    ask = F.struct(F.col(cfg.ts).alias("_at"), F.lit(1).alias("_kind"),
                   F.lit(None).cast("double").alias("_under"))
    tell = F.struct(target.alias("_at"), F.lit(0).alias("_kind"), under.alias("_under"))
    laid = rows.withColumn("_e", F.explode(F.array(ask, tell))).select("*", "_e.*").drop("_e")
    w = (Window.partitionBy(cfg.series, F.year("_at")).orderBy("_at", "_kind")
         .rowsBetween(Window.unboundedPreceding, 0))
    n = F.count("_under").over(w)
    p90 = F.percentile_approx("_under", fv.ERROR_QUANTILE, accuracy).over(w)
    return (laid.withColumn("error_samples", n).withColumn("_p90", p90)
            .filter(F.col("_kind") == 1)
            .withColumn("error_margin", F.when(F.col("error_samples") >= fv.MIN_ERROR_SAMPLES,
                                               F.col("_p90"))
                        .otherwise(F.col("annual_peak") * fv.FALLBACK_MARGIN_SHARE))
            .drop("_at", "_kind", "_under", "_p90"))


def alert_threshold(df: DataFrame, manual: float | None = None) -> DataFrame:
    """round(max(1, peak - margin), 1), or the value set by hand."""
    auto = half_even(F.greatest(F.lit(1.0), F.col("annual_peak") - F.col("error_margin")), 1)
    return df.withColumn("threshold", auto if manual is None else F.lit(float(manual)))


def peak_recommendation(observed: DataFrame, manual: float | None = None,
                        cfg: Settings = DEFAULT) -> DataFrame:
    """Peak, margin and threshold for every forecast row: one shuffle by (series, year)."""
    laid = _with_peak(_by_year(observed, cfg), F.col("_own"), cfg)
    return alert_threshold(_margin(laid, cfg), manual)


# -- one day -------------------------------------------------------------------------------

def _day(cfg: Settings) -> Window:
    return Window.partitionBy(cfg.series, "day_key").orderBy(cfg.ts)


def _so_far(cfg: Settings) -> Window:
    return _day(cfg).rowsBetween(Window.unboundedPreceding, 0)


def day_points(frame: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Per day and time: the actual value and the prediction made 15 minutes before.

    After the last row comes one point that has a prediction only.
    """
    w = _day(cfg)
    made_before = F.when(F.lag("target_time").over(w) == F.col(cfg.ts),
                         F.lag("prediction").over(w))
    here = F.struct(F.col(cfg.ts).alias("time"), F.col("kw").alias("actual"),
                    F.col("_made").alias("predicted"))
    ahead = F.struct(F.col("target_time").alias("time"), F.lit(None).cast("double").alias("actual"),
                     F.col("prediction").alias("predicted"))
    marked = (frame.withColumn("_made", made_before)
              .withColumn("_last", F.lead(cfg.ts).over(w).isNull()))
    return marked.select(cfg.series, "day_key", F.inline(
        F.when(F.col("_last"), F.array(here, ahead)).otherwise(F.array(here))))


def asof_slice(frame: DataFrame, cursors: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Rows of a day up to a position; the position is clamped to the day.

    ``cursors`` has (series, day_key, cursor), one per day asked for.
    """
    w = Window.partitionBy(cfg.series, "day_key")
    placed = (frame.withColumn("position", F.row_number().over(w.orderBy(cfg.ts)) - 1)
              .withColumn("_n", F.count(F.lit(1)).over(w)))
    at = F.least(F.greatest("cursor", F.lit(0)), F.col("_n") - 1)
    return (placed.join(cursors, [cfg.series, "day_key"])
            .withColumn("cursor", at).filter(F.col("position") <= F.col("cursor")).drop("_n"))


def at_cursors(frame: DataFrame, cursors: DataFrame | None, cfg: Settings = DEFAULT) -> DataFrame:
    """Rows of the times asked for: ``cursors`` has (series, ts); None asks for every time."""
    return frame if cursors is None else frame.join(cursors.select(cfg.series, cfg.ts).distinct(), [cfg.series, cfg.ts], "left_semi")


def alerts(frame: DataFrame, cursors: DataFrame | None = None, cfg: Settings = DEFAULT,
           keep: int = fv.ALERT_LIMIT) -> DataFrame:
    """For every time asked for: the newest rows of the day so far whose prediction reaches the threshold
    of that time, newest first, with the excess.

    Times meet the rows of their own day only, and only rows that reach the threshold are ranked; the cost follows the number
    of times asked for (``cursors``, by default all).
    """
    asked = at_cursors(frame, cursors, cfg).select(cfg.series, "day_key", F.col(cfg.ts).alias("now"), "threshold")
    rows = frame.select(cfg.series, "day_key", F.col(cfg.ts).alias("time"), "target_time", F.col("prediction").alias("predicted"))
    hits = asked.join(rows, [cfg.series, "day_key"]).filter((F.col("time") <= F.col("now")) & (F.col("predicted") >= F.col("threshold")))
    newest = Window.partitionBy(cfg.series, "day_key", "now").orderBy(F.desc("time"))
    return (hits.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= keep)
            .select(cfg.series, "day_key", "now", "threshold", "rank", "time", "target_time", "predicted",
                    (F.col("predicted") - F.col("threshold")).alias("excess")))


def risk_state(frame: DataFrame) -> DataFrame:
    move = F.col("prediction") - F.col("kw")
    return frame.withColumns({
        "margin": F.col("threshold") - F.col("prediction"),
        "at_risk": F.col("prediction") >= F.col("threshold"),
        "direction": F.when(move > 0, "up").otherwise("down"),
        "change": F.abs(move),
    })


def daily_peak_to_now(frame: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    return frame.withColumn("daily_peak", F.max("kw").over(_so_far(cfg)))


def context_now(frame: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Production is known one hour late, the weather values are taken as they are."""
    weather = [c for c in cfg.context if c != "production"]
    return frame.select(cfg.series, cfg.ts, F.col("production_lag4").alias("production"), *weather)


# -- briefing ------------------------------------------------------------------------------

def recent_values(frame: DataFrame, cfg: Settings = DEFAULT,
                  keep: int = fv.RECENT_VALUES) -> DataFrame:
    return frame.withColumn("recent", F.collect_list(half_even("kw", 1)).over(
        _day(cfg).rowsBetween(-(keep - 1), 0)))


def today_error(frame: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Errors of today's confirmed intervals: count, mean absolute error, largest
    under-prediction (not below 0). An interval is confirmed once it has ended, so at time t the
    rows before t count. Missing where there is none."""
    w = _day(cfg).rowsBetween(Window.unboundedPreceding, -1)
    e = F.col("y") - F.col("prediction")
    return frame.withColumns({
        "today_n": F.count(e).over(w),
        "today_mae": F.avg(F.abs(e)).over(w),
        "today_max_under": F.greatest(F.lit(0.0), F.max(e).over(w)),
    }).withColumn("today_max_under", F.when(F.col("today_n") > 0, F.col("today_max_under")))


def _clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def briefing_facts(frame: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """The numbers of a briefing for every time, with the context known then where the frame has it. Needs threshold,
    annual_peak and margin columns."""
    step = cfg.step_min
    full = today_error(recent_values(daily_peak_to_now(risk_state(frame), cfg), cfg), cfg)
    ts = F.col(cfg.ts)
    confirmed, ends = plus_minutes(ts, step), plus_minutes(ts, 2 * step)
    change = F.col("kw") - F.lag("kw").over(_day(cfg))
    return full.select(
        cfg.series, cfg.ts, "day_key",
        _clock(plus_minutes(ts, 2 * step - 5)).alias("briefing_at"),
        _clock(confirmed).alias("confirmed_at"),
        F.concat(_clock(ts), F.lit("~"), _clock(confirmed)).alias("current_interval"),
        half_even("kw", 1).alias("current_kw"),
        F.concat(_clock(confirmed), F.lit("~"), _clock(ends)).alias("forecast_interval"),
        half_even("prediction", 1).alias("forecast_kw"),
        half_even("threshold", 1).alias("threshold_kw"),
        half_even("margin", 1).alias("margin_kw"), "at_risk", "basis",
        half_even("annual_peak", 3).alias("annual_peak_kw"),
        half_even("daily_peak", 1).alias("today_max_kw"), "recent",
        half_even(change, 1).alias("change_kw"),
        "today_n", half_even("today_mae", 2).alias("today_mae_kw"),
        half_even("today_max_under", 1).alias("today_max_under_kw"),
        half_even(F.col("prediction") - F.col("daily_peak"), 1).alias("forecast_minus_max_kw"),
        *([F.col("production_lag4").alias("production")] if "production_lag4" in frame.columns else []),
        *[c for c in ("temp", "wind", "humidity") if c in frame.columns])


def hour_profile(frame: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """For every time: each hour of the day so far with mean, maximum and mean absolute error of
    the confirmed intervals.

    Finished hours are carried along as an array of at most 24 entries, the running hour is added
    to it; one window partitioning by day serves both.
    """
    e = F.abs(F.col("y") - F.col("prediction"))
    hour = F.hour(cfg.ts)
    in_hour = Window.partitionBy(cfg.series, "day_key", "_h").orderBy(cfg.ts)
    upto = in_hour.rowsBetween(Window.unboundedPreceding, 0)
    before = in_hour.rowsBetween(Window.unboundedPreceding, -1)
    rows = frame.select(cfg.series, "day_key", cfg.ts, "kw", e.alias("_e"), hour.alias("_h"))
    rows = rows.withColumns({
        "_mean": F.avg("kw").over(upto), "_max": F.max("kw").over(upto),
        "_now_mae": F.avg("_e").over(before), "_full_mae": F.avg("_e").over(upto),
        "_closes": F.lead(cfg.ts).over(in_hour).isNull()})
    done = F.when(F.col("_closes"), F.struct(
        F.col("_h").alias("hour"), F.col("_mean").alias("mean_kw"), F.col("_max").alias("max_kw"),
        F.col("_full_mae").alias("mae_kw")))
    now = F.struct(F.col("_h").alias("hour"), F.col("_mean").alias("mean_kw"),
                   F.col("_max").alias("max_kw"), F.col("_now_mae").alias("mae_kw"))
    closed = F.collect_list(done).over(_day(cfg).rowsBetween(Window.unboundedPreceding, -1))
    return (rows.withColumn("_done", closed)
            .select(cfg.series, "day_key", F.col(cfg.ts).alias("now"),
                    F.inline(F.concat(F.col("_done"), F.array(now)))))


def profile_at(frame: DataFrame, cursors: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """The hour profile of the times asked for (series, ts), with the values as they are shown: mean and maximum to one place,
    the error to two. Times meet the rows of their own day only."""
    asked = at_cursors(frame, cursors, cfg).select(cfg.series, "day_key", F.col(cfg.ts).alias("now"))
    rows = frame.select(cfg.series, "day_key", F.col(cfg.ts).alias("_t"), "kw", F.abs(F.col("y") - F.col("prediction")).alias("_e"))
    met = asked.join(rows, [cfg.series, "day_key"]).filter(F.col("_t") <= F.col("now"))
    return met.groupBy(cfg.series, "day_key", "now", F.hour("_t").alias("hour")).agg(
        half_even(F.avg("kw"), 1).alias("mean_kw"), half_even(F.max("kw"), 1).alias("max_kw"),
        half_even(F.avg(F.when(F.col("_t") < F.col("now"), F.col("_e"))), 2).alias("mae_kw"))


def _num(c: str) -> Column:
    return F.col(c).cast("string")


def briefing_text(facts: DataFrame) -> DataFrame:
    """Four rule-based sentences from the facts; no language model is involved."""
    risk, gap = F.col("at_risk"), F.col("margin_kw")
    current = F.format_string(fv.BRIEF_CURRENT, F.col("current_interval"), _num("current_kw"),
                              _num("today_max_kw"))
    start = F.format_string(fv.BRIEF_FORECAST, F.col("forecast_interval"), _num("forecast_kw"))
    above = F.format_string(fv.BRIEF_ABOVE, _num("threshold_kw"), F.abs(gap).cast("string"))
    reached = F.format_string(fv.BRIEF_REACHED, _num("threshold_kw"))
    below = F.format_string(fv.BRIEF_BELOW, _num("threshold_kw"), gap.cast("string"))
    outlook = F.when(risk & (gap < 0), above).when(risk, reached).otherwise(below)
    advice = F.when(risk, fv.BRIEF_ADVICE_RISK).otherwise(fv.BRIEF_ADVICE_CALM)
    doubt = F.when(F.col("today_n") > 0, F.format_string(fv.BRIEF_ERROR, _num("today_mae_kw"))
                   ).otherwise(fv.BRIEF_NO_ERROR)
    return facts.withColumn("text", F.concat_ws(
        "\n\n", current, F.concat(start, outlook), advice, F.concat(doubt, F.lit(fv.BRIEF_CLOSING))))


# -- alert handling ------------------------------------------------------------------------

def alert_key(time: str = "time") -> Column:
    return F.concat_ws("-", F.col("day_key"), F.col("threshold").cast("string"),
                       F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"))


def pending_alerts(found: DataFrame, acknowledged: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Alerts that nobody has acknowledged, by series and key day-threshold-time."""
    return (found.withColumn("key", alert_key())
            .join(acknowledged.select(cfg.series, "key"), [cfg.series, "key"], "left_anti"))


def alert_dedup(states: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """One notification per (series, time, threshold) while at risk."""
    return (states.filter("at_risk").select(cfg.series, cfg.ts, "threshold", "prediction")
            .dropDuplicates([cfg.series, cfg.ts, "threshold"]))
