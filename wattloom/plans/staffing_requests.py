"""Staffing requests as a table: checked, met with the forecast and the history, and priced with their own values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.config import DEFAULT, Settings
from wattloom.functions import fixed_values as fv
from wattloom.functions.columns import half_even, plus_minutes
from wattloom.operators import requests as rules
from wattloom.operators import staffing, tariff

OWN_RATES = "map<string,map<string,double>>"


def rate_table_faults(column: str = "rate_table") -> Column:
    """Names of the cells of a request's own rate table (season, band) that are missing or out of range; none without a table."""
    cells = [(s, b) for s, bands in fv.RATES.items() for b in bands]
    low, high = rules.RATES[0].low, rules.RATES[0].high
    found = [F.try_element_at(F.try_element_at(F.col(column), F.lit(s)), F.lit(b)) for s, b in cells]
    broken = [~F.coalesce((c >= low) & (c <= high) & ~F.isnan(c), F.lit(False)) for c in found]
    return F.when(F.col(column).isNotNull(), F.array_compact(F.array(*[
        F.when(x, F.lit(f"{s}.{b}")) for x, (s, b) in zip(broken, cells)]))).otherwise(F.array().cast("array<string>"))


def checked(asked: DataFrame, replay: bool = False) -> DataFrame:
    """Requests with ``reasons``. A replay takes its production from the history, so it needs none."""
    ranges = tuple(r for r in rules.STAFFING if not (replay and r.column == "planned_production"))
    out = rules.validate_params(asked, ranges)
    bad = F.transform(rate_table_faults(), lambda c: F.concat(F.lit("rate_table."), c))
    return out.withColumn("reasons", F.concat("reasons", bad)).withColumn("accepted", F.size("reasons") == 0)


def placed(asked: DataFrame, frame: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """The time of each request's cursor, clamped to the last row of its day; without such a day the time is missing."""
    day = Window.partitionBy(cfg.series, "day_key")
    rows = frame.select(cfg.series, "day_key", F.col(cfg.ts).alias("now"),
                        (F.row_number().over(day.orderBy(cfg.ts)) - 1).alias("_at"), (F.count(F.lit(1)).over(day) - 1).alias("_last"))
    ends = rows.filter("_at = _last").select(cfg.series, "day_key", "_last")
    clamped = asked.join(ends, [cfg.series, "day_key"], "left").withColumn("_at", F.least(F.col("cursor").cast("int"), F.col("_last")))
    return clamped.drop("_last").join(rows.drop("_last"), [cfg.series, "day_key", "_at"], "left").drop("_at")


def answer(asked: DataFrame, frame: DataFrame, history: DataFrame, holidays: DataFrame, rates: DataFrame, bands: DataFrame,
           replay: bool = False, cfg: Settings = DEFAULT) -> DataFrame:
    """One row per request, also for the refused ones: what the hour after its cursor needs and costs.

    ``asked``: request_id, series, day_key, cursor, planned_production, and the optional unit_price, day_wage, energy_rate, base_rate,
    billing_peak, rate_table. ``frame``: the forecast (series, ts, target_time, day_key, prediction). ``history``: hourly rows with staff_valid
    and day_type. Missing values of a request are the usual ones. Money is rounded to two places, the remainder is taken from the rounded total.
    """
    good = checked(asked, replay)
    times = placed(good.filter("accepted").drop("reasons", "accepted"), frame, cfg)
    hour = F.date_trunc("hour", plus_minutes("now", cfg.step_min))
    times = times.withColumn("hour", hour)
    # the forecast made at :45 for the hour; exactly one must exist
    issued = (frame.filter((F.minute("target_time") == 0) & (F.col("target_time") == plus_minutes(cfg.ts, cfg.step_min)))
              .groupBy(cfg.series, F.col("target_time").alias("hour"))
              .agg(F.count(F.lit(1)).alias("_issues"), F.max("prediction").alias("prediction")))
    rows = times.join(issued, [cfg.series, "hour"], "left")
    if replay:
        rows = staffing.replay_target(rows.drop("planned_production"), history, cfg).drop("rows", "target_ok")
    else:
        rows = rows.withColumn("target", F.col("planned_production").cast("double"))
    lacking = (F.when(F.col("now").isNull(), "day").when(F.coalesce("_issues", F.lit(0)) != 1, "forecast")
               .when(F.col("target").isNull(), "production"))
    rows = rows.withColumn("_lacks", lacking)
    open_ = rows.filter("_lacks IS NULL").withColumnRenamed("hour", cfg.ts)
    open_ = tariff.tariff_at(open_, bands, rates, holidays, cfg=cfg)
    own = F.try_element_at(F.try_element_at(F.col("rate_table"), F.col("season")), F.col("band"))
    open_ = tariff.day_type(open_.withColumn("rate", F.coalesce("energy_rate", own, "tariff_rate")))
    matched = staffing.staff_match(open_, history, cfg)

    def value(column: str, usual: float) -> Column:
        return F.coalesce(F.col(column).cast("double"), F.lit(float(usual)))
    night = tariff.is_night(F.hour(cfg.ts))
    wage = value("day_wage", fv.DAY_WAGE) * F.when(night, F.lit(float(fv.NIGHT_MULTIPLIER))).otherwise(1.0)
    labor = F.col("staff_ref") * wage
    energy = F.greatest(F.lit(0.0), F.col("prediction")) * F.col("rate")
    base = value("billing_peak", fv.BILLING_PEAK_KW) * value("base_rate", fv.BASE_RATE_PER_KW) / (F.dayofmonth(F.last_day(F.to_date(cfg.ts))) * 24)
    revenue = F.col("target") * value("unit_price", fv.UNIT_PRICE)
    priced = matched.withColumns({
        "wage": wage, "labor": half_even(labor, 2), "energy": half_even(energy, 2), "base_allocated": half_even(base, 2),
        "total": half_even(labor + energy + base, 2), "revenue": half_even(revenue, 2)})
    priced = staffing.match_status(priced.withColumn("remainder", half_even(revenue - F.col("total"), 2)))
    columns = ["matches", "staff_ref", "ref_ts", "rate", "wage", "labor", "energy", "base_allocated", "total", "revenue", "remainder", "status"]
    answered = priced.select("request_id", F.col(cfg.ts).alias("hour"), F.col("target").alias("production"), "prediction", *columns)
    refused = good.filter("NOT accepted").select("request_id", F.array_join("reasons", ",").alias("status")) \
        .unionByName(rows.filter("_lacks IS NOT NULL").select("request_id", F.concat(F.lit("no "), "_lacks").alias("status")))
    return answered.unionByName(refused, allowMissingColumns=True)
