"""Season, load band, rate, wage and day type of a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.config import DEFAULT, Settings
from wattloom.functions import fixed_values as fv


def season(ts: str = "ts") -> Column:
    m = F.month(ts)
    return (F.when(m.isin(*fv.SUMMER_MONTHS), "summer").when(m.isin(*fv.WINTER_MONTHS), "winter")
            .otherwise("spring_autumn"))


def with_season(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    return df.withColumn("season", season(cfg.ts))


def load_band(df: DataFrame, bands: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Band of the fractional hour in the half-open intervals of the season.

    Equality on the season plus a range; the band table covers 24 hours of three seasons and is
    broadcast. A time that no interval holds keeps its row, with a null band.
    """
    h = F.hour(cfg.ts) + F.minute(cfg.ts) / 60 + F.second(cfg.ts) / 3600
    b = bands.select(F.col("season").alias("_s"), "band", "h_start", "h_end")
    rows = df.withColumn("_h", h)
    cond = ((F.col("season") == F.col("_s")) & (F.col("_h") >= F.col("h_start"))
            & (F.col("_h") < F.col("h_end")))
    return rows.join(F.broadcast(b), cond, "left").drop("_s", "_h", "h_start", "h_end")


def with_holiday(df: DataFrame, holidays: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Flag public holidays; the calendar (at most 366 dates a year) is broadcast. A year that the calendar does not know stops
    the job: "no holiday" would be a guess. Rows without a time have no holiday."""
    day = F.to_date(cfg.ts)
    known = holidays.agg(F.collect_set(F.year("date")).alias("_years"))
    dim = holidays.select(F.col("date").alias("_hd")).distinct()
    where = F.concat(F.lit("the calendar has no entries for the year "), F.year(day).cast("string"))
    sure = F.when(day.isNull() | F.array_contains("_years", F.year(day)), F.col("_hd").isNotNull()).otherwise(F.raise_error(where).cast("boolean"))
    return (df.join(F.broadcast(dim), day == F.col("_hd"), "left").join(F.broadcast(known))
            .withColumn("is_holiday", sure).drop("_hd", "_years"))


def band_override(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Sunday and holiday are off-peak; the Saturday peak falls to mid. Holiday goes first."""
    dow = F.weekday(cfg.ts)
    return df.withColumn("band", F.when((dow == 6) | F.col("is_holiday"), "off")
                         .when((dow == 5) & (F.col("band") == "peak"), "mid")
                         .otherwise(F.col("band")))


def rate_lookup(df: DataFrame, rates: DataFrame, override: float | None = None) -> DataFrame:
    """Rate by season and band (nine rows, broadcast); one override replaces all of them. Where the table
    has no rate the row stays, with a null rate."""
    out = df.join(F.broadcast(rates.select("season", "band", F.col("rate").alias("tariff_rate"))),
                  ["season", "band"], "left")
    return out.withColumn("rate", F.col("tariff_rate") if override is None
                          else F.lit(float(override)))


def tariff_at(df: DataFrame, bands: DataFrame, rates: DataFrame, holidays: DataFrame,
              override: float | None = None, cfg: Settings = DEFAULT) -> DataFrame:
    rows = load_band(with_season(df, cfg), bands, cfg)
    return rate_lookup(band_override(with_holiday(rows, holidays, cfg), cfg), rates, override)


def is_night(hour: Column) -> Column:
    return (hour >= fv.NIGHT_START) | (hour < fv.NIGHT_END)


def hour_wage(df: DataFrame, day_wage: float = fv.DAY_WAGE, cfg: Settings = DEFAULT) -> DataFrame:
    night = is_night(F.hour(cfg.ts))
    return (df.withColumn("night", night)
            .withColumn("wage", F.when(night, day_wage * fv.NIGHT_MULTIPLIER).otherwise(day_wage)))


def day_type(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Needs ``is_holiday``."""
    off = (F.weekday(cfg.ts) >= 5) | F.col("is_holiday")
    return df.withColumn("day_type", F.when(off, "off").otherwise("work"))
