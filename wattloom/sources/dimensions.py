"""Holiday calendar and tariff: JSON documents to small dimension tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.functions import fixed_values as fv
from wattloom.operators.validate import RuleViolation

CALENDAR_SCHEMA = "schema int, country string, years map<string,map<string,string>>"
TARIFF_SCHEMA = ("rates map<string,map<string,double>>, "
                 "time_bands map<string,map<string,array<array<double>>>>, "
                 "base_rate_per_kw double, billing_peak_kw double, day_wage double, "
                 "night_multiplier double, night_start int, night_end int, unit_price_won double")


def calendar_document() -> str:
    """The built-in calendar in the JSON form that ``load_holidays`` reads."""
    years: dict[str, dict[str, str]] = {}
    for day, name in fv.holidays():
        years.setdefault(day[:4], {})[day] = name
    return json.dumps({"schema": 1, "country": "KR", "years": years}, ensure_ascii=False)


def tariff_document() -> str:
    return json.dumps({
        "rates": fv.RATES, "time_bands": fv.TIME_BANDS, "base_rate_per_kw": fv.BASE_RATE_PER_KW,
        "billing_peak_kw": fv.BILLING_PEAK_KW, "day_wage": fv.DAY_WAGE,
        "night_multiplier": fv.NIGHT_MULTIPLIER, "night_start": fv.NIGHT_START,
        "night_end": fv.NIGHT_END, "unit_price_won": fv.UNIT_PRICE})


def _document(spark: SparkSession, path: str | None, text: str, schema: str) -> DataFrame:
    if path is not None:
        return spark.read.schema(schema).json(path, multiLine=True)
    return spark.range(1).select(F.from_json(F.lit(text), schema).alias("d")).select("d.*")


def calendar_problems(doc: DataFrame, years: DataFrame | None = None) -> DataFrame:
    """All rule breaks of a calendar document as (problem, detail) rows.

    ``years`` is a table of requested years (column ``year``).
    """
    head = doc.filter(~F.coalesce((F.col("schema") == 1) & (F.col("country") == "KR"), F.lit(False))
                      ).select(F.lit("header").alias("problem"), F.lit("schema, country").alias("detail"))
    per_year = doc.select(F.explode("years").alias("year", "dates"))
    empty = (per_year.filter(F.coalesce(F.size("dates"), F.lit(0)) <= 0)
             .select(F.lit("empty_year").alias("problem"), F.col("year").alias("detail")))
    dates = per_year.select("year", F.explode("dates").alias("date", "name"))
    parsed = F.try_to_timestamp("date", F.lit("yyyy-MM-dd"))
    good = ((F.date_format(parsed, "yyyy-MM-dd") == F.col("date"))
            & (F.year(parsed).cast("string") == F.col("year")) & (F.length("name") > 0))
    bad = (dates.filter(~F.coalesce(good, F.lit(False)))
           .select(F.lit("bad_date").alias("problem"), F.col("date").alias("detail")))
    out = head.unionByName(empty).unionByName(bad)
    if years is not None:
        known = per_year.select(F.col("year").cast("int").alias("year"))
        lost = (years.select("year").distinct().join(F.broadcast(known), "year", "left_anti")
                .select(F.lit("missing_year").alias("problem"), F.col("year").cast("string").alias("detail")))
        out = out.unionByName(lost)
    return out


def load_holidays(spark: SparkSession, path: str | None = None,
                  years: DataFrame | None = None, check: bool = True) -> DataFrame:
    """Calendar JSON (or the built-in calendar) to ``holiday(year, date, name)``.

    At most 366 rows per calendar year. ``check`` raises on any rule break.
    """
    doc = _document(spark, path, calendar_document(), CALENDAR_SCHEMA)
    if check and (path is not None or years is not None):
        problems = calendar_problems(doc, years).limit(20).collect()
        if problems:
            raise RuleViolation(f"calendar: {[(p['problem'], p['detail']) for p in problems]}")
    return (doc.select(F.explode("years").alias("y", "dates"))
            .select(F.col("y").cast("int").alias("year"), F.explode("dates").alias("d", "name"))
            .select("year", F.to_date("d").alias("date"), "name"))


def load_tariff(spark: SparkSession, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Tariff JSON (or the built-in one) to ``rate`` and ``band_interval`` dimensions."""
    doc = _document(spark, path, tariff_document(), TARIFF_SCHEMA)
    rates = (doc.select(F.explode("rates").alias("season", "b"))
             .select("season", F.explode("b").alias("band", "rate")))
    bands = (doc.select(F.explode("time_bands").alias("season", "b"))
             .select("season", F.explode("b").alias("band", "iv"))
             .select("season", "band", F.explode("iv").alias("i"))
             .select("season", "band", F.col("i")[0].alias("h_start"), F.col("i")[1].alias("h_end")))
    return rates, bands
