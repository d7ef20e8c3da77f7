"""Checks and row filters of the raw hourly table.

A rule that only reports returns a table; a rule that must stop the run has a ``require_`` or
``reject_`` form that raises. Counting forms use partial aggregation, so a source that holds a
third of all rows is reduced before it is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.config import DEFAULT, Settings
from wattloom.functions.columns import nan_to_null, plus_minutes

# fixed values: date text forms that are understood, by the shape of the text; of several forms of a shape the first that fits
DATE_SHAPES = (
    (r"^\d{8}$", ("yyyyMMdd",)),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", ("yyyy-M-d",)),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", ("yyyy/M/d",)),
    (r"^\d{4}\.\d{1,2}\.\d{1,2}$", ("yyyy.M.d",)),
    (r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}$", ("yyyy-M-d H:mm", "yyyy-M-d'T'H:mm")),
    (r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}:\d{2}$", ("yyyy-M-d H:mm:ss", "yyyy-M-d'T'H:mm:ss")),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}$", ("yyyy/M/d H:mm",)),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$", ("yyyy/M/d H:mm:ss",)),
    (r"^\d{8}[ T]\d{4}$", ("yyyyMMdd HHmm", "yyyyMMdd'T'HHmm")),
    (r"^\d{14}$", ("yyyyMMddHHmmss",)),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ("M/d/yyyy", "d/M/yyyy")),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ("M-d-yyyy", "d-M-yyyy")),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", ("M.d.yyyy", "d.M.yyyy")),
    (r"^[A-Za-z]{3} \d{1,2},? \d{4}$", ("MMM d, yyyy", "MMM d yyyy")),
    (r"^[A-Za-z]{4,} \d{1,2},? \d{4}$", ("MMMM d, yyyy", "MMMM d yyyy")),
    (r"^\d{1,2}[ -][A-Za-z]{3}[ -]\d{4}$", ("d MMM yyyy", "d-MMM-yyyy")),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", ("d MMMM yyyy",)),
)
SOURCE_DAY = "src_day"            # name of a source column "day" beside the parsed date


class RuleViolation(ValueError):
    """Input breaks a rule that must not be repaired silently."""


# -- B1, B7, B8 ----------------------------------------------------------------------------

def require_columns(df: DataFrame, needed) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise RuleViolation(f"missing columns {missing}; present: {df.columns}")
    return df


def require_nonempty(df: DataFrame, what: str = "table") -> DataFrame:
    if df.isEmpty():
        raise RuleViolation(f"{what} has no usable rows")
    return df


def schema_summary(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Row and column count, context columns present and absent; one aggregate."""
    have = [c for c in cfg.context if c in df.columns]
    lack = [c for c in cfg.context if c not in df.columns]
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).alias("columns"), F.lit(len(have)).alias("context_present"),
        F.lit(",".join(have)).alias("present"), F.lit(",".join(lack)).alias("absent"))


# -- B2, B3, B4 ----------------------------------------------------------------------------

def strict_numeric(df: DataFrame, columns) -> DataFrame:
    """Cast text to double. Text that is not a number stops the job (it never becomes null)."""
    def cast(c: str) -> Column:
        text = F.trim(F.col(c).cast("string"))
        number = text.try_cast("double")
        bad = text.isNotNull() & (text != "") & number.isNull()
        return F.when(bad, F.raise_error(F.concat(F.lit(f"{c}: not a number: "), text))
                      .cast("double")).otherwise(number)
    return df.withColumns({c: cast(c) for c in columns})


def numeric_report(df: DataFrame, columns) -> DataFrame:
    """Report form: per column, the number of texts that are not numbers."""
    aggs = []
    for c in columns:
        text = F.trim(F.col(c).cast("string"))
        bad = text.isNotNull() & (text != "") & text.try_cast("double").isNull()
        aggs.append(F.struct(F.lit(c).alias("column"),
                             F.count_if(bad).alias("not_numeric")))
    return df.agg(F.array(*aggs).alias("r")).select(F.inline("r"))


def infinite_report(df: DataFrame, columns) -> DataFrame:
    aggs = [F.struct(F.lit(c).alias("column"),
                     F.count_if(F.abs(F.col(c).cast("double")) == math.inf).alias("infinite"))
            for c in columns]
    return df.agg(F.array(*aggs).alias("r")).select(F.inline("r"))


def reject_infinite(df: DataFrame, columns) -> DataFrame:
    bad = [r["column"] for r in infinite_report(df, columns).filter("infinite > 0").collect()]
    if bad:
        raise RuleViolation(f"infinite values in {bad}")
    return df


def negative_power(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Rows with any negative power. Missing values pass."""
    return df.filter(F.least(*cfg.power) < 0)


def reject_negative_power(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    if not negative_power(df, cfg).isEmpty():
        raise RuleViolation("negative power; check the sign definition of the source")
    return df


# -- B5, B6 --------------------------------------------------------------------------------

def parse_mixed_date(c: Column | str) -> Column:
    """Date text in mixed forms; a trailing ``.0`` is removed, failure gives null.

    The shape of the text picks the forms that are tried. Month first, day first only where the month cannot be one. A time of
    day in the text is kept: such a text makes its own "day" for the hour checks.
    """
    text = F.trim(F.regexp_replace((F.col(c) if isinstance(c, str) else c).cast("string"), r"\.0$", ""))
    out = None
    for shape, forms in DATE_SHAPES:
        found = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms])
        out = F.when(text.rlike(shape), found) if out is None else out.when(text.rlike(shape), found)
    return out


def with_date(df: DataFrame, date_col: str = "dt") -> DataFrame:
    """The parsed date as ``day``. A column of the source with that name goes on as ``src_day``."""
    if "day" in df.columns and date_col != "day":
        df = df.withColumnRenamed("day", SOURCE_DAY)
    return df.withColumn("day", parse_mixed_date(date_col))


def drop_bad_dates(df: DataFrame) -> DataFrame:
    return df.filter(F.col("day").isNotNull())


def bad_date_report(df: DataFrame, cfg: Settings = DEFAULT, keep: int = 20) -> DataFrame:
    """Per series: number of unreadable dates and the first source rows that hold them.

    ``row_number <= keep`` is pruned inside each task before the shuffle.
    """
    bad = df.filter(F.col("day").isNull())
    top = (bad.withColumn("_rn", F.row_number().over(
        Window.partitionBy(cfg.series).orderBy("src_row"))).filter(F.col("_rn") <= keep)
        .groupBy(cfg.series).agg(F.array_sort(F.collect_list("src_row")).alias("src_rows")))
    return bad.groupBy(cfg.series).agg(F.count(F.lit(1)).alias("rows")).join(top, cfg.series)


# -- B9 - B12 ------------------------------------------------------------------------------

def valid_hour(hour: Column | str = "hr") -> Column:
    h = F.col(hour) if isinstance(hour, str) else hour
    return F.coalesce(~F.isnan(h) & (h >= 0) & (h <= 23) & (h == F.floor(h)), F.lit(False))


def hour_quality(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Per series and day: are all hours integers 0..23 without repeats, and are there 24.

    Distinct hours are counted with a 24-bit mask, so one partially aggregated pass is enough.
    """
    ok = valid_hour()
    bit = F.when(ok, F.expr("shiftleft(1, cast(hr as int))")).otherwise(0)
    return (df.groupBy(cfg.series, "day")
            .agg(F.count(F.lit(1)).alias("rows"), F.bool_and(ok).alias("_valid"),
                 F.bit_count(F.bit_or(bit)).cast("long").alias("distinct_hours"))
            .withColumn("hours_ok", F.col("_valid") & (F.col("distinct_hours") == F.col("rows")))
            .withColumn("complete", F.col("rows") == cfg.hours_per_day).drop("_valid"))


def incomplete_days(quality: DataFrame, cfg: Settings = DEFAULT, keep: int = 20) -> DataFrame:
    """Days that miss hours but have valid ones: kept, and listed (first ones per series) with the series' ``total``."""
    w = Window.partitionBy(cfg.series)
    return (quality.filter(F.col("hours_ok") & ~F.col("complete")).withColumn("total", F.count(F.lit(1)).over(w))
            .withColumn("_rn", F.row_number().over(w.orderBy("day"))).filter(F.col("_rn") <= keep).drop("_rn"))


def drop_bad_hour_days(df: DataFrame, quality: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Remove whole days with bad hours. AQE broadcasts the bad days when they are few."""
    bad = quality.filter(~F.col("hours_ok")).select(cfg.series, "day")
    return df.join(bad, [cfg.series, "day"], "left_anti")


def bad_hour_detail(df: DataFrame, quality: DataFrame, cfg: Settings = DEFAULT,
                    keep: int = 8) -> DataFrame:
    """Per bad day: rows, completeness, first hour values in file order."""
    bad = quality.filter(~F.col("hours_ok")).select(cfg.series, "day", "rows", "complete")
    w = Window.partitionBy(cfg.series, "day").orderBy("src_row")
    first = (df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep)
             .groupBy(cfg.series, "day")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "hr"))),
                              lambda s: s["hr"]).alias("hours")))
    return bad.join(first, [cfg.series, "day"])


def normalize_hour(df: DataFrame) -> DataFrame:
    """Integer hour, or null where the value is not one of 0..23."""
    return df.withColumn("hour", F.when(valid_hour(), F.col("hr").cast("int")))


def require_hours(df: DataFrame) -> DataFrame:
    """Stop where a row has no hour after the days with bad hours are gone."""
    n = df.filter(F.col("hour").isNull()).count()
    if n:
        raise RuleViolation(f"{n} rows without an hour of 0..23 are left")
    return df


# -- B13 - B15 -----------------------------------------------------------------------------

def build_hour_ts(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", plus_minutes("day", F.col("hour") * 60))


def duplicate_ts(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    return (df.groupBy(cfg.series, cfg.ts).agg(F.count(F.lit(1)).alias("rows"))
            .filter(F.col("rows") > 1))


def reject_duplicate_ts(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    examples = duplicate_ts(df, cfg).orderBy(cfg.series, cfg.ts).limit(5).collect()
    if examples:
        shown = [(r[cfg.series], str(r[cfg.ts]), r["rows"]) for r in examples]
        raise RuleViolation(f"several rows for the same series and time, e.g. {shown}")
    return df


def gap_report(df: DataFrame, cfg: Settings = DEFAULT, step_sec: int = 3600) -> DataFrame:
    """Gaps longer than one step: time before, time after, missing steps.

    Inside a day ``lag`` works on one day; between days only the first and last time of each day
    are compared, so no task ever holds a whole series.
    """
    day = F.to_date(cfg.ts)
    inner = Window.partitionBy(cfg.series, "_d").orderBy(cfg.ts)
    rows = df.select(cfg.series, cfg.ts, day.alias("_d"))
    inside = rows.select(cfg.series, F.lag(cfg.ts).over(inner).alias("before"),
                         F.col(cfg.ts).alias("after"))
    ends = rows.groupBy(cfg.series, "_d").agg(F.min(cfg.ts).alias("after"),
                                             F.max(cfg.ts).alias("_last"))
    days = Window.partitionBy(cfg.series).orderBy("_d")
    between = ends.select(cfg.series, F.lag("_last").over(days).alias("before"), "after")
    width = F.unix_seconds("after") - F.unix_seconds("before")
    return (inside.unionByName(between).filter(width > step_sec)
            .withColumn("missing", F.floor(width / step_sec) - 1))


# -- B16, B19, B20 -------------------------------------------------------------------------

def expand_check(hourly: DataFrame, long: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Per series: hours, intervals, and whether intervals = 4 x hours with unique times."""
    a = hourly.groupBy(cfg.series).agg(F.count(F.lit(1)).alias("hours"))
    b = (long.groupBy(cfg.series, cfg.ts).agg(F.count(F.lit(1)).alias("_n"))
         .groupBy(cfg.series).agg(F.sum("_n").alias("intervals"),
                                  F.max("_n").alias("_worst")))
    return (a.join(b, cfg.series, "full_outer")
            .withColumn("ok", F.coalesce((F.col("intervals") == F.col("hours") * cfg.per_hour)
                                         & (F.col("_worst") == 1), F.lit(False))).drop("_worst"))


def finite_prediction(df: DataFrame, column: str = "prediction") -> DataFrame:
    """Counts of missing, NaN and infinite predictions, and the overall verdict."""
    c = F.col(column)
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(c.isNull()).alias("missing"),
        F.count_if(F.isnan(c)).alias("nan"), F.count_if(F.abs(c) == math.inf).alias("infinite"),
    ).withColumn("ok", F.col("missing") + F.col("nan") + F.col("infinite") == 0)


def require_weight(weight: float) -> float:
    if not 0 <= weight <= 1:
        raise RuleViolation(f"blend weight {weight} is outside 0..1")
    return weight


def unknown_years(df: DataFrame, holidays: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Years of the data that the calendar does not know, with their row counts."""
    years = df.groupBy(F.year(cfg.ts).alias("year")).agg(F.count(F.lit(1)).alias("rows"))
    known = holidays.select("year").distinct()
    return years.join(F.broadcast(known), "year", "left_anti")


def require_calendar_years(df: DataFrame, holidays: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    bad = sorted(r["year"] for r in unknown_years(df, holidays, cfg).collect())
    if bad:
        raise RuleViolation(f"the calendar has no entries for the years {bad}")
    return df


def number_faults(columns, cfg: Settings = DEFAULT) -> list[Column]:
    """Counts of infinite values per column, rows with negative power, rows without a series: for one aggregate or as metrics
    of a run that reads the rows anyway."""
    return [*[F.count_if(F.abs(F.col(c).cast("double")) == math.inf).alias(c) for c in columns],
            F.count_if(F.least(*cfg.power) < 0).alias("negative_power"),
            F.count_if(F.col(cfg.series).isNull()).alias("missing_series")]


def numeric_texts(df: DataFrame, columns) -> list[str]:
    """Text columns that hold numbers only (and at least one)."""
    if not columns:
        return []
    def form(c: str) -> Column:
        text = F.nullif(F.trim(F.col(c)), F.lit(""))
        number = text.try_cast("double")
        return (F.coalesce(F.bool_and(number.isNotNull() | text.isNull()), F.lit(False))
                & (F.count(number) > 0)).alias(c)
    row = df.agg(*[form(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def numeric_names(raw: DataFrame, cfg: Settings = DEFAULT) -> list[str]:
    """Columns that must be numbers."""
    return ["hr", *cfg.power, *[c for c in cfg.context if c in raw.columns]]


def as_numbers(raw: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Texts of numeric columns, and of columns of unknown role that hold numbers only, as numbers; the leak
    detection judges the latter."""
    require_columns(raw, [cfg.series, "dt", "hr", *cfg.power])
    numeric = numeric_names(raw, cfg)
    texts = [f.name for f in raw.schema.fields if isinstance(f.dataType, T.StringType)]
    unknown = [c for c in texts if c not in (*numeric, cfg.series, "dt", "src_file")]
    return strict_numeric(raw, [c for c in texts if c in numeric] + numeric_texts(raw, unknown))


def refuse_faults(counts: dict[str, int]) -> None:
    faults = {k: n for k, n in counts.items() if n}
    if faults:
        raise RuleViolation(f"infinite values, negative power or a missing series: {faults}")


def without_nan(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(c) for c in doubles})


def ingest(raw: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Numeric check, rules that stop the run, and NaN to null.

    The rules see all rows, also those whose date turns out to be unreadable.
    """
    df = as_numbers(raw, cfg)
    refuse_faults(df.agg(*number_faults(numeric_names(raw, cfg), cfg)).first().asDict())
    return without_nan(df)


def require_ok(report: DataFrame, what: str) -> None:
    """Raise when a report with an ``ok`` column holds a row that is not ok."""
    bad = report.filter(~F.col("ok")).limit(5).collect()
    if bad:
        raise RuleViolation(f"{what}: {[r.asDict() for r in bad]}")
