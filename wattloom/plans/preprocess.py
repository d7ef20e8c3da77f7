"""The preprocessing run: raw hourly rows to the labelled feature table, with a record of what every rule did."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wattloom.config import DEFAULT, Settings
from wattloom.functions.columns import date_key
from wattloom.operators import features, impute, leaks, reshape, split, validate
from wattloom.operators.validate import RuleViolation
from wattloom.session import stage
from wattloom.sources import raw as tables
from wattloom.sources import results


def clean_hourly(raw: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Dates read, days with corrupt hours removed, hour and hour timestamp built."""
    dated = validate.drop_bad_dates(validate.with_date(raw))
    return _clean(dated, validate.hour_quality(dated, cfg), cfg)


def _clean(dated: DataFrame, quality: DataFrame, cfg: Settings) -> DataFrame:
    return validate.build_hour_ts(validate.normalize_hour(validate.drop_bad_hour_days(dated, quality, cfg)))


def day_table(hourly: DataFrame, fraction: float | None, cfg: Settings = DEFAULT,
              boundary: int | None = None, defaults: bool = False) -> DataFrame:
    """Activity and split boundary per series and day; power is never imputed, so the cleaned
    hours are enough for it."""
    energy = features.daily_energy(reshape.to_15min(hourly, cfg=cfg), cfg)
    days = features.activity(features.day_active(energy, cfg), cfg).withColumn(
        "date_key", date_key("date"))
    if boundary is not None:
        return days.withColumn("boundary", F.lit(int(boundary)))
    return split.boundary_on_days(days, fraction, cfg, defaults)


def _rows() -> Column:
    return F.count(F.lit(1)).alias("rows")


@dataclass
class Watch:
    """Metrics of the steps, taken on the way by the jobs that run anyway (``DataFrame.observe``).

    Spark may count a row twice when a task of a shuffle stage runs again after an executor was lost, so the run checks
    that the numbers add up (``Run.verify``).
    """
    seen: dict[str, Observation] = field(default_factory=dict)

    def on(self, df: DataFrame, name: str, *metrics: Column) -> DataFrame:
        self.seen[name] = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
        return df.observe(self.seen[name], *metrics)

    def __getitem__(self, name: str) -> dict:
        return self.seen[name].get


@dataclass
class Run:
    """Tables of one preprocessing run; ``features`` is lazy, all others are stored."""
    parsed: DataFrame
    quality: DataFrame
    hourly: DataFrame
    days: DataFrame
    features: DataFrame
    watch: Watch
    context: list[str]
    dropped: list[str]

    def verify(self) -> None:
        """Rows that came in are kept, or gone for a counted reason."""
        seen, quality = self.watch["parsed"], self.watch["quality"]
        if seen["rows"] != seen["bad_dates"] + (quality["bad_rows"] or 0) + self.watch["hourly"]["rows"]:
            raise RuntimeError("the counted rows do not add up; run the preprocessing again")


def prepare(raw: DataFrame, holidays: DataFrame | None = None, cfg: Settings = DEFAULT,
            fraction: float | None = None, boundary: int | None = None,
            drop: list[str] | None = None, strict: bool = True) -> Run:
    """All steps up to the lazy feature table.

    The raw text is read and parsed once; the parsed rows, the day qualities, the cleaned hours and the day table are written
    once to the shared folder, and each later step reads only the columns it needs.
    """
    watch = Watch()
    parsed = validate.as_numbers(raw, cfg) if strict else raw
    numeric = validate.numeric_names(raw, cfg)
    faults = validate.number_faults(numeric, cfg) if strict else []
    parsed = validate.with_date(parsed)
    parsed = watch.on(parsed, "parsed", _rows(), F.count_if(F.col("day").isNull()).alias("bad_dates"), *faults)
    parsed = stage(validate.without_nan(parsed) if strict else parsed, "parsed-hours")
    if strict:
        validate.refuse_faults({k: n for k, n in watch["parsed"].items() if k not in ("rows", "bad_dates")})

    dated = validate.drop_bad_dates(parsed)
    ok, whole = F.col("hours_ok"), F.col("complete")
    quality = stage(watch.on(validate.hour_quality(dated, cfg), "quality",
                             F.count_if(ok).alias("good_days"), F.count_if(~ok).alias("bad_days"),
                             F.count_if(~whole).alias("incomplete_days"), F.count_if(ok & ~whole).alias("incomplete_kept"),
                             F.sum(F.when(~ok, F.col("rows"))).alias("bad_rows")), "day-quality")
    context = [c for c in cfg.context if c in parsed.columns]
    hourly = stage(watch.on(_clean(dated, quality, cfg), "hourly", _rows(), F.min(cfg.ts).alias("first"), F.max(cfg.ts).alias("last"),
                            F.count_if(F.col("hour").isNull()).alias("without_hour"),
                            *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in context]), "clean-hours")
    if strict:
        if not watch["hourly"]["rows"]:
            raise RuleViolation("hourly table has no usable rows")
        if watch["hourly"]["without_hour"]:
            raise RuleViolation(f"{watch['hourly']['without_hour']} rows without an hour of 0..23 are left")
        validate.reject_duplicate_ts(hourly, cfg)
        if holidays is not None:
            validate.require_calendar_years(hourly, holidays, cfg)
    if drop is None:
        drop = leaks.drop_list(hourly, cfg)
    context = [c for c in context if c not in drop]
    lacking = [c for c in context if watch["hourly"][f"missing_{c}"]]      # a column with every value there has nothing to fill
    filled = watch.on(impute.impute_past_median(hourly, lacking, cfg), "filled", _rows(),
                      *[F.count_if(F.col(c).isNull()).alias(f"left_{c}") for c in context])
    long = watch.on(reshape.to_15min(filled, context, cfg), "intervals", _rows())
    days = stage(day_table(hourly, fraction, cfg, boundary, defaults=holidays is not None), "day-table")
    if strict:
        split.require_both_parts(days, cfg)
    table = split.label_by_boundary(features.all_features(long, holidays, cfg, days))
    table = watch.on(table, "labelled", _rows(), F.count_if(F.col("split") == "train").alias("train"),
                     F.count_if(F.col("split") == "test").alias("test"), F.count_if(F.col("y").isNull()).alias("unlabelled"))
    return Run(parsed, quality, hourly, days, split.drop_unlabelled(table), watch, context, drop)


def preprocess(raw: DataFrame, holidays: DataFrame | None = None, cfg: Settings = DEFAULT,
               fraction: float | None = None, boundary: int | None = None,
               drop: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Full run to the lazy feature table. ``drop`` names leaking columns found before; None detects them here.

    The split is made before unlabelled rows go: at ``boundary``, else with a calendar at the default date of
    the year of a one-year series, else by the fraction. A series with an empty part stops a strict run, and
    so does a row without a series.
    """
    return prepare(raw, holidays, cfg, fraction, boundary, drop, strict).features


def run(raw: DataFrame, out: str, audit: str, holidays: DataFrame | None = None, cfg: Settings = DEFAULT,
        run_id: str = "run", **options) -> DataFrame:
    """Write the feature table to ``out`` and what every rule did to ``audit`` (``steps`` and ``details``).

    The numbers come from the jobs of the run itself. Stops where the expansion did not make four intervals of every hour.
    """
    done = prepare(raw, holidays, cfg, **options)
    tables.write_features(done.features, out, cfg)
    done.verify()
    watch = done.watch
    if watch["intervals"]["rows"] != cfg.per_hour * watch["hourly"]["rows"]:
        raise RuleViolation(f"{watch['intervals']['rows']} intervals from {watch['hourly']['rows']} hours")
    write_run_audit(done, audit, raw, holidays, cfg, run_id)
    return tables.scan_features(raw.sparkSession, out)


def write_run_audit(done: Run, folder: str, raw: DataFrame, holidays: DataFrame | None, cfg: Settings, run_id: str) -> None:
    """One row of metrics for every rule, also where it changed nothing, and the lists that belong to them."""
    spark, watch = raw.sparkSession, done.watch
    parsed, quality, hourly, cells = watch["parsed"], watch["quality"], watch["hourly"], watch["labelled"]
    gaps = stage(validate.gap_report(done.hourly, cfg), "gaps")
    segments = _segments(done.hourly, gaps, cfg)
    steps: dict[str, dict] = {
        "input": {"rows": parsed["rows"], "columns": len(raw.columns)},
        "bad_dates": {"rows": parsed["bad_dates"]},
        "schema": {"rows": parsed["rows"] - parsed["bad_dates"], "columns": len(raw.columns),
                   "context": sum(c in raw.columns for c in cfg.context),
                   "absent": ",".join(c for c in cfg.context if c not in raw.columns)},
        "calendar": {"given": holidays is not None},
        "hours": {"good_days": quality["good_days"], "bad_days": quality["bad_days"], "incomplete_days": quality["incomplete_days"]},
        "incomplete_kept": {"days": quality["incomplete_kept"]},
        "bad_hour_days": {"days": quality["bad_days"], "rows": quality["bad_rows"] or 0},
        "time_axis": {"first": hourly["first"], "last": hourly["last"], "rows": hourly["rows"], "gaps": gaps.count()},
        "leaks": {"checked": len(leaks.other_numeric(done.hourly, cfg)), "dropped": len(done.dropped),
                  "columns": ",".join(source_name(c) for c in done.dropped)},
        "imputation": {f"{m}_{c}": n for c in done.context for m, n in (
            ("missing", hourly[f"missing_{c}"]), ("filled", hourly[f"missing_{c}"] - watch["filled"][f"left_{c}"]),
            ("left", watch["filled"][f"left_{c}"]))},
        "expansion": {"hours": hourly["rows"], "intervals": watch["intervals"]["rows"], "per_hour": cfg.per_hour},
        "segments": segments,
        "split": {"train": cells["train"], "test": cells["test"]},
        "unlabelled": {"dropped": cells["unlabelled"], "rows": cells["rows"] - cells["unlabelled"]},
    }
    rows = [(run_id, step, {k: _text(v) for k, v in metrics.items()}) for step, metrics in steps.items()]
    spark.createDataFrame(rows, "run_id string, step string, metrics map<string,string>").coalesce(1) \
        .write.mode("append").parquet(f"{folder}/steps")

    day = lambda rows: rows.select(F.concat_ws(" ", cfg.series, F.date_format("day", "yyyy-MM-dd")).alias("item"), F.col("rows").alias("value"))
    bad = done.parsed.filter(F.col("day").isNull()) if "src_row" in done.parsed.columns else None
    details = [
        results.audit_details(run_id, "bad_hour_days", day(done.quality.filter(~F.col("hours_ok")))),
        results.audit_details(run_id, "incomplete_kept", day(done.quality.filter("hours_ok AND NOT complete")), sample=20),
        results.audit_details(run_id, "time_axis", gaps.select(F.concat_ws(" ", cfg.series, F.col("before").cast("string")).alias("item"),
                                                               F.col("missing").alias("value")), sample=20),
        results.audit_details(run_id, "split", done.days.groupBy(cfg.series).agg(F.max("boundary").alias("value"))
                              .select(F.col(cfg.series).alias("item"), "value")),
        results.audit_details(run_id, "leaks", spark.createDataFrame([(source_name(c), "dropped") for c in done.dropped], "item string, value string")),
    ]
    if bad is not None:
        details.append(results.audit_details(run_id, "bad_dates", bad.select(
            F.concat_ws(" ", cfg.series, F.lpad(F.col("src_row").cast("string"), 12, "0")).alias("item"), F.col("dt").alias("value")), sample=20))
    results.write_audit(details, f"{folder}/details")


def _segments(hourly: DataFrame, gaps: DataFrame, cfg: Settings) -> dict:
    """Number, smallest and largest size of the unbroken stretches, in intervals: from one row per gap and series."""
    from pyspark.sql import Window
    ends = hourly.groupBy(cfg.series).agg(F.min(cfg.ts).alias("start"), F.max(cfg.ts).alias("stop"))
    w = Window.partitionBy(cfg.series).orderBy("start")
    starts = ends.select(cfg.series, "start").unionByName(gaps.select(cfg.series, F.col("after").alias("start")))
    stops = ends.select(cfg.series, "stop").unionByName(gaps.select(cfg.series, F.col("before").alias("stop")))
    pairs = starts.withColumn("n", F.row_number().over(w)).join(
        stops.withColumn("n", F.row_number().over(Window.partitionBy(cfg.series).orderBy("stop"))), [cfg.series, "n"])
    size = ((F.unix_seconds("stop") - F.unix_seconds("start")) / 3600 + 1).cast("long") * cfg.per_hour
    r = pairs.agg(F.count(F.lit(1)).alias("segments"), F.min(size).alias("min_rows"), F.max(size).alias("max_rows")).first()
    return r.asDict()


def source_name(column: str) -> str:
    """The name that the source uses."""
    return "day" if column == validate.SOURCE_DAY else column


def _text(value) -> str | None:
    return None if value is None else str(value).lower() if isinstance(value, bool) else str(value)
