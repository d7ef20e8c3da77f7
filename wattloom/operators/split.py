"""Train/test split, usable rows, walk-forward folds and model windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.config import DEFAULT, Settings
from wattloom.functions import fixed_values as fv
from wattloom.functions.columns import all_finite, date_key, finite
from wattloom.operators import blocks
from wattloom.operators.validate import RuleViolation, require_columns, require_ok

REQUIRED = tuple(fv.TREE_FEATURES + fv.WEATHER_LAGS + fv.SEQUENCE_CALENDAR) + ("kw", "y")


def with_date_key(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    return df.withColumn("date_key", date_key(cfg.ts))


def _label(boundary: Column) -> Column:
    """No label where the day or the boundary is missing."""
    return F.when(F.col("date_key") < boundary, F.lit("train")).when(F.col("date_key") >= boundary, F.lit("test"))


def split_by_date(df: DataFrame, boundary: int | None = None, cfg: Settings = DEFAULT) -> DataFrame:
    """Days before the boundary train, the rest tests.

    Without a boundary each series whose rows lie in one single year gets the default of that
    year, if there is one; every other series is split by the fraction.
    """
    if boundary is not None:
        return df.withColumn("split", _label(F.lit(int(boundary))))
    days = boundary_on_days(df.select(cfg.series, "date_key").distinct(), None, cfg, defaults=True)
    return _label_days(df, label_by_boundary(days), cfg)


def _label_days(df: DataFrame, days: DataFrame, cfg: Settings) -> DataFrame:
    """Bring a label of the day table to the rows.

    Joined by (series, day) and not by series: a series that holds a third of all rows is then
    spread over as many tasks as it has days.
    """
    return df.join(days.select(cfg.series, "date_key", "split"), [cfg.series, "date_key"])


def boundary_on_days(days: DataFrame, fraction: float | None = None,
                     cfg: Settings = DEFAULT, defaults: bool = False) -> DataFrame:
    """Per series the day that starts the test part: distinct day number int(n * (1 - f)).

    ``days`` has one row per series and ``date_key``; the boundary becomes a column of it. With
    ``defaults`` a series that lies in one year takes the default date of that year where there is one.
    """
    fraction = cfg.test_fraction if fraction is None else fraction
    if not 0 < fraction < 1:
        raise RuleViolation("the test fraction must lie between 0 and 1")
    w = Window.partitionBy(cfg.series)
    numbered = (days.withColumn("_i", F.row_number().over(w.orderBy("date_key")) - 1)
                .withColumn("_n", F.count(F.lit(1)).over(w)))
    at = F.when(F.col("_i") == F.floor(F.col("_n") * F.lit(1 - fraction)), F.col("date_key"))
    boundary = F.max(at).over(w)
    if defaults and cfg.default_split:
        by_year = F.create_map(*[F.lit(x) for kv in cfg.default_split.items() for x in kv])
        year = F.floor(F.col("date_key") / 10000).cast("int")
        one_year = F.min(year).over(w) == F.max(year).over(w)
        boundary = F.coalesce(F.when(one_year, F.try_element_at(by_year, F.min(year).over(w))), boundary)
    return numbered.withColumn("boundary", boundary).drop("_i", "_n")


def require_both_parts(days: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Stop where a series of the day table has no day before its boundary, or none from it on."""
    parts = days.groupBy(cfg.series).agg(F.min("date_key").alias("first"), F.max("date_key").alias("last"),
                                         F.max("boundary").alias("boundary"))
    require_ok(parts.withColumn("ok", F.coalesce((F.col("first") < F.col("boundary"))
                                                 & (F.col("boundary") <= F.col("last")), F.lit(False))),
               "a part of the split is empty")
    return days


def label_by_boundary(df: DataFrame) -> DataFrame:
    return df.withColumn("split", _label(F.col("boundary"))).drop("boundary")


def split_by_fraction(df: DataFrame, fraction: float | None = None,
                      cfg: Settings = DEFAULT) -> DataFrame:
    """Split each series at its own boundary day."""
    days = boundary_on_days(df.select(cfg.series, "date_key").distinct(), fraction, cfg)
    return _label_days(df, label_by_boundary(days), cfg)


def split_guard(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Per series: row counts of both parts and whether both exist."""
    return (df.groupBy(cfg.series)
            .agg(F.count_if(F.col("split") == "train").alias("train_rows"),
                 F.count_if(F.col("split") == "test").alias("test_rows"))
            .withColumn("ok", (F.col("train_rows") > 0) & (F.col("test_rows") > 0)))


def drop_unlabelled(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["y"])


# -- windows -------------------------------------------------------------------------------

def window_ok(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Flag rows whose last 96 rows are unbroken 15-minute steps with finite values.

    Meant for the labelled table, before other filters: a removed row breaks the windows that
    need it. A repeated time stops the job. Counted as the difference of two running counts: a sliding frame
    would look at 96 rows for each row.
    """
    n = cfg.window
    w = blocks.segment_window(cfg)
    out = blocks.with_local_segments(df, cfg, before_steps=n - 1, strict=True)
    out = out.withColumn("_good", F.count(F.when(finite("kw"), 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    good = F.col("_good") - F.lag("_good", n, 0).over(w) == n
    return blocks.drop_halo(out.withColumn("window_ok", good).drop("_good"))


def usable_rows(df: DataFrame, columns=REQUIRED, cfg: Settings = DEFAULT,
                window: str | None = None) -> DataFrame:
    """Rows that every model can use: all inputs finite and the window unbroken.

    ``window`` names a column to hold the window itself. It is taken from the table as given:
    after the filter, removed rows would be missing from the windows of their successors.
    """
    require_columns(df, columns)
    ok = all_finite(columns)
    if window:
        return window_vectors(df, cfg, window).filter(ok)
    return window_ok(df, cfg).filter(ok & F.col("window_ok")).drop("window_ok")


def window_vectors(df: DataFrame, cfg: Settings = DEFAULT, out: str = "window") -> DataFrame:
    """Last 96 values as 24 rows of 4, only for rows whose window is unbroken."""
    n, rows = cfg.window, cfg.window_rows
    width = n // rows
    frame = blocks.segment_window(cfg).rowsBetween(-(n - 1), 0)
    cut = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)),
                      lambda i: F.slice("_flat", i * width + 1, F.lit(width)))
    local = blocks.with_local_segments(df, cfg, before_steps=n - 1, strict=True)
    return (blocks.drop_halo(local
                             .withColumn("_n", F.count(F.when(finite("kw"), 1)).over(frame))
                             .withColumn("_flat", F.collect_list("kw").over(frame)))
            .filter(F.col("_n") == n).withColumn(out, cut).drop("_n", "_flat"))


# -- folds and jobs ------------------------------------------------------------------------

def forward_folds(df: DataFrame, folds: int | None = None, days: int | None = None,
                  cfg: Settings = DEFAULT) -> DataFrame:
    """Per series the last months of the training part that leave room for a whole fold.

    A fold is ``[lo, hi)`` in date keys and starts on the first of a month present in train.
    ``fold_no`` counts from the newest fold (1).
    """
    folds = folds or cfg.forward_folds
    days = days or cfg.fold_days
    months = (df.filter(F.col("split") == "train")
              .groupBy(cfg.series, F.trunc(F.to_date(cfg.ts), "MM").alias("first"))
              .agg(F.max(cfg.ts).alias("_last")))
    w = Window.partitionBy(cfg.series)
    stop = F.date_add("first", days)
    return (months.withColumn("_end", F.max("_last").over(w))
            .filter(stop.cast("timestamp") <= F.col("_end") + F.expr("interval 1 day"))
            .withColumn("_rn", F.row_number().over(w.orderBy(F.desc("first"))))
            .filter(F.col("_rn") <= folds)
            .select(cfg.series, date_key("first").alias("lo"), date_key(stop).alias("hi"),
                    date_key("first").cast("string").alias("fold"), F.col("_rn").alias("fold_no")))


def eval_jobs(df: DataFrame, folds: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """The folds plus the open-ended test job of each series (at most five rows per series)."""
    test = (df.filter(F.col("split") == "test").groupBy(cfg.series)
            .agg(F.min("date_key").alias("lo"))
            .select(cfg.series, "lo", F.lit(None).cast("int").alias("hi"),
                    F.lit("test").alias("fold"), F.lit(0).alias("fold_no")))
    return folds.unionByName(test)


def job_days(df: DataFrame, jobs: DataFrame, cfg: Settings = DEFAULT, part: str = "eval") -> DataFrame:
    """The days of each job, one row per (series, date key, job): ``eval`` = [lo, hi), ``train`` = everything before
    lo, from ``start`` on where the jobs have that column. Only days between the series' first and last one."""
    def day(c) -> Column:
        return F.to_date(c.cast("string"), "yyyyMMdd")
    ends = df.groupBy(cfg.series).agg(F.min("date_key").alias("_first"), F.max("date_key").alias("_last"))
    spans = jobs.join(ends, cfg.series)
    first, last = day(F.col("_first")), day(F.col("_last"))
    lo = day(F.col("lo"))
    if part == "eval":
        begin, end = F.greatest(lo, first), F.least(F.date_sub(F.coalesce(day(F.col("hi")), F.date_add(last, 1)), 1), last)
    else:
        begin, end = first, F.least(F.date_sub(lo, 1), last)
        if "start" in jobs.columns:
            begin = F.greatest(begin, day(F.col("start")))
    spans = spans.withColumns({"_begin": begin, "_end": end}).filter("_begin <= _end")
    return spans.withColumn("_day", F.explode(F.sequence("_begin", "_end"))).withColumn("date_key", date_key("_day")) \
        .drop("_day", "_begin", "_end", "_first", "_last")


def job_rows(df: DataFrame, jobs: DataFrame, cfg: Settings = DEFAULT,
             part: str = "eval") -> DataFrame:
    """Rows of each job: ``eval`` = [lo, hi), ``train`` = everything before lo, from ``start`` on
    where the jobs have that column.

    The jobs are laid out over their days, so rows meet them by (series, day): no join on the series
    alone, and one scan serves all jobs. The days are the side to be hashed in each task: a stored table of rows looks small
    to Spark (compressed, few of its columns read), so it would be sent whole through the driver as a broadcast.
    """
    return df.join(job_days(df, jobs, cfg, part).hint("shuffle_hash"), [cfg.series, "date_key"])


def train_lookback(jobs: DataFrame, months: int | None = None, cfg: Settings = DEFAULT) -> DataFrame:
    """First date key of the training part of a sequence model: some months before ``lo``."""
    start = F.add_months(F.to_date(F.col("lo").cast("string"), "yyyyMMdd"),
                         -(cfg.train_months if months is None else months))
    return jobs.withColumn("start", date_key(start))


def tail_validation(df: DataFrame, share: float | None = None, cfg: Settings = DEFAULT,
                    bucket: Column | None = None) -> DataFrame:
    """Chronological first ``int(share * n)`` rows are ``fit``, the rest ``validation``."""
    share = cfg.fit_share if share is None else share
    ranked = blocks.running_rank(df, cfg, bucket, "_rank", "_total")
    return ranked.withColumn(
        "part", F.when(F.col("_rank") <= F.floor(F.col("_total") * F.lit(share)), "fit")
        .otherwise("validation")).drop("_rank", "_total")


def train_stats(windows: DataFrame, cfg: Settings = DEFAULT, keys=None, part: str = "fit",
                window: str = "window") -> DataFrame:
    """Mean and population deviation + 1e-8 of all window cells and of y over the fit rows.

    Each row is first reduced to the sum and the square sum of its own cells.
    """
    keys = [cfg.series] if keys is None else keys
    n = float(cfg.window)
    flat = F.flatten(F.col(window))
    s = F.aggregate(flat, F.lit(0.0), lambda a, x: a + x)
    q = F.aggregate(flat, F.lit(0.0), lambda a, x: a + x * x)
    sums = (windows.filter(F.col("part") == part).select(*keys, "y", s.alias("_s"), q.alias("_q"))
            .groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("rows"), F.sum("_s").alias("_s"), F.sum("_q").alias("_q"),
                 F.avg("y").alias("y_mean"), (F.stddev_pop("y") + 1e-8).alias("y_std")))
    mean = F.col("_s") / (F.col("rows") * n)
    var = F.greatest(F.col("_q") / (F.col("rows") * n) - mean * mean, F.lit(0.0))
    return sums.select(*keys, "rows", mean.alias("x_mean"), (F.sqrt(var) + 1e-8).alias("x_std"),
                       "y_mean", "y_std")
