"""Features of 15-minute readings. Nothing here looks past the current interval.

The row features are a catalogue: name -> (expression over the segment window, steps it looks
back, steps it looks ahead). ``segment_features`` takes any subset and copies just the halo that
subset needs, so all of them cost one shuffle by ``(series, block)``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.config import DEFAULT, Settings
from wattloom.functions.columns import date_key
from wattloom.operators import blocks
from wattloom.operators.running import running_quantile

Expr = Callable[[Window], Column]


def _lag(n: int, c: str = "kw") -> Expr:
    return lambda w: F.lag(c, n).over(w) if n else F.col(c)


def _diff(a: int, b: int) -> Expr:
    return lambda w: _lag(a)(w) - _lag(b)(w)


def _full(n: int, agg: Callable[[str], Column]) -> Expr:
    """Aggregate of the last n values, missing unless all n are there."""
    def build(w: Window) -> Column:
        frame = w.rowsBetween(-(n - 1), 0)
        return F.when(F.count("kw").over(frame) == n, agg("kw").over(frame))
    return build


def catalogue(cfg: Settings = DEFAULT) -> dict[str, tuple[Expr, int, int]]:
    """All segment features in output order."""
    cat: dict[str, tuple[Expr, int, int]] = {"y": (lambda w: F.lead("kw", 1).over(w), 0, 1)}
    # lag 1 is the current interval: it is the value known when the forecast is made
    for n in (1, 2, 3, 4, 8, cfg.per_day, cfg.per_week):
        cat[f"kw_lag{n}"] = (_lag(n - 1), n - 1, 0)
    cat["lag16"] = (_lag(16), 16, 0)
    cat["kw_d1"] = (_diff(0, 1), 1, 0)
    cat["kw_d2"] = (_diff(1, 2), 2, 0)
    cat["kw_roll4"] = (_full(4, F.avg), 3, 0)
    cat["kw_roll16"] = (_full(16, F.avg), 15, 0)
    cat["kw_std4"] = (_full(4, F.stddev_samp), 3, 0)
    for n, label in ((8, "2h"), (16, "4h")):
        cat[f"delta_{label}"] = (_diff(0, n), n, 0)
        cat[f"mean_{label}"] = (_full(n, F.avg), n - 1, 0)
        cat[f"max_{label}"] = (_full(n, F.max), n - 1, 0)
    for c in cfg.delayed:
        cat[f"{c}_lag{cfg.per_hour}"] = (_lag(cfg.per_hour, c), cfg.per_hour, 0)
    return cat


def default_names(df: DataFrame, cfg: Settings = DEFAULT) -> list[str]:
    """Catalogue features that the columns at hand allow."""
    absent = {f"{c}_lag{cfg.per_hour}" for c in cfg.delayed if c not in df.columns}
    return [n for n in catalogue(cfg) if n not in absent]


def segment_features(df: DataFrame, names: Iterable[str] | None = None,
                     cfg: Settings = DEFAULT) -> DataFrame:
    """Add the named catalogue features (all that the columns allow by default)."""
    cat = catalogue(cfg)
    names = default_names(df, cfg) if names is None else list(names)
    back = max(cat[n][1] for n in names)
    ahead = max(cat[n][2] for n in names)
    w = blocks.segment_window(cfg)
    out = blocks.with_local_segments(df, cfg, back, ahead)
    out = out.withColumns({n: cat[n][0](w) for n in names})
    return blocks.drop_halo(out)


# -- calendar ------------------------------------------------------------------------------

def slot(ts: str) -> Column:
    return F.hour(ts) * 4 + F.floor(F.minute(ts) / 15).cast("int")


def calendar_parts(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    ts = cfg.ts
    return df.withColumns({
        "hour": F.hour(ts),
        "quarter": F.floor(F.minute(ts) / cfg.step_min).cast("int"),
        "dow": F.weekday(ts) + 1,
    })


def flags(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    ts = cfg.ts
    return df.withColumns({
        "is_weekend": (F.weekday(ts) >= 5).cast("int"),
        "is_day_shift": F.hour(ts).between(9, 17).cast("int"),
    })


def cyclic(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    day = slot(cfg.ts) * F.lit(2 * math.pi) / cfg.per_day
    week = F.weekday(cfg.ts) * F.lit(2 * math.pi) / 7
    return df.withColumns({"tod_sin": F.sin(day), "tod_cos": F.cos(day),
                           "dow_sin": F.sin(week), "dow_cos": F.cos(week)})


def is_off(df: DataFrame, holidays: DataFrame | None, cfg: Settings = DEFAULT) -> DataFrame:
    """Weekend or holiday; weekend only where no calendar is given.

    The calendar has at most 366 dates per year, so it is joined as a broadcast dimension.
    """
    weekend = F.weekday(cfg.ts) >= 5
    if holidays is None:
        return df.withColumn("is_off", weekend.cast("int"))
    dim = holidays.select(F.col("date").alias("_hd")).distinct()
    return (df.withColumn("_d", F.to_date(cfg.ts))
            .join(F.broadcast(dim), F.col("_d") == F.col("_hd"), "left")
            .withColumn("is_off", (weekend | F.col("_hd").isNotNull()).cast("int"))
            .drop("_d", "_hd"))


# -- activity of earlier days --------------------------------------------------------------

def daily_energy(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Sum per day across segments; a day with only missing values counts as 0."""
    return (df.groupBy(cfg.series, F.to_date(cfg.ts).alias("date"))
            .agg(F.coalesce(F.sum("kw"), F.lit(0.0)).alias("energy")))


def day_active(daily: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Active: at least a share of the median of earlier days. The first day is not active."""
    out = running_quantile(daily, [cfg.series], ["date"], "energy", 0.5, "past_median")
    hit = F.col("energy") >= F.col("past_median") * F.lit(cfg.inactive_ratio)
    return out.withColumn("active", F.coalesce(hit, F.lit(False)))


def activity(active: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Inactive observed days before today, and whether the previous observed day was active.

    Works on the day table: one row per day and series.
    """
    w = Window.partitionBy(cfg.series).orderBy("date")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return (active.withColumn("_rn", F.row_number().over(w))
            .withColumn("_last", F.max(F.when(F.col("active"), F.col("_rn"))).over(before))
            .withColumn("days_since_active",
                        (F.col("_rn") - 1 - F.coalesce("_last", F.lit(0))).cast("int"))
            .withColumn("prev_day_active",
                        F.coalesce(F.lag("active").over(w), F.lit(True)).cast("int"))
            .drop("_rn", "_last"))


def attach_activity(df: DataFrame, days: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Join the day values to the rows; days without a value get 0 and 1 (``default_fill``).

    The day table is folded to one row per (series, block) holding a map of at most
    ``block_days`` entries. The rows are already partitioned by (series, block) after
    ``segment_features``, so the join does not shuffle them again. A ``boundary`` column of the
    day table (one value per series) is carried along.
    """
    carried = [c for c in ("boundary",) if c in days.columns]
    per_block = (days.withColumn("_ts", F.col("date").cast("timestamp"))
                 .groupBy(cfg.series, blocks.block_number("_ts", cfg.block_days).alias(blocks.BLOCK))
                 .agg(F.map_from_entries(F.collect_list(F.struct(
                     "date", F.struct("days_since_active", "prev_day_active")))).alias("_days"),
                     *[F.max(c).alias(c) for c in carried]))
    own = blocks.block_number(cfg.ts, cfg.block_days)
    rows = df if blocks.BLOCK in df.columns else df.withColumn(blocks.BLOCK, own)
    found = F.try_element_at(F.col("_days"), F.to_date(cfg.ts))
    joined = rows.join(per_block, [cfg.series, blocks.BLOCK], "left").withColumn("_f", found)
    return default_fill(joined.withColumn("days_since_active", F.col("_f.days_since_active"))
                        .withColumn("prev_day_active", F.col("_f.prev_day_active"))
                        ).drop("_f", "_days", blocks.BLOCK)


def default_fill(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "days_since_active": F.coalesce("days_since_active", F.lit(0)),
        "prev_day_active": F.coalesce("prev_day_active", F.lit(1)),
    })


def all_features(df: DataFrame, holidays: DataFrame | None = None, cfg: Settings = DEFAULT,
                 days: DataFrame | None = None) -> DataFrame:
    """The whole feature table of one or many series.

    ``days`` is the day table of ``activity``; it is computed from the readings when not given.
    """
    if days is None:
        days = activity(day_active(daily_energy(df, cfg), cfg), cfg)
    cat = catalogue(cfg)
    names = default_names(df, cfg)
    back, ahead = max(cat[n][1] for n in names), max(cat[n][2] for n in names)
    w = blocks.segment_window(cfg)
    rows = (blocks.with_local_segments(df, cfg, back, ahead)
            .withColumns({n: cat[n][0](w) for n in names})
            .filter(F.col(blocks.OWN) == F.col(blocks.BLOCK)).drop(blocks.OWN, blocks.SEG))
    rows = attach_activity(rows, days, cfg)
    rows = cyclic(flags(calendar_parts(rows, cfg), cfg), cfg)
    return is_off(rows, holidays, cfg).withColumn("date_key", date_key(cfg.ts))
