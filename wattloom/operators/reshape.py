"""Hourly rows to 15-minute rows, and runs of unbroken readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattloom.config import DEFAULT, Settings
from wattloom.functions.columns import plus_minutes
from wattloom.operators import blocks


def to_15min(hourly: DataFrame, keep=(), cfg: Settings = DEFAULT) -> DataFrame:
    """One row per hour with four power columns -> four rows. The first column starts at :00."""
    quarters = F.posexplode(F.array(*[F.col(c).cast("double") for c in cfg.power]))
    return (hourly.select(cfg.series, F.col(cfg.ts).alias("_hour"), *keep,
                          quarters.alias("_q", "kw"))
            .withColumn(cfg.ts, plus_minutes("_hour", F.col("_q") * cfg.step_min))
            .select(cfg.series, cfg.ts, "kw", *keep))


def add_segments(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Segment number 1.. per series; a new one whenever the step is not exactly 15 minutes.

    Level one numbers the segments inside a block, level two adds the segments of earlier blocks.
    Both sides of the join are partitioned by (series, block).
    """
    w = blocks.block_window(cfg)
    local = (blocks.with_halo(df, cfg, before_steps=1)
             .withColumn("_new", blocks.starts_segment(cfg))
             .filter(F.col(blocks.OWN) == F.col(blocks.BLOCK))
             .withColumn("_local", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    earlier = (Window.partitionBy(cfg.series).orderBy(blocks.BLOCK)
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (local.groupBy(cfg.series, blocks.BLOCK).agg(F.sum("_new").alias("_n"))
               .select(cfg.series, blocks.BLOCK,
                       F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")))
    return (local.join(offsets, [cfg.series, blocks.BLOCK])
            .withColumn("segment", F.col("_local") + F.col("_offset"))
            .drop("_local", "_offset", "_new", blocks.BLOCK, blocks.OWN))


def segment_stats(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Per series: number of segments, smallest and largest row count."""
    return (df.groupBy(cfg.series, "segment").agg(F.count(F.lit(1)).alias("_n"))
            .groupBy(cfg.series).agg(F.count(F.lit(1)).alias("segments"),
                                     F.min("_n").alias("min_rows"), F.max("_n").alias("max_rows")))


def gap_starts(df: DataFrame, cfg: Settings = DEFAULT, keep: int = 10) -> DataFrame:
    """The first rows that follow a gap longer than one interval (shorter steps are not gaps)."""
    w = blocks.block_window(cfg)
    long_days = blocks.with_halo(df, cfg, before_steps=1)
    prev = F.lag(F.unix_micros(cfg.ts)).over(w)
    step = F.unix_micros(cfg.ts) - prev
    inside = (long_days.withColumn("_gap", F.coalesce(step > cfg.step_sec * 1_000_000, prev.isNull()))
              .filter((F.col(blocks.OWN) == F.col(blocks.BLOCK)) & F.col("_gap")))
    first = df.groupBy(cfg.series).agg(F.min(cfg.ts).alias("_first"))
    top = Window.partitionBy(cfg.series).orderBy(cfg.ts)
    return (inside.join(first, cfg.series).filter(F.col(cfg.ts) > F.col("_first"))
            .select(cfg.series, cfg.ts).withColumn("n", F.row_number().over(top))
            .filter(F.col("n") <= keep))


def prune_helpers(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith("_") and c != "segment"])


def line_breaks(df: DataFrame, value: str = "kw", cfg: Settings = DEFAULT,
                day: str = "day_key") -> DataFrame:
    """Path number of a drawn day line: a missing value or a step over 15 minutes lifts the pen.

    Rows with a missing value get no path. A drawn line is one day, at most 96 points.
    """
    w = Window.partitionBy(cfg.series, day).orderBy(cfg.ts)
    here = F.col(value).isNotNull()
    step = F.unix_micros(cfg.ts) - F.lag(F.unix_micros(cfg.ts)).over(w)
    joined = here & F.lag(value).over(w).isNotNull() & (step <= cfg.step_sec * 1_000_000)
    lift = F.when(here & ~F.coalesce(joined, F.lit(False)), 1).otherwise(0)
    return (df.withColumn("_lift", lift)
            .withColumn("path", F.when(here, F.sum("_lift").over(
                w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_lift"))
