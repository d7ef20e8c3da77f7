"""Blocks with halo, and two-level running values.

A window over a whole series puts that series into one task. Here rows are grouped by
``(series, block)`` instead, where a block is a fixed number of days. Rows that a neighbour block
needs to look at (its halo) are copied into it, and the copies are dropped at the end. A block on
the 15-minute grid holds at most ``block_days * 96`` rows however much data there is, and one long
series is spread over as many tasks as it has blocks.

Values that run over the whole history (segment numbers, ranks) are computed in two levels: one
summary row per block, a running value over those few summary rows, then the block offset is added
to the value inside the block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.config import DEFAULT, Settings

BLOCK, OWN, SEG = "_block", "_own", "_seg"


def block_number(ts: str, days: int, shift_sec: int = 0) -> Column:
    sec = F.unix_seconds(F.col(ts)) + F.lit(shift_sec)
    return F.floor(sec / F.lit(days * 86400)).cast("long")


def with_halo(df: DataFrame, cfg: Settings = DEFAULT, before_steps: int = 0,
              after_steps: int = 0) -> DataFrame:
    """Give every row its block and copy it into the blocks whose halo it belongs to.

    The rows are then shuffled by (series, block) explicitly: a window would also accept rows that
    are already together by series alone, and a long series would stay in one task.
    """
    days = cfg.block_days
    own = block_number(cfg.ts, days)
    if not before_steps and not after_steps:
        return df.withColumn(OWN, own).withColumn(BLOCK, own).repartition(cfg.series, BLOCK)
    first = block_number(cfg.ts, days, -after_steps * cfg.step_sec)
    last = block_number(cfg.ts, days, before_steps * cfg.step_sec)
    return df.withColumn(OWN, own).withColumn(
        BLOCK, F.explode(F.sequence(first, last))).repartition(cfg.series, BLOCK)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(F.col(OWN) == F.col(BLOCK)).drop(OWN, BLOCK, SEG)


def block_window(cfg: Settings = DEFAULT, *more: str) -> Window:
    return Window.partitionBy(cfg.series, BLOCK, *more).orderBy(cfg.ts)


def starts_segment(cfg: Settings = DEFAULT, strict: bool = False) -> Column:
    """1 where the step from the previous row is not exactly one interval.

    ``strict`` stops the job where a series has the same time twice.
    """
    step = F.unix_micros(cfg.ts) - F.lag(F.unix_micros(cfg.ts)).over(block_window(cfg))
    new = F.when(step == F.lit(cfg.step_sec * 1_000_000), 0)
    if strict:
        where = F.concat_ws(" ", F.lit("repeated time:"), cfg.series, F.col(cfg.ts).cast("string"))
        new = new.when(step == 0, F.raise_error(where).cast("int"))
    return new.otherwise(1)


def with_local_segments(df: DataFrame, cfg: Settings = DEFAULT, before_steps: int = 0,
                        after_steps: int = 0, strict: bool = False) -> DataFrame:
    """Blocks with halo plus a segment number that is valid inside the block."""
    running = block_window(cfg).rowsBetween(Window.unboundedPreceding, 0)
    return (with_halo(df, cfg, before_steps, after_steps)
            .withColumn("_new", starts_segment(cfg, strict))
            .withColumn(SEG, F.sum("_new").over(running)).drop("_new"))


def segment_window(cfg: Settings = DEFAULT) -> Window:
    """Rows of one segment inside one block; no further shuffle after ``block_window``."""
    return block_window(cfg, SEG)


def running_rank(df: DataFrame, cfg: Settings = DEFAULT, bucket: Column | None = None,
                 rank: str = "rank", total: str = "total") -> DataFrame:
    """Chronological rank (1..) and row count of each series without a window over the series.

    Counts per bucket (a day by default) are summed up bucket by bucket; the rank inside the
    bucket is added. The bucket table has one row per day and series.
    """
    keyed = df.withColumn("_bucket", bucket if bucket is not None else F.to_date(cfg.ts))
    by_series = Window.partitionBy(cfg.series)
    earlier = by_series.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (keyed.groupBy(cfg.series, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
             .select(cfg.series, "_bucket",
                     F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
                     F.sum("_n").over(by_series).alias(total)))
    inside = Window.partitionBy(cfg.series, "_bucket").orderBy(cfg.ts)
    return (keyed.withColumn("_rn", F.row_number().over(inside))
            .join(sizes, [cfg.series, "_bucket"])
            .withColumn(rank, F.col("_offset") + F.col("_rn"))
            .drop("_bucket", "_offset", "_rn"))
