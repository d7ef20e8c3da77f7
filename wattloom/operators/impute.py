"""Filling of missing values from what was known before."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.config import DEFAULT, Settings
from wattloom.operators.order_stats import quantile_before
from wattloom.session import stage

LARGEST = sys.float_info.max


def past_medians(hourly: DataFrame, columns, cfg: Settings = DEFAULT) -> DataFrame:
    """For each missing value: the median of the strictly earlier observed values.

    Narrow triples (time, column, value) tell, the missing ones ask; see ``order_stats`` for how no task holds a series.
    """
    long = hourly.select(cfg.series, cfg.ts, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
        for c in columns])).alias("_c")).select(cfg.series, F.col(cfg.ts).alias("t"), "_c.*")
    found = quantile_before(long.filter(F.col("value").isNotNull()), long.filter(F.col("value").isNull()), [cfg.series, "column"], 0.5)
    return found.select(cfg.series, F.col("t").alias(cfg.ts), "column", F.col("quantile").alias("fill"))


def impute_past_median(hourly: DataFrame, columns, cfg: Settings = DEFAULT) -> DataFrame:
    """Fill the columns; leading missing values stay missing. Segments play no part here."""
    columns = [c for c in columns if c in hourly.columns]
    if not columns:
        return hourly
    fills = (past_medians(hourly, columns, cfg).groupBy(cfg.series, cfg.ts)
             .agg(*[F.max(F.when(F.col("column") == c, F.col("fill"))).alias(f"_fill_{c}")
                    for c in columns]))
    joined = hourly.join(fills, [cfg.series, cfg.ts], "left")
    filled = joined.withColumns({c: F.coalesce(c, f"_fill_{c}") for c in columns})
    return filled.drop(*[f"_fill_{c}" for c in columns])


def impute_audit(before: DataFrame, after: DataFrame, columns,
                 cfg: Settings = DEFAULT) -> DataFrame:
    """Per series and column: missing, filled, still missing. One aggregate per side."""
    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(cfg.series).agg(F.array(*[
            F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias(name))
            for c in columns]).alias("_a")).select(cfg.series, F.inline("_a"))
    both = counts(before, "missing").join(counts(after, "left"), [cfg.series, "column"])
    return both.withColumn("filled", F.col("missing") - F.col("left"))


def middle_values(df: DataFrame, columns, bins: int = 4096) -> dict[str, tuple[float, float]]:
    """The two middle values of each column (the same one twice for an odd number), exactly.

    Distributed selection: count the values of a bracket by bins, go on with the bin that holds the wanted rank, from its
    smallest to its largest value, until that bin holds one distinct value. A pass leaves at most ``bins`` rows per column, however many
    distinct values there are, and the bracket gets narrower by that factor. Missing values and NaN take no part;
    columns without a value are left out.
    """
    value = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for c in columns}
    rows = stage(df.select(*[v.alias(f"v{i}") for i, v in enumerate(value.values())]), "selection")
    ends = rows.agg(*[F.struct(F.count(f"v{i}").alias("n"), F.min(f"v{i}").alias("lo"), F.max(f"v{i}").alias("hi")).alias(f"v{i}")
                      for i in range(len(value))]).first()
    # column -> (rank inside the bracket, smallest, largest)
    open_ = {i: ((ends[i]["n"] - 1) // 2, ends[i]["lo"], ends[i]["hi"]) for i in range(len(value)) if ends[i]["n"]}
    found: dict[int, float] = {}
    while True:
        found |= {i: lo for i, (_, lo, hi) in open_.items() if lo == hi}
        open_ = {i: x for i, x in open_.items() if i not in found}
        if not open_:
            break

        def place(i: int):
            x, lo, hi = F.col(f"v{i}"), max(open_[i][1], -LARGEST), min(open_[i][2], LARGEST)
            share = (x / 2 - lo / 2) / (hi / 2 - lo / 2)                      # halves: the width itself may not be finite
            bin_ = F.when(x < -LARGEST, -1).when(x > LARGEST, bins).otherwise(F.least(F.lit(bins - 1), F.floor(share * bins)))
            return F.when(x.between(*map(F.lit, open_[i][1:])), bin_.cast("int"))
        cells = F.array(*[F.struct(F.lit(i).alias("i"), place(i).alias("bin"), F.col(f"v{i}").alias("x")) for i in open_])
        counts = rows.select(F.inline(cells)).filter("bin IS NOT NULL").groupBy("i", "bin").agg(
            F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        for i, (rank, _, _) in list(open_.items()):
            for r in sorted((r for r in counts if r["i"] == i), key=lambda r: r["bin"]):
                if rank < r["n"]:
                    open_[i] = rank, r["lo"], r["hi"]
                    break
                rank -= r["n"]
    if not found:
        return {}
    after = rows.agg(*[F.struct(F.count_if(F.col(f"v{i}") <= x).alias("upto"),
                                F.min(F.when(F.col(f"v{i}") > x, F.col(f"v{i}"))).alias("next")).alias(f"v{i}")
                       for i, x in found.items()]).first()
    upper = {i: x if ends[i]["n"] // 2 < after[f"v{i}"]["upto"] else after[f"v{i}"]["next"] for i, x in found.items()}
    return {c: (found[i], upper[i]) for i, c in enumerate(value) if i in found}


def train_medians(df: DataFrame, columns) -> dict[str, float]:
    """Per-column median of the training rows; of an even number the mean of the two middle values."""
    found = middle_values(df.filter(F.col("split") == "train"), columns)
    return {c: a + (b - a) / 2 for c, (a, b) in found.items()}


def impute_train_median(df: DataFrame, columns) -> DataFrame:
    """Fill all rows with what the training rows say."""
    return df.fillna(train_medians(df, columns))
