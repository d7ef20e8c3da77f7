"""Raw hourly CSV and the processed feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattloom.config import DEFAULT, Settings
from wattloom.functions import fixed_values as fv
from wattloom.operators.validate import require_columns

FEATURE_COLUMNS = ("series_id", "ts", "date_key", "split", "kw", "y")


def scan_raw(spark: SparkSession, path: str, series: str | None = None,
             columns: dict[str, str] | None = None, number_rows: bool = True) -> DataFrame:
    """CSV with header, UTF-8 with or without byte-order mark, all columns as text. A field that holds one of
    ``MISSING_WORDS`` is missing.

    ``columns`` maps headers of the file to the names used here (the usual ones by default);
    other headers keep their name. ``series`` names the meter where the file has no ``series_id``.

    ``src_row`` is the line number inside its file, counting the header as line 1. Large files are
    read in blocks: the rows of each block are counted once, the counts of earlier blocks of the
    same file are added up, and each row adds its place inside its block. The block table has one
    row per 128 MB, so the numbering needs no shuffle of the rows and no single ordered task.
    """
    text = (spark.read.option("header", True).csv(path)
            .withColumnsRenamed(fv.SOURCE_COLUMNS if columns is None else columns))
    fields = text.columns
    if number_rows:
        text = text.select("*", F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_block_start").alias("_at"))
    text = text.withColumns({c: F.when(~F.col(f"`{c}`").isin(*fv.MISSING_WORDS), F.col(f"`{c}`")) for c in fields})
    if series is not None:
        text = text.withColumn("series_id", F.lit(series))
    if not number_rows:
        return text
    rows = text.withColumn("_id", F.monotonically_increasing_id())
    earlier = (Window.partitionBy("src_file").orderBy("_at")
               .rowsBetween(Window.unboundedPreceding, -1))
    sizes = (rows.groupBy("src_file", "_at")
             .agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
             .select("src_file", "_at", "_first",
                     F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    return (rows.join(sizes, ["src_file", "_at"])
            .withColumn("src_row", F.col("_before") + F.col("_id") - F.col("_first") + 2)
            .drop("_at", "_id", "_first", "_before"))


def scan_features(spark: SparkSession, path: str, needed=FEATURE_COLUMNS) -> DataFrame:
    """Processed table; fails on missing columns. Order is made where a window needs it."""
    return require_columns(spark.read.parquet(path), needed)


def output_columns(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Helper columns out, the key columns in front."""
    front = [c for c in FEATURE_COLUMNS if c in df.columns]
    rest = [c for c in df.columns if c not in front and not c.startswith("_") and c != "segment"]
    return df.select(*front, *rest)


def write_features(df: DataFrame, path: str, cfg: Settings = DEFAULT) -> None:
    """Parquet partitioned by split, so that training and scoring read only their part."""
    output_columns(df, cfg).write.mode("overwrite").partitionBy("split").parquet(path)
