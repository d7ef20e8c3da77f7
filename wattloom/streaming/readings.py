"""Streams of meter events: source, windows, sessions, duplicates, late data and joins.

The transformations take and return streaming DataFrames. State is bounded by the watermark.
"""

from __future__ import annotations

from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from wattloom.config import DEFAULT, Settings
from wattloom.operators import tariff
from wattloom.session import shared_folder

LOCAL_SESSIONS = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT_SCHEMA = ("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
                "props string")


def stream_readings(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA,
                    files_per_batch: int | None = None) -> DataFrame:
    """File stream with an explicit schema; event time as a zoned timestamp.

    ``path`` is a folder or a pattern; a single file needs a pattern, too.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def as_readings(events: DataFrame) -> DataFrame:
    """Events as (series, time, value)."""
    return events.select(F.col("event_type").alias("series_id"), "ts",
                         F.col("value").cast("decimal(18,2)").alias("kw"))


def tumbling_15m(readings: DataFrame, delay: str = "10 minutes",
                 cfg: Settings = DEFAULT) -> DataFrame:
    """Sum and count per series and 15 minutes."""
    return (readings.withWatermark(cfg.ts, delay)
            .groupBy(cfg.series, F.window(cfg.ts, f"{cfg.step_min} minutes").alias("w"))
            .agg(F.sum("kw").cast("double").alias("kw"), F.count(F.lit(1)).alias("n_events"))
            .select(cfg.series, F.col("w.start").alias("ts"), "kw", "n_events"))


def sliding_mean_max(readings: DataFrame, width: str = "2 hours", delay: str = "10 minutes",
                     cfg: Settings = DEFAULT) -> DataFrame:
    """Mean and maximum of the events in windows of 2 or 4 hours that move by 15 minutes.

    Events are first reduced to panes of 15 minutes; the windows are built from the panes, so an event is shuffled
    once and only the few pane rows are copied into the windows they belong to.
    """
    pane = f"{cfg.step_min} minutes"
    panes = (readings.withWatermark(cfg.ts, delay)
             .groupBy(cfg.series, F.window(cfg.ts, pane).alias("pane"))
             .agg(F.sum("kw").alias("_sum"), F.count("kw").alias("_n"), F.max("kw").alias("_max")))
    return (panes.groupBy(cfg.series, F.window(F.window_time("pane"), width, pane).alias("w"))
            .agg(F.sum("_sum").cast("double").alias("_sum"), F.sum("_n").alias("_n"), F.max("_max").cast("double").alias("max_kw"))
            .select(cfg.series, F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"),
                    F.try_divide("_sum", F.col("_n").cast("double")).alias("mean_kw"), "max_kw"))


def session_segments(readings: DataFrame, gap: str = "15 minutes", delay: str = "10 minutes",
                     cfg: Settings = DEFAULT) -> DataFrame:
    """Runs of readings with no pause of ``gap`` or more.

    Looser than the segments of the batch side: steps shorter than 15 minutes do not split. Runs of a task are joined
    before the shuffle (``LOCAL_SESSIONS``), so a frequent series sends runs and not events.
    """
    readings.sparkSession.conf.set(LOCAL_SESSIONS, "true")
    return (readings.withWatermark(cfg.ts, delay)
            .groupBy(cfg.series, F.session_window(cfg.ts, gap).alias("w"))
            .agg(F.count(F.lit(1)).alias("readings"))
            .select(cfg.series, F.col("w.start").alias("start"), F.col("w.end").alias("stop"),
                    "readings"))


def stream_dedup(readings: DataFrame, keys=("series_id", "ts"), delay: str = "10 minutes",
                 cfg: Settings = DEFAULT) -> DataFrame:
    """First arrival of each key within the watermark."""
    return readings.withWatermark(cfg.ts, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_calendar_join(points: DataFrame, bands: DataFrame, rates: DataFrame,
                         holidays: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Season, band, holiday and rate of streamed points; the dimensions are static."""
    return tariff.tariff_at(points, bands, rates, holidays, cfg=cfg)


def confirm_join(predictions: DataFrame, actuals: DataFrame, delay: str = "1 hour",
                 cfg: Settings = DEFAULT) -> DataFrame:
    """A prediction meets the value of its target time. Equality of event times bounds the state."""
    p = predictions.withWatermark("target_time", delay).alias("p")
    a = actuals.withWatermark(cfg.ts, delay).alias("a")
    return p.join(a, F.expr(f"p.{cfg.series} = a.{cfg.series} AND p.target_time = a.{cfg.ts}")).select(
        F.col(f"p.{cfg.series}"), F.col("p.target_time"), F.col("p.prediction"),
        F.col("a.kw").alias("actual"))


# -- running a stream over what is there ---------------------------------------------------

class BatchCounts(StreamingQueryListener):
    """Rows in and rows dropped behind the watermark, per query and batch, from every progress report.

    A query keeps its newest 100 reports only; the listener sees each one. A batch that is run again counts once.
    """

    def __init__(self) -> None:
        self.counts: dict[tuple[str, int], tuple[int, int]] = {}
        self.ended: dict[str, Event] = {}

    def onQueryStarted(self, event) -> None:
        self.ended.setdefault(str(event.runId), Event())

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        before = self.counts.get((str(p.runId), p.batchId), (0, 0))
        self.counts[str(p.runId), p.batchId] = max(before[0], p.numInputRows), max(before[1], late)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), Event()).set()

    def of(self, run_id: str, wait: float = 60.0) -> list[tuple[int, int, int]]:
        """(batch, rows, late) of an ended query; reports arrive in order, so its end is the last one."""
        if not self.ended.setdefault(run_id, Event()).wait(wait):
            raise TimeoutError(f"no end of query {run_id} was reported")
        return sorted((batch, *n) for (run, batch), n in self.counts.items() if run == run_id)


COUNTS_SCHEMA = "batch long, rows long, late long"


def run_counted(stream: DataFrame, purpose: str, mode: str = "append", settings: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Process all available input into parquet; returns the table and its counts (batch, rows, late).

    ``settings`` are in force while the query starts, which keeps them for itself, and are then put back.
    """
    spark = stream.sparkSession
    out, checkpoint = shared_folder(spark, purpose), shared_folder(spark, f"{purpose}-state")
    listener = BatchCounts()
    spark.streams.addListener(listener)
    before = {k: spark.conf.get(k, None) for k in settings or {}}
    try:
        for k, v in (settings or {}).items():
            spark.conf.set(k, v)
        query = (stream.writeStream.format("parquet").outputMode(mode).option("path", out)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
        counts = listener.of(str(query.runId))
    finally:
        spark.streams.removeListener(listener)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(out), spark.createDataFrame(counts, COUNTS_SCHEMA)


def run_available(stream: DataFrame, purpose: str, mode: str = "append", settings: dict[str, str] | None = None) -> DataFrame:
    """Process all available input into parquet and return the table."""
    return run_counted(stream, purpose, mode, settings)[0]


def dropped_as_late(counts: DataFrame) -> DataFrame:
    """Rows that came after the watermark had passed them, over all batches: one row, ``late``."""
    return counts.agg(F.coalesce(F.sum("late"), F.lit(0)).alias("late"))
