"""Stateful streams: running threshold, scoring with an idempotent sink, alerts sent once."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wattloom.config import DEFAULT, Settings
from wattloom.functions import fixed_values as fv
from wattloom.streaming.readings import ROCKSDB, STATE_STORE

THRESHOLD_SETTINGS = {STATE_STORE: ROCKSDB}

# Histogram of under-predictions: bin 0 holds values up to SMALLEST (as 0), the others grow by 1 % and
# reach beyond 1e15. A quantile is interpolated between the bins of its two ranks, as the exact one is
# between the two values, so it is within 1 % (or SMALLEST) of it whatever the number of rows.
GROWTH = math.log(1.01)
SMALLEST = 0.001
BINS = 4200

STATE = "year int, peak double, bins binary, last_us long, last_prediction double"       # times in microseconds
HELD = "us long, kw double, prediction double"
OUTPUT = ("series_id string, ts timestamp, kw double, prediction double, annual_peak double, "
          "error_samples long, error_margin double, threshold double, at_risk boolean")
OUTPUT_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]


def _bin(x: float) -> int:
    if x <= SMALLEST:
        return 0
    return min(BINS - 1, 1 + int(math.log(x / SMALLEST) / GROWTH))


class RunningBins:
    """Counts per bin with the running place of one quantile: ``below`` values lie under bin ``at``."""

    def __init__(self, q: float, bins: np.ndarray | None = None) -> None:
        self.q, self.bins = q, np.zeros(BINS, np.int64) if bins is None else bins
        self.n, self.at, self.below = int(self.bins.sum()), 0, 0

    def add(self, x: float) -> None:
        i = _bin(x)
        self.bins[i] += 1
        self.n += 1
        self.below += i < self.at

    def quantile(self) -> float:
        place = self.q * (self.n - 1)
        low = int(place)
        while self.below > low:
            self.at -= 1
            self.below -= int(self.bins[self.at])
        while self.below + self.bins[self.at] <= low:
            self.below += int(self.bins[self.at])
            self.at += 1
        after = self.at
        if low + 1 < self.n and self.below + self.bins[after] <= low + 1:
            after += 1
            while not self.bins[after]:
                after += 1
        a, b = (0.0 if i == 0 else SMALLEST * math.exp((i - 0.5) * GROWTH) for i in (self.at, after))
        return a + (b - a) * (place - low)


class _Threshold(StatefulProcessor):
    """Holds the readings of a series until the watermark has passed them, then takes them in order of time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", HELD)
        self.summary = handle.getValueState("summary", STATE)

    def _wake(self, earliest: int) -> None:
        at = -(-earliest // 1_000)                                 # the first millisecond at which it is passed
        if at not in set(self.handle.listTimers()):
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        if len(new):
            us = new["ts"].to_numpy("datetime64[us]").astype("int64").tolist()
            self.held.appendList(list(zip(us, map(_number, new["kw"]), map(_number, new["prediction"]))))
            self._wake(min(us))
        yield pd.DataFrame(columns=OUTPUT_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1_000
        rows = sorted(self.held.get(), key=lambda r: r[0])
        ready = [r for r in rows if r[0] <= passed]
        waiting = rows[len(ready):]
        if waiting:
            self.held.put([tuple(r) for r in waiting])
            self._wake(waiting[0][0])
        else:
            self.held.clear()
        year, peak, packed, last_us, last_p = self.summary.get() if self.summary.exists() else (0, -math.inf, b"", None, None)
        bins = RunningBins(fv.ERROR_QUANTILE, np.frombuffer(packed, np.int64).copy() if packed else None)
        out = []
        for us, kw, p in ready:
            if last_us is not None and us <= last_us:              # the same time once more
                continue
            ts = pd.Timestamp(us, unit="us")
            if ts.year != year:
                year, peak, bins = ts.year, -math.inf, RunningBins(fv.ERROR_QUANTILE)
            peak = peak if kw is None else max(peak, kw)
            if last_p is not None and kw is not None and us - last_us == fv.STEP_MINUTES * 60_000_000:
                bins.add(max(0.0, kw - last_p))
            margin = bins.quantile() if bins.n >= fv.MIN_ERROR_SAMPLES else peak * fv.FALLBACK_MARGIN_SHARE
            threshold = round(max(1.0, peak - margin), 1)
            if p is not None:
                out.append((key[0], ts, kw, p, peak, bins.n, margin, threshold, bool(p >= threshold)))
            last_us, last_p = us, p
        if ready:
            self.summary.update((int(year), float(peak), bins.bins.tobytes(), last_us, last_p))
        yield pd.DataFrame(out, columns=OUTPUT_NAMES)

    def close(self) -> None:
        pass


def _number(x) -> float | None:
    return None if x is None or x != x else float(x)


def stateful_threshold(observed: DataFrame, delay: str = "10 minutes", cfg: Settings = DEFAULT) -> DataFrame:
    """Peak, error margin and threshold after every reading, from (series, ts, kw, prediction).

    Readings wait until the watermark has passed them and are then taken in order of time, so readings that arrive up
    to ``delay`` late, in whatever batch, give the same rows as a sorted table; only what comes behind the watermark is
    dropped (and counted by Spark). Of several readings of one time the first held counts. Peak and errors start anew with each
    year. Run it with ``THRESHOLD_SETTINGS``: list state and timers need the RocksDB store.
    """
    rows = observed.select(F.col(cfg.series).cast("string").alias("series_id"), F.col(cfg.ts).alias("ts"), F.col("kw").cast("double").alias("kw"),
                           F.col("prediction").cast("double").alias("prediction")).withWatermark("ts", delay)
    return rows.groupBy("series_id").transformWithStateInPandas(
        statefulProcessor=_Threshold(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def alert_once(states: DataFrame, delay: str = "1 day", cfg: Settings = DEFAULT) -> DataFrame:
    """One alert per (series, time, threshold) while at risk; the watermark bounds the state."""
    return (states.filter("at_risk").withWatermark(cfg.ts, delay)
            .select(cfg.series, cfg.ts, "threshold", "prediction")
            .dropDuplicates([cfg.series, cfg.ts, "threshold"]))


def stream_scoring(rows: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
                   delay: str | None = None, cfg: Settings = DEFAULT) -> None:
    """Apply a stored model to every micro-batch; one row per (series, time) over all batches.

    A batch leaves out the keys that earlier committed batches hold (only files of its own time range are read), writes to
    a folder of its own, which a run of the same batch overwrites, and then names itself in the list of committed batches. A
    batch that failed half-way is in no list, so readers never see it. With ``delay`` repeats are also removed before, by
    state that the watermark bounds; rows behind the watermark are dropped then.
    """
    keys = [cfg.series, cfg.ts]
    if delay:
        rows = rows.withWatermark(cfg.ts, delay).dropDuplicatesWithinWatermark(keys)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        once = batch.dropDuplicates(keys)
        span = once.agg(F.min(cfg.ts).alias("lo"), F.max(cfg.ts).alias("hi")).first()
        if batch_id and span["lo"] is not None:
            done = read_scored(spark, out, before=batch_id)
            if done is not None:
                known = done.filter(F.col(cfg.ts).between(span["lo"], span["hi"])).select(*keys)
                once = once.join(known, keys, "left_anti")
        score(once).write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")
        spark.createDataFrame([(batch_id,)], "batch long").coalesce(1).write.mode("overwrite").parquet(f"{out}/committed/of={batch_id}")

    (rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def read_scored(spark, out: str, before: int | None = None) -> DataFrame | None:
    """Rows of the committed batches (those before one); None where no batch is committed yet."""
    try:
        listed = spark.read.schema("batch long").parquet(f"{out}/committed")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    batches = sorted(r["batch"] for r in listed.collect() if before is None or r["batch"] < before)
    if not batches:
        return None
    return spark.read.option("basePath", f"{out}/rows").parquet(*[f"{out}/rows/batch={b}" for b in batches]).drop("batch")
