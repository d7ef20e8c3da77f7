"""Staffing reference from earlier days, and the cost of an interval."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import chain
from math import ceil
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wattloom.config import DEFAULT, Settings
from wattloom.functions import fixed_values as fv
from wattloom.functions.columns import finite, half_even, plus_minutes
from wattloom.operators.order_stats import RUN_ROWS, in_runs
from wattloom.session import stage

SPREAD = 16                       # copies of the history summaries that meet the runs of questions


def staff_validity(df: DataFrame) -> DataFrame:
    """Finite, not negative, and above 0 unless nothing was produced."""
    s, p = F.col("staff"), F.col("production")
    ok = finite("staff") & (s >= 0) & (F.coalesce(p == 0, F.lit(False)) | (s > 0))
    return df.withColumn("staff_valid", F.coalesce(ok, F.lit(False)))


MATCH_FIELDS = [
    T.StructField("matches", T.LongType()), T.StructField("staff_ref", T.LongType()),
    T.StructField("ref_production", T.DoubleType()), T.StructField("ref_staff", T.DoubleType()),
    T.StructField("ref_ts", T.TimestampType())]


class _Records:
    """Earlier records of one (series, hour, day type).

    ``front`` keeps the records that can still win, sorted by production: a record is useless once
    another has at least its production and comes before it in the order (ceil of staff,
    production, newest first). The first one with enough production is the answer.
    """

    def __init__(self, seen: list[float] | None = None) -> None:
        self.seen: list[float] = seen or []
        self.front: list[tuple] = []     # (production, order key, staff, time)

    def contend(self, production: float, staff: float, ts: int) -> None:
        key = (ceil(staff), production, -ts)
        front = self.front
        i = bisect_left(front, production, key=itemgetter(0))
        if i < len(front) and front[i][1] <= key:
            return
        j = bisect_right(front, production, key=itemgetter(0))
        while i > 0 and front[i - 1][1] >= key:
            i -= 1
        front[i:j] = [(production, key, staff, ts)]

    def add(self, production: float, staff: float, ts: int) -> None:
        insort(self.seen, production)
        self.contend(production, staff, ts)

    def best(self, target: float | None) -> tuple:
        matches = len(self.seen) - bisect_left(self.seen, target) if target is not None and target == target else 0
        if not matches:
            return 0, None, None, None, None
        _, key, staff, ts = self.front[bisect_left(self.front, target, key=itemgetter(0))]
        return matches, key[0], key[1], staff, ts


RECORD = "array<struct<production: double, staff: double, _when: bigint>>"
PIECE_VALUES = 20_000             # list elements that become Python objects at a time


def _elements(c: pa.Array) -> np.ndarray:
    """Number of innermost elements of each list."""
    sizes = np.array(c.value_lengths().fill_null(0), np.int64)
    if not pa.types.is_list(c.type.value_type):
        return sizes
    inner, ends = np.concatenate(([0], np.cumsum(_elements(c.flatten())))), np.cumsum(sizes)
    return inner[ends] - inner[ends - sizes] + sizes


def _pieces(batches, *columns: str, most: int = PIECE_VALUES):
    """Parts of the batches in order, each of one row or of at most ``most`` elements in these list columns."""
    for b in batches:
        sizes = sum((_elements(b.column(c)) for c in columns), np.ones(b.num_rows, np.int64))
        upto, at = np.cumsum(sizes), 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, end - at)
            at = end


def _frontiers(batches):
    """The records of each run that no other record of the run beats."""
    for b in _pieces(batches, "own"):
        found = []
        for rows in b.column("own").to_pylist():
            run = _Records()
            for r in rows:
                run.contend(r["production"], r["staff"], r["_when"])
            found.append([{"production": p, "staff": staff, "_when": ts} for p, _, staff, ts in run.front])
        kept = [c for c in b.schema.names if c != "own"]
        front = pa.array(found, b.schema.field("own").type)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), front], names=[*kept, "front"])


def _answers(schema: pa.Schema):
    """Sweep the records and questions of a run in order of time, on top of what earlier runs left."""
    def run(batches):
        for b in _pieces(batches, "seen", "fronts", "own", "place"):
            cols = [b.column(c).to_pylist() for c in ("seen", "fronts", "own", "place", "target")]
            out = []
            for seen, fronts, own, places, targets in zip(*cols):
                known = _Records(sorted(chain.from_iterable(seen or ())))
                for r in chain.from_iterable(fronts or ()):
                    known.contend(r["production"], r["staff"], r["_when"])
                own = sorted(own or (), key=itemgetter("_place"))
                at, done = 0, [None] * len(places)
                for i in sorted(range(len(places)), key=places.__getitem__):
                    while at < len(own) and own[at]["_place"] < places[i]:
                        known.add(own[at]["production"], own[at]["staff"], own[at]["_when"])
                        at += 1
                    done[i] = known.best(targets[i])
                out += done
            asked = b.column("asked").flatten()
            answers = [pa.array([a[j] for a in out]).cast(schema.field(f.name).type) for j, f in enumerate(MATCH_FIELDS)]
            yield pa.RecordBatch.from_arrays([*asked.flatten(), *answers], schema=schema)
    return run


def staff_match(asked: DataFrame, history: DataFrame, cfg: Settings = DEFAULT, run_rows: int = RUN_ROWS) -> DataFrame:
    """Smallest staffing among earlier dates that produced at least the target.

    Same series, hour and day type; valid staff; strictly earlier date; production >= target.
    Order: ceil(staff), production, newest. ``asked`` has (series, ts, day_type, target, …).

    A plane sweep in parts: records and questions stand in one order (series, hour, day type, time) that is range
    partitioned and cut into runs of at most ``run_rows``. A run leaves a summary, its sorted productions and the
    frontier of records that can still win; a question sees the summaries of the earlier runs of its key and the
    records before it in its own run. So many questions on one key become many runs, each with its own copy of
    the (short) history. A question costs a binary search.
    """
    def key(series, day_type) -> list:
        nothing = F.lit("\0")
        return [F.coalesce(series.cast("string"), nothing).alias("_series"), F.coalesce(F.hour(cfg.ts), F.lit(-1)).alias("_hour"),
                F.coalesce(day_type.cast("string"), nothing).alias("_type")]
    keys = ["_series", "_hour", "_type"]
    whole = F.struct(*[F.col(f"`{c}`") for c in asked.columns])
    questions = asked.select(*key(F.col(cfg.series), F.col("day_type")), F.unix_micros(F.date_trunc("day", cfg.ts)).alias("_when"),
                             F.lit(0).alias("_kind"), F.col("target").cast("double").alias("production"),
                             F.lit(None).cast("double").alias("staff"), whole.alias("_asked"))
    records = history.filter(F.col("staff_valid") & finite("production") & F.col(cfg.ts).isNotNull()).select(
        *key(F.col(cfg.series), F.col("day_type")), F.unix_micros(cfg.ts).alias("_when"), F.lit(1).alias("_kind"),
        F.col("production").cast("double"), F.col("staff").cast("double"), F.lit(None).cast(questions.schema["_asked"].dataType).alias("_asked"))
    # a question sorts before the records of its own day; equal questions are spread by their hash
    order = [*keys, "_when", "_kind", "_spread"]
    hashed = [F.col(f"_asked.`{f.name}`") for f in asked.schema.fields if "map<" not in f.dataType.simpleString()]
    swept = in_runs(questions.unionByName(records).withColumn("_spread", F.xxhash64("production", "staff", *hashed)), order, run_rows)

    own = swept.filter("_kind = 1").groupBy(*keys, "run").agg(
        F.array_sort(F.collect_list("production")).alias("seen"),
        F.collect_list(F.struct("production", "staff", "_when")).cast(RECORD).alias("own"))
    shape = T.StructType([*(f for f in own.schema.fields if f.name != "own"), T.StructType.fromDDL(f"front {RECORD}").fields[0]])
    summaries = stage(own.mapInArrow(_frontiers, shape), "frontiers")
    spread = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    ask = swept.filter("_kind = 0").groupBy(*keys, "run").agg(
        F.collect_list(F.struct("_place", "production", "_asked")).alias("a"))
    # summaries are few and small, runs of questions may be many: each copy of the history serves its share of them
    waiting = ask.select(*keys, "run", F.pmod(F.xxhash64("run"), F.lit(SPREAD)).cast("int").alias("_copy"))
    earlier = waiting.join(summaries.withColumnRenamed("run", "_run").withColumn("_copy", spread), [*keys, "_copy"]) \
        .filter("_run < run").groupBy(*keys, "run").agg(F.collect_list("seen").alias("seen"), F.collect_list("front").alias("fronts"))
    inside = swept.filter("_kind = 1").groupBy(*keys, "run").agg(F.collect_list(F.struct("_place", "production", "staff", "_when")).alias("own"))
    rows = ask.join(earlier, [*keys, "run"], "left").join(inside, [*keys, "run"], "left").select(
        "seen", "fronts", "own", F.col("a._place").alias("place"), F.col("a.production").alias("target"), F.col("a._asked").alias("asked"))
    schema = T.StructType(list(asked.schema.fields) + MATCH_FIELDS)
    return rows.mapInArrow(_answers(to_arrow_schema(schema)), schema)


def match_status(df: DataFrame) -> DataFrame:
    return df.withColumn("status", F.when(F.col("staff_ref").isNotNull(), "complete")
                         .otherwise("insufficient_data"))


def interval_cost(df: DataFrame, peak_kw: float = fv.BILLING_PEAK_KW,
                  base_rate: float = fv.BASE_RATE_PER_KW, cfg: Settings = DEFAULT,
                  raw: bool = False) -> DataFrame:
    """Labour, energy and the share of the monthly base charge of one hour.

    The 15-minute forecast is taken as constant for the hour. Needs staff_ref, wage, prediction
    and rate. ``raw`` keeps the unrounded values.
    """
    days = F.dayofmonth(F.last_day(F.to_date(cfg.ts)))
    labor = F.col("staff_ref") * F.col("wage")
    energy = F.greatest(F.lit(0.0), F.col("prediction")) * F.col("rate")
    base = F.lit(peak_kw * base_rate) / (days * 24)
    total = labor + energy + base
    shown = (lambda c: c) if raw else (lambda c: half_even(c, 2))
    return df.withColumns({
        "labor": shown(labor), "energy": shown(energy), "base_allocated": shown(base),
        "total": shown(total)})


def economics(df: DataFrame, unit_price: float = fv.UNIT_PRICE) -> DataFrame:
    """Profit of the production and what is left of it after the (rounded) total cost."""
    profit = F.col("target") * F.lit(unit_price)
    return (df.withColumn("profit", half_even(profit, 2))
            .withColumn("remainder", half_even(profit - F.col("total"), 2)))


def issue_selection(times: DataFrame, forecast: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """The forecast made at :45 for the hour that starts next; exactly one must exist.

    ``times`` has (series, ts). The hour is floor(ts + 15 min); ``issues`` counts the forecasts
    found, so a value other than 1 marks a time without a valid answer.
    """
    hour = F.date_trunc("hour", plus_minutes(cfg.ts, cfg.step_min))
    asked = times.select(cfg.series, F.col(cfg.ts).alias("now"), hour.alias("hour"))
    made = (forecast.filter(F.minute("target_time") == 0)
            .groupBy(cfg.series, F.col("target_time").alias("hour"))
            .agg(F.count(F.lit(1)).alias("issues"), F.max("prediction").alias("prediction")))
    return (asked.join(made, [cfg.series, "hour"], "left")
            .withColumn("issues", F.coalesce("issues", F.lit(0)))
            .withColumn("ok", F.col("issues") == 1))


def replay_target(hours: DataFrame, history: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Actual production of the hour as the target; exactly one history row must exist."""
    real = (history.groupBy(cfg.series, F.col(cfg.ts).alias("hour"))
            .agg(F.count(F.lit(1)).alias("rows"), F.max("production").alias("target")))
    return (hours.join(real, [cfg.series, "hour"], "left")
            .withColumn("rows", F.coalesce("rows", F.lit(0)))
            .withColumn("target_ok", F.col("rows") == 1))


def scenario_cost(requests: DataFrame, frame: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Baseline and scenario cost of 15 minutes. Production does not change the prediction.

    ``requests`` name (series, day_key, cursor). A request whose day or position does not exist
    stays in the result with ``found`` false and without costs.
    """
    w = Window.partitionBy(cfg.series, "day_key").orderBy(cfg.ts)
    placed = frame.select(cfg.series, "day_key", cfg.ts, "prediction",
                          (F.row_number().over(w) - 1).cast("long").alias("cursor"))
    joined = (requests.join(placed, [cfg.series, "day_key", "cursor"], "left")
              .withColumn("found", F.col("prediction").isNotNull()))
    power = F.when(F.col("found"), F.greatest(F.lit(0.0), F.col("prediction")))
    energy = power * F.col("power_factor") * 0.25 * F.col("energy_rate")
    out = {"energy": half_even(energy, 0)}
    for name, n in (("baseline", "baseline_staff"), ("scenario", "staff")):
        labor = F.when(F.col("found"), F.col(n) * F.col("hourly_wage") * 0.25)
        out[f"{name}_labor"] = half_even(labor, 0)
        out[f"{name}_total"] = half_even(energy + labor, 0)
    return joined.withColumns(out)


def production_range(frame: DataFrame, keys) -> DataFrame:
    return frame.groupBy(*keys).agg(F.min("production").alias("min_production"),
                                    F.max("production").alias("max_production"))
