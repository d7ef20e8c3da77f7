"""Quantiles of all earlier values, without a group that holds a series.

A question (key, t) asks for the quantile of the values told before t. Values are sorted along (key, value, t) and cut into *runs*
of a bounded number of rows; times are cut into blocks. Counts of values per (block, run) say, for each question, in which run the
wanted rank lies and how many ranks before it belong to the run: the block's own rows are looked at one by one, all earlier blocks
only through their counts. The run then holds the answer: its r-th value among those told before t. Questions of one block that meet
in one run are answered together, so no task holds more than a run and a block, however long the series is.

For a series of n values the count table has (n / block rows) x (n / run rows) entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.session import stage

RUN_ROWS = 4096
BLOCK_DAYS = 28
PART_SHIFT = 33                   # monotonically_increasing_id: part number above, row in the part below


def in_runs(df: DataFrame, order: list, rows: int = RUN_ROWS) -> DataFrame:
    """Stored rows in global order with ``run``: consecutive rows, at most ``rows`` to a run, run numbers ascending."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    part = F.shiftright("_place", PART_SHIFT)
    inside = F.col("_place").bitwiseAND(F.lit((1 << PART_SHIFT) - 1))
    run = F.shiftleft(part, PART_SHIFT) + F.floor(inside / F.lit(rows))
    return stage(ordered.withColumn("run", run), "runs")


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column; a missing list is empty."""
    c = batch.column(name)
    sizes = np.array([0 if x is None else x for x in c.value_lengths().to_pylist()], np.int64)
    return c.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def _locate(q: float, inclusive: bool, schema: pa.Schema, keys: list[str]):
    """Questions of a block to (run, rank in the run) of the two order statistics around the quantile."""
    side = "right" if inclusive else "left"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {c: _lists(b, c) for c in ("before_run", "before_n", "tell_t", "tell_run", "ask_t")}
            for i in range(b.num_rows):
                before_run, before_n, tell_t, tell_run, ask_t = (v[o[i]:o[i + 1]] for v, o in cols.values())
                order = np.argsort(tell_t, kind="stable")
                tell_t, tell_run = tell_t[order], tell_run[order]
                runs, at = np.unique(np.concatenate([before_run, tell_run]), return_inverse=True)
                base = np.bincount(at[:len(before_run)], before_n, len(runs)).astype(np.int64)
                steps = np.zeros((len(tell_t) + 1, len(runs)), np.int64)
                steps[np.arange(1, len(tell_t) + 1), at[len(before_run):]] = 1
                np.cumsum(steps, axis=0, out=steps)
                for ask in np.split(ask_t, range(512, len(ask_t), 512)):
                    upto = np.cumsum(base + steps[np.searchsorted(tell_t, ask, side)], axis=1)
                    n = upto[:, -1] if len(runs) else np.zeros(len(ask), np.int64)
                    place = q * (n - 1)
                    low = np.maximum(place, 0).astype(np.int64)
                    share = np.where(n > 0, place - low, 0.0)
                    out = []
                    for which, rank in ((0, low), (1, np.minimum(low + 1, n - 1))):
                        ok = (n > 0) & ((share > 0) if which else True)
                        of = (upto <= rank[:, None]).sum(axis=1)[ok]
                        first = np.where(of > 0, upto[ok, of - 1], 0) if len(runs) else rank[ok]
                        out.append((ask[ok], n[ok], share[ok], np.full(len(of), which), runs[of], rank[ok] - first))
                    none = n == 0
                    nothing = np.zeros(int(none.sum()), np.int64)
                    out.append((ask[none], nothing, nothing * 0.0, nothing, nothing - 1, nothing))
                    got = [np.concatenate(x) for x in zip(*out)]
                    own = [b.column(k).take(pa.array(np.full(len(got[0]), i))) for k in keys]
                    yield pa.RecordBatch.from_arrays(
                        [*own, *(pa.array(g).cast(f.type) for g, f in zip(got, list(schema)[len(keys):]))], schema=schema)
    return run


def rank_search(times: np.ndarray, asked: np.ndarray, ranks: np.ndarray, inclusive: bool) -> np.ndarray:
    """For each question the place of the ``rank``-th element among those of ``times`` that are before ``asked``.

    Halves the places level by level; on each level the times of a half are sorted, so a count is a binary search.
    """
    n = len(times)
    order = np.argsort(times, kind="stable")
    when = np.empty(n, np.int64)
    when[order] = np.arange(n)                                             # rank in time of each place
    upto = np.searchsorted(times[order], asked, "right" if inclusive else "left")
    left = ranks.astype(np.int64).copy()
    node = np.zeros(len(asked), np.int64)
    levels = max(1, int(n - 1).bit_length())
    for level in range(1, levels + 1):
        half = np.sort((np.arange(n) >> (levels - level)) * (n + 1) + when)
        child = node * 2
        inside = np.searchsorted(half, child * (n + 1) + upto) - np.searchsorted(half, child * (n + 1))
        right = left >= inside
        left -= np.where(right, inside, 0)
        node = child + right
    return node


def _pick(inclusive: bool, schema: pa.Schema, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {c: _lists(b, c) for c in ("times", "values", "ask_t", "ask_rank", "ask_n", "ask_share", "ask_which")}
            for i in range(b.num_rows):
                times, values, t, rank, n, share, which = (v[o[i]:o[i + 1]] for v, o in cols.values())
                found = values[rank_search(times, t, rank, inclusive)]
                own = [b.column(k).take(pa.array(np.full(len(t), i))) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [*own, *(pa.array(x).cast(f.type) for x, f in zip((t, n, share, which, found), list(schema)[len(keys):]))],
                    schema=schema)
    return run


def quantile_before(tells: DataFrame, asks: DataFrame, keys: list[str], q: float, inclusive: bool = False,
                    block_days: int = BLOCK_DAYS, run_rows: int = RUN_ROWS) -> DataFrame:
    """``tells``: keys, t, value; ``asks``: keys, t. Per distinct question: keys, t, quantile, n.

    ``n`` values were told before t (up to t if ``inclusive``); the quantile is interpolated between two of them as ``percentile``
    does, and is missing where n is 0. Missing values and times tell and ask nothing; equal values count each.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    block = F.floor(F.col("_t") / F.lit(block_days * 86_400_000_000)).alias("_block")
    told = tells.select(*keys, F.unix_micros("t").alias("_t"), F.col("value").cast("double").alias("value")) \
        .filter(F.col("_t").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    told = in_runs(told, [*keys, "value", "_t"], run_rows).select("*", block)
    asked = asks.select(*keys, F.unix_micros("t").alias("_t")).filter(F.col("_t").isNotNull()).select("*", block)
    by_block = asked.groupBy(*keys, "_block").agg(F.collect_set("_t").alias("ask_t"))

    counts = told.groupBy(*keys, "run", "_block").agg(F.count(F.lit(1)).alias("n")) \
        .groupBy(*keys, "run").agg(F.collect_list(F.struct("_block", "n")).alias("steps"))
    earlier = F.aggregate(F.filter("steps", lambda s: s["_block"] < F.col("_block")), F.lit(0).cast("bigint"), lambda a, s: a + s["n"])
    before = by_block.select(*keys, "_block").join(counts, keys).select(*keys, "_block", "run", earlier.alias("n")).filter("n > 0") \
        .groupBy(*keys, "_block").agg(F.collect_list(F.struct("run", "n")).alias("before"))
    own = told.groupBy(*keys, "_block").agg(F.collect_list(F.struct("_t", "run")).alias("own"))
    plain = by_block.join(before, [*keys, "_block"], "left").join(own, [*keys, "_block"], "left").select(
        *keys, "ask_t", F.col("before.run").alias("before_run"), F.col("before.n").alias("before_n"),
        F.col("own._t").alias("tell_t"), F.col("own.run").alias("tell_run"))

    head = [asked.schema[k] for k in keys]

    def shape(ddl: str):
        from pyspark.sql import types as T
        return T.StructType(head + T.StructType.fromDDL(ddl).fields)
    where = shape("_t bigint, n bigint, share double, which int, run bigint, rank bigint")
    wanted = stage(plain.mapInArrow(_locate(q, inclusive, to_arrow_schema(where), keys), where), "wanted")
    found = shape("_t bigint, n bigint, share double, which int, value double")
    requests = wanted.filter("n > 0").select("*", block).groupBy(*keys, "run", "_block").agg(
        F.collect_list(F.struct("_t", "rank", "n", "share", "which")).alias("a"))
    sorted_run = F.array_sort(F.collect_list(F.struct("_place", "_t", "value")))
    held = told.groupBy(*keys, "run").agg(sorted_run.alias("v"))
    picked = requests.join(held, [*keys, "run"]).select(
        *keys, F.col("v._t").alias("times"), F.col("v.value").alias("values"), F.col("a._t").alias("ask_t"), F.col("a.rank").alias("ask_rank"),
        F.col("a.n").alias("ask_n"), F.col("a.share").alias("ask_share"), F.col("a.which").alias("ask_which")) \
        .mapInArrow(_pick(inclusive, to_arrow_schema(found), keys), found)
    nothing = wanted.filter("n = 0").select(*keys, "_t", "n", "share", "which", F.lit(None).cast("double").alias("value"))
    low, high = F.max(F.when(F.col("which") == 0, F.col("value"))), F.max(F.when(F.col("which") == 1, F.col("value")))
    both = picked.unionByName(nothing).groupBy(*keys, "_t").agg(low.alias("_low"), high.alias("_high"), F.max("n").alias("n"), F.max("share").alias("_s"))
    value = F.when(F.col("_high").isNull(), F.col("_low")).otherwise(F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_s"))
    return both.select(*keys, F.timestamp_micros("_t").alias("t"), value.alias("quantile"), "n")
