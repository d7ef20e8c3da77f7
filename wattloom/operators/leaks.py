"""Detection of columns that are computed from the power columns or copied from the calendar.

The verdict is about columns, so it is taken over the whole table of all series. The number of
(column, candidate) pairs depends on the schema only, so every result table here is small.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.config import DEFAULT, Settings
from wattloom.functions import fixed_values as fv
from wattloom.operators.validate import RuleViolation

SUM, MEAN, MAX, MIN = "_p_sum", "_p_mean", "_p_max", "_p_min"
CALENDAR_ROWS = 100_000           # rows that a task judges together for the calendar bounds
HELPERS = ("dt", "hr", "day", "hour", "ts", "src_row", "series_id")


def power_aggregates(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Row sum, mean, maximum and minimum of the power columns, missing values skipped.

    The sum of a row without any value is 0, the other three are missing.
    """
    cols = [F.col(c) for c in cfg.power]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    n = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    return df.withColumns({SUM: total, MEAN: F.when(n > 0, total / n),
                           MAX: F.greatest(*cfg.power), MIN: F.least(*cfg.power)})


def other_numeric(df: DataFrame, cfg: Settings = DEFAULT) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in cfg.power
            and f.name not in HELPERS and not f.name.startswith("_")]


@dataclass(frozen=True)
class Candidate:
    """A value built from the power columns and at most one other column."""
    label: str
    base: str
    form: str = "plain"         # plain, ratio, inverse or product of partner and base
    partner: str | None = None

    def value(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        base = columns[self.base]
        if self.form == "plain":
            return base
        other = columns[self.partner]
        if self.form == "product":
            return other * base
        top, bottom = (other, base) if self.form == "ratio" else (base, other)
        return top / np.where(bottom == 0, np.nan, bottom)


def identity_candidates(others: list[str]) -> list[Candidate]:
    """The four aggregates, then ratio, inverse ratio and product with sum and mean per column."""
    out = [Candidate("sum", SUM), Candidate("mean", MEAN), Candidate("max", MAX),
           Candidate("min", MIN)]
    for c in others:
        for name, base in (("sum", SUM), ("mean", MEAN)):
            out += [Candidate(f"{c} / {name}", base, "ratio", c),
                    Candidate(f"{name} / {c}", base, "inverse", c),
                    Candidate(f"{c} * {name}", base, "product", c)]
    return out


def match_rates(df: DataFrame, cfg: Settings = DEFAULT, others: list[str] | None = None) -> DataFrame:
    """For every pair: compared rows, share within tolerance, largest difference.

    ``n`` rows of the pair are those where both values are present and finite. Each Arrow batch is
    reduced to one row per pair inside the task (hundreds of comparisons per row are much cheaper
    on arrays than as expressions); only these partial counts are shuffled.
    """
    others = others or other_numeric(df, cfg)
    cands = identity_candidates(others)
    tol = cfg.derived_tol
    columns = others + [SUM, MEAN, MAX, MIN]

    def partial(batches):
        for pdf in batches:
            values = {c: pdf[c].to_numpy("float64", na_value=np.nan) for c in columns}
            with np.errstate(all="ignore"):
                table = np.stack([cand.value(values) for cand in cands])
                for c in others:
                    diff = np.abs(table - values[c])
                    ok = np.isfinite(diff)
                    yield pd.DataFrame({
                        "column": c, "order": np.arange(len(cands)), "n": ok.sum(axis=1),
                        "hits": (ok & (diff <= tol)).sum(axis=1), "total": len(pdf),
                        "worst": np.where(ok, diff, -1.0).max(axis=1, initial=-1.0)})

    narrow = power_aggregates(df, cfg).select(*[F.col(c).cast("double") for c in columns])
    parts = narrow.mapInPandas(partial, "column string, order long, n long, hits long, total long, worst double")
    names = [[c.label, c.partner or c.label, str(c.partner is not None)] for c in cands]
    at = F.element_at(F.array(*[F.array(*[F.lit(w) for w in n]) for n in names]),
                      (F.col("order") + 1).cast("int"))
    stats = (parts.groupBy("column", "order").agg(
        F.sum("n").alias("rows"), (F.sum("hits") / F.nullif(F.sum("n"), F.lit(0))).alias("rate"),
        F.max("worst").alias("max_diff"), F.sum("total").alias("total")).withColumn("_c", at))
    partner = F.when(F.col("_c")[2] == "True", F.col("_c")[1])
    return (stats.select("column", "order", F.col("_c")[0].alias("candidate"),
                         partner.alias("partner"), "rows", "rate", "max_diff", "total")
            .filter((F.col("rows") > 0)
                    & (F.col("partner").isNull() | (F.col("partner") != F.col("column")))))


def first_hits(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Per column the first candidate that matches well enough on enough rows."""
    enough = F.col("rows") >= F.greatest(F.lit(float(fv.DERIVED_MIN_ROWS)),
                                         F.col("total") * fv.DERIVED_MIN_SHARE)
    hits = match_rates(df, cfg).filter(enough & (F.col("rate") >= cfg.derived_share))
    w = Window.partitionBy("column").orderBy("order")
    return (hits.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
            .drop("_rn", "total", "order"))


def null_fingerprint(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Is a column missing exactly where the power sum or mean is 0 (the mark of a division)."""
    others = other_numeric(df, cfg)
    zero = F.coalesce(F.col(SUM) == 0, F.lit(False)) | F.coalesce(F.col(MEAN) == 0, F.lit(False))
    aggs = [F.struct(F.lit(c).alias("column"),
                     (F.bool_or(F.col(c).isNull())
                      & F.bool_and(F.col(c).isNull() == zero)).alias("fingerprint"))
            for c in others]
    return power_aggregates(df, cfg).agg(F.array(*aggs).alias("_a")).select(F.inline("_a"))


def resolve_drop(hits: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Which column goes. Without a partner the column itself goes, protected or not."""
    own = F.col("column").isin(*cfg.protected)
    other = F.coalesce(F.col("partner").isin(*cfg.protected), F.lit(False))
    decision = (F.when(F.col("partner").isNull(), "drop_column")
                .when(own & other, "ask_human").when(own, "drop_partner").otherwise("drop_column"))
    return (hits.withColumn("decision", decision)
            .withColumn("dropped", F.when(F.col("decision") == "drop_column", F.col("column"))
                        .when(F.col("decision") == "drop_partner", F.col("partner"))))


def _calendar_key(name: str) -> Column:
    return {"hour": F.col("hour"), "month": F.month("day"), "dayofweek": F.weekday("day"),
            "date": F.unix_seconds("day")}[name].cast("long")


def _chunk_modes(key: np.ndarray, code: np.ndarray, distinct: int) -> int:
    """Sum over the keys of the count of their most frequent value; ``code`` numbers the values from 0, -1 is missing."""
    known = code >= 0
    if not known.any():
        return 0
    pairs, n = np.unique(key[known] * distinct + code[known], return_counts=True)
    of = pairs // distinct
    return int(np.maximum.reduceat(n, np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))).sum())


def _chunk_bounds(n_keys: int, columns: int, chunk_rows: int):
    """Rows that agree per cell (column, calendar key) within chunks of some ``chunk_rows`` rows, and the ends of each column."""
    def summary(batches):
        rows, held, cells = 0, [], n_keys * columns
        total, agree, ends = 0, np.zeros(cells, np.int64), np.full((columns, 2), np.nan)

        def judge(chunk: list[list[np.ndarray]]) -> None:
            keys = [np.unique(np.concatenate(k), return_inverse=True)[1] for k in chunk[:n_keys]]
            for i, parts in enumerate(chunk[n_keys:]):
                values = np.concatenate(parts)
                known = ~np.isnan(values)
                if not known.any():
                    continue
                found, place = np.unique(values[known] + 0.0, return_inverse=True)          # -0.0 becomes 0.0
                code = np.full(len(values), -1, np.int64)
                code[known] = place
                ends[i] = np.fmin(ends[i, 0], found[0]), np.fmax(ends[i, 1], found[-1])
                for o, key in enumerate(keys):
                    agree[i * n_keys + o] += _chunk_modes(key, code, len(found))
        for pdf in batches:
            if not held:
                held = [[] for _ in range(n_keys + columns)]
            for o in range(n_keys):
                held[o].append(pdf[f"_k{o}"].to_numpy("int64"))
            for i in range(columns):
                held[n_keys + i].append(pdf[f"_v{i}"].to_numpy("float64", na_value=np.nan))
            rows += len(pdf)
            if rows >= chunk_rows:
                judge(held)
                total, rows, held = total + rows, 0, []
        if rows:
            judge(held)
            total += rows
        if total:
            yield pd.DataFrame({"cell": np.arange(cells), "agree": agree, "rows": total,
                                "lo": np.repeat(ends[:, 0], n_keys), "hi": np.repeat(ends[:, 1], n_keys)})
    return summary


def calendar_bounds(df: DataFrame, columns=None, cfg: Settings = DEFAULT, chunk_rows: int = CALENDAR_ROWS) -> DataFrame:
    """Per (column, calendar key) an upper bound of the agreement: cell, high, varies.

    The rows that agree within chunks of rows, each chunk with most frequent values of its own, are at least as many as those
    that agree over the whole table. So a task holds one chunk at a time and leaves one row per cell.
    """
    columns = columns or other_numeric(df, cfg)
    narrow = df.select(*[_calendar_key(k).alias(f"_k{o}") for o, k in enumerate(fv.CALENDAR_KEYS)],
                       *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    parts = narrow.mapInPandas(_chunk_bounds(len(fv.CALENDAR_KEYS), len(columns), chunk_rows), "cell long, agree long, rows long, lo double, hi double")
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    return parts.groupBy("cell").agg((F.sum("agree") / F.sum("rows")).alias("high"),
                                     F.coalesce(F.min(known("lo")) < F.max(known("hi")), F.lit(False)).alias("varies"))


def _counted_agreement(df: DataFrame, columns, cells: list[int]) -> DataFrame:
    """(cell, agreement) of some cells by counting all their values."""
    n_keys = len(fv.CALENDAR_KEYS)
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).cast("long").alias("cell"), _calendar_key(fv.CALENDAR_KEYS[c % n_keys]).alias("at"),
                 F.nanvl(F.col(columns[c // n_keys]).cast("double"), F.lit(None)).alias("value"))
        for c in cells])).alias("_c")).select("_c.*")
    per_key = pairs.groupBy("cell", "at", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("cell", "at").agg(
        F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("mode_n"), F.sum("n").alias("n"))
    return per_key.groupBy("cell").agg((F.coalesce(F.sum("mode_n"), F.lit(0)) / F.sum("n")).alias("agreement"))


def calendar_determined(df: DataFrame, columns=None, cfg: Settings = DEFAULT, at_least: float | None = None,
                        chunk_rows: int = CALENDAR_ROWS) -> DataFrame:
    """Per (column, calendar key): share of rows that equal the most frequent value of their key.

    All values are counted, by grouping. With ``at_least``, pairs whose upper bound lies below it and columns that do not
    vary are ruled out without counting and left out of the result. Missing values (and NaN) count as disagreement.
    """
    columns = columns or other_numeric(df, cfg)
    n_keys = len(fv.CALENDAR_KEYS)
    schema = "column string, order long, key string, agreement double, varies boolean"
    found = calendar_bounds(df, columns, cfg, chunk_rows).collect()        # one row per column and key
    if at_least is not None:
        found = [r for r in found if r["varies"] and r["high"] >= at_least]
    cells = sorted(r["cell"] for r in found)
    agreement = {r["cell"]: r["agreement"] for r in _counted_agreement(df, columns, cells).collect()} if cells else {}
    rows = [(columns[r["cell"] // n_keys], r["cell"] % n_keys, fv.CALENDAR_KEYS[r["cell"] % n_keys], float(agreement[r["cell"]]),
             r["varies"]) for r in found]
    return df.sparkSession.createDataFrame(rows, schema)


def calendar_hits(df: DataFrame, columns=None, cfg: Settings = DEFAULT) -> DataFrame:
    """First calendar key that determines a column; constant columns are not judged."""
    w = Window.partitionBy("column").orderBy("order")
    return (calendar_determined(df, columns, cfg, cfg.calendar_share)
            .filter(F.col("varies") & (F.col("agreement") >= cfg.calendar_share))
            .withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
            .select("column", "key", "agreement"))


def calendar_identity(df: DataFrame, columns=None, cfg: Settings = DEFAULT) -> DataFrame:
    """First calendar number that a column equals on every row."""
    columns = columns or other_numeric(df, cfg)
    forms = [("dayofweek+1", F.weekday("day") + 1), ("dayofweek", F.weekday("day")),
             ("day of month", F.dayofmonth("day")), ("month", F.month("day")),
             ("year", F.year("day"))]
    def first(c: str) -> Column:
        same = [F.when(F.bool_and(F.col(c).eqNullSafe(e.cast("double"))), F.lit(n))
                for n, e in forms]
        return F.struct(F.lit(c).alias("column"), F.coalesce(*same).alias("identity"))
    return (df.agg(F.array(*[first(c) for c in columns]).alias("_a"))
            .select(F.inline("_a")).filter(F.col("identity").isNotNull()))


def drop_list(df: DataFrame, cfg: Settings = DEFAULT) -> list[str]:
    """Sorted names of all columns to drop. Only names travel to the driver."""
    verdicts = resolve_drop(first_hits(df, cfg), cfg).select("column", "decision", "dropped").collect()
    ask = sorted(v["column"] for v in verdicts if v["decision"] == "ask_human")
    if ask:
        raise RuleViolation(f"identity between two protected inputs, decide by hand: {ask}")
    found = {v["dropped"] for v in verdicts}
    left = [c for c in other_numeric(df, cfg) if c not in found]
    if left:
        found |= {r["column"] for r in calendar_hits(df, left, cfg).select("column").collect()}
    left = [c for c in left if c not in found]
    if left:
        found |= {r["column"] for r in calendar_identity(df, left, cfg).select("column").collect()}
    return sorted(found)


def drop_leaks(df: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    return df.drop(*drop_list(df, cfg))
