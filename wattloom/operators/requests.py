"""Range rules for cost and scenario requests, applied to a table of requests."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.operators.validate import require_columns


@dataclass(frozen=True)
class Range:
    """One rule: a finite number inside a range, or missing where that is allowed."""
    column: str
    low: float
    high: float | None = None
    open_low: bool = False
    optional: bool = False

    def broken(self) -> Column:
        c = F.col(self.column).cast("double")
        low = c > self.low if self.open_low else c >= self.low
        ok = low & ~F.isnan(c) & (c < math.inf)
        if self.high is not None:
            ok = ok & (c <= self.high)
        return ~F.coalesce(ok, F.lit(self.optional) & F.col(self.column).isNull())


# fixed values: accepted ranges of request fields
SNAPSHOT = (Range("cursor", 0), Range("threshold", 0, 10000, open_low=True, optional=True))
SCENARIO = (Range("cursor", 0), Range("production", 0, 100000), Range("staff", 0, 10000),
            Range("hourly_wage", 0, 1000000), Range("energy_rate", 0, 100000),
            Range("power_factor", 0, 10000, open_low=True), Range("baseline_staff", 0, 10000))
STAFFING = (Range("cursor", 0), Range("planned_production", 0, 1000000),
            Range("unit_price", 0, 1000000, optional=True),
            Range("day_wage", 0, 1000000, open_low=True, optional=True),
            Range("energy_rate", 0, 100000, optional=True),
            Range("base_rate", 0, 1000000, optional=True),
            Range("billing_peak", 0, 1000000, optional=True))
RATES = (Range("rate", 0, 100000),)


def validate_params(requests: DataFrame, rules) -> DataFrame:
    """Add ``reasons`` (names of the broken fields) and ``accepted``; no row is dropped."""
    require_columns(requests, [r.column for r in rules])
    reasons = F.array_compact(F.array(*[F.when(r.broken(), r.column) for r in rules]))
    return requests.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0)


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter("accepted").drop("accepted", "reasons")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.filter("not accepted").drop("accepted")
