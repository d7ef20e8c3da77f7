"""Names, thresholds and layout choices in one immutable place."""

from __future__ import annotations

from dataclasses import dataclass, field

from wattloom.functions import fixed_values as fv


@dataclass(frozen=True)
class Settings:
    # columns
    series: str = "series_id"
    ts: str = "ts"
    power: tuple[str, ...] = ("q1", "q2", "q3", "q4")
    context: tuple[str, ...] = ("production", "temp", "wind", "humidity", "rain")
    delayed: tuple[str, ...] = ("production", "temp", "wind", "humidity", "rain")
    protected: tuple[str, ...] = ("production", "temp", "wind", "humidity", "rain")
    # grid
    step_min: int = fv.STEP_MINUTES
    per_hour: int = fv.STEPS_PER_HOUR
    per_day: int = fv.STEPS_PER_DAY
    per_week: int = fv.STEPS_PER_WEEK
    hours_per_day: int = 24
    # rules
    derived_tol: float = fv.DERIVED_ABS_TOLERANCE
    derived_share: float = fv.DERIVED_MATCH_SHARE
    calendar_share: float = fv.CALENDAR_MATCH_SHARE
    inactive_ratio: float = fv.INACTIVE_DAY_RATIO
    test_fraction: float = fv.TEST_FRACTION
    default_split: dict[int, int] = field(default_factory=lambda: dict(fv.DEFAULT_SPLIT_DATES))
    # evaluation
    forward_folds: int = fv.FORWARD_FOLDS
    fold_days: int = fv.FORWARD_FOLD_DAYS
    window: int = fv.WINDOW_STEPS
    window_rows: int = fv.WINDOW_ROWS
    train_months: int = fv.TRAIN_MONTHS
    fit_share: float = fv.FIT_SHARE
    seeds: tuple[int, ...] = fv.SEEDS
    blend_default: float = fv.BLEND_DEFAULT
    # layout: rows of one series are processed in blocks of this many days, so that a long
    # series becomes many tasks; must be whole days
    block_days: int = 28

    @property
    def step_sec(self) -> int:
        return self.step_min * 60


DEFAULT = Settings()
