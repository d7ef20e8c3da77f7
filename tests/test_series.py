"""Segments, features, windows, thresholds and staffing on miniature frames."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings as hsettings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import T0, at_minutes, column, readings
from wattloom.config import DEFAULT, Settings
from wattloom.operators import asof, evaluate, features, reshape, split, staffing
from wattloom.operators.running import earlier_quantile
from wattloom.operators.validate import RuleViolation
from wattloom.sources import dimensions


# -- segments ------------------------------------------------------------------------------

def test_every_other_step_splits(spark):
    df = reshape.add_segments(at_minutes(spark, [0, 15, 45, 55, 70]))
    assert column(df, "segment") == [1, 1, 2, 3, 3]


def test_only_long_steps_are_reported_as_gaps(spark):
    df = at_minutes(spark, [0, 15, 45, 55, 70, 60 * 24 * 90])
    assert [r.ts for r in reshape.gap_starts(df).orderBy("n").collect()] == [
        T0 + timedelta(minutes=45), T0 + timedelta(days=90)]


def broken(spark, n=3000, seed=1):
    """Long readings with gaps, off-grid steps and missing values over many blocks."""
    rng, rows, at = random.Random(seed), [], 0
    for i in range(n):
        rows.append(("A" if i % 7 else "B", T0 + timedelta(minutes=at), None if rng.random() < .01 else float(rng.randrange(400)) / 4))
        at += 15 if rng.random() > .004 else rng.choice([5, 10, 30, 60, 60 * 24 * 40])
    a = [("A", *r[1:]) for r in rows]
    b = [("B", r[1] + timedelta(minutes=7), r[2]) for r in rows[: n // 3]]
    return spark.createDataFrame(a + b, "series_id string, ts timestamp, kw double")


@pytest.mark.parametrize("days", [1, 3])
def test_block_size_changes_nothing(spark, days):
    """Small blocks with halo give exactly what one block per series gives."""
    df = broken(spark).cache()
    one, many = Settings(block_days=100_000), Settings(block_days=days)
    for build in (lambda c: features.segment_features(df, None, c).drop("kw_std4"),
                  lambda c: reshape.add_segments(df, c), lambda c: split.window_ok(df, c),
                  lambda c: reshape.gap_starts(df, c)):
        a, b = build(one), build(many)
        assert a.count() == b.count()
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


# -- features ------------------------------------------------------------------------------

def test_lag1_is_now_but_lag16_is_a_true_shift(spark):
    df = features.segment_features(readings(spark, range(20)), ["kw_lag1", "kw_lag2", "lag16", "y"]).orderBy("ts")
    last = df.collect()[18]
    assert (last.kw, last.kw_lag1, last.kw_lag2, last.lag16, last.y) == (18, 18, 17, 2, 19)


def test_one_missing_value_empties_its_windows(spark):
    df = features.segment_features(readings(spark, [1, 2, None, 4, 5, 6, 7]), ["kw_roll4", "y"])
    assert column(df, "kw_roll4") == [None] * 6 + [5.5]
    assert column(df, "y") == [2, None, 4, 5, 6, 7, None]


def test_sample_deviation(spark):
    df = features.segment_features(readings(spark, [1, 2, 3, 4]), ["kw_std4"])
    assert column(df, "kw_std4")[-1] == pytest.approx(np.std([1, 2, 3, 4], ddof=1))


def test_first_day_is_inactive(spark):
    values = [10.0] * 96 + [10.0] * 96 + [0.5] * 96 + [10.0] * 96
    df = readings(spark, values)
    days = features.activity(features.day_active(features.daily_energy(df))).orderBy("date").collect()
    assert [d.active for d in days] == [False, True, False, True]
    assert [d.days_since_active for d in days] == [0, 1, 0, 1]
    assert [d.prev_day_active for d in days] == [1, 0, 1, 0]


def test_absent_days_are_not_counted(spark):
    df = readings(spark, [5.0] * 96).unionByName(readings(spark, [5.0] * 96, T0 + timedelta(days=9)))
    days = features.activity(features.day_active(features.daily_energy(df))).orderBy("date").collect()
    assert [d.days_since_active for d in days] == [0, 1]


@pytest.mark.parametrize("cut", [500, 1400])
def test_features_do_not_look_ahead(spark, cut):
    """Changing all values after a time changes no feature at or before it (y excepted)."""
    values = [float(random.Random(5).randrange(400)) for _ in range(2000)]
    a = readings(spark, values)
    b = a.withColumn("kw", F.when(F.col("ts") > T0 + timedelta(minutes=15 * cut), F.col("kw") * 3 + 1).otherwise(F.col("kw")))
    hol = dimensions.load_holidays(spark)
    early = [features.all_features(d, hol).drop("y").filter(F.col("ts") <= T0 + timedelta(minutes=15 * cut)) for d in (a, b)]
    assert early[0].exceptAll(early[1]).isEmpty() and early[0].count() == cut + 1


# -- split and windows ---------------------------------------------------------------------

def test_fraction_is_cut_in_floating_point(spark):
    for n in (3, 7, 10, 30):
        df = split.with_date_key(readings(spark, range(n), step=1440))
        first = split.split_by_fraction(df).filter("split = 'test'").agg(F.min("ts")).first()[0]
        assert (first - T0).days == int(n * (1 - 0.3))


@pytest.mark.parametrize("f", [0, 1, -1, 2])
def test_fraction_range(spark, f):
    with pytest.raises(RuleViolation):
        split.split_by_fraction(split.with_date_key(readings(spark, range(4))), f)


def test_missing_value_breaks_the_windows_of_the_labelled_axis(spark):
    """A missing value at t takes away the label of t-1, whose row then breaks the windows."""
    values = [1.0] * 300
    values[100] = None
    table = split.drop_unlabelled(features.segment_features(readings(spark, values), ["y"]))
    ok = {r.ts for r in split.window_ok(table).filter("window_ok").collect()}
    index = sorted(int((t - T0).total_seconds() // 900) for t in ok)
    assert index == list(range(95, 99)) + list(range(196, 299))


def test_repeated_time_stops_the_window_check(spark):
    from pyspark.errors import PySparkException
    df = readings(spark, range(120))
    with pytest.raises(PySparkException, match="repeated time"):
        split.window_ok(df.unionByName(df.limit(1))).collect()


def test_window_is_taken_before_rows_are_filtered(spark):
    table = split.drop_unlabelled(features.segment_features(readings(spark, range(400)), ["y"]))
    table = table.withColumn("extra", F.when(F.col("kw") % 10 != 0, 1.0))
    rows = split.usable_rows(table, ["kw", "y", "extra"], window="window")
    assert rows.count() == len([i for i in range(95, 399) if i % 10])
    r = rows.filter("kw = 101").first()
    assert [x for part in r.window for x in part] == [float(v) for v in range(6, 102)]


def test_folds_fit_into_the_training_part(spark):
    rows = [("A", datetime(2021, 1, 10) + timedelta(days=i), 1.0) for i in range(200)]
    df = split.with_date_key(spark.createDataFrame(rows, "series_id string, ts timestamp, kw double"))
    df = split.split_by_date(df, 20210625)      # last training row: 24 June, midnight
    got = sorted((r.lo, r.hi) for r in split.forward_folds(df).collect())
    assert got == [(20210301, 20210325), (20210401, 20210425), (20210501, 20210525), (20210601, 20210625)]
    short = split.split_by_date(df.drop("split"), 20210624)
    assert max(r.lo for r in split.forward_folds(short).collect()) == 20210501


# -- evaluation ----------------------------------------------------------------------------

def test_score_of_constant_target_has_no_r2(spark):
    df = spark.createDataFrame([("m", 2.0, 1.0), ("m", 2.0, 4.0)], "model string, y double, prediction double")
    r = evaluate.score(df, ["model"]).first()
    assert (r.mse, r.rmse, r.mae, r.r2, r.bias) == (2.5, 1.5811, 1.5, None, -0.5)


def test_blend_tie_goes_to_the_weight_nearest_one_half(spark):
    rows = [("A", w / 100, 5.0, 3.0 if w in (30, 45, 55, 80) else 4.0) for w in range(1, 100)]
    table = spark.createDataFrame(rows, "series_id string, w double, forward double, test double")
    r = evaluate.blend_pick(table, ["series_id"]).first()
    assert (r.weight, r.other_weight, r.test, r.alt_weight) == (0.45, 0.55, 3.0, 0.5)


def test_moments_give_the_grid(spark):
    rng = np.random.default_rng(3)
    y, a, b = rng.normal(size=(3, 60)) * 10
    rows = [("A", "f" if i < 20 else "g" if i < 40 else "test", *map(float, v)) for i, v in enumerate(zip(y, a, b))]
    df = spark.createDataFrame(rows, "series_id string, fold string, y double, a double, b double")
    got = {round(r.w, 2): (r.forward, r.test) for r in evaluate.blend_search(df, ["series_id"]).collect()}
    for w in (0.01, 0.37, 0.99):
        e = (y - (w * a + (1 - w) * b)) ** 2
        assert got[w][0] == pytest.approx((e[:20].mean() + e[20:40].mean()) / 2, abs=1e-4)
        assert got[w][1] == pytest.approx(e[40:].mean(), abs=1e-4)


def test_blend_weight_range(spark):
    with pytest.raises(RuleViolation):
        evaluate.blend(spark.range(1), 1.2)


# -- running quantile ----------------------------------------------------------------------

@hsettings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-40, 40)), max_size=60), st.sampled_from([0.5, 0.9]))
def test_running_quantile_is_exact(values, q):
    v = np.array([np.nan if x is None else x / 4 for x in values])
    out, seen = earlier_quantile(v, q)
    for i in range(len(v)):
        past = v[:i][~np.isnan(v[:i])]
        assert seen[i] == len(past)
        if len(past):
            assert out[i] == pytest.approx(np.quantile(past, q))
        else:
            assert math.isnan(out[i])


# -- thresholds ----------------------------------------------------------------------------

def observed(spark, kw, start=T0, error=1.0):
    """Prediction of the next value is that value minus ``error``."""
    rows = [("A", start + timedelta(minutes=15 * i), float(kw[i]), float(kw[i + 1]), float(kw[i + 1]) - error)
            for i in range(len(kw) - 1)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, kw double, y double, prediction double")
    return df.withColumns({"target_time": F.col("ts") + F.expr("interval 15 minutes"),
                           "day_key": F.date_format("ts", "yyyy-MM-dd")})


def test_peak_starts_anew_each_year_and_keeps_its_first_time(spark):
    df = observed(spark, [5, 9, 9, 3, 4, 4, 2], datetime(2021, 12, 31, 23, 0))
    rows = asof.annual_peak_to_date(df).orderBy("ts").collect()
    assert [r.annual_peak for r in rows] == [5, 9, 9, 9, 4, 4]
    assert rows[3].annual_peak_time == datetime(2021, 12, 31, 23, 15)
    assert rows[4].coverage_start == datetime(2022, 1, 1)


def test_thirty_errors_switch_the_margin(spark):
    rows = asof.peak_recommendation(observed(spark, [100] * 40)).orderBy("ts").collect()
    assert [r.error_samples for r in rows] == list(range(39))
    assert (rows[29].error_margin, rows[29].basis) == (5.0, "peak_share")
    assert (rows[30].error_margin, rows[30].basis) == (1.0, "quantile")
    assert rows[30].threshold == 99.0


def test_errors_belong_to_the_year_of_their_target(spark):
    rows = asof.peak_recommendation(observed(spark, [50] * 9, datetime(2021, 12, 31, 23, 0))).orderBy("ts").collect()
    assert [r.error_samples for r in rows] == [0, 1, 2, 3, 1, 2, 3, 4]


def test_threshold_is_at_least_one(spark):
    assert asof.peak_recommendation(observed(spark, [0.2] * 3)).first().threshold == 1.0


def test_asof_does_not_look_ahead(spark):
    rng = random.Random(2)
    a = observed(spark, [rng.randrange(400) for _ in range(200)])
    cut = T0 + timedelta(minutes=15 * 120)
    b = a.withColumns({c: F.when(F.col("ts") > cut, F.col(c) * 2 + 50).otherwise(F.col(c)) for c in ("kw", "prediction")})
    b = b.withColumn("y", F.when(F.col("ts") >= cut, F.col("y") * 2 + 50).otherwise(F.col("y")))
    out = [asof.briefing_facts(asof.peak_recommendation(d)).filter(F.col("ts") <= cut) for d in (a, b)]
    assert out[0].exceptAll(out[1]).isEmpty() and out[0].count() == 121


def test_day_points_across_a_gap(spark):
    df = observed(spark, [1, 2, 3, 4, 5, 6]).filter(F.col("kw") != 3)
    got = [(r.time.minute, r.actual, r.predicted) for r in asof.day_points(df).orderBy("time").collect()]
    assert got == [(0, 1, None), (15, 2, 1), (45, 4, None), (0, 5, 4), (15, None, 5)]


def test_newest_alerts_first_and_at_most_twenty(spark):
    frame = asof.alert_threshold(observed(spark, [500] * 40), 100)
    last = asof.alerts(frame).filter(F.col("now") == T0 + timedelta(minutes=15 * 38)).orderBy("rank").collect()
    assert len(last) == 20 and last[0].time == T0 + timedelta(minutes=15 * 38) and last[0].excess == 399.0


# -- staffing ------------------------------------------------------------------------------

def history(spark, rows):
    return spark.createDataFrame([("A", t, dt, float(p), float(s), True) for t, dt, p, s in rows],
                                 "series_id string, ts timestamp, day_type string, production double, staff double, "
                                 "staff_valid boolean")


def test_staff_tie_goes_to_the_newest(spark):
    at = lambda d: datetime(2021, 3, d, 8)
    h = history(spark, [(at(1), "work", 10, 2.2), (at(2), "work", 10, 2.9), (at(3), "work", 30, 2.5), (at(4), "off", 10, 1.0)])
    ask = spark.createDataFrame([("A", at(5), "work", 10.0), ("A", at(5), "work", 31.0), ("A", at(2), "work", 5.0)],
                                "series_id string, ts timestamp, day_type string, target double")
    got = {(r.ts.day, r.target): (r.matches, r.staff_ref, r.ref_ts and r.ref_ts.day, r.ref_staff)
           for r in staffing.match_status(staffing.staff_match(ask, h)).collect()}
    assert got[(5, 10.0)] == (3, 3, 2, 2.9)
    assert got[(5, 31.0)] == (0, None, None, None)
    assert got[(2, 5.0)] == (1, 3, 1, 2.2)


@pytest.mark.parametrize("run_rows", [4096, 5])
def test_staff_match_equals_brute_force(spark, run_rows):
    rng = random.Random(8)
    hist = [(datetime(2021, 1, 1, h) + timedelta(days=d), rng.choice(["work", "off"]), rng.randrange(12), rng.randrange(1, 40) / 4)
            for d in range(60) for h in (7, 8)]
    asks = [("A", datetime(2021, 1, 1, rng.choice([7, 8])) + timedelta(days=rng.randrange(70)), rng.choice(["work", "off"]),
             float(rng.randrange(14))) for _ in range(300)]
    ask = spark.createDataFrame(asks, "series_id string, ts timestamp, day_type string, target double")
    got = {(r.ts, r.day_type, r.target): (r.matches, r.staff_ref, r.ref_ts) for r in
           staffing.staff_match(ask, history(spark, hist), run_rows=run_rows).collect()}
    for _, ts, kind, target in asks:
        day = ts.replace(hour=0)
        found = [x for x in hist if x[0] < day and x[0].hour == ts.hour and x[1] == kind and x[2] >= target]
        best = min(found, key=lambda x: (math.ceil(x[3]), x[2], -x[0].timestamp())) if found else None
        assert got[(ts, kind, target)] == (len(found), math.ceil(best[3]) if best else None, best[0] if best else None)


def test_runs_become_python_objects_piece_by_piece():
    """A batch of many runs is taken apart in order; a piece is one run or holds few elements."""
    own = [[{"production": 1.0, "staff": 1.0, "_when": i}] * (i % 7) for i in range(200)]
    seen = [None if i % 3 else [[1.0] * 5, [2.0] * (i % 11)] for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(own, pa.list_(pa.struct({"production": pa.float64(),
                                       "staff": pa.float64(), "_when": pa.int64()}))), pa.array(seen, pa.list_(pa.list_(pa.float64())))],
                                       names=["i", "own", "seen"])
    size = lambda i: 1 + len(own[i]) + sum(len(x) + 1 for x in seen[i] or ())
    pieces = [p.column("i").to_pylist() for p in staffing._pieces([batch.slice(7), batch.slice(0, 0)], "own", "seen", most=30)]
    assert [i for p in pieces for i in p] == list(range(7, 200))
    assert all(len(p) == 1 or sum(map(size, p)) <= 30 for p in pieces) and len(pieces) > 20


def test_scenario_keeps_requests_without_a_position(spark):
    frame = observed(spark, [10, 20, 30])
    ask = spark.createDataFrame([("A", "2021-03-01", c, 2, 1, 100.0, 3.0, 2.0) for c in (0, 1, 7)],
                                "series_id string, day_key string, cursor long, staff int, baseline_staff int, "
                                "hourly_wage double, energy_rate double, power_factor double")
    got = staffing.scenario_cost(ask, frame).orderBy("cursor").collect()
    assert [(r.found, r.energy, r.baseline_total, r.scenario_total) for r in got] == [
        (True, 28.0, 54.0, 78.0), (True, 44.0, 68.0, 94.0), (False, None, None, None)]


def test_money_is_rounded_half_to_even(spark):
    df = spark.createDataFrame([("A", datetime(2021, 2, 1), 1, 0.125, 0.0, 0.0)],
                               "series_id string, ts timestamp, staff_ref int, wage double, prediction double, rate double")
    assert staffing.interval_cost(df, peak_kw=0).first().labor == 0.12


def test_briefing_sentences_follow_the_state(spark):
    facts = asof.briefing_facts(asof.risk_state(asof.alert_threshold(
        asof.annual_peak_to_date(observed(spark, [100] * 6)).withColumns(
            {"error_margin": F.lit(0.0), "basis": F.lit("peak_share")}), 99)))
    texts = column(asof.briefing_text(facts), "text")
    assert "도달할 것으로" in texts[0] and "확정 자료가 없어요" in texts[0]
    assert "평균 예측 오차는 1.0 kW" in texts[1] and len(texts[0].split("\n\n")) == 4


def test_settings_stay_consistent():
    assert DEFAULT.per_day == 24 * DEFAULT.per_hour and DEFAULT.per_week == 7 * DEFAULT.per_day
    assert DEFAULT.window % DEFAULT.window_rows == 0
