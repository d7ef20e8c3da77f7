"""The runs that bind operators together: preprocessing with its record, training, replay."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.functions import fixed_values as fv
from wattloom.operators import features, models, split, tariff
from wattloom.operators.validate import RuleViolation
from wattloom.plans import preprocess, replay, train
from wattloom.session import shared_folder, stage
from wattloom.sources import dimensions, results

T0 = datetime(2024, 1, 1)


def hours(spark, days=40, faults=()):
    r = np.random.default_rng(1)
    rows = []
    for i in range(days * 24):
        day, hour = T0 + timedelta(days=i // 24), i % 24
        if ("gap", i // 24) in faults and hour == 5:
            continue
        hr = 70.0 if ("hour", i // 24) in faults and hour == 3 else float(hour)
        text = "no date" if ("date", i // 24) in faults and hour == 7 else day.strftime("%Y%m%d")
        q = [float(x) for x in r.uniform(10, 90, 4)]
        temp = None if i % 50 == 0 else float(r.integers(-5, 30))
        rows.append(("A", i + 2, text, hr, *q, float(r.integers(1, 400)), temp, float(r.integers(1, 9)), 50.0 + i % 7, 0.5 * (i % 5)))
    return spark.createDataFrame(rows, "series_id string, src_row long, dt string, hr double, q1 double, q2 double, q3 double, q4 double, "
                                       "production double, temp double, wind double, humidity double, rain double")


def audit(spark, folder):
    steps = {r.step: r.metrics for r in spark.read.parquet(f"{folder}/steps").collect()}
    details = {}
    for r in spark.read.parquet(f"{folder}/details").collect():
        details.setdefault(r.step, []).append((r.item, r.value))
    return steps, {k: sorted(v) for k, v in details.items()}


def test_every_rule_is_recorded(spark):
    raw = hours(spark, faults={("hour", 4), ("date", 9), ("gap", 12)})
    out, folder = shared_folder(spark, "features"), shared_folder(spark, "audit")
    table = preprocess.run(raw, out, folder, run_id="r1")
    steps, details = audit(spark, folder)
    assert set(steps) == {"input", "bad_dates", "schema", "calendar", "hours", "incomplete_kept", "bad_hour_days", "time_axis", "leaks",
                          "imputation", "expansion", "segments", "split", "unlabelled"}
    assert steps["input"]["rows"] == "959" and steps["bad_dates"]["rows"] == "1"
    assert steps["bad_hour_days"] == {"days": "1", "rows": "24"}
    assert steps["hours"] == {"good_days": "39", "bad_days": "1", "incomplete_days": "2"}
    assert steps["time_axis"]["gaps"] == "3" and steps["segments"]["segments"] == "4"
    kept = raw.count() - 1 - 24
    assert steps["expansion"] == {"hours": str(kept), "intervals": str(4 * kept), "per_hour": "4"}
    assert steps["unlabelled"] == {"dropped": "4", "rows": str(4 * kept - 4)} and table.count() == 4 * kept - 4
    assert int(steps["split"]["train"]) + int(steps["split"]["test"]) == 4 * kept
    missing, filled, left = (int(steps["imputation"][f"{k}_temp"]) for k in ("missing", "filled", "left"))
    assert missing == filled + left and left == 1
    assert details["bad_hour_days"] == [("A 2024-01-05", "24")]
    assert details["bad_dates"] == [(f"A {9 * 24 + 7 + 2:012d}", "no date")]
    assert [i for i, _ in details["incomplete_kept"]] == ["A 2024-01-10", "A 2024-01-13"]


def test_rules_that_change_nothing_are_recorded_too(spark):
    out, folder = shared_folder(spark, "features"), shared_folder(spark, "audit")
    preprocess.run(hours(spark), out, folder)
    steps, details = audit(spark, folder)
    assert steps["bad_hour_days"] == {"days": "0", "rows": "0"} and steps["bad_dates"] == {"rows": "0"} and steps["leaks"]["dropped"] == "0"
    assert set(details) == {"split"}


def test_faults_stop_the_run_before_anything_is_written(spark):
    raw = hours(spark, 3).withColumn("q1", F.when(F.col("src_row") == 9, -1.0).otherwise(F.col("q1")))
    with pytest.raises(RuleViolation, match="negative_power"):
        preprocess.prepare(raw)
    with pytest.raises(RuleViolation, match="no usable rows"):
        preprocess.prepare(hours(spark, 3).withColumn("dt", F.lit("?")), drop=[])


def test_an_unknown_year_stops_the_tariff(spark):
    holidays = dimensions.load_holidays(spark)
    known = spark.createDataFrame([(datetime(2024, 1, 1, 5),), (datetime(2024, 1, 2, 5),), (None,)], "ts timestamp")
    assert sorted(str(r.is_holiday) for r in tariff.with_holiday(known, holidays).collect()) == ["False", "False", "True"]
    with pytest.raises(Exception, match="no entries for the year 1999"):
        tariff.with_holiday(known.union(spark.createDataFrame([(datetime(1999, 1, 1),)], "ts timestamp")), holidays).collect()


@pytest.fixture(scope="module")
def meter(spark):
    """A meter of seven months whose next value follows from the last ones."""
    n = 96 * 210
    r = np.random.default_rng(4)
    i = np.arange(n)
    kw = 50 + 30 * np.sin(2 * np.pi * i / 96) + 5 * r.standard_normal(n)
    rows = [("A", T0 + timedelta(minutes=15 * int(k)), float(round(v * 64) / 64), float(k % 400), float(k % 30), float(1 + k % 3), float(50 + k % 7),
             float(0.5 * (k % 5))) for k, v in zip(i, kw)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, kw double, production double, temp double, wind double, humidity double, rain double")
    table = stage(split.drop_unlabelled(split.split_by_fraction(features.all_features(df, dimensions.load_holidays(spark)))), "table")
    return table, stage(split.usable_rows(table, window="window"), "usable")


def test_training_and_replay(spark, meter):
    table, usable = meter
    folder, settings = shared_folder(spark, "trained"), results.settings_row(spark)
    quick_tree = lambda rows: models.fit_tree_model(rows, trees=5, depth=6)
    quick_sequence = lambda rows: models.fit_sequence_model(rows, rounds=3, depth=3, seeds=(42, 7))
    done = train.run(usable, folder, settings, fit_tree=quick_tree, fit_sequence=quick_sequence)
    folds = {r.fold for r in done.scores.filter("model = 'tree'").collect()}
    assert "test" in folds and len(folds) == 5
    by = {(r.model, r.fold): r.mse for r in done.scores.collect()}
    best = min((r.test, abs(r.w - 0.5), r.w) for r in done.weights.collect())
    assert by["ensemble", "test"] == pytest.approx(best[0], abs=1e-3) and done.weight == best[2]
    assert by["ensemble", "test"] <= min(by["tree", "test"], by["sequence", "test"]) + 1e-3
    assert [r.rank for r in done.summary.orderBy("rank").collect()] == [1, 2, 3]
    scores, weights, choice = results.load_results(spark, f"{folder}/results")
    assert choice.first()["weight"] == done.weight and weights.count() == 99
    assert {(r.model, r.fold): r.value for r in scores.filter("metric = 'MSE'").collect()} == by

    # the stored models give the predictions of the training run again
    made, weight = replay.forecast(spark, folder, usable, settings)
    told = done.predictions.filter("fold = 'test'").select("ts", F.col("prediction").alias("told"))
    assert weight == done.weight
    assert made.join(told, "ts").agg(F.count("told"), F.max(F.abs(F.col("told") - F.col("prediction")))).first()[1] < 1e-9
    run = replay.run(spark, folder, table, usable, settings, cursors=usable.filter("split = 'test'").select("series_id", "ts").limit(3))
    assert run.briefings.count() == 3 and run.frame.filter("threshold IS NULL").count() == 0
    assert run.frame.count() == told.count()


def test_other_files_or_settings_stop_the_replay(spark, meter):
    _, usable = meter
    folder, settings = shared_folder(spark, "gate"), results.settings_row(spark)
    small = usable.limit(2500)
    models.save_model(models.fit_tree_model(small, trees=2, depth=3), settings, folder)
    results.artefact_gate(spark, folder)
    with pytest.raises(RuleViolation, match="not an ensemble"):
        results.artefact_gate(spark, folder, blended=True)
    spark.range(1).selectExpr("cast(id AS string)").coalesce(1).write.text(f"{folder}/model/more")
    with pytest.raises(RuleViolation, match="unknown file"):
        models.batch_score(spark, folder, settings, usable)


def test_a_prediction_that_is_no_number_stops_the_job(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "prediction double")
    with pytest.raises(Exception, match="not a finite number"):
        models.finite_only(df).collect()


def test_results_document_over_many_lines(spark, tmp_path):
    import json
    doc = {"자료": {"x": 1}, fv.RESULTS_SEARCH: {fv.RESULTS_BY: "test", fv.RESULTS_CHOSEN: 0.47, "주의": "…", fv.RESULTS_TABLE: [
        {fv.RESULTS_WEIGHT: 0.47, fv.RESULTS_FORWARD: 1.5, fv.RESULTS_TEST: 2.5}]},
        fv.RESULTS_FOLDS: {"gru": {"20210401": {"MSE": 69.5481, "RMSE": 8.3, "MAE": 5.8, "R2": 0.97, "bias": -0.5, "rows": 2304, "seeds": [1, 2]}}}}
    (tmp_path / "results.json").write_text(json.dumps(doc, ensure_ascii=False, indent=1), "utf-8")
    scores, weights, choice = results.load_results(spark, str(tmp_path / "results.json"))
    assert {r.metric: r.value for r in scores.collect()}["MSE"] == 69.5481 and tuple(weights.first()) == (0.47, 1.5, 2.5)
    assert tuple(choice.first()) == (0.47, "test")
    only = {k: v for k, v in doc.items() if k != fv.RESULTS_SEARCH}
    (tmp_path / "old.json").write_text(json.dumps(only, ensure_ascii=False), "utf-8")
    assert results.load_results(spark, str(tmp_path / "old.json"))[1].count() == 0


def test_only_columns_with_missing_values_are_searched(spark, monkeypatch):
    """A column without a missing value has nothing to fill; the long table of its values is not sorted for that."""
    from wattloom.operators import impute
    asked, full = [], impute.past_medians
    monkeypatch.setattr(impute, "past_medians", lambda hourly, columns, cfg: (asked.extend(columns), full(hourly, columns, cfg))[1])
    raw = hours(spark, 3)
    raw = raw.withColumns({"temp": F.when(F.col("src_row") % 7 != 0, F.col("src_row") * 0.5), "wind": F.col("src_row") * 0.25})
    run = preprocess.prepare(raw, drop=[], strict=False)
    rows = run.features.collect()
    assert asked == ["temp"] and rows and all(r.wind_lag4 is None or r.wind_lag4 > 0 for r in rows)
