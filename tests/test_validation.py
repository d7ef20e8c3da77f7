"""Rules of the raw hourly table."""

import math
import tracemalloc
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.errors import PySparkException

from helpers import raw_hours
from wattloom.config import Settings
from wattloom.functions import fixed_values as fv
from wattloom.operators import impute, leaks, requests, reshape, validate
from wattloom.operators.validate import RuleViolation
from wattloom.plans import preprocess
from wattloom.sources import dimensions, raw, results


def day(dt, hours=range(24), kw=1.0):
    return [(dt, float(h), kw, kw, kw, kw) for h in hours]


def test_missing_column_is_an_error(spark):
    with pytest.raises(RuleViolation, match="q4"):
        validate.ingest(raw_hours(spark, day("20210301")).drop("q4"))


def test_text_that_is_no_number_is_an_error_not_null(spark):
    df = raw_hours(spark, day("20210301")).withColumn("q1", F.lit("1,5"))
    with pytest.raises(PySparkException):
        validate.strict_numeric(df, ["q1"]).collect()
    blank = df.withColumn("q1", F.lit(" "))
    assert {r.q1 for r in validate.strict_numeric(blank, ["q1"]).collect()} == {None}


@pytest.mark.parametrize("bad", [math.inf, -math.inf, -0.5])
def test_infinite_and_negative_power_stop_the_run(spark, bad):
    with pytest.raises(RuleViolation):
        validate.ingest(raw_hours(spark, day("20210301") + [("20210302", 0.0, 1.0, bad, 1.0, 1.0)]))


def test_negative_rule_sees_rows_with_bad_dates(spark):
    with pytest.raises(RuleViolation):
        validate.ingest(raw_hours(spark, [("no date", 0.0, -1.0, 1.0, 1.0, 1.0)]))


def test_nan_becomes_null(spark):
    df = validate.ingest(raw_hours(spark, [("20210301", 0.0, math.nan, 1.0, 1.0, 1.0)]))
    assert df.first().q1 is None


def test_mixed_dates(spark):
    texts = ["20210105.0", "20210105", "2021-01-05", "2021-13-01", "2021/01/05", "2021-01-05 07:30:00", None, "x"]
    df = spark.createDataFrame([(t,) for t in texts], "dt string")
    got = [r.day for r in validate.with_date(df).collect()]
    d = datetime(2021, 1, 5)
    assert got == [d, d, d, None, d, datetime(2021, 1, 5, 7, 30), None, None]


def test_a_date_with_a_time_is_its_own_day(spark):
    rows = day("20210301", range(12)) + day("2021-03-01 00:30:00", range(12, 24))
    q = validate.hour_quality(validate.with_date(raw_hours(spark, rows)))
    assert q.count() == 2


def test_hour_quality(spark):
    rows = (day("20210301") + day("20210302", range(23)) + day("20210303", [0, 1, 1])
            + day("20210304", [0.5, 1]) + day("20210305", [24]) + day("20210306", [math.nan, 1]))
    q = {r.day.day: (r.hours_ok, r.complete) for r in
         validate.hour_quality(validate.with_date(raw_hours(spark, rows))).collect()}
    assert q == {1: (True, True), 2: (True, False), 3: (False, False), 4: (False, False),
                 5: (False, False), 6: (False, False)}


def test_bad_days_go_incomplete_days_stay(spark):
    rows = day("20210301") + day("20210302", range(23)) + day("20210303", range(70, 94))
    clean = preprocess.clean_hourly(raw_hours(spark, rows))
    assert clean.count() == 47
    dated = validate.with_date(raw_hours(spark, rows))
    q = validate.hour_quality(dated)
    assert [r.day.day for r in validate.incomplete_days(q).collect()] == [2]
    detail = validate.bad_hour_detail(dated, q).first()
    assert detail.hours == [70.0 + i for i in range(8)] and detail.complete


def test_duplicate_hours_are_an_error(spark):
    hourly = preprocess.clean_hourly(raw_hours(spark, day("20210301")))
    with pytest.raises(RuleViolation, match="2021-03-01"):
        validate.reject_duplicate_ts(hourly.unionByName(hourly))


def test_gap_report_inside_and_between_days(spark):
    rows = day("20210301", [0, 1, 5]) + day("20210303", [2])
    got = validate.gap_report(preprocess.clean_hourly(raw_hours(spark, rows))).orderBy("after").collect()
    assert [(r.before.hour, r.after.hour, r.missing) for r in got] == [(1, 5, 3), (5, 2, 44)]


def test_reports_can_stop_the_run(spark):
    hourly = preprocess.clean_hourly(raw_hours(spark, day("20210301")))
    long = reshape.to_15min(hourly)
    validate.require_ok(validate.expand_check(hourly, long), "reshape")
    with pytest.raises(RuleViolation, match="reshape"):
        validate.require_ok(validate.expand_check(hourly, long.unionByName(long.limit(1))), "reshape")


def test_empty_table_is_an_error(spark):
    with pytest.raises(RuleViolation):
        validate.require_nonempty(raw_hours(spark, day("20210301")).limit(0))


def test_unknown_year_is_an_error(spark):
    hourly = preprocess.clean_hourly(raw_hours(spark, day("20300301")))
    with pytest.raises(RuleViolation, match="2030"):
        validate.require_calendar_years(hourly, dimensions.load_holidays(spark))


def test_calendar_document_rules(spark, tmp_path):
    def problems(text):
        f = tmp_path / "c.json"
        f.write_text(text)
        doc = spark.read.schema(dimensions.CALENDAR_SCHEMA).json(str(f), multiLine=True)
        years = spark.createDataFrame([(2021,), (2022,)], "year int")
        return {r.problem for r in dimensions.calendar_problems(doc, years).collect()}
    good = '"2022": {"2022-01-01": "x"}'
    assert problems('{"schema": 1, "country": "KR", "years": {"2021": {"2021-01-01": "x"}, %s}}' % good) == set()
    assert problems('{"schema": 2, "country": "KR", "years": {"2021": {"2021-01-01": "x"}, %s}}' % good) == {"header"}
    assert problems('{"schema": 1, "country": "KR", "years": {"2021": {}, %s}}' % good) == {"empty_year"}
    assert problems('{"schema": 1, "country": "KR", "years": {%s}}' % good) == {"missing_year"}
    for bad in ('"2021-1-01": "x"', '"2022-01-01": "x"', '"2021-01-01": ""', '"2021-02-30": "x"'):
        assert problems('{"schema": 1, "country": "KR", "years": {"2021": {%s}, %s}}' % (bad, good)) == {"bad_date"}


def test_csv_with_byte_order_mark_and_line_numbers(spark, tmp_path):
    head = "series_id,dt,hr,q1,q2,q3,q4,production,temp,wind,humidity,rain\n"
    body = "".join(f"A,20210301,{h},{h},1,1,1,,,,,\n" for h in range(5))
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + (head + body).encode())
    rows = raw.scan_raw(spark, str(tmp_path / "a.csv")).orderBy("src_row").collect()
    assert [r.src_row for r in rows] == [2, 3, 4, 5, 6]
    assert [r.q1 for r in rows] == ["0", "1", "2", "3", "4"] and rows[0].series_id == "A"


def test_line_numbers_over_many_blocks(spark, tmp_path):
    head = "series_id,dt,hr,q1,q2,q3,q4,production,temp,wind,humidity,rain\n"
    for name, n in (("a", 3000), ("b", 700)):
        (tmp_path / f"{name}.csv").write_text(head + "".join(f"A,{i + 2},1,1,1,1,1,,,,,\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        df = raw.scan_raw(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 1
        assert df.filter("src_row <> cast(dt as long)").count() == 0 and df.count() == 3700
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_source_headers_and_columns_of_unknown_role(spark, tmp_path):
    head = "날짜,시간,15분,30분,45분,60분,생산량,공장인원,note\n"
    body = "".join(f"20210301,{h},{h},1,1,1,{h * 5},{h / 2},x{h}\n" for h in range(24))
    (tmp_path / "k.csv").write_bytes(b"\xef\xbb\xbf" + (head + body).encode())
    df = validate.ingest(raw.scan_raw(spark, str(tmp_path / "k.csv"), series="M"))
    kinds = dict(df.dtypes)
    assert kinds["staff"] == kinds["production"] == kinds["q1"] == "double" and kinds["note"] == "string"
    hourly = preprocess.clean_hourly(df)
    assert hourly.count() == 24 and hourly.filter("src_row <> hour + 2").count() == 0
    assert "staff" in leaks.other_numeric(hourly) and "note" not in leaks.other_numeric(hourly)


# -- leaks ---------------------------------------------------------------------------------

def leak_table(spark, n=200, **columns):
    rows = []
    for i in range(n):
        q = [float((i * k) % 17 + 100 * (i % 3)) for k in (3, 5, 7, 11)]
        rows.append((q, {k: f(i, q) for k, f in columns.items()}))
    data = [("A", datetime(2021, 3, 1 + i // 24), i % 24, *q, *[v[c] for c in columns])
            for i, (q, v) in enumerate(rows)]
    schema = ("series_id string, day timestamp, hour int, q1 double, q2 double, q3 double, q4 double"
              + "".join(f", {c} double" for c in columns))
    return spark.createDataFrame(data, schema)


noise = lambda i, q: float((i * 7919) % 1009) * 37


def test_rounded_mean_is_a_leak_even_when_protected(spark):
    df = leak_table(spark, production=lambda i, q: float(round(sum(q) / 4)), temp=noise)
    assert leaks.drop_list(df) == ["production"]


def test_partner_of_a_protected_column_goes(spark):
    df = leak_table(spark, production=noise, staff=lambda i, q: noise(i, q) / sum(q) if sum(q) else None)
    hits = {r["column"]: (r.decision, r.dropped) for r in leaks.resolve_drop(leaks.first_hits(df)).collect()}
    assert hits["production"] == ("drop_partner", "staff") and hits["staff"] == ("drop_column", "staff")


def test_two_unprotected_partners_both_go(spark):
    df = leak_table(spark, x=noise, z=lambda i, q: noise(i, q) * sum(q))
    assert leaks.drop_list(df) == ["x", "z"]


def test_two_protected_partners_need_a_human(spark):
    df = leak_table(spark, production=noise, temp=lambda i, q: noise(i, q) * sum(q))
    with pytest.raises(RuleViolation, match="by hand"):
        leaks.drop_list(df)


def test_too_few_rows_prove_nothing(spark):
    df = leak_table(spark, n=99, x=lambda i, q: sum(q))
    assert leaks.first_hits(df).count() == 0


def test_calendar_copies(spark):
    df = leak_table(spark, wage=lambda i, q: 9.0 if i % 24 < 6 else 5.0, dow=lambda i, q: float(i // 24 % 7 + 1),
                    flat=lambda i, q: 3000.0, temp=noise)
    assert {r["column"]: r.key for r in leaks.calendar_hits(df).collect()} == {"wage": "hour", "dow": "dayofweek"}
    assert {r["column"]: r.identity for r in leaks.calendar_identity(df).collect()} == {"dow": "dayofweek+1"}


def test_mode_tie_counts_half(spark):
    """Two values per hour, equally often: the agreement is one half whichever is the mode."""
    df = leak_table(spark, n=192, x=lambda i, q: float(i // 24 % 2))
    got = {r.key: r.agreement for r in leaks.calendar_determined(df).collect()}
    assert got["hour"] == 0.5 and got["date"] == 1.0


def test_missing_values_count_as_disagreement(spark):
    df = leak_table(spark, n=96, x=lambda i, q: None if i % 2 else 4.0)
    got = {r.key: r.agreement for r in leaks.calendar_determined(df).collect()}
    assert got["hour"] == 0.5


def test_calendar_bounds_do_not_grow_with_the_dates():
    """A task keeps one chunk of rows and leaves one row per cell, however many dates and values it meets."""
    def peak(batches: int) -> tuple[int, int]:
        rng = np.random.default_rng(5)
        made = (pd.DataFrame({"_k0": rng.integers(0, 24, 500), "_k1": 500 * b + np.arange(500), "_v0": rng.random(500)}) for b in range(batches))
        tracemalloc.start()
        out = list(leaks._chunk_bounds(2, 1, 1000)(made))
        return tracemalloc.get_traced_memory()[1], sum(map(len, out))
    try:
        (few, rows), (many, more) = peak(8), peak(160)
    finally:
        tracemalloc.stop()
    assert rows == more == 2 and many < 2 * few


def test_calendar_bounds_lie_above_the_agreement(spark):
    df = leak_table(spark, n=480, x=lambda i, q: float(i // 24 % 2), wage=lambda i, q: 9.0 if i % 24 < 6 else 5.0, temp=noise,
                    flat=lambda i, q: 1.0, none=lambda i, q: None if i else 2.0)
    exact = {(r["column"], r.key): r.agreement for r in leaks.calendar_determined(df).collect()}
    names = leaks.other_numeric(df)
    for chunk_rows in (30, 100_000):
        found = {(names[r.cell // 4], fv.CALENDAR_KEYS[r.cell % 4]): r.high for r in leaks.calendar_bounds(df, chunk_rows=chunk_rows).collect()}
        assert found.keys() == exact.keys() and all(found[k] >= exact[k] for k in exact)
    assert exact["wage", "hour"] == 1.0 and exact["x", "hour"] == 0.5 and exact["none", "month"] == 1 / 480


# -- imputation and reshaping --------------------------------------------------------------

def test_fill_uses_the_unfilled_past(spark):
    values = [None, 1.0, None, 5.0, None, 100.0, None]
    rows = [("A", datetime(2021, 3, 1, i), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp, temp double")
    out = [r.temp for r in impute.impute_past_median(df, ["temp"]).orderBy("ts").collect()]
    assert out == [None, 1.0, 1.0, 5.0, 3.0, 100.0, 5.0]


def test_first_column_starts_at_the_full_hour(spark):
    hourly = preprocess.clean_hourly(raw_hours(spark, [("20210301", 5.0, 1.0, 2.0, 3.0, 4.0)]))
    got = [(r.ts.hour, r.ts.minute, r.kw) for r in reshape.to_15min(hourly).orderBy("ts").collect()]
    assert got == [(5, 0, 1.0), (5, 15, 2.0), (5, 30, 3.0), (5, 45, 4.0)]


# -- requests, audit, settings -------------------------------------------------------------

def test_request_ranges(spark):
    rows = [(1, 0, None), (2, 1, 10000.0), (3, 1, 0.0), (4, -1, 5.0), (5, 1, math.nan), (6, 1, math.inf)]
    df = spark.createDataFrame(rows, "id int, cursor int, threshold double")
    got = {r.id: r.reasons for r in requests.validate_params(df, requests.SNAPSHOT).collect()}
    assert got == {1: [], 2: [], 3: ["threshold"], 4: ["cursor"], 5: ["threshold"], 6: ["threshold"]}


def test_gate_refuses_other_settings(spark):
    stored = results.settings_row(spark)
    results.model_gate(stored, results.settings_row(spark))
    with pytest.raises(RuleViolation, match="window"):
        results.model_gate(stored, results.settings_row(spark, Settings(window=48)))


def test_audit_keeps_a_sample_of_details(spark):
    metrics = spark.createDataFrame([(3,)], "rows int")
    details = spark.createDataFrame([(f"{i:03d}", i) for i in range(50)], "item string, value int")
    row = results.audit_step("r", "step", metrics, details).first()
    assert row.metrics == {"rows": "3"} and len(row.details) == 20 and row.details[0]["item"] == "000"


def test_audit_details_are_whole(spark):
    details = spark.createDataFrame([(f"{i:03d}", i) for i in range(50)], "item string, value int")
    rows = results.audit_details("r", "step", details).collect()
    assert sorted((r.run_id, r.step, r["item"], r.value) for r in rows) == [("r", "step", f"{i:03d}", str(i)) for i in range(50)]
    few = results.audit_details("r", "step", details, sample=20).collect()
    assert sorted(r["item"] for r in few) == [f"{i:03d}" for i in range(20)]


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(50).selectExpr("id", "id * 2 AS v")
    a = results.table_fingerprint(df, ["id", "v"]).first()
    b = results.table_fingerprint(df.orderBy(F.desc("id")).repartition(7), ["id", "v"]).first()
    c = results.table_fingerprint(df.withColumn("v", F.when(F.col("id") == 7, 0).otherwise(F.col("v"))), ["id", "v"]).first()
    assert a == b and a != c
