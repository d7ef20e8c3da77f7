"""Queries over the raw hourly path: sources, checks, leaks, imputation, reshaping."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from wattloom.operators import features, impute, leaks, requests, reshape, split, validate
from wattloom.plans import fixtures as x
from wattloom.plans.registry import REGISTRY
from wattloom.session import shared_folder, stage
from wattloom.sources import dimensions, raw, results

add = REGISTRY.add
TEXT = ["series_id", "dt", "hr", "q1", "q2", "q3", "q4", "production", "temp", "wind", "humidity", "rain"]


# -- A: sources and sinks ------------------------------------------------------------------

@add("a1_scan_raw", "series_id dt hr:r q1:r q2:r q3:r q4:r production:r temp:r", x.HOURLY,
     "SELECT * FROM hourly")
def a1(t):
    """Write the hourly table as CSV and read it back with line numbers."""
    path = shared_folder(t.spark, "raw-csv")
    t.hourly.select(*TEXT).write.csv(path, header=True)
    return validate.strict_numeric(raw.scan_raw(t.spark, path), TEXT[2:])


@add("a1_row_numbers", "n_rows:i contiguous", x.HOURLY,
     "SELECT count(*) AS n_rows, true AS contiguous FROM hourly")
def a1_rows(t):
    """Line numbers of every file run from 2 without holes."""
    path = shared_folder(t.spark, "raw-csv")
    t.hourly.select(*TEXT).write.csv(path, header=True)
    n = F.col("src_row")
    return (raw.scan_raw(t.spark, path).groupBy("src_file")
            .agg(F.count(n).alias("n"), F.min(n).alias("lo"), F.max(n).alias("hi"),
                 F.sum(n).alias("s"))
            .agg(F.sum("n").alias("n_rows"), F.bool_and(
                (F.col("lo") == 2) & (F.col("hi") == F.col("n") + 1)
                & (F.col("s") == F.expr("n * (n + 3) div 2"))).alias("contiguous")))


@add("a1_missing_words", "series_id q1_missing:i temp_missing:i production:r", x.HOURLY,
     "SELECT series_id, count(*) FILTER (WHERE src_row % 19 = 0) AS q1_missing, count(*) FILTER (WHERE src_row % 7 < 3 OR temp IS NULL) "
     "AS temp_missing, sum(production) AS production FROM hourly GROUP BY 1")
def a1_missing(t):
    """Words that stand for a missing value in a CSV field are missing, not a fault."""
    path = shared_folder(t.spark, "raw-csv")
    n = F.col("src_row")
    words = F.element_at(F.array(*[F.lit(w) for w in ("NA", "N/A", "null")]), (n % 7 + 1).cast("int"))
    t.hourly.select("series_id", "src_row", "production", F.when(n % 19 == 0, "NaN").otherwise(F.col("q1").cast("string")).alias("q1"),
                    F.when(n % 7 < 3, words).otherwise(F.col("temp").cast("string")).alias("temp")) \
        .write.csv(path, header=True)
    back = validate.strict_numeric(raw.scan_raw(t.spark, path, number_rows=False), ["q1", "temp", "production"])
    return back.groupBy("series_id").agg(F.count_if(F.col("q1").isNull()).alias("q1_missing"),
                                         F.count_if(F.col("temp").isNull()).alias("temp_missing"), F.sum("production").alias("production"))


FEATURE_COLS = "series_id ts:t date_key:i split kw:r y:r kw_lag4:r"


@add("a2_scan_features", FEATURE_COLS, x.SEG + f""",
feat AS (SELECT series_id, ts, kw, lead(kw) OVER w AS y, lag(kw, 3) OVER w AS kw_lag4,
  {x.DATE_KEY} AS date_key FROM seg {x.W}), """ + x.split_ctes("feat"),
     "SELECT * FROM parted WHERE y IS NOT NULL")
def a2(t):
    path = shared_folder(t.spark, "features")
    rows = features.segment_features(t.readings, ["y", "kw_lag4"])
    raw.write_features(split.drop_unlabelled(split.split_by_fraction(split.with_date_key(rows))), path)
    return raw.scan_features(t.spark, path)


@add("a3_load_holidays", "date:d name n_points:i", x.TARIFF + ",\n" + x.HOLIDAYS,
     "SELECT h.date, h.name, count(*) AS n_points FROM tariff p JOIN holidays h "
     "ON CAST(p.ts AS DATE) = h.date GROUP BY 1, 2")
def a3(t):
    """Calendar checked against the years of the data, then counted over all points."""
    years = t.tariff.select(F.year("ts").alias("year"))
    hol = dimensions.load_holidays(t.spark, years=years)
    return (t.tariff.join(F.broadcast(hol), F.to_date("ts") == F.col("date"))
            .groupBy("date", "name").agg(F.count(F.lit(1)).alias("n_points")))


@add("a4_load_tariff", "season band rate:r n_points:i", x.TARIFF + ",\n" + x.BANDS + ",\n" + x.RATES,
     """SELECT r.season, r.band, r.rate, count(*) AS n_points FROM tariff p
  JOIN bands b ON b.season = CASE WHEN month(p.ts) IN (6, 7, 8) THEN 'summer'
       WHEN month(p.ts) IN (11, 12, 1, 2) THEN 'winter' ELSE 'spring_autumn' END
   AND hour(p.ts) + minute(p.ts) / 60 >= b.h_start AND hour(p.ts) + minute(p.ts) / 60 < b.h_end
  JOIN rates r ON r.season = b.season AND r.band = b.band GROUP BY 1, 2, 3""")
def a4(t):
    from wattloom.operators import tariff
    rates, bands = dimensions.load_tariff(t.spark)
    rows = tariff.load_band(tariff.with_season(t.tariff), bands)
    return (rows.join(F.broadcast(rates), ["season", "band"]).groupBy("season", "band", "rate")
            .agg(F.count(F.lit(1)).alias("n_points")))


@add("a5_write_features", "split n_rows:i n_columns:i first_columns", x.OBSERVED,
     "SELECT split, count(*) AS n_rows, 7 AS n_columns, 'series_id,ts,date_key,kw,y' AS first_columns "
     "FROM observed GROUP BY 1")
def a5(t):
    """Helper columns are dropped, key columns come first, one folder per split."""
    path = shared_folder(t.spark, "features")
    rows = t.observed.select("kw", "a", "y", "ts", "series_id", "split", "date_key",
                             F.lit(1).alias("_helper"), F.lit(1).alias("segment"))
    raw.write_features(rows, path)
    back = t.spark.read.parquet(path)
    return (back.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("n_columns", F.lit(len(back.columns)))
            .withColumn("first_columns", F.lit(",".join(back.columns[:5]))))


@add("a6_write_audit", "step metric value", x.QUALITY, """
SELECT 'input' AS step, 'rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM hourly
UNION ALL SELECT 'bad_dates', 'rows', CAST(count(*) AS VARCHAR) FROM dated WHERE day0 IS NULL
UNION ALL SELECT 'bad_hours', 'days', CAST(count(*) AS VARCHAR) FROM quality WHERE NOT hours_ok
UNION ALL SELECT 'bad_hours', 'rows', CAST(sum(n_rows) AS VARCHAR) FROM quality WHERE NOT hours_ok
UNION ALL SELECT 'incomplete', 'days', CAST(count(*) AS VARCHAR) FROM quality WHERE hours_ok AND n_rows <> 24""")
def a6(t):
    path = shared_folder(t.spark, "audit")
    dated = validate.with_date(t.hourly)
    quality = validate.hour_quality(validate.drop_bad_dates(dated))
    bad = F.when(~F.col("hours_ok"), F.col("rows"))
    one = lambda df, **aggs: df.agg(*[c.alias(n) for n, c in aggs.items()])
    detail = quality.filter("not hours_ok").select(
        F.concat_ws(" ", "series_id", F.date_format("day", "yyyy-MM-dd")).alias("item"),
        F.col("rows").alias("value"))
    run = "run-1"
    results.write_audit([
        results.audit_step(run, "input", one(t.hourly, rows=F.count(F.lit(1)))),
        results.audit_step(run, "bad_dates", one(dated, rows=F.count_if(F.col("day").isNull()))),
        results.audit_step(run, "bad_hours", one(
            quality, days=F.count_if(~F.col("hours_ok")), rows=F.sum(bad)), detail),
        results.audit_step(run, "incomplete", one(
            quality, days=F.count_if(F.col("hours_ok") & ~F.col("complete")))),
    ], path)
    return (t.spark.read.schema(results.AUDIT_SCHEMA).parquet(path)
            .select("step", F.explode("metrics").alias("metric", "value")))


@add("a6_audit_details", "step item value", x.QUALITY + """,
days_ AS (SELECT series_id || ' ' || strftime(day0, '%Y-%m-%d') AS item, n_rows, hours_ok FROM quality)""",
     """SELECT 'bad_hours' AS step, item, CAST(n_rows AS VARCHAR) AS value FROM days_ WHERE NOT hours_ok
UNION ALL SELECT 'incomplete', item, CAST(n_rows AS VARCHAR) FROM (SELECT *, row_number() OVER (ORDER BY item) AS rn
  FROM days_ WHERE hours_ok AND n_rows <> 24) WHERE rn <= 20""")
def a6_details(t):
    """Every deleted day; of the incomplete days that are kept a sample, as in the reference."""
    path = shared_folder(t.spark, "audit-details")
    quality = validate.hour_quality(validate.drop_bad_dates(validate.with_date(t.hourly)))
    days = lambda rows: quality.filter(rows).select(
        F.concat_ws(" ", "series_id", F.date_format("day", "yyyy-MM-dd")).alias("item"), F.col("rows").alias("value"))
    run = "run-1"
    results.write_audit([
        results.audit_details(run, "bad_hours", days("not hours_ok")),
        results.audit_details(run, "incomplete", days("hours_ok and not complete"), sample=20)], path)
    return t.spark.read.parquet(path)


@add("a7_export_predictions", "series_id target_time actual_kw:r predicted_kw:r", x.OBSERVED,
     "SELECT series_id, strftime(target_time, '%Y-%m-%d %H:%M:%S') AS target_time, y AS actual_kw, "
     "prediction AS predicted_kw FROM forecast")
def a7(t):
    path = shared_folder(t.spark, "predictions")
    frame = t.forecast.withColumn("target_time", F.date_format("target_time", "yyyy-MM-dd HH:mm:ss"))
    results.export_predictions(frame, path)
    return t.spark.read.csv(path, header=True,
                            schema="series_id string, target_time string, actual_kw double, predicted_kw double")


@add("a8_export_day_points", "series_id day_key time actual:r predicted:r", x.OBSERVED + """,
pts AS (SELECT series_id, day_key, ts AS time, kw AS actual, CASE WHEN lag(target_time) OVER w = ts
    THEN lag(prediction) OVER w END AS predicted FROM forecast
    WINDOW w AS (PARTITION BY series_id, day_key ORDER BY ts)
  UNION ALL SELECT series_id, day_key, max(target_time), NULL, arg_max(prediction, ts) FROM forecast
  GROUP BY 1, 2)""",
     "SELECT series_id, day_key, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, actual, predicted FROM pts")
def a8(t):
    from wattloom.operators import asof
    path = shared_folder(t.spark, "points")
    points = asof.day_points(t.forecast).withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))
    results.export_day_points(points, path)
    return t.spark.read.csv(path, header=True, schema="series_id string, day_key string, time string,"
                                                      " actual double, predicted double")


@add("a9_table_fingerprint", "series_id rows:i digest_sum digest_xor:i", x.OBSERVED + """,
heads AS (SELECT series_id, CAST('0x' || substr(sha256(length(series_id) || ':' || series_id || '19:' ||
    strftime(ts, '%Y-%m-%d %H:%M:%S') || length(CAST(CAST(kw * 64 AS BIGINT) AS VARCHAR)) || ':' ||
    CAST(CAST(kw * 64 AS BIGINT) AS VARCHAR)), 1, 13) AS BIGINT) AS h FROM forecast)""",
     "SELECT series_id, count(*) AS rows, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS digest_sum, "
     "bit_xor(h) AS digest_xor FROM heads GROUP BY 1")
def a9(t):
    rows = t.forecast.select("series_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
                             (F.col("kw") * 64).cast("long").alias("kw64"))
    return results.table_fingerprint(rows, ["series_id", "ts", "kw64"], ["series_id"])


@add("a9_ordered_fingerprint", "series_id rows:i digest differs", x.OBSERVED + """,
digests AS (SELECT series_id, ts, sha256('19:' || strftime(ts, '%Y-%m-%d %H:%M:%S')) AS d, row_number() OVER
    (PARTITION BY series_id ORDER BY ts) - 1 AS p0 FROM forecast),
level1 AS (SELECT series_id, p0 // 16 AS p1, sha256(string_agg(d, '' ORDER BY p0)) AS d, count(*) AS n FROM digests GROUP BY 1, 2),
level2 AS (SELECT series_id, p1 // 16 AS p2, sha256(string_agg(d, '' ORDER BY p1)) AS d, sum(n) AS n FROM level1 GROUP BY 1, 2),
level3 AS (SELECT series_id, sha256(string_agg(d, '' ORDER BY p2)) AS d, sum(n) AS n FROM level2 GROUP BY 1)""",
     "SELECT series_id, n AS rows, d AS digest, true AS differs FROM level3")
def a9_ordered(t):
    """A digest of the ordered test times, as a tree of hashes; the same times in another order give another one."""
    rows = t.forecast.select("series_id", "ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"))
    here = results.ordered_fingerprint(rows, ["time"], fan=16)
    mirrored = rows.withColumn("ts", F.timestamp_micros(-F.unix_micros("ts")))
    other = results.ordered_fingerprint(mirrored, ["time"], fan=16).withColumnRenamed("digest", "other").drop("rows")
    return here.join(other, "series_id").withColumn("differs", F.col("digest") != F.col("other"))


# -- B: checks -----------------------------------------------------------------------------

@add("b1_require_columns", "table_rows:i ok", x.HOURLY, "SELECT count(*) AS table_rows, true AS ok FROM hourly")
def b1(t):
    df = validate.require_columns(t.hourly, ["series_id", "dt", "hr", "q1", "q2", "q3", "q4"])
    return df.agg(F.count(F.lit(1)).alias("table_rows")).withColumn("ok", F.lit(True))


@add("b2_strict_numeric", "column not_numeric:i", x.HOURLY,
     "SELECT 'q1' AS \"column\", 0 AS not_numeric UNION ALL SELECT 'temp', count(*) FROM hourly "
     "WHERE temp IS NULL UNION ALL SELECT 'humidity', 0")
def b2(t):
    """Report form: texts that are not numbers. The strict form raises (see the tests)."""
    text = t.hourly.select(F.col("q1").cast("string"),
                           F.coalesce(F.col("temp").cast("string"), F.lit("n/a")).alias("temp"),
                           F.coalesce(F.col("humidity").cast("string"), F.lit("")).alias("humidity"))
    return validate.numeric_report(text, ["q1", "temp", "humidity"])


@add("b3_reject_infinite", "column infinite:i", x.HOURLY,
     "SELECT 'production' AS \"column\", count(*) AS infinite FROM hourly WHERE wind = 0 "
     "UNION ALL SELECT 'q1', 0")
def b3(t):
    df = t.hourly.withColumn("production", F.when(F.col("wind") == 0, math.inf).otherwise(F.col("production")))
    return validate.infinite_report(df, ["production", "q1"])


@add("b4_reject_negative_power", "series_id src_row:i q1:r q2:r", x.HOURLY + """,
shifted AS (SELECT * REPLACE (q1 - 40 AS q1, CASE WHEN wind = 0 THEN NULL ELSE q2 END AS q2) FROM hourly)""",
     "SELECT series_id, src_row, q1, q2 FROM shifted WHERE least(q1, q2, q3, q4) < 0")
def b4(t):
    df = t.hourly.withColumn("q1", F.col("q1") - 40).withColumn(
        "q2", F.when(F.col("wind") != 0, F.col("q2")))
    return validate.negative_power(df)


@add("b5_parse_mixed_date", "src_row:i dt day:t", x.DATED, "SELECT src_row, dt, day0 AS day FROM dated")
def b5(t):
    return validate.with_date(t.hourly)


FORMS = [("yyyyMMdd", "%Y%m%d"), ("yyyy-MM-dd", "%Y-%m-%d"), ("yyyy/M/d", "%Y/%-m/%-d"), ("yyyy.MM.dd", "%Y.%m.%d"), ("M/d/yyyy", "%-m/%-d/%Y"),
         ("MMM d, yyyy", "%b %-d, %Y"), ("MMMM d, yyyy", "%B %-d, %Y"), ("d MMM yyyy", "%-d %b %Y"), ("d-MMM-yyyy", "%-d-%b-%Y"),
         ("yyyy-MM-dd H:mm:ss", "%Y-%m-%d %-H:%M:%S"), ("yyyy-MM-dd'T'HH:mm", "%Y-%m-%dT%H:%M"), ("yyyyMMddHHmmss", "%Y%m%d%H%M%S")]


@add("b5_date_forms", "o_orderkey:i text day:t", x.TARIFF,
     "SELECT o_orderkey, text, CASE WHEN form >= 9 THEN date_trunc(CASE WHEN form = 10 THEN 'minute' ELSE 'second' END, ts) ELSE date_trunc('day', ts) END AS day "
     "FROM (SELECT o_orderkey, ts, o_orderkey % 12 AS form, CASE o_orderkey % 12 "
     + " ".join(f"WHEN {i} THEN strftime(ts, '{f}')" for i, (_, f) in enumerate(FORMS)) + " END AS text FROM tariff)")
def b5_forms(t):
    """Dates of all forms that the reference reads, one form per row; a month that cannot be one makes the day come first."""
    form = (F.col("o_orderkey") % len(FORMS)).cast("int")
    text = F.coalesce(*[F.when(form == i, F.date_format("ts", f)) for i, (f, _) in enumerate(FORMS)])
    return validate.with_date(t.tariff.withColumn("text", text), "text")


@add("b6_drop_bad_dates", "series_id kept:i dropped:i src_rows", x.DATED + """,
bad AS (SELECT series_id, src_row, row_number() OVER (PARTITION BY series_id ORDER BY src_row) AS rn
  FROM dated WHERE day0 IS NULL),
listed AS (SELECT series_id, count(*) AS dropped, string_agg(CASE WHEN rn <= 20 THEN CAST(src_row AS VARCHAR)
  END, ',' ORDER BY src_row) AS src_rows FROM bad GROUP BY 1)""",
     "SELECT d.series_id, count(*) AS kept, any_value(l.dropped) AS dropped, any_value(l.src_rows) AS src_rows "
     "FROM dated d JOIN listed l USING (series_id) WHERE d.day0 IS NOT NULL GROUP BY 1")
def b6(t):
    dated = validate.with_date(t.hourly)
    kept = validate.drop_bad_dates(dated).groupBy("series_id").agg(F.count(F.lit(1)).alias("kept"))
    report = validate.bad_date_report(dated).withColumnRenamed("rows", "dropped")
    return kept.join(report, "series_id").withColumn(
        "src_rows", F.concat_ws(",", F.col("src_rows").cast("array<string>")))


@add("b7_require_nonempty", "rows:i ok", x.QUALITY, "SELECT count(*) AS rows, true AS ok FROM dated WHERE day0 IS NOT NULL")
def b7(t):
    df = validate.require_nonempty(validate.drop_bad_dates(validate.with_date(t.hourly)), "hourly")
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("ok", F.lit(True))


@add("b8_schema_summary", "rows:i columns:i context_present:i present absent", x.HOURLY,
     "SELECT count(*) AS rows, 16 AS columns, 4 AS context_present, 'production,temp,wind,humidity' "
     "AS present, 'rain' AS absent FROM hourly")
def b8(t):
    return validate.schema_summary(t.hourly.drop("rain", "m"))


@add("b9_hour_quality", "series_id day:t rows:i distinct_hours:i hours_ok complete", x.QUALITY,
     "SELECT series_id, day0 AS day, n_rows AS rows, CASE WHEN bool_and(hours_ok) OVER (PARTITION BY "
     "series_id, day0) THEN distinct_hours ELSE 0 END AS distinct_hours, hours_ok, n_rows = 24 AS complete FROM quality")
def b9(t):
    return validate.hour_quality(validate.drop_bad_dates(validate.with_date(t.hourly)))


@add("b10_incomplete_days", "series_id day:t rows:i", x.QUALITY,
     "SELECT series_id, day, rows FROM (SELECT series_id, day0 AS day, n_rows AS rows, row_number() OVER "
     "(PARTITION BY series_id ORDER BY day0) AS rn FROM quality WHERE hours_ok AND n_rows <> 24) WHERE rn <= 20")
def b10(t):
    quality = validate.hour_quality(validate.drop_bad_dates(validate.with_date(t.hourly)))
    return validate.incomplete_days(quality)


@add("b10_incomplete_total", "series_id total:i listed:i", x.QUALITY,
     "SELECT series_id, count(*) AS total, least(count(*), 2) AS listed FROM quality WHERE hours_ok AND n_rows <> 24 GROUP BY 1")
def b10_total(t):
    """The list is cut, the number of days is not."""
    quality = validate.hour_quality(validate.drop_bad_dates(validate.with_date(t.hourly)))
    return validate.incomplete_days(quality, keep=2).groupBy("series_id").agg(
        F.max("total").alias("total"), F.count(F.lit(1)).alias("listed"))


@add("b11_drop_bad_hour_days", "series_id src_row:i dt hr:r", x.QUALITY,
     "SELECT d.series_id, src_row, dt, hr FROM dated d JOIN quality q ON q.series_id = d.series_id "
     "AND q.day0 = d.day0 AND q.hours_ok")
def b11(t):
    dated = validate.drop_bad_dates(validate.with_date(t.hourly))
    return validate.drop_bad_hour_days(dated, validate.hour_quality(dated))


@add("b11_bad_hour_detail", "series_id day:t rows:i complete hours", x.QUALITY + """,
ranked AS (SELECT d.*, row_number() OVER (PARTITION BY d.series_id, d.day0 ORDER BY src_row) AS rn,
  q.n_rows FROM dated d JOIN quality q ON q.series_id = d.series_id AND q.day0 = d.day0 AND NOT q.hours_ok)""",
     "SELECT series_id, day0 AS day, n_rows AS rows, n_rows = 24 AS complete, string_agg(CAST(CAST(hr AS INTEGER) "
     "AS VARCHAR), ',' ORDER BY src_row) FILTER (WHERE rn <= 8) AS hours FROM ranked GROUP BY ALL")
def b11_detail(t):
    dated = validate.drop_bad_dates(validate.with_date(t.hourly))
    out = validate.bad_hour_detail(dated, validate.hour_quality(dated))
    return out.withColumn("hours", F.concat_ws(",", F.col("hours").cast("array<int>").cast("array<string>")))


@add("b12_normalize_hour", "src_row:i hr:r hour:r", x.HOURLY,
     "SELECT src_row, hr, CASE WHEN hr BETWEEN 0 AND 23 THEN hr END AS hour FROM hourly")
def b12(t):
    return validate.normalize_hour(t.hourly)


@add("b13_build_hour_ts", "series_id src_row:i ts:t", x.CLEAN, "SELECT series_id, src_row, ts FROM clean")
def b13(t):
    return t.clean


@add("b14_reject_duplicate_ts", "series_id ts:t rows:i", x.CLEAN + """,
twice AS (SELECT series_id, ts FROM clean UNION ALL SELECT series_id, ts FROM clean WHERE wind = 0)""",
     "SELECT series_id, ts, count(*) AS rows FROM twice GROUP BY 1, 2 HAVING count(*) > 1")
def b14(t):
    """Report form on a table with planted duplicates; the strict form raises (see the tests)."""
    rows = t.clean.select("series_id", "ts", "wind")
    return validate.duplicate_ts(rows.unionByName(rows.filter("wind = 0")))


@add("b15_gap_report", "series_id before:t after:t missing:i", x.CLEAN,
     "SELECT * FROM (SELECT series_id, lag(ts) OVER w AS before, ts AS after, epoch(ts - lag(ts) OVER w) / 3600 - 1 "
     "AS missing FROM clean WINDOW w AS (PARTITION BY series_id ORDER BY ts)) WHERE missing > 0")
def b15(t):
    return validate.gap_report(t.clean)


@add("b16_expand_postcondition", "series_id hours:i intervals:i ok", x.CLEAN,
     "SELECT series_id, count(*) AS hours, 4 * count(*) AS intervals, true AS ok FROM clean GROUP BY 1")
def b16(t):
    return validate.expand_check(t.clean, reshape.to_15min(t.clean))


@add("b17_split_guard", "series_id train_rows:i test_rows:i ok", x.OBSERVED,
     "SELECT series_id, count(*) FILTER (WHERE split = 'train') AS train_rows, count(*) FILTER (WHERE "
     "split = 'test') AS test_rows, true AS ok FROM parted GROUP BY 1")
def b17(t):
    rows = split.with_date_key(t.readings)
    return split.split_guard(split.split_by_fraction(rows))


REQUESTS = """requests AS (SELECT o_orderkey AS request_id, o_custkey % 120 AS cursor, o_totalprice / 4 AS production,
  o_custkey % 60 - 3 AS staff, floor(o_totalprice) * 3 AS hourly_wage, CAST(o_custkey % 200 AS DOUBLE) AS energy_rate,
  CAST(o_custkey % 7 AS DOUBLE) AS power_factor, o_custkey % 50 AS baseline_staff,
  CASE WHEN o_custkey % 3 = 0 THEN o_totalprice END AS planned_production,
  CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_custkey % 300 - 10 AS DOUBLE) END AS unit_price,
  CASE WHEN o_custkey % 4 <> 0 THEN CAST((o_custkey % 9) * 1000 AS DOUBLE) END AS day_wage FROM orders)"""


@add("b18_validate_scenario", "request_id:i accepted reasons", REQUESTS,
     """SELECT request_id, reasons = '' AS accepted, reasons FROM (SELECT request_id, concat_ws(',',
  CASE WHEN production > 100000 THEN 'production' END, CASE WHEN staff < 0 THEN 'staff' END,
  CASE WHEN hourly_wage > 1000000 THEN 'hourly_wage' END, CASE WHEN power_factor <= 0 THEN 'power_factor' END)
  AS reasons FROM requests)""")
def b18(t):
    out = requests.validate_params(t.requests, requests.SCENARIO)
    return out.withColumn("reasons", F.concat_ws(",", "reasons"))


@add("b18_validate_staffing", "request_id:i accepted reasons", REQUESTS,
     """SELECT request_id, reasons = '' AS accepted, reasons FROM (SELECT request_id, concat_ws(',',
  CASE WHEN planned_production IS NULL THEN 'planned_production' END, CASE WHEN unit_price < 0 THEN 'unit_price' END,
  CASE WHEN day_wage <= 0 THEN 'day_wage' END) AS reasons FROM requests)""")
def b18_staffing(t):
    rows = t.requests.withColumns({"base_rate": F.lit(None).cast("double"),
                                   "billing_peak": F.lit(200.0)})
    out = requests.validate_params(rows, requests.STAFFING)
    return out.withColumn("reasons", F.concat_ws(",", "reasons"))


@add("b19_finite_prediction", "rows:i missing:i nan:i infinite:i ok", x.OBSERVED,
     "SELECT count(*) AS rows, 0 AS missing, 0 AS nan, 0 AS infinite, true AS ok FROM forecast")
def b19(t):
    return validate.finite_prediction(t.forecast)


@add("b19_planted_faults", "rows:i missing:i nan:i infinite:i ok", x.OBSERVED, """SELECT count(*) AS rows, count(*) FILTER (WHERE minute(ts) = 0) AS missing,
  count(*) FILTER (WHERE minute(ts) = 15) AS nan, count(*) FILTER (WHERE minute(ts) = 30) AS infinite, false AS ok FROM forecast""")
def b19_planted(t):
    """Predictions that are missing, NaN or infinite are told apart and counted."""
    at = F.minute("ts")
    bad = F.when(at == 15, math.nan).when(at == 30, -math.inf).when(at != 0, F.col("prediction"))
    return validate.finite_prediction(t.forecast.withColumn("prediction", bad))


@add("b20_calendar_year_check", "year:i rows:i", None,
     "SELECT year(o_orderdate + to_months(312)) AS year, count(*) AS rows FROM orders "
     "WHERE year(o_orderdate + to_months(312)) > 2026 GROUP BY 1")
def b20(t):
    rows = t.table("orders").select(F.add_months("o_orderdate", 312).cast("timestamp").alias("ts"))
    return validate.unknown_years(rows, t.holidays)


# -- C: leaks ------------------------------------------------------------------------------

AGGS = x.CLEAN + """,
p AS (SELECT *, coalesce(q1, 0) + coalesce(q2, 0) + coalesce(q3, 0) + coalesce(q4, 0) AS p_sum,
  list_avg([q1, q2, q3, q4]) AS p_mean, greatest(q1, q2, q3, q4) AS p_max, least(q1, q2, q3, q4) AS p_min FROM clean)"""


@add("c1_power_aggregates", "src_row:i p_sum:r p_mean:r p_max:r p_min:r", AGGS.replace("FROM clean)",
     "FROM (SELECT * REPLACE (CASE WHEN wind = 0 THEN NULL ELSE q1 END AS q1) FROM clean))"),
     "SELECT * FROM p")
def c1(t):
    rows = t.clean.withColumn("q1", F.when(F.col("wind") != 0, F.col("q1")))
    return leaks.power_aggregates(rows).withColumnsRenamed(
        {leaks.SUM: "p_sum", leaks.MEAN: "p_mean", leaks.MAX: "p_max", leaks.MIN: "p_min"})


OTHERS = ["production", "temp", "wind", "humidity", "rain", "mean4", "staff", "wage", "m", "d"]


def candidate_ctes() -> str:
    """SQL twin of the candidate list: every pair as one row of (column, candidate, difference)."""
    cands = [("sum", "p_sum", None), ("mean", "p_mean", None), ("max", "p_max", None), ("min", "p_min", None)]
    for c in OTHERS:
        for n in ("sum", "mean"):
            cands += [(f"{c} / {n}", f"{c} / nullif(p_{n}, 0)", c), (f"{n} / {c}", f"p_{n} / nullif({c}, 0)", c),
                      (f"{c} * {n}", f"{c} * p_{n}", c)]
    parts = []
    for c in OTHERS:
        for i, (label, expr, partner) in enumerate(cands):
            if partner != c:
                mate = f"'{partner}'" if partner else "NULL"
                parts.append(f"{{'c': '{c}', 'o': {i}, 'k': '{label}', 'p': {mate}, 'x': abs(CAST({c} AS DOUBLE) - ({expr}))}}")
    return AGGS + f""",
cells AS (SELECT unnest([{', '.join(parts)}]) AS u FROM p),
rates_ AS (SELECT u.c AS "column", u.o AS ord, u.k AS candidate, u.p AS partner, count(*) AS rows,
  count(*) FILTER (WHERE u.x <= 0.5 + 1e-9) / count(*) AS rate, max(u.x) AS max_diff
  FROM cells WHERE u.x IS NOT NULL AND isfinite(u.x) GROUP BY 1, 2, 3, 4),
hits AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY r."column" ORDER BY ord) AS rn FROM rates_ r
  WHERE rows >= greatest(100, 0.5 * (SELECT count(*) FROM clean)) AND rate >= 0.99) WHERE rn = 1)"""


CANDS = candidate_ctes()


@add("c2_identity_candidates", "column candidate partner rows:i", CANDS, "SELECT * FROM rates_")
def c2(t):
    return leaks.match_rates(t.clean)


@add("c3_match_rate", "column candidate rate:r max_diff:r3", CANDS, "SELECT * FROM rates_")
def c3(t):
    return leaks.match_rates(t.clean)


@add("c3_first_hits", "column candidate partner rate:r", CANDS, "SELECT * FROM hits")
def c3_hits(t):
    return leaks.first_hits(t.clean)


FINGER = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", bool_or({c} IS NULL) AND bool_and(({c} IS NULL) = (coalesce(p_sum = 0, false) "
    f"OR coalesce(p_mean = 0, false))) AS fingerprint FROM z" for c in OTHERS)


@add("c4_null_fingerprint", "column fingerprint", AGGS.replace("FROM clean)", "FROM (SELECT * REPLACE "
     "(q1 * k AS q1, q2 * k AS q2, q3 * k AS q3, q4 * k AS q4, CASE WHEN k > 0 THEN staff END AS staff) FROM "
     "(SELECT *, CASE WHEN wind = 0 THEN 0 ELSE 1 END AS k FROM clean)))") + ", z AS (SELECT * FROM p)", FINGER)
def c4(t):
    k = F.when(F.col("wind") == 0, 0.0).otherwise(1.0)
    rows = t.clean.withColumns({q: F.col(q) * k for q in ("q1", "q2", "q3", "q4")}).withColumn(
        "staff", F.when(F.col("wind") != 0, F.col("staff")))
    return leaks.null_fingerprint(rows)


@add("c5_resolve_drop", "column candidate decision dropped", CANDS,
     """SELECT "column", candidate, decision, CASE decision WHEN 'drop_column' THEN "column"
  WHEN 'drop_partner' THEN partner END AS dropped FROM (SELECT *, CASE WHEN partner IS NULL THEN 'drop_column'
  WHEN "column" IN ('production','temp','wind','humidity','rain') AND partner IN
    ('production','temp','wind','humidity','rain') THEN 'ask_human'
  WHEN "column" IN ('production','temp','wind','humidity','rain') THEN 'drop_partner'
  ELSE 'drop_column' END AS decision FROM hits)""")
def c5(t):
    return leaks.resolve_drop(leaks.first_hits(t.clean))


CAL = x.CLEAN + ",\nlongc AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS c, {o} AS o, '{k}' AS k, CAST({e} AS BIGINT) AS ka, CAST({c} AS DOUBLE) AS v FROM clean"
    for c in OTHERS for o, (k, e) in enumerate([("hour", "hour"), ("month", "month(day0)"),
                                                ("dayofweek", "isodow(day0) - 1"), ("date", "epoch(day0)")])
) + """),
cnt AS (SELECT c, o, k, ka, v, count(*) AS n FROM longc GROUP BY ALL),
per AS (SELECT c, o, k, ka, max(n) FILTER (WHERE v IS NOT NULL) AS mode_n, sum(n) AS n, min(v) AS lo, max(v) AS hi
  FROM cnt GROUP BY 1, 2, 3, 4),
agree AS (SELECT c AS "column", o, k AS key, coalesce(sum(mode_n), 0) / sum(n) AS agreement,
  min(lo) < max(hi) AS varies FROM per GROUP BY 1, 2, 3)"""


@add("c6_calendar_determined", "column key agreement:r varies", CAL, "SELECT * FROM agree")
def c6(t):
    return leaks.calendar_determined(t.clean)


@add("c6_calendar_hits", "column key agreement:r", CAL,
     "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY o) AS rn FROM agree "
     "WHERE varies AND agreement >= 0.99) WHERE rn = 1")
def c6_hits(t):
    return leaks.calendar_hits(t.clean)


IDENT = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CASE WHEN bool_and({c} IS NOT DISTINCT FROM isodow(day0)) THEN 'dayofweek+1'
  WHEN bool_and({c} IS NOT DISTINCT FROM isodow(day0) - 1) THEN 'dayofweek'
  WHEN bool_and({c} IS NOT DISTINCT FROM day(day0)) THEN 'day of month'
  WHEN bool_and({c} IS NOT DISTINCT FROM month(day0)) THEN 'month'
  WHEN bool_and({c} IS NOT DISTINCT FROM year(day0)) THEN 'year' END AS identity FROM clean""" for c in OTHERS)


@add("c7_calendar_identity", "column identity", x.CLEAN, f"SELECT * FROM ({IDENT}) WHERE identity IS NOT NULL")
def c7(t):
    return leaks.calendar_identity(t.clean)


DROPS = CANDS + CAL[len(x.CLEAN):] + f""",
drops AS (SELECT CASE WHEN partner IS NULL OR "column" NOT IN ('production','temp','wind','humidity','rain')
    THEN "column" ELSE partner END AS c FROM hits
  UNION SELECT "column" FROM agree WHERE varies AND agreement >= 0.99
  UNION SELECT "column" FROM ({IDENT}) WHERE identity IS NOT NULL)"""


@add("c8_drop_leaks", "src_row:i q1:r production:r temp:r n_columns:i dropped", DROPS,
     "SELECT src_row, q1, production, temp, 21 - (SELECT count(*) FROM drops) AS n_columns, "
     "(SELECT string_agg(c, ',' ORDER BY c) FROM drops) AS dropped FROM clean")
def c8(t):
    names = leaks.drop_list(t.clean)
    out = t.clean.drop(*names)
    return out.withColumn("n_columns", F.lit(len(out.columns))).withColumn("dropped", F.lit(",".join(names)))


@add("c8_source_day", "column key:s identity n_rows:i", x.CLEAN,
     "SELECT 'src_day' AS \"column\", 'dayofweek' AS key, 'dayofweek+1' AS identity, count(*) AS n_rows FROM clean")
def c8_day(t):
    """A source column named ``day`` (a weekday number) stands beside the parsed date and is judged like any other."""
    weekday = (F.weekday(validate.parse_mixed_date("dt")) + 1).cast("double")
    rows = stage(validate.build_hour_ts(validate.normalize_hour(validate.drop_bad_dates(validate.with_date(
        t.hourly.withColumn("day", weekday))))).filter(~F.dayofmonth("day").isin(13, 15)), "source-day")
    hit = leaks.calendar_hits(rows, [validate.SOURCE_DAY])
    same = leaks.calendar_identity(rows, [validate.SOURCE_DAY])
    return hit.join(same, "column").withColumn("n_rows", F.lit(rows.count()))


# -- D: imputation -------------------------------------------------------------------------

def filled_sql(c: str) -> str:
    return (f"coalesce({c}, median({c}) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED "
            f"PRECEDING AND 1 PRECEDING)) AS {c}")


FILLED = x.CLEAN + f""",
filled AS (SELECT * REPLACE ({filled_sql('temp')}, {filled_sql('humidity')}) FROM clean)"""


@add("d1_impute_past_median", "series_id ts:t temp:r humidity:r", FILLED, "SELECT * FROM filled")
def d1(t):
    return impute.impute_past_median(t.clean, ["temp", "humidity"])


@add("d1_impute_audit", "series_id column missing:i filled:i left:i", FILLED, " UNION ALL ".join(
    f"SELECT c.series_id, '{c}' AS \"column\", count(*) FILTER (WHERE c.{c} IS NULL) AS missing, "
    f"count(*) FILTER (WHERE c.{c} IS NULL AND f.{c} IS NOT NULL) AS filled, count(*) FILTER (WHERE f.{c} IS NULL) "
    f"AS \"left\" FROM clean c JOIN filled f USING (series_id, ts) GROUP BY 1" for c in ("temp", "humidity")))
def d1_audit(t):
    cols = ["temp", "humidity"]
    return impute.impute_audit(t.clean, impute.impute_past_median(t.clean, cols), cols)


@add("d2_impute_train_median", "series_id ts:t temp:r humidity:r", x.OBSERVED + """,
middle AS (SELECT median(temp) AS mt, median(humidity) AS mh FROM observed WHERE split = 'train')""",
     "SELECT series_id, ts, coalesce(temp, mt) AS temp, coalesce(humidity, mh) AS humidity FROM observed, middle")
def d2(t):
    return impute.impute_train_median(t.observed, ["temp", "humidity"])


@add("d3_default_fill", "series_id ts:t days_since_active:i prev_day_active:i", x.DENSE,
     "SELECT series_id, ts, CASE WHEN temp IS NULL THEN 0 ELSE 5 END AS days_since_active, "
     "CASE WHEN humidity IS NULL THEN 1 ELSE 0 END AS prev_day_active FROM dense")
def d3(t):
    rows = t.dense.withColumns({
        "days_since_active": F.when(F.col("temp").isNotNull(), 5),
        "prev_day_active": F.when(F.col("humidity").isNotNull(), 0)})
    return features.default_fill(rows)


# -- E: reshaping --------------------------------------------------------------------------

LONG = x.CLEAN + """,
long15 AS (SELECT series_id, ts + to_minutes(15 * i) AS ts, [q1, q2, q3, q4][i + 1] AS kw, production, temp
  FROM clean, (SELECT unnest([0, 1, 2, 3]) AS i))"""


@add("e1_to_15min", "series_id ts:t kw:r production:r", LONG, "SELECT * FROM long15")
def e1(t):
    return reshape.to_15min(t.clean, ["production"])


@add("e2_add_segments", "series_id ts:t kw:r segment:i", x.NATURAL + ",\n" + x.segmented("natural_r"),
     "SELECT * FROM seg")
def e2(t):
    return reshape.add_segments(t.natural)


@add("e2_segments_after_cleaning", "series_id ts:t segment:i", LONG + ",\n" + x.segmented("long15"),
     "SELECT * FROM seg")
def e2_clean(t):
    return reshape.add_segments(reshape.to_15min(t.clean))


@add("e3_segment_stats", "series_id segments:i min_rows:i max_rows:i", x.NATURAL + ",\n" + x.segmented("natural_r"),
     "SELECT series_id, count(*) AS segments, min(n) AS min_rows, max(n) AS max_rows FROM (SELECT series_id, segment, "
     "count(*) AS n FROM seg GROUP BY 1, 2) GROUP BY 1")
def e3(t):
    return reshape.segment_stats(reshape.add_segments(t.natural))


@add("e3_gap_starts", "series_id ts:t n:i", x.NATURAL, """SELECT * FROM (SELECT series_id, ts, row_number() OVER
  (PARTITION BY series_id ORDER BY ts) AS n FROM (SELECT series_id, ts, ts - lag(ts) OVER (PARTITION BY series_id
  ORDER BY ts) AS step FROM natural_r) WHERE step > INTERVAL '15 minutes') WHERE n <= 10""")
def e3_gaps(t):
    return reshape.gap_starts(t.natural)


@add("e4_prune_helpers", "series_id ts:t kw:r n_columns:i", x.DENSE, "SELECT series_id, ts, kw, 9 AS n_columns FROM dense")
def e4(t):
    out = reshape.prune_helpers(t.dense.withColumn("_x", F.lit(1)).withColumn("segment", F.lit(1)))
    return out.withColumn("n_columns", F.lit(len(out.columns)))


@add("e5_line_breaks", "series_id ts:t kw:r path:r", x.NATURAL + """,
n2 AS (SELECT series_id, ts, CAST(ts AS DATE) AS dk, CASE WHEN n_events % 3 <> 0 THEN kw END AS kw FROM natural_r),
n3 AS (SELECT *, kw IS NOT NULL AND NOT coalesce(lag(kw) OVER w IS NOT NULL AND ts - lag(ts) OVER w <=
  INTERVAL '15 minutes', false) AS lift FROM n2 WINDOW w AS (PARTITION BY series_id, dk ORDER BY ts))""",
     "SELECT series_id, ts, kw, CASE WHEN kw IS NOT NULL THEN sum(CAST(lift AS INTEGER)) OVER (PARTITION BY "
     "series_id, dk ORDER BY ts ROWS UNBOUNDED PRECEDING) END AS path FROM n3")
def e5(t):
    rows = (t.natural.withColumn("kw", F.when(F.col("n_events") % 3 != 0, F.col("kw")))
            .withColumn("day_key", F.date_format("ts", "yyyy-MM-dd")))
    return reshape.line_breaks(rows)
