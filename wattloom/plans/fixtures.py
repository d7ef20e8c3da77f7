"""Meter data derived from the supplied tables, in Spark and as SQL text.

Every view reads a whole table and grows with it. Power values are multiples of 1/64, so sums and
means are exact in any order and can be compared bit by bit.

* ``natural``  events summed per type and 15 minutes: irregular, with many gaps
* ``dense``    every order is one 15-minute reading; 2,880 consecutive orders (30 days) are one
               meter; meters start on different days of 2021-2026; days 6-9 run at 1/16 load
* ``long``     the same readings with 17,280 consecutive orders (180 days) to a meter: room for
               walk-forward folds of whole months
* ``hourly``   the dense readings as raw hourly rows with planted defects: corrupt hours on days
               13 and 15, mixed and unreadable date texts, two columns computed from power
* ``tariff``   orders moved to 2021-2026: all seasons, hours and holidays
* ``daily``    shipments per return flag and day, 1995-2001: long series for folds
* ``observed`` labelled dense readings with split and stand-in predictions in the test part
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.functions import fixed_values as fv
from wattloom.functions.columns import date_key, plus_minutes
from wattloom.operators import features, split
from wattloom.plans import preprocess
from wattloom.session import pin
from wattloom.sources.dimensions import load_holidays, load_tariff

METER_SLOTS = 2880
LONG_SLOTS = 17280
START = "2021-12-17"


class Fixtures:
    """The derived views over one data folder; all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = pin(spark), sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """A supplied table. Zone-less timestamps become timestamps in the pinned zone."""
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df

    @cached_property
    def natural(self) -> DataFrame:
        e = self.table("events")
        slot = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 900) * 900)
        return (e.groupBy(F.col("event_type").alias("series_id"), slot.alias("ts"))
                .agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("kw"),
                     F.count(F.lit(1)).alias("n_events")))

    def meters(self, prefix: str, slots: int) -> DataFrame:
        """Orders as 15-minute readings, ``slots`` consecutive ones to a meter."""
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
        meter = F.expr(f"o_orderkey div {slots}")
        minutes = (meter * 37 % 1700) * 1440 + F.expr(f"o_orderkey % {slots}") * 15
        ts = plus_minutes(F.lit(START).cast("timestamp"), minutes)
        cust = F.col("o_custkey")
        rows = o.select(
            F.concat(F.lit(prefix), meter.cast("string")).alias("series_id"), ts.alias("ts"),
            (F.floor(F.col("o_totalprice") / 250) / 4).alias("kw"),
            (cust % 400).cast("double").alias("production"),
            F.when(cust % 11 != 0, (cust % 256) / 8 - 8).alias("temp"),
            ((cust % 64) / 8).alias("wind"),
            F.when(cust % 97 != 0, (cust % 80 + 20).cast("double")).alias("humidity"),
            ((F.col("o_orderkey") % 16) / 4).alias("rain"),
            F.expr("o_orderkey div 4 + 2").alias("src_row"))
        low = F.dayofmonth("ts").between(6, 9)
        return rows.withColumn("kw", F.col("kw") * F.when(low, 0.0625).otherwise(1.0))

    @cached_property
    def dense(self) -> DataFrame:
        return self.meters("M", METER_SLOTS)

    @cached_property
    def long(self) -> DataFrame:
        return self.meters("L", LONG_SLOTS)

    @cached_property
    def readings(self) -> DataFrame:
        return self.dense.select("series_id", "ts", "kw")

    @cached_property
    def hourly(self) -> DataFrame:
        d = self.dense.withColumn("h", F.date_trunc("hour", "ts"))
        at = lambda minute, c: F.max(F.when(F.minute("ts") == minute, F.col(c)))
        hours = d.groupBy("series_id", "h").agg(
            F.min("src_row").alias("src_row"), at(0, "kw").alias("q1"), at(15, "kw").alias("q2"),
            at(30, "kw").alias("q3"), at(45, "kw").alias("q4"),
            F.sum("production").alias("production"), at(0, "temp").alias("temp"),
            at(15, "wind").alias("wind"), at(30, "humidity").alias("humidity"),
            at(45, "rain").alias("rain"), F.sum("kw").alias("_s"))
        day, hr = F.dayofmonth("h"), F.hour("h")
        text = (F.when((day == 20) & (hr == 5), "2021-13-01")
                .when(day == 3, F.date_format("h", "yyyyMMdd'.0'"))
                .when(day == 4, F.date_format("h", "yyyy-MM-dd"))
                .otherwise(F.date_format("h", "yyyyMMdd")))
        return hours.select(
            "series_id", "src_row", text.alias("dt"),
            (hr + F.when(day.isin(13, 15), 70).otherwise(0)).cast("double").alias("hr"),
            "q1", "q2", "q3", "q4", "production", "temp", "wind", "humidity", "rain",
            (F.col("_s") / 4).alias("mean4"),
            (F.col("production") / F.nullif(F.col("_s"), F.lit(0.0))).alias("staff"),
            F.when((hr >= 22) | (hr < 6), 13080.0).otherwise(8720.0).alias("wage"),
            F.month("h").alias("m"), day.alias("d"))

    @cached_property
    def clean(self) -> DataFrame:
        """Hourly rows after the date and hour rules."""
        return preprocess.clean_hourly(self.hourly)

    @cached_property
    def tariff(self) -> DataFrame:
        o = self.table("orders")
        months = F.when(F.year("o_orderdate") == 2001, 240).otherwise(312)
        day = F.add_months("o_orderdate", months).cast("timestamp")
        return o.select("o_orderkey", plus_minutes(day, F.col("o_orderkey") * 7 % 96 * 15).alias("ts"),
                        (F.floor(F.col("o_totalprice") / 250) / 4).alias("kw"),
                        F.lit("T").alias("series_id"))

    @cached_property
    def daily(self) -> DataFrame:
        li = self.table("lineitem")
        return (li.groupBy(F.col("l_returnflag").alias("series_id"),
                           F.date_trunc("day", "l_shipdate").alias("ts"))
                .agg((F.floor(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
                              / 1000) / 4).alias("kw")))

    @cached_property
    def holidays(self) -> DataFrame:
        return load_holidays(self.spark)

    @cached_property
    def tariff_dims(self) -> tuple[DataFrame, DataFrame]:
        return load_tariff(self.spark)

    @cached_property
    def observed(self) -> DataFrame:
        f = features.segment_features(self.dense.drop("src_row"),
                                      ["y", "kw_lag1", "kw_roll4", "production_lag4"])
        rows = f.withColumns({"date_key": date_key("ts"), "day_key": F.date_format("ts", "yyyy-MM-dd"),
                              "target_time": plus_minutes("ts", 15)})
        rows = split.drop_unlabelled(split.split_by_fraction(rows))
        return (rows.withColumnsRenamed({"kw_lag1": "a", "kw_roll4": "b"})
                .withColumn("prediction", F.when(F.col("split") == "test",
                                                 F.col("a") * 0.5 + F.col("b") * 0.5)))

    @cached_property
    def forecast(self) -> DataFrame:
        return self.observed.filter(F.col("prediction").isNotNull())

    @cached_property
    def daily_predictions(self) -> DataFrame:
        """Daily series with target and two stand-in models, split by fraction."""
        from pyspark.sql import Window
        w = Window.partitionBy("series_id").orderBy("ts")
        rows = (self.daily.withColumn("y", F.lead("kw").over(w)).withColumn("a", F.col("kw"))
                .withColumn("b", F.avg("kw").over(w.rowsBetween(-3, 0)))
                .withColumn("date_key", date_key("ts")))
        return split.drop_unlabelled(split.split_by_fraction(rows))

    @cached_property
    def requests(self) -> DataFrame:
        """One scenario request per order, some of them out of range."""
        c = F.col("o_custkey")
        return self.table("orders").select(
            F.col("o_orderkey").alias("request_id"), (c % 120).alias("cursor"),
            (F.col("o_totalprice") / 4).alias("production"), (c % 60 - 3).alias("staff"),
            (F.floor("o_totalprice") * 3).cast("double").alias("hourly_wage"), (c % 200).cast("double").alias("energy_rate"),
            (c % 7).cast("double").alias("power_factor"), (c % 50).alias("baseline_staff"),
            F.when(c % 3 == 0, F.col("o_totalprice")).alias("planned_production"),
            F.when(c % 5 != 0, c % 300 - 10).cast("double").alias("unit_price"),
            F.when(c % 4 != 0, (c % 9) * 1000).cast("double").alias("day_wage"))


# -- the same views as SQL text ------------------------------------------------------------

NATURAL = """natural_r AS (
  SELECT event_type AS series_id, time_bucket(INTERVAL '15 minutes', ts) AS ts,
    CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS kw, count(*) AS n_events
  FROM events GROUP BY 1, 2)"""

DENSE = f"""dense AS (
  SELECT * REPLACE (kw * CASE WHEN day(ts) BETWEEN 6 AND 9 THEN 0.0625::DOUBLE ELSE 1 END AS kw) FROM (
  SELECT 'M' || CAST(o_orderkey // {METER_SLOTS} AS VARCHAR) AS series_id,
    TIMESTAMP '{START}' + to_minutes(((o_orderkey // {METER_SLOTS}) * 37 % 1700) * 1440
      + (o_orderkey % {METER_SLOTS}) * 15) AS ts,
    floor(o_totalprice / 250) / 4 AS kw,
    CAST(o_custkey % 400 AS DOUBLE) AS production,
    CASE WHEN o_custkey % 11 <> 0 THEN (o_custkey % 256) / 8 - 8 END AS temp,
    (o_custkey % 64) / 8 AS wind,
    CASE WHEN o_custkey % 97 <> 0 THEN CAST(o_custkey % 80 + 20 AS DOUBLE) END AS humidity,
    (o_orderkey % 16) / 4 AS rain, o_orderkey // 4 + 2 AS src_row
  FROM orders))"""

LONG_METERS = DENSE.replace(f"// {METER_SLOTS}", f"// {LONG_SLOTS}").replace(f"% {METER_SLOTS}", f"% {LONG_SLOTS}").replace("'M' ||", "'L' ||")

HOURLY = DENSE + """,
hours AS (SELECT series_id, date_trunc('hour', ts) AS h, min(src_row) AS src_row,
    max(CASE WHEN minute(ts) = 0 THEN kw END) AS q1, max(CASE WHEN minute(ts) = 15 THEN kw END) AS q2,
    max(CASE WHEN minute(ts) = 30 THEN kw END) AS q3, max(CASE WHEN minute(ts) = 45 THEN kw END) AS q4,
    sum(production) AS production, max(CASE WHEN minute(ts) = 0 THEN temp END) AS temp,
    max(CASE WHEN minute(ts) = 15 THEN wind END) AS wind,
    max(CASE WHEN minute(ts) = 30 THEN humidity END) AS humidity,
    max(CASE WHEN minute(ts) = 45 THEN rain END) AS rain, sum(kw) AS s
  FROM dense GROUP BY 1, 2),
hourly AS (SELECT series_id, src_row,
    CASE WHEN day(h) = 20 AND hour(h) = 5 THEN '2021-13-01'
         WHEN day(h) = 3 THEN strftime(h, '%Y%m%d') || '.0'
         WHEN day(h) = 4 THEN strftime(h, '%Y-%m-%d') ELSE strftime(h, '%Y%m%d') END AS dt,
    CAST(hour(h) + CASE WHEN day(h) IN (13, 15) THEN 70 ELSE 0 END AS DOUBLE) AS hr,
    q1, q2, q3, q4, production, temp, wind, humidity, rain, s / 4 AS mean4,
    production / nullif(s, 0) AS staff,
    CASE WHEN hour(h) >= 22 OR hour(h) < 6 THEN 13080.0::DOUBLE ELSE 8720.0::DOUBLE END AS wage,
    month(h) AS m, day(h) AS d FROM hours)"""

DATED = HOURLY + """,
dated AS (SELECT *, coalesce(try_strptime(regexp_replace(dt, '\\.0$', ''), '%Y%m%d'),
    try_strptime(regexp_replace(dt, '\\.0$', ''), '%Y-%m-%d')) AS day0 FROM hourly)"""

QUALITY = DATED + """,
quality AS (SELECT series_id, day0, count(*) AS n_rows, count(DISTINCT hr) AS distinct_hours,
    bool_and(hr >= 0 AND hr <= 23 AND hr = floor(hr)) AND count(DISTINCT hr) = count(*) AS hours_ok
  FROM dated WHERE day0 IS NOT NULL GROUP BY 1, 2)"""

CLEAN = QUALITY + """,
clean AS (SELECT d.*, CAST(hr AS INTEGER) AS hour, d.day0 + to_hours(CAST(hr AS BIGINT)) AS ts
  FROM dated d JOIN quality k ON d.series_id = k.series_id AND d.day0 = k.day0 AND k.hours_ok)"""

TARIFF = """tariff AS (
  SELECT o_orderkey, o_orderdate + to_months(CASE WHEN year(o_orderdate) = 2001 THEN 240 ELSE 312 END)
    + to_minutes((o_orderkey * 7) % 96 * 15) AS ts, floor(o_totalprice / 250) / 4 AS kw FROM orders)"""

DAILY = """daily AS (
  SELECT l_returnflag AS series_id, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts,
    floor(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / 1000) / 4 AS kw
  FROM lineitem GROUP BY 1, 2)"""

HOLIDAYS = ("holidays AS (SELECT CAST(d AS DATE) AS date, year(CAST(d AS DATE)) AS year, name FROM (VALUES "
            + ", ".join(f"('{d}', '{n}')" for d, n in fv.holidays()) + ") v(d, name))")

BANDS = ("bands AS (SELECT * FROM (VALUES "
         + ", ".join(f"('{s}', '{b}', {i[0]}, {i[1]})" for s, bs in fv.TIME_BANDS.items()
                     for b, ivs in bs.items() for i in ivs) + ") v(season, band, h_start, h_end))")

RATES = ("rates AS (SELECT season, band, CAST(rate AS DOUBLE) AS rate FROM (VALUES "
         + ", ".join(f"('{s}', '{b}', {r})" for s, bs in fv.RATES.items() for b, r in bs.items())
         + ") v(season, band, rate))")


def segmented(source: str) -> str:
    """CTE ``seg``: the rows of a view with their segment number."""
    return f"""stepped AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY series_id ORDER BY ts)
    = INTERVAL '15 minutes' THEN 0 ELSE 1 END AS new_seg FROM {source}),
seg AS (SELECT * EXCLUDE (new_seg), sum(new_seg) OVER (PARTITION BY series_id ORDER BY ts
    ROWS UNBOUNDED PRECEDING) AS segment FROM stepped)"""


SEG = DENSE + ",\n" + segmented("dense")
W = "WINDOW w AS (PARTITION BY series_id, segment ORDER BY ts)"
FRAME = "OVER (PARTITION BY series_id, segment ORDER BY ts ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


def full(n: int, agg: str) -> str:
    """Aggregate of the last n values, missing unless all are there."""
    f = FRAME.format(n=n - 1)
    return f"CASE WHEN count(kw) {f} = {n} THEN {agg}(kw) {f} END"


DATE_KEY = "CAST(strftime(ts, '%Y%m%d') AS INTEGER)"


def split_ctes(source: str) -> str:
    """CTE ``parted``: rows with ``split`` by the default fraction, per series."""
    return f"""days_ AS (SELECT series_id, date_key, row_number() OVER (PARTITION BY series_id
    ORDER BY date_key) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n
  FROM (SELECT DISTINCT series_id, date_key FROM {source})),
bound_ AS (SELECT series_id, date_key AS boundary FROM days_ WHERE i = floor(n * (1 - 3e-1))),
parted AS (SELECT s.*, CASE WHEN s.date_key < b.boundary THEN 'train' ELSE 'test' END AS split
  FROM {source} s JOIN bound_ b USING (series_id))"""


OBSERVED = SEG + f""",
feat AS (SELECT series_id, ts, kw, production, temp, wind, humidity, rain, lead(kw) OVER w AS y,
    kw AS a, {full(4, 'avg')} AS b, lag(production, 4) OVER w AS production_lag4,
    {DATE_KEY} AS date_key, strftime(ts, '%Y-%m-%d') AS day_key,
    ts + INTERVAL '15 minutes' AS target_time FROM seg {W}),
""" + split_ctes("feat") + """,
observed AS (SELECT *, CASE WHEN split = 'test' THEN a * 0.5::DOUBLE + b * 0.5::DOUBLE END AS prediction
  FROM parted WHERE y IS NOT NULL),
forecast AS (SELECT * FROM observed WHERE prediction IS NOT NULL)"""

DAILY_PRED = DAILY + f""",
dfeat AS (SELECT *, lead(kw) OVER w AS y, kw AS a,
    avg(kw) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS b,
    {DATE_KEY} AS date_key FROM daily WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
""" + split_ctes("dfeat") + """,
dpred AS (SELECT * FROM parted WHERE y IS NOT NULL)"""

THRESHOLD = OBSERVED + """,
peaks AS (SELECT *, max(kw) OVER p AS annual_peak, min(ts) OVER p AS coverage_start,
    arg_max({'t': ts}, {'k': kw, 'n': -epoch(ts)}) OVER p AS top
  FROM observed WINDOW p AS (PARTITION BY series_id, year(ts) ORDER BY ts ROWS UNBOUNDED PRECEDING)),
laid AS (SELECT series_id, year(ts) AS yr, ts AS t_, 1 AS kind, NULL::DOUBLE AS x, ts FROM forecast
  UNION ALL SELECT series_id, year(target_time), target_time, 0, greatest(0, y - prediction), NULL FROM forecast),
marg AS (SELECT *, quantile_cont(x, 0.9) OVER q AS p90, count(x) OVER q AS n FROM laid
  WINDOW q AS (PARTITION BY series_id, yr ORDER BY t_, kind ROWS UNBOUNDED PRECEDING)),
margins AS (SELECT p.*, m.n AS error_samples,
    CASE WHEN m.n >= 30 THEN m.p90 ELSE p.annual_peak * 0.05::DOUBLE END AS error_margin,
    CASE WHEN m.n >= 30 THEN 'quantile' ELSE 'peak_share' END AS basis
  FROM peaks p JOIN marg m ON m.kind = 1 AND m.series_id = p.series_id AND m.ts = p.ts)"""


def half_even_sql(expr: str, digits: int) -> str:
    """Half-to-even rounding on the decimal form of a double, as in ``functions.half_even``."""
    d = f"CAST(CAST({expr} AS DOUBLE) AS DECIMAL(28,10))"
    up = f"round({d}, {digits})"
    return (f"CAST(CASE WHEN abs({d} * {10 ** digits}) % 2 = 0.5 THEN trunc({d} * {10 ** digits})"
            f" / {10 ** digits} ELSE {up} END AS DOUBLE)")


RECOMMEND = THRESHOLD + f""",
rec AS (SELECT *, {half_even_sql('greatest(1, annual_peak - error_margin)', 1)} AS threshold FROM margins)"""
