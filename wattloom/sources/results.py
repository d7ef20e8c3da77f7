"""Sinks and result tables: exports, audit, fingerprints, stored settings and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.config import DEFAULT, Settings
from wattloom.functions import fixed_values as fv
from wattloom.operators import blocks
from wattloom.operators.validate import RuleViolation


def prediction_rows(frame: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    return frame.select(cfg.series, "target_time", F.col("y").alias("actual_kw"),
                        F.col("prediction").alias("predicted_kw"))


def export_predictions(frame: DataFrame, path: str, cfg: Settings = DEFAULT) -> None:
    prediction_rows(frame, cfg).write.mode("overwrite").csv(path, header=True)


def export_day_points(points: DataFrame, path: str) -> None:
    """Day points as CSV; missing values are empty fields."""
    (points.select("series_id", "day_key", "time", "actual", "predicted")
     .write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue=""))


def row_digest(df: DataFrame, columns) -> DataFrame:
    """SHA-256 of the text form of each row. Each value comes after its length and a colon, a missing one is
    a tilde, so no two different rows have one form."""
    def form(c: str):
        text = F.col(c).cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~"))
    return df.withColumn("digest", F.sha2(F.concat(*map(form, columns)), 256))


def table_fingerprint(df: DataFrame, columns, keys=()) -> DataFrame:
    """Order-free fingerprint: row count, sum and bitwise xor of the row digests' first 52 bits."""
    head = F.conv(F.substring("digest", 1, 13), 16, 10).cast("long")
    return (row_digest(df, columns).withColumn("_h", head).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("rows"),
                 F.sum(F.col("_h").cast("decimal(38,0)")).cast("string").alias("digest_sum"),
                 F.bit_xor("_h").alias("digest_xor")))


def ordered_fingerprint(df: DataFrame, columns, cfg: Settings = DEFAULT, fan: int = 4096) -> DataFrame:
    """Per series: row count and a digest that depends on the order of the rows in time.

    A hash tree: the row digests of ``fan`` consecutive rows are hashed together, then ``fan`` of these hashes, until one is left.
    Places come from counts per day (no task holds a series), so the digest does not depend on how the rows are dealt.
    """
    level = blocks.running_rank(row_digest(df.select(cfg.series, cfg.ts, *[c for c in columns if c not in (cfg.series, cfg.ts)]), columns),
                                cfg, None, "_place", "rows").select(cfg.series, "rows", (F.col("_place") - 1).alias("_place"), "digest")
    longest = level.agg(F.max("rows")).first()[0] or 0
    while True:
        part = F.expr(f"_place div {fan}")
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("_place", "digest"))), lambda s: s["digest"])
        level = level.groupBy(cfg.series, "rows", part.alias("_part")).agg(F.sha2(F.array_join(ordered, ""), 256).alias("digest")) \
            .withColumnRenamed("_part", "_place")
        longest = -(-longest // fan)
        if longest <= 1:
            return level.select(cfg.series, "rows", "digest")


# -- audit ---------------------------------------------------------------------------------

AUDIT_SCHEMA = ("run_id string, step string, metrics map<string,string>, "
                "details array<struct<item:string,value:string>>")


def audit_step(run_id: str, step: str, metrics: DataFrame, details: DataFrame | None = None,
               limit: int = 20) -> DataFrame:
    """One audit row from a one-row metrics table and an optional detail table (item, value).

    Every rule writes one, also when it changed nothing. The metrics are whole; the details of this row
    are a preview of ``limit`` rows, ``audit_details`` has them all.
    """
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in metrics.columns]),
                              F.array(*[F.col(c).cast("string") for c in metrics.columns]))
    row = metrics.select(F.lit(run_id).alias("run_id"), F.lit(step).alias("step"),
                         pairs.alias("metrics"))
    if details is None:
        return row.withColumn("details", F.expr("cast(array() as array<struct<item:string,value:string>>)"))
    few = (details.select(F.col("item").cast("string"), F.col("value").cast("string"))
           .orderBy("item").limit(limit)
           .agg(F.array_sort(F.collect_list(F.struct("item", "value"))).alias("details")))
    return row.join(few.withColumn("step", F.lit(step)), "step", "left").select(
        "run_id", "step", "metrics", "details")


def audit_details(run_id: str, step: str, details: DataFrame, sample: int | None = None) -> DataFrame:
    """Details of a step as rows (run_id, step, item, value): all of them, or the first ``sample`` by
    item for a step whose list the reference cuts."""
    if sample is not None:
        details = details.orderBy("item").limit(sample)
    return details.select(F.lit(run_id).alias("run_id"), F.lit(step).alias("step"),
                          F.col("item").cast("string"), F.col("value").cast("string"))


def write_audit(steps: list[DataFrame], path: str) -> None:
    """Append audit rows of one kind: of ``audit_step``, or of ``audit_details`` to a folder of its own."""
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    out.write.mode("append").parquet(path)


# -- stored settings and evaluations -------------------------------------------------------

def settings_row(spark: SparkSession, cfg: Settings = DEFAULT, select: str = "test") -> DataFrame:
    """The settings a model depends on, as one row."""
    return spark.range(1).select(
        F.array(*[F.lit(c) for c in fv.TREE_FEATURES]).alias("tree_features"),
        F.array(*[F.lit(c) for c in fv.SEQUENCE_CALENDAR]).alias("sequence_calendar"),
        F.array(*[F.lit(c) for c in fv.TREE_FEATURES + fv.WEATHER_LAGS]).alias("gate_features"),
        F.lit(cfg.window).cast("long").alias("window"),
        F.lit(cfg.window_rows).cast("long").alias("window_rows"),
        F.lit("0.01..0.99/99").alias("blend_grid"), F.lit(select).alias("blend_select"))


def settings_differences(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Names and values of the settings that differ between two one-row tables."""
    def long(df: DataFrame, name: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("setting"), F.to_json(F.struct(c)).alias(name))
                          for c in sorted(df.columns)])
        return df.select(F.inline(cells))
    both = long(stored, "stored").join(long(current, "current"), "setting", "full_outer")
    return both.filter(~F.col("stored").eqNullSafe(F.col("current")))


def model_gate(stored: DataFrame, current: DataFrame) -> None:
    """Refuse to score with a model that was fitted under other settings."""
    diff = [r["setting"] for r in settings_differences(stored, current).collect()]
    if diff:
        raise RuleViolation(f"stored model settings differ: {sorted(diff)}")


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(name, digest) of the files below a folder; names are relative to it, without the run's mark in Spark's part names.
    Bookkeeping files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    tail = folder.rstrip("/").rsplit("/", 1)[-1]
    name = F.regexp_extract("path", f"/{tail}/(.*)$", 1)
    name = F.regexp_replace(name, r"part-(\d+)-[0-9a-f-]{36}(-c\d+)?", "part-$1")
    return files.select(name.alias("name"), F.sha2("content", 256).alias("digest")).filter(~F.col("name").rlike(r"(^|/)[._][^/]*$"))


def write_manifest(spark: SparkSession, folder: str, ensemble: bool = False, blend_weight: float | None = None,
                   test_rows: DataFrame | None = None, cfg: Settings = DEFAULT) -> None:
    """What was evaluated: digests of the model's files, the blend weight, and the ordered digest of the test times."""
    rows = None if test_rows is None else ordered_fingerprint(test_rows, [cfg.series, cfg.ts], cfg).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(cfg.series, "digest"))), lambda s: s["digest"]), ",")).first()[0]
    file_digests(spark, f"{folder}/model").agg(F.array_sort(F.collect_list(F.struct("name", "digest"))).alias("files")).select(
        "files", F.lit(ensemble).alias("ensemble"), F.lit(blend_weight).cast("double").alias("blend_weight"),
        F.lit(rows).alias("test_rows")).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


MANIFEST = "files array<struct<name:string,digest:string>>, ensemble boolean, blend_weight double, test_rows string"


def manifest_faults(spark: SparkSession, folder: str, blended: bool = False) -> DataFrame:
    """(fault, name) of every difference between a model folder and its manifest; with ``blended`` also what a blended forecast
    needs: an evaluated ensemble and its weight."""
    stored = spark.read.schema(MANIFEST).json(f"{folder}/manifest")
    told = stored.select(F.inline("files")).withColumnRenamed("digest", "told")
    both = told.join(file_digests(spark, f"{folder}/model"), "name", "full_outer")
    kind = F.when(F.col("digest").isNull(), "missing file").when(F.col("told").isNull(), "unknown file").otherwise("changed file")
    out = both.filter(~F.col("told").eqNullSafe(F.col("digest"))).select(kind.alias("fault"), "name")
    if blended:
        wanted = F.array(F.when(~F.col("ensemble"), F.struct(F.lit("not an ensemble").alias("fault"), F.lit("ensemble").alias("name"))),
                         F.when(F.col("blend_weight").isNull(), F.struct(F.lit("no weight").alias("fault"), F.lit("blend_weight").alias("name"))))
        out = out.unionByName(stored.select(F.explode(F.array_compact(wanted)).alias("x")).select("x.*"))
    return out


def artefact_gate(spark: SparkSession, folder: str, blended: bool = False) -> None:
    """Refuse files that are not those that were evaluated."""
    faults = [f"{r['fault']}: {r['name']}" for r in manifest_faults(spark, folder, blended).limit(20).collect()]
    if faults:
        raise RuleViolation(f"the stored model is not the evaluated one: {sorted(faults)}")


EVAL_JSON = ("models map<string,map<string,struct<MSE:double,RMSE:double,MAE:double,R2:double,"
             "bias:double,rows:long>>>")


def write_eval(scores: DataFrame, path: str) -> None:
    """Scores (model, fold, mse, …) as one nested JSON document per run (a few dozen numbers)."""
    cell = F.struct(F.col("mse").alias("MSE"), F.col("rmse").alias("RMSE"), F.col("mae").alias("MAE"),
                    F.col("r2").alias("R2"), "bias", "rows")
    per_model = scores.groupBy("model").agg(F.map_from_entries(
        F.collect_list(F.struct("fold", cell.alias("c")))).alias("folds"))
    doc = per_model.agg(F.map_from_entries(F.collect_list(F.struct("model", "folds"))).alias("models"))
    doc.coalesce(1).write.mode("overwrite").json(path)


def load_eval(spark: SparkSession, path: str) -> DataFrame:
    """Nested results JSON to long rows (model, fold, metric, value)."""
    doc = spark.read.schema(EVAL_JSON).json(path)
    cells = (doc.select(F.explode("models").alias("model", "folds"))
             .select("model", F.explode("folds").alias("fold", "c")))
    names = ("MSE", "RMSE", "MAE", "R2", "bias", "rows")
    return cells.select("model", "fold", F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(f"c.{n}").cast("double").alias("value"))
        for n in names])))


def _results_schema() -> str:
    cell = "struct<" + ",".join(f"{n}:{'long' if n == 'rows' else 'double'}" for n in fv.RESULTS_SCORES) + ">"
    weight = f"struct<`{fv.RESULTS_WEIGHT}`:double,`{fv.RESULTS_FORWARD}`:double,`{fv.RESULTS_TEST}`:double>"
    search = f"struct<`{fv.RESULTS_BY}`:string,`{fv.RESULTS_CHOSEN}`:double,`{fv.RESULTS_TABLE}`:array<{weight}>>"
    return f"`{fv.RESULTS_FOLDS}` map<string,map<string,{cell}>>, `{fv.RESULTS_SEARCH}` {search}"


def load_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A stored results document, also over many lines: scores (model, fold, metric, value), the table of blend weights
    (w, forward, test), and the choice (weight, criterion). Further fields are ignored; a document without a search has no weights."""
    doc = spark.read.schema(_results_schema()).option("multiLine", True).json(path)
    cells = doc.select(F.explode(F.col(fv.RESULTS_FOLDS)).alias("model", "folds")).select("model", F.explode("folds").alias("fold", "c"))
    scores = cells.select("model", "fold", F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(f"c.{n}").cast("double").alias("value")) for n in fv.RESULTS_SCORES])))
    search = doc.select(F.col(fv.RESULTS_SEARCH).alias("s")).filter("s IS NOT NULL")
    table = search.select(F.explode(F.col("s")[fv.RESULTS_TABLE]).alias("x")).select(
        F.col("x")[fv.RESULTS_WEIGHT].alias("w"), F.col("x")[fv.RESULTS_FORWARD].alias("forward"), F.col("x")[fv.RESULTS_TEST].alias("test"))
    choice = search.select(F.col("s")[fv.RESULTS_CHOSEN].alias("weight"), F.col("s")[fv.RESULTS_BY].alias("criterion"))
    return scores, table, choice


def write_results(scores: DataFrame, weights: DataFrame, choice: DataFrame, path: str, by: str = "test") -> None:
    """The document that ``load_results`` reads, from scores (model, fold, mse, …), blend weights and the choice among them. One
    document of a few hundred numbers."""
    cell = F.struct(F.col("mse").alias("MSE"), F.col("rmse").alias("RMSE"), F.col("mae").alias("MAE"), F.col("r2").alias("R2"), "bias", "rows")
    per_model = scores.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("fold", cell.alias("c")))).alias("folds"))
    folds = per_model.agg(F.map_from_entries(F.collect_list(F.struct("model", "folds"))).alias(fv.RESULTS_FOLDS))
    row = F.struct(F.col("w").alias(fv.RESULTS_WEIGHT), F.col("forward").alias(fv.RESULTS_FORWARD), F.col("test").alias(fv.RESULTS_TEST))
    table = weights.agg(F.array_sort(F.collect_list(row)).alias("t"))
    picked = choice.agg(F.first("weight").alias("w"))
    search = F.struct(F.lit(by).alias(fv.RESULTS_BY), F.col("w").alias(fv.RESULTS_CHOSEN), F.col("t").alias(fv.RESULTS_TABLE))
    one = F.lit(1).alias("_1")
    folds.select("*", one).join(table.select("t", one), "_1").join(picked.select("w", one), "_1") \
        .select(fv.RESULTS_FOLDS, search.alias(fv.RESULTS_SEARCH)).coalesce(1).write.mode("overwrite").json(path)
