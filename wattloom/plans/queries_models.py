"""Queries over predictions: scaling, scores, blend, models and stored results."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattloom.functions import fixed_values as fv
from wattloom.operators import evaluate, features, models, split
from wattloom.plans import fixtures as x
from wattloom.plans.queries_features import FOLDS, LABELLED, eval_rows, labelled
from wattloom.plans.registry import REGISTRY
from wattloom.session import shared_folder, stage
from wattloom.sources import results

add = REGISTRY.add


# -- G12: scaling --------------------------------------------------------------------------

@add("g12_train_stats", "series_id rows:i x_mean:r x_std:r y_mean:r y_std:r", LABELLED + """,
ends_ AS (SELECT *, sum(kw) OVER f AS s, sum(kw * kw) OVER f AS q FROM windows
  WINDOW f AS (PARTITION BY series_id, segment ORDER BY ts ROWS BETWEEN 95 PRECEDING AND CURRENT ROW)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn, count(*) OVER (PARTITION BY
  series_id) AS n FROM ends_ WHERE window_ok)""",
     """SELECT series_id, count(*) AS rows, sum(s) / (96 * count(*)) AS x_mean,
  sqrt(sum(q) / (96 * count(*)) - pow(sum(s) / (96 * count(*)), 2)) + 1e-8 AS x_std,
  avg(y) AS y_mean, stddev_pop(y) + 1e-8 AS y_std FROM ranked WHERE rn <= floor(0.85::DOUBLE * n) GROUP BY 1""")
def g12(t):
    rows = split.tail_validation(split.window_vectors(labelled(t)))
    return split.train_stats(rows)


# -- G13 - G20: scores and blend -----------------------------------------------------------

H = x.half_even_sql
LONGP = FOLDS + f""",
longp AS (SELECT series_id, ts, fold, y, 'a' AS model, a AS p FROM evals UNION ALL
  SELECT series_id, ts, fold, y, 'b', b FROM evals UNION ALL
  SELECT series_id, ts, fold, y, 'blend', a * 0.25::DOUBLE + b * 0.75::DOUBLE FROM evals),
moments AS (SELECT series_id, model, fold, count(*) AS rows, avg((y - p) * (y - p)) AS m, avg(abs(y - p)) AS ae,
  avg(y - p) AS e, var_pop(y) AS v FROM longp GROUP BY 1, 2, 3),
scores AS (SELECT series_id, model, fold, rows, {H('m', 4)} AS mse, {H('sqrt(m)', 4)} AS rmse, {H('ae', 4)} AS mae,
  {H('CASE WHEN v <> 0 THEN 1 - m / v END', 6)} AS r2, {H('e', 4)} AS bias FROM moments),
folded AS (SELECT series_id, model, avg(mse) FILTER (WHERE fold <> 'test') AS fm, stddev_pop(mse) FILTER (WHERE
  fold <> 'test') AS fs, max(mse) FILTER (WHERE fold = 'test') AS test_mse FROM scores GROUP BY 1, 2),
summary AS (SELECT series_id, model, {H('fm', 3)} AS forward_mean, {H('fs', 3)} AS forward_std, test_mse FROM folded)"""


def long_predictions(t):
    """One row per model, fold, series and time."""
    rows = evaluate.blend(eval_rows(t), 0.25, out="c")
    return rows.select("series_id", "ts", "fold", "y", F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(c).alias("prediction"))
        for m, c in (("a", "a"), ("b", "b"), ("blend", "c"))])))


def scores(t):
    return evaluate.score(long_predictions(t), ["series_id", "model", "fold"])


@add("g13_score", "series_id model fold rows:i mse:r4 rmse:r4 mae:r4 r2:r6 bias:r4", LONGP, "SELECT * FROM scores")
def g13(t):
    return scores(t)


@add("g14_fold_summary", "series_id model forward_mean:r3 forward_std:r3 test_mse:r4", LONGP, "SELECT * FROM summary")
def g14(t):
    return evaluate.fold_summary(scores(t), ["series_id", "model"])


GRID = FOLDS + f""",
per_fold AS (SELECT series_id, fold, i / 1e2 AS w, avg(pow(y - (i / 1e2 * a + (1 - i / 1e2) * b), 2)) AS mse
  FROM evals, (SELECT unnest(generate_series(1, 99)) AS i) GROUP BY 1, 2, 3),
raw_grid AS (SELECT series_id, w, avg(mse) FILTER (WHERE fold <> 'test') AS f, max(mse) FILTER (WHERE fold = 'test')
  AS t FROM per_fold GROUP BY 1, 2),
grid AS (SELECT series_id, w, {H('f', 4)} AS forward, {H('t', 4)} AS test FROM raw_grid)"""


@add("g15_blend_search", "series_id w:r2 forward:r4 test:r4", GRID, "SELECT * FROM grid")
def g15(t):
    return evaluate.blend_search(eval_rows(t), ["series_id"])


PICK = GRID + """,
by_test AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY test, abs(w - 0.5::DOUBLE), w)
  AS rn FROM grid) WHERE rn = 1),
by_fwd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY forward, abs(w - 0.5::DOUBLE), w)
  AS rn FROM grid) WHERE rn = 1),
picks AS (SELECT t.series_id, t.w AS weight, 1 - t.w AS other_weight, t.forward, t.test, h.forward AS half_forward,
  h.test AS half_test, f.w AS alt_weight, f.forward AS alt_forward, f.test AS alt_test
  FROM by_test t JOIN by_fwd f USING (series_id) JOIN grid h ON h.series_id = t.series_id AND h.w = 0.5)"""


@add("g16_blend_pick", "series_id weight:r2 other_weight:r2 forward:r4 test:r4 half_forward:r4 half_test:r4 "
     "alt_weight:r2 alt_forward:r4 alt_test:r4", PICK, "SELECT * FROM picks")
def g16(t):
    return evaluate.blend_pick(evaluate.blend_search(eval_rows(t), ["series_id"]), ["series_id"])


@add("g17_blend", "series_id ts:t prediction:r9", x.DAILY_PRED,
     "SELECT *, a * 0.25::DOUBLE + b * 0.75::DOUBLE AS prediction FROM dpred")
def g17(t):
    return evaluate.blend(t.daily_predictions, 0.25)


@add("g18_align_check", "matched:i only_a:i only_b:i ok", x.DAILY_PRED,
     "SELECT count(*) FILTER (WHERE kw > 0 AND b > 50) AS matched, count(*) FILTER (WHERE kw > 0 AND NOT b > 50) AS "
     "only_a, count(*) FILTER (WHERE NOT kw > 0 AND b > 50) AS only_b, false AS ok FROM dpred")
def g18(t):
    rows = t.daily_predictions
    return evaluate.align_check(rows.filter("kw > 0"), rows.filter("b > 50"), ["series_id", "ts"])


@add("g19_seed_average", "series_id ts:t prediction:r9 seeds:i", x.DAILY_PRED,
     "SELECT series_id, ts, (a + b + kw / 2) / 3 AS prediction, 3 AS seeds FROM dpred")
def g19(t):
    rows = t.daily_predictions.select("series_id", "ts", F.inline(F.array(*[
        F.struct(F.lit(s).alias("seed"), c.alias("prediction"))
        for s, c in zip(fv.SEEDS, (F.col("a"), F.col("b"), F.col("kw") / 2))])))
    return evaluate.seed_average(rows, ["series_id", "ts"])


@add("g20_rank_models", "series_id model rank:i forward_mean:r3", LONGP,
     "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY forward_mean NULLS LAST, model) AS rank FROM summary")
def g20(t):
    return evaluate.rank_models(evaluate.fold_summary(scores(t), ["series_id", "model"]), ["series_id"])


@add("h20_model_candidates", "series_id model rank:i forward_mean:r3 test_mse:r4 blend_weight:r2 blend_forward:r4 "
     "blend_test:r4", LONGP + PICK[len(FOLDS):],
     "SELECT s.*, row_number() OVER (PARTITION BY s.series_id ORDER BY forward_mean NULLS LAST, model) AS rank, "
     "p.weight AS blend_weight, p.forward AS blend_forward, p.test AS blend_test FROM summary s "
     "JOIN picks p USING (series_id)")
def h20(t):
    picks = evaluate.blend_pick(evaluate.blend_search(eval_rows(t), ["series_id"]), ["series_id"])
    return evaluate.model_candidates(evaluate.fold_summary(scores(t), ["series_id", "model"]), picks, ["series_id"])


@add("a11_load_eval", "model fold metric value:r6", LONGP + f""",
pm AS (SELECT model, fold, count(*) AS rows, avg((y - p) * (y - p)) AS m, avg(abs(y - p)) AS ae FROM longp GROUP BY 1, 2),
pooled AS (SELECT model, fold, rows, {H('m', 4)} AS mse, {H('ae', 4)} AS mae FROM pm)""",
     "SELECT model, fold, 'MSE' AS metric, mse AS value FROM pooled UNION ALL SELECT model, fold, 'MAE', mae FROM pooled "
     "UNION ALL SELECT model, fold, 'rows', rows FROM pooled")
def a11(t):
    """Write the scores of all series as nested JSON and read them back as long rows."""
    path = shared_folder(t.spark, "eval")
    results.write_eval(evaluate.score(long_predictions(t), ["model", "fold"]), path)
    return results.load_eval(t.spark, path).filter(F.col("metric").isin("MSE", "MAE", "rows"))


POOLED = GRID + """,
pooled_ AS (SELECT fold, i / 1e2 AS w, avg(pow(y - (i / 1e2 * a + (1 - i / 1e2) * b), 2)) AS mse
  FROM evals, (SELECT unnest(generate_series(1, 99)) AS i) GROUP BY 1, 2),
pooled_grid AS (SELECT w, """ + H('f', 4) + " AS forward, " + H('t', 4) + """ AS test FROM (SELECT w,
  avg(mse) FILTER (WHERE fold <> 'test') AS f, max(mse) FILTER (WHERE fold = 'test') AS t FROM pooled_ GROUP BY 1)),
chosen_ AS (SELECT w FROM pooled_grid ORDER BY test, abs(w - 0.5::DOUBLE), w LIMIT 1)"""


@add("a11_load_results", "w:r2 forward:r4 test:r4 chosen", POOLED, "SELECT g.*, g.w = c.w AS chosen FROM pooled_grid g, chosen_ c")
def a11_results(t):
    """Scores, blend weights and the choice as one stored document, read back in its own layout."""
    path, pairs = shared_folder(t.spark, "results"), eval_rows(t)
    weights = evaluate.blend_search(pairs, [])
    results.write_results(evaluate.score(long_predictions(t), ["model", "fold"]), weights, evaluate.blend_pick(weights, []), path)
    _, table, choice = results.load_results(t.spark, path)
    picked = choice.first()["weight"]
    return table.withColumn("chosen", F.col("w") == F.lit(picked))


# -- G21 - G23, A10: models ----------------------------------------------------------------

def usable(t, window=None, readings=None):
    """Usable rows as a stored table: a fit reads them many times."""
    table = split.split_by_fraction(features.all_features(t.dense if readings is None else readings, t.holidays))
    return stage(split.usable_rows(split.drop_unlabelled(table), window=window), "usable")


def usable_sql(source: str) -> str:
    """Usable rows of the meters in ``source`` with split, and their rows of the naive forecast."""
    from wattloom.plans.queries_features import DELAYED, SEGMENT_SQL, USABLE_NULLS
    lags = ", ".join(f"lag({c[:-5]}, 4) OVER w AS {c}" for c in DELAYED)
    return source + ",\n" + x.segmented("dense") + f""",
full_ AS (SELECT series_id, ts, kw, {x.DATE_KEY} AS date_key, {SEGMENT_SQL}, {lags} FROM seg {x.W}),
""" + x.split_ctes("full_") + """,
lab AS (SELECT * FROM parted WHERE y IS NOT NULL),
""" + x.segmented("lab").replace("stepped", "stepped2").replace("seg AS (", "seg2 AS (") + f""",
windows AS (SELECT *, count(kw) OVER (PARTITION BY series_id, segment ORDER BY ts ROWS BETWEEN 95 PRECEDING AND
  CURRENT ROW) = 96 AS window_ok FROM seg2),
usable AS (SELECT * FROM windows WHERE window_ok AND {USABLE_NULLS})"""


def jobs_sql(least: int, months: int | None = None) -> str:
    """Evaluation rows of every job that has enough earlier rows; the n-th newest fold of all series is one job."""
    start = "" if months is None else (f" AND u.date_key >= CAST(strftime(strptime(CAST(j.lo AS VARCHAR), '%Y%m%d') - INTERVAL {months} MONTHS, "
                                       "'%Y%m%d') AS INTEGER)")
    return usable_sql(x.LONG_METERS) + f""",
months_ AS (SELECT series_id, date_trunc('month', ts) AS first, max(ts) AS last FROM usable WHERE split = 'train' GROUP BY 1, 2),
ends_ AS (SELECT *, max(last) OVER (PARTITION BY series_id) AS stop FROM months_),
jobs AS (SELECT series_id, CAST(strftime(first, '%Y%m%d') AS INTEGER) AS lo,
    CAST(strftime(first + INTERVAL 24 DAYS, '%Y%m%d') AS INTEGER) AS hi, strftime(first, '%Y%m%d') AS fold, rn AS fold_no
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY first DESC) AS rn FROM ends_
    WHERE first + INTERVAL 24 DAYS <= stop + INTERVAL 1 DAY) WHERE rn <= 4
  UNION ALL SELECT series_id, min(date_key), NULL, 'test', 0 FROM usable WHERE split = 'test' GROUP BY 1),
enough AS (SELECT fold_no FROM usable u JOIN jobs j ON j.series_id = u.series_id AND u.date_key < j.lo{start} GROUP BY 1
  HAVING count(*) >= {least}),
evals AS (SELECT u.*, j.fold FROM usable u JOIN jobs j ON j.series_id = u.series_id AND u.date_key >= j.lo
  AND (j.hi IS NULL OR u.date_key < j.hi) JOIN enough USING (fold_no))"""


BETTER = ("SELECT series_id, fold, count(*) AS rows, avg((y - kw_lag1) * (y - kw_lag1)) AS persistence_mse, true AS better "
          "FROM evals GROUP BY 1, 2")


def beside_persistence(out):
    """Rows and squared error of "as it is now", and whether the model's is smaller, per series and fold."""
    keys = ["series_id", "fold"]
    naive = evaluate.score(out.withColumn("p0", F.col("kw_lag1")), keys, p="p0").select(*keys, F.col("mse").alias("persistence_mse"))
    return evaluate.score(out, keys).join(naive, keys).withColumn("better", F.col("mse") < F.col("persistence_mse"))


@add("g21_fit_tree_model", "series_id fold rows:i persistence_mse:r3 better", jobs_sql(fv.MIN_TREE_ROWS), BETTER)
def g21(t):
    """Tree ensemble fitted before each walk-forward fold and the test part, scored on it, beside persistence."""
    rows = usable(t, readings=t.long)
    jobs = split.eval_jobs(rows, split.forward_folds(rows))
    return beside_persistence(stage(models.evaluate_jobs(rows, jobs, models.fit_tree_model, models.score_tree_model), "scored"))


@add("g22_fit_sequence_model", "series_id fold rows:i persistence_mse:r3 better", jobs_sql(fv.MIN_SEQUENCE_ROWS, 3), BETTER)
def g22(t):
    """Boosted trees over the last 96 values, three seeds, early stop on the last 15 %: fitted on the
    three months before each walk-forward fold and the test part, scored on it."""
    rows = usable(t, "window", t.long)
    jobs = split.train_lookback(split.eval_jobs(rows, split.forward_folds(rows)))
    out = models.evaluate_jobs(rows, jobs, models.fit_sequence_model,
                               lambda fitted, test: models.score_sequence_model(*fitted, test),
                               least=fv.MIN_SEQUENCE_ROWS)
    return beside_persistence(stage(out, "scored"))


@add("g23_batch_score", "series_id ts:t split y:r scored", usable_sql(x.DENSE),
     "SELECT series_id, ts, split, y, true AS scored FROM usable WHERE split = 'test'")
def g23(t):
    """Fit, store with settings and manifest, pass both gates, load and score the test rows."""
    rows = usable(t)
    folder = shared_folder(t.spark, "model")
    current = results.settings_row(t.spark)
    models.save_model(models.fit_tree_model(rows.filter("split = 'train'")), current, folder)
    return models.batch_score(t.spark, folder, current, rows).withColumn("scored", F.col("prediction") >= 0)


@add("a10_model_gate", "setting n_rows:i", x.OBSERVED,
     "SELECT s AS setting, (SELECT count(*) FROM observed) AS n_rows FROM (SELECT unnest(['blend_select', 'window']) AS s)")
def a10(t):
    """Settings that differ from the stored ones, beside the rows that may not be scored."""
    folder = shared_folder(t.spark, "config")
    results.settings_row(t.spark).coalesce(1).write.json(folder)
    now = results.settings_row(t.spark, select="forward").withColumn("window", F.lit(48).cast("long"))
    n = t.observed.count()
    return results.settings_differences(t.spark.read.json(folder), now).withColumn("n_rows", F.lit(n))


@add("a10_manifest", "fault name n_rows:i", x.OBSERVED,
     "SELECT fault, name, (SELECT count(*) FROM observed) AS n_rows FROM (VALUES ('changed file', 'tree-0/part-00000.txt'), "
     "('missing file', 'tree-1/part-00000.txt'), ('unknown file', 'tree-9/part-00000.txt'), ('no weight', 'blend_weight'), "
     "('not an ensemble', 'ensemble')) v(fault, name)")
def a10_manifest(t):
    """Files changed, lost or added since the manifest was written, and what a blended forecast would lack."""
    first, later = shared_folder(t.spark, "artefacts"), shared_folder(t.spark, "artefacts")

    def model(folder: str, **trees: str) -> None:
        for name, text in trees.items():
            t.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/model/{name.replace('_', '-')}")
    model(first, tree_0="a", tree_1="b", tree_2="c")
    results.write_manifest(t.spark, first, test_rows=t.forecast)
    model(later, tree_0="x", tree_2="c", tree_9="d")
    t.spark.read.schema(results.MANIFEST).json(f"{first}/manifest").coalesce(1).write.json(f"{later}/manifest")
    return results.manifest_faults(t.spark, later, blended=True).withColumn("n_rows", F.lit(t.observed.count()))
