"""The model queries: which jobs they run and with which settings."""

from inspect import signature

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.config import DEFAULT
from wattloom.functions import fixed_values as fv
from wattloom.operators import extra_trees, models, split
from wattloom.plans import load_all
from wattloom.session import shared_folder

MONTHS_DIR = "/root/testdata/sf0.01"        # the smallest tables with a meter of several months


@pytest.fixture
def quick_trees(monkeypatch):
    """The jobs are looked at here, not the size of the models."""
    full = models.fit_tree_model
    monkeypatch.setattr(models, "fit_tree_model", lambda train, **_: full(train, trees=2, depth=3))


def test_tree_query_scores_forward_folds(spark, quick_trees):
    got = {(r.series_id, r.fold): r.rows for r in load_all().queries["g21_fit_tree_model"](spark, MONTHS_DIR).collect()}
    folds = {fold for _, fold in got}
    assert "test" in folds and len(folds) > 1
    assert all(fold == "test" or fold.endswith("01") for fold in folds) and min(got.values()) > 0


@pytest.fixture
def settings(monkeypatch):
    """Settings that each fit is called with; the models themselves are small."""
    seen = []

    def record(name, quick):
        full = getattr(models, name)
        bind = signature(full).bind

        def fit(*args, **kw):
            call = bind(*args, **kw)
            call.apply_defaults()
            seen.append({k: v for k, v in call.arguments.items() if k in ("trees", "depth", "rounds", "seeds")})
            return full(*args, **kw | quick)
        monkeypatch.setattr(models, name, fit)
    record("fit_tree_model", {"trees": 2, "depth": 3})
    record("fit_sequence_model", {"rounds": 2, "depth": 2, "seeds": (42,)})
    return seen


@pytest.mark.parametrize("name", ["g21_fit_tree_model", "g23_batch_score", "j10_stream_scoring"])
def test_tree_queries_fit_the_default_model(spark, settings, name):
    assert load_all().queries[name](spark, MONTHS_DIR).count() > 0
    assert settings and all(s == {"trees": 300, "depth": 32} for s in settings)


def test_sequence_query_runs_its_jobs_with_lookback(spark, settings, monkeypatch):
    parts = []
    full = split.job_rows

    def job_rows(df, jobs, cfg=DEFAULT, part="eval"):
        out = full(df, jobs, cfg, part)
        if part == "train":
            parts.append(out.filter((F.col("date_key") < F.col("start")) | (F.col("date_key") >= F.col("lo"))).count())
        return out
    monkeypatch.setattr(split, "job_rows", job_rows)
    folds = {r.fold for r in load_all().queries["g22_fit_sequence_model"](spark, MONTHS_DIR).collect()}
    assert "test" in folds and len(folds) > 1
    assert settings and all(s == {"rounds": 100, "depth": 5, "seeds": (42, 2024, 7)} for s in settings)
    assert parts and not any(parts)


def test_default_forest_beats_persistence_and_is_the_same_again(spark):
    """The default size, on rows whose next value follows from the inputs."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 25))
    y = x[:, 0] * 3 + np.sin(3 * x[:, 1]) * 2
    names = list(fv.TREE_FEATURES)
    rows = spark.createDataFrame([(float(b), *map(float, a)) for a, b in zip(x, y)], "y double, " + ", ".join(f"{c} double" for c in names))
    train, test = rows.limit(2500), rows.subtract(rows.limit(2500))
    model = models.fit_tree_model(train)
    assert model.trees.count() == 300
    got = {r.y: r.prediction for r in models.score_tree_model(model, test).collect()}
    assert np.mean([(a - b) ** 2 for a, b in got.items()]) < 0.2 * y.var()
    folder = shared_folder(spark, "forest")
    model.save(folder)
    again = models.score_tree_model(models.Forest.load(spark, folder), test).collect()
    assert {r.y: r.prediction for r in again} == got
    other = models.fit_tree_model(train.repartition(7))
    assert {r.y: r.prediction for r in models.score_tree_model(other, test).collect()} == got


def test_trees_keep_their_rules():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, (500, 3)).astype(np.float32)
    y = x[:, 0] + rng.normal(size=500)
    feature, threshold, child, value = extra_trees.grow(x, y, 6, 5, 0.7, np.random.default_rng(0))
    node, depth = np.zeros(500, int), np.zeros(len(feature), int)
    for i in np.flatnonzero(feature >= 0):
        depth[child[i]] = depth[child[i] + 1] = depth[i] + 1
    for _ in range(7):
        inner = feature[node] >= 0
        node = np.where(inner, child[node] + (x[np.arange(500), np.maximum(feature[node], 0)] >= threshold[node]), node)
    size = np.bincount(node, minlength=len(feature))
    assert depth.max() <= 6 and size[feature < 0].min() >= 5
    assert value[feature < 0] == pytest.approx(np.bincount(node, y, len(feature))[feature < 0] / size[feature < 0], abs=1e-5)
    assert len(extra_trees.grow(np.ones((50, 2), np.float32), np.arange(50.0), 6, 3, 0.7, np.random.default_rng(0))[0]) == 1


def test_missing_inputs_take_the_median(spark):
    rows = spark.createDataFrame([(float(i % 5), float(i % 5), None if i % 3 else 1.0) for i in range(200)], "y double, a double, b double")
    model = extra_trees.fit(rows, ["a", "b"], trees=5)
    assert model.medians == [2.0, 1.0]
    out = model.predict(spark.createDataFrame([(None, float("nan")), (2.0, 1.0)], "a double, b double")).collect()
    assert out[0].prediction == out[1].prediction


def test_samples_are_bounded(spark):
    rows = spark.range(5000).select((F.col("id") % 7).cast("double").alias("y"), F.col("id").cast("double").alias("a"))
    model = extra_trees.fit(rows, ["a"], trees=20, sample_rows=500)
    nodes = [len(r.feature) // 4 for r in model.trees.collect()]
    assert len(nodes) == 20 and max(nodes) < 2 * 600 / 3


def test_leaf_means_follow_every_tree():
    """Row by row down each tree, also for infinite inputs and a tree that is one leaf."""
    rng = np.random.default_rng(2)
    x = rng.random((400, 5)).astype(np.float32)
    trees = [extra_trees.grow(x, x[:, 0] + rng.random(400), 12, 2, 0.7, np.random.default_rng(k)) for k in range(3)]
    trees.append(extra_trees.grow(np.ones((9, 5), np.float32), np.arange(9.0), 4, 2, 0.7, rng))
    asked = np.concatenate((rng.random((60, 5)).astype(np.float32), [[np.inf] * 5, [-np.inf] * 5])).astype(np.float32)
    wanted = []
    for row in asked:
        total = 0.0
        for feature, threshold, child, value in trees:
            node = 0
            while feature[node] >= 0:
                node = child[node] + int(row[feature[node]] >= threshold[node])
            total += float(value[node])
        wanted.append(total / len(trees))
    assert extra_trees.leaf_means(asked, [extra_trees.walk(t) for t in trees]).tolist() == wanted


def test_rows_of_a_job_are_never_broadcast(spark, tmp_path):
    """A stored table of rows looks small to Spark; the days of the jobs meet it in the tasks, not the rows in the driver."""
    days = 40
    rows = spark.range(days * 96).select(
        F.lit("A").alias("series_id"), F.timestamp_seconds(F.lit(1_614_556_800) + F.col("id") * 900).alias("ts"), F.col("id").cast("double").alias("y"),
        F.array_repeat(F.col("id").cast("double"), 96).alias("window")).withColumn("date_key", F.date_format("ts", "yyyyMMdd").cast("int")) \
        .withColumn("split", F.when(F.col("date_key") < 20210401, "train").otherwise("test"))
    rows.write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    jobs = split.eval_jobs(stored, split.forward_folds(stored)).filter("fold_no = 0")
    for part, n in (("train", 31 * 96), ("eval", 9 * 96)):
        got = split.job_rows(stored, jobs, part=part)
        assert got.count() == n
        plan = got.select("ts", "y", "date_key")._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join [series_id" in line and "date_key" in line.split("Join")[1].split("]")[0]]
        assert joins and all("ShuffledHashJoin" in line and "BuildRight" in line for line in joins), plan


def leaf_rows(spark, n):
    """Rows of which every one can have a leaf of its own."""
    return spark.range(n).select((F.col("id") * 7 % 1000).cast("double").alias("y"), F.col("id").cast("double").alias("a"))


def leaf_count(model):
    """Leaves of every tree; those of a top below which a piece hangs are no leaves."""
    out = {}
    for r in model.trees.collect():
        out[r.tree] = out.get(r.tree, 0) + int((np.frombuffer(r.feature, "<i4") < 0).sum()) - (r.piece != extra_trees.WHOLE)
    return out


def test_every_tree_learns_from_every_row(spark):
    """More rows than the samples the trees were once grown on."""
    n = 30_000
    model = extra_trees.fit(leaf_rows(spark, n).repartition(3), ["a"], trees=12, depth=300, min_leaf=1)
    assert leaf_count(model) == {t: n for t in range(12)}


def test_trees_in_pieces_learn_from_every_row(spark, monkeypatch):
    """Tables and forests too large for a task: tops from the blocks' reports, pieces below them, rows sent to the trees."""
    n = 6000
    monkeypatch.setattr(extra_trees, "BATCH_ROWS", 2 * n)
    rows = leaf_rows(spark, n).repartition(3)
    model = extra_trees.fit(rows, ["a"], trees=3, depth=300, min_leaf=1, task_rows=1500)
    assert model.trees.filter(F.col("piece") != extra_trees.WHOLE).count() > 3 * n / 1500
    assert leaf_count(model) == {t: n for t in range(3)}
    asked = rows.unionByName(spark.createDataFrame([(21.0, 3.0), (None, None)], "y double, a double"))
    out = model.predict(asked.withColumn("kept", F.col("y") + 1)).collect()
    assert len(out) == n + 2 and all(r.prediction == r.y for r in out if r.a is not None)
    assert [r.kept for r in out if r.a is not None] == [r.y + 1 for r in out if r.a is not None]
    assert [abs(r.prediction - (model.medians[0] * 7 % 1000)) < 1e-6 for r in out if r.a is None] == [True]
    folder = shared_folder(spark, "pieces")
    model.save(folder)
    again = extra_trees.Forest.load(spark, folder).predict(rows)
    assert again.filter("prediction = y").count() == n
    other = extra_trees.fit(rows.repartition(7), ["a"], trees=3, depth=300, min_leaf=1, task_rows=1500)
    key = lambda m: sorted((r.tree, r.piece, bytes(r.feature), bytes(r.threshold), bytes(r.value)) for r in m.trees.collect())
    assert key(other) == key(model)


def test_rows_are_sent_to_a_forest_too_large_to_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(float(a + b), float(a), float(b), None if i % 9 else 1.0) for i, (a, b) in enumerate(rng.normal(size=(800, 2)))],
                                 "y double, a double, b double, c double")
    model = extra_trees.fit(rows, ["a", "b", "c"], trees=25)
    near = {(r.a, r.b): r.prediction for r in model.predict(rows).collect()}
    monkeypatch.setattr(extra_trees, "BROADCAST_NODES", 3000)
    monkeypatch.setattr(extra_trees, "BATCH_ROWS", 2000)
    sent = model.predict(rows)
    assert sent.columns == [*rows.columns, "prediction"]
    assert {(r.a, r.b): pytest.approx(r.prediction, abs=1e-12) for r in sent.collect()} == near


def test_large_nodes_are_counted_in_stretches():
    """Nodes of all sizes, also beyond the rows looked at together, against plain counting."""
    rng = np.random.default_rng(5)
    sizes = np.array([40_000, 2, 64, 65, 17_000, 7, 16_384, 300])
    n = sizes.sum()
    x, y, rows = rng.normal(size=(n, 3)).astype(np.float32), rng.random(n), rng.permutation(n)
    starts, at = np.cumsum(sizes) - sizes, rng.random((len(sizes), 3))
    lo, hi, cut, count, total = extra_trees.node_stats(x, y, rows, starts, sizes, at)
    for k, (a, z) in enumerate(zip(starts, sizes)):
        mine = rows[a:a + z]
        assert (lo[k] == x[mine].min(axis=0)).all() and (hi[k] == x[mine].max(axis=0)).all()
        left = x[mine] < cut[k]
        assert (count[k] == left.sum(axis=0)).all() and total[k] == pytest.approx((left * y[mine][:, None]).sum(axis=0))


def test_rows_of_a_sequence_fit_are_split_once(spark, monkeypatch):
    """Checks, scaling and inputs read stored rows: the join and the ranking behind them run once."""
    from pyspark.sql.types import DoubleType
    seen = spark.sparkContext.accumulator(0)

    @F.udf(DoubleType())
    def read(v):
        seen.add(1)
        return v
    n = 2000
    rows = spark.range(n).select(
        F.lit("A").alias("series_id"), F.timestamp_seconds(F.lit(1_614_556_800) + F.col("id") * 900).alias("ts"), (F.col("id") % 96).cast("double").alias("y"),
        F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.array_repeat(((F.col("id") + i) % 96).cast("double"), 4)).alias("window"),
        *[(F.col("id") % 7).cast("double").alias(c) for c in fv.SEQUENCE_CALENDAR])
    full = split.tail_validation
    monkeypatch.setattr(split, "tail_validation", lambda df, **kw: (lambda out: out.withColumn("y", read(F.col("y"))))(full(df, **kw)))
    fitted, stats = models.fit_sequence_model(rows, rounds=2, depth=2, seeds=(42,))
    assert len(fitted) == 1 and stats["y_std"] > 0
    assert seen.value == n


def test_jobs_are_counted_together(spark, monkeypatch):
    """One pass over the rows to be scored and one over those learnt from say which jobs there are, not two for each job."""
    rows = spark.range(180 * 96).select(F.lit("A").alias("series_id"), F.timestamp_seconds(F.lit(1_614_556_800) + F.col("id") * 900).alias("ts"),
                                        F.col("id").cast("double").alias("y")) \
        .withColumn("date_key", F.date_format("ts", "yyyyMMdd").cast("int")).withColumn("split", F.when(F.col("date_key") < 20210705, "train").otherwise("test"))
    jobs, asked, full = split.eval_jobs(rows, split.forward_folds(rows)).cache(), [], split.job_rows

    def job_rows(df, these, cfg=DEFAULT, part="eval"):
        asked.append((part, these.select("fold_no").distinct().count()))
        return full(df, these, cfg, part)
    monkeypatch.setattr(split, "job_rows", job_rows)
    learnt = []
    out = models.evaluate_jobs(rows, jobs, lambda train: learnt.append(train.count()), lambda _, test: test.withColumn("prediction", F.lit(0.0)), least=40 * 96)
    assert sorted(asked[:2]) == [("eval", 5), ("train", 5)] and len(asked) == 2 + 2 * len(learnt)
    assert sorted(learnt) == [61 * 96, 92 * 96, 126 * 96] and {r.fold for r in out.select("fold").distinct().collect()} == {"test", "20210501", "20210601"}
