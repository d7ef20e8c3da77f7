"""The training run: both models over the same jobs, their blend, ranking, stored results and stored models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.config import DEFAULT, Settings
from wattloom.functions import fixed_values as fv
from wattloom.operators import evaluate, models, split
from wattloom.operators.validate import require_ok
from wattloom.session import stage
from wattloom.sources import results


@dataclass
class Trained:
    """Tables of a run: predictions (series, ts, fold, y, a, b, prediction), scores per model and fold, the summary by rank,
    the table of blend weights and the choice among them."""
    predictions: DataFrame
    scores: DataFrame
    summary: DataFrame
    weights: DataFrame
    choice: DataFrame
    weight: float


def run(rows: DataFrame, folder: str, settings: DataFrame, cfg: Settings = DEFAULT, select: str = "test",
        fit_tree=models.fit_tree_model, fit_sequence=models.fit_sequence_model) -> Trained:
    """``rows``: stored usable rows with their ``window``. Every walk-forward fold and the test part is one job of both models.

    The models must have predicted exactly the same rows. The blend weight is chosen over the pooled errors of all series, the models are
    ranked by their mean forward error. The models of the test job are stored with settings and manifest.
    """
    jobs = split.train_lookback(split.eval_jobs(rows, split.forward_folds(rows, cfg=cfg), cfg), cfg=cfg)
    least = max(fv.MIN_TREE_ROWS, fv.MIN_SEQUENCE_ROWS)
    kept: dict[str, object] = {}

    def keep(name: str):
        def on(number: int, model) -> None:
            if number == 0:
                kept[name] = model
        return on
    keys = [cfg.series, cfg.ts, "fold"]
    plain = jobs.drop("start")                             # the tree learns from everything before a fold
    a = models.evaluate_jobs(rows, plain, fit_tree, models.score_tree_model, cfg, least, keep("tree"))
    b = models.evaluate_jobs(rows, jobs, fit_sequence, lambda m, test: models.score_sequence_model(*m, test), cfg, least, keep("sequence"))
    a = stage(a.select(*keys, "y", F.col("prediction").alias("a")), "tree-predictions")
    b = stage(b.select(*keys, F.col("prediction").alias("b")), "sequence-predictions")
    require_ok(evaluate.align_check(a, b, keys), "the models predicted different rows")
    pairs = a.join(b, keys)

    weights = stage(evaluate.blend_search(pairs, []), "blend-weights")
    choice = evaluate.blend_pick(weights, [], select, cfg)
    weight = float(choice.first()["weight"])
    predictions = stage(evaluate.blend(pairs, weight), "predictions")
    long = predictions.select("fold", "y", F.inline(F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(c).alias("p")) for name, c in (("tree", "a"), ("sequence", "b"), ("ensemble", "prediction"))])))
    scores = stage(evaluate.score(long, ["model", "fold"], p="p"), "scores")
    summary = evaluate.rank_models(evaluate.fold_summary(scores, ["model"]))

    results.write_results(scores, weights, choice, f"{folder}/results", select)
    test = predictions.filter("fold = 'test'").select(cfg.series, cfg.ts)
    models.save_model(kept["tree"], settings, f"{folder}/tree", ensemble=True, blend_weight=weight, test_rows=test)
    models.save_sequence_model(*kept["sequence"], settings, f"{folder}/sequence", ensemble=True, blend_weight=weight, test_rows=test)
    return Trained(predictions, scores, summary, weights, choice, weight)
