"""The replay run: stored models to a blended forecast, thresholds, alerts and briefings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.config import DEFAULT, Settings
from wattloom.functions.columns import plus_minutes
from wattloom.operators import asof, evaluate, models
from wattloom.operators.extra_trees import Forest
from wattloom.operators.validate import RuleViolation
from wattloom.session import stage
from wattloom.sources import results


@dataclass
class Replay:
    """``frame``: forecast rows with threshold and context; ``alerts`` and ``briefings`` of the times asked for."""
    frame: DataFrame
    alerts: DataFrame
    briefings: DataFrame
    weight: float


def forecast(spark, folder: str, usable: DataFrame, settings: DataFrame, weight: float | None = None) -> tuple[DataFrame, float]:
    """Blended predictions of the test rows by the stored models of a training run, and the weight of the tree.

    Both model folders must hold what was evaluated, under the present settings. The weight is the stored one unless given.
    """
    for part in ("tree", "sequence"):
        results.model_gate(spark.read.json(f"{folder}/{part}/config"), settings)
        results.artefact_gate(spark, f"{folder}/{part}", blended=True)
    if weight is None:
        weight = spark.read.schema(results.MANIFEST).json(f"{folder}/tree/manifest").first()["blend_weight"]
    test = usable.filter(F.col("split") == "test")
    if test.isEmpty():
        raise RuleViolation("there are no test rows to replay")
    scored = models.score_tree_model(Forest.load(spark, f"{folder}/tree/model"), test).withColumnRenamed("prediction", "a")
    scored = models.score_sequence_model(*models.load_sequence_model(spark, f"{folder}/sequence"), scored).withColumnRenamed("prediction", "b")
    return models.finite_only(evaluate.blend(scored, weight)), weight


def run(spark, folder: str, table: DataFrame, usable: DataFrame, settings: DataFrame, weight: float | None = None,
        manual: float | None = None, cursors: DataFrame | None = None, cfg: Settings = DEFAULT) -> Replay:
    """``table``: all labelled rows (the year's peak needs those outside the test part, too); ``usable``: the rows for the models."""
    made, weight = forecast(spark, folder, usable, settings, weight)
    made = made.select(cfg.series, cfg.ts, "prediction", F.col("a").alias("tree_prediction"), F.col("b").alias("sequence_prediction"))
    observed = table.join(made, [cfg.series, cfg.ts], "left").withColumns({
        "target_time": plus_minutes(cfg.ts, cfg.step_min), "day_key": F.date_format(cfg.ts, "yyyy-MM-dd")})
    frame = stage(asof.peak_recommendation(observed, manual, cfg), "replay-frame")
    facts = asof.briefing_facts(frame, cfg)
    return Replay(frame, asof.alerts(frame, cursors, cfg), asof.briefing_text(asof.at_cursors(facts, cursors, cfg)), weight)
