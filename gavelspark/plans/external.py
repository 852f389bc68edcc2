"""External labelled sets: votes or reviewed prompts -> decisions -> evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelspark.functions.decisions import Thresholds, label_decision
from gavelspark.operators import metrics as mt
from gavelspark.operators.model import TextModel, score, with_decision


def decide_examples(
    examples: DataFrame, model: TextModel, thresholds: Thresholds | dict | None = None, *, keep: tuple[str, ...]
) -> DataFrame:
    """Expected and predicted decision of labelled examples, without their text."""
    scored = score(examples, model, key="example_id", keep=keep)
    return with_decision(scored, thresholds)


def external_evidence(decided: DataFrame, *, unsafe: str, model_id: str) -> DataFrame:
    """One evidence row per model for the release gates."""
    labelled = decided.withColumn("expected_decision", label_decision(F.col(unsafe)))
    cube = mt.decision_cube(labelled, confidence="confidence")
    return mt.metric_row(cube).select(
        F.lit(model_id).alias("model_id"),
        "rows",
        "macro_f1",
        "false_acceptance_rate",
        "false_rejection_rate",
        "escalation_rate",
    )
