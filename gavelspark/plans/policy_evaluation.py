"""Policy cases -> decisions of several systems -> metrics per system and slice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from gavelspark.operators.metrics import decision_cube, metric_row
from gavelspark.operators.policy import System, decide_all, run_systems

EXTRA = ("language", "policy_version", "label_budget")


def evaluate_decisions(decided: DataFrame, *, dimensions: Sequence[str] = ()) -> DataFrame:
    """Metrics per system: overall, by slice, and by each further dimension."""
    by = ["system", "slice_name", *dimensions]
    cube = decision_cube(
        decided,
        by=by,
        confidence="confidence",
        rule=("expected_rule_id", "policy"),
        remediation=("expected_remediation", "remediation"),
        latency="latency_ms" if "latency_ms" in decided.columns else None,
    )
    levels = [["system"], ["system", "slice_name"], *(["system", d] for d in dimensions)]
    return metric_row(cube, by, levels=levels)


def evaluate_policies(
    cases: DataFrame,
    rules: DataFrame,
    *,
    systems: Mapping[str, System] | None = None,
    dimensions: Sequence[str] = (),
) -> DataFrame:
    """The built-in systems in one pass, or any others by name."""
    decided = decide_all(cases, rules) if systems is None else run_systems(cases, rules, systems)
    return evaluate_decisions(decided, dimensions=dimensions)
