"""Decision expressions: scores, thresholds, class probabilities and contracts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavelspark.schemas import ALLOW, ESCALATE, LABELS, REJECT


@dataclass(frozen=True)
class ScoreCuts:
    """Cuts of a [0, 1] score; both ends are inclusive."""

    allow_max: float = 0.10
    reject_min: float = 0.50

    def __post_init__(self) -> None:
        if not 0 <= self.allow_max < self.reject_min <= 1:
            raise ValueError("need 0 <= allow_max < reject_min <= 1")


@dataclass(frozen=True)
class Thresholds:
    allow_minimum: float
    reject_minimum: float
    reject_cap: float


def score_in_range(score: Column) -> Column:
    # Spark orders NaN above every number, so the upper bound also refuses it.
    return F.coalesce((score >= 0) & (score <= 1), F.lit(False))


def score_decision(score: Column, cuts: ScoreCuts = ScoreCuts()) -> Column:
    """Decision of a score; a score outside [0, 1] fails the query."""
    return (
        F.when(
            ~score_in_range(score),
            F.raise_error(F.lit("score must be between zero and one")),
        )
        .when(score <= cuts.allow_max, F.lit(ALLOW))
        .when(score >= cuts.reject_min, F.lit(REJECT))
        .otherwise(F.lit(ESCALATE))
    )


def label_decision(unsafe: Column) -> Column:
    """Expected decision of a two-way label."""
    return F.when(unsafe, F.lit(REJECT)).otherwise(F.lit(ALLOW))


def threshold_decision(
    p_allow: Column,
    p_reject: Column,
    thresholds: Thresholds | tuple[Column, Column, Column],
) -> Column:
    """Reject first, then a capped allow, else escalate. A probability that is no number
    reaches no threshold, so it escalates.

    ``thresholds`` is a value object or three columns, so one plan serves a fixed
    choice as well as a table of choices.
    """
    if isinstance(thresholds, Thresholds):
        allow_minimum, reject_minimum, cap = (
            F.lit(thresholds.allow_minimum),
            F.lit(thresholds.reject_minimum),
            F.lit(thresholds.reject_cap),
        )
    else:
        allow_minimum, reject_minimum, cap = thresholds
    return (
        F.when((p_reject >= reject_minimum) & ~F.isnan(p_reject), F.lit(REJECT))
        .when((p_allow >= allow_minimum) & (p_reject <= cap) & ~F.isnan(p_allow), F.lit(ALLOW))
        .otherwise(F.lit(ESCALATE))
    )


def argmax_decision(p_allow: Column, p_escalate: Column, p_reject: Column) -> Column:
    """Most probable class; the first in label order wins a tie."""
    return (
        F.when(p_allow >= F.greatest(p_escalate, p_reject), F.lit(ALLOW))
        .when(p_escalate >= p_reject, F.lit(ESCALATE))
        .otherwise(F.lit(REJECT))
    )


def decide(
    p_allow: Column,
    p_escalate: Column,
    p_reject: Column,
    thresholds: Thresholds | dict[str, float] | None = None,
) -> Column:
    """Thresholds when the model has them (object or mapping), else the argmax."""
    if thresholds is None:
        return argmax_decision(p_allow, p_escalate, p_reject)
    if isinstance(thresholds, dict):
        thresholds = Thresholds(
            thresholds["allow_minimum"],
            thresholds["reject_minimum"],
            thresholds.get("reject_cap", thresholds.get("reject_probability_cap_for_allow")),
        )
    return threshold_decision(p_allow, p_reject, thresholds)


def top_probability(p_allow: Column, p_escalate: Column, p_reject: Column) -> Column:
    return F.greatest(p_allow, p_escalate, p_reject)


def chosen_probability(
    decision: Column, p_allow: Column, p_escalate: Column, p_reject: Column
) -> Column:
    return (
        F.when(decision == ALLOW, p_allow)
        .when(decision == ESCALATE, p_escalate)
        .otherwise(p_reject)
    )


def reorder_probabilities(classes: Column, values: Column) -> list[Column]:
    """Three probability columns in label order from parallel name and value arrays.

    The names must be exactly the three labels, in any order.
    """
    expected = F.array(*(F.lit(label) for label in sorted(LABELS)))
    usable = (F.sort_array(classes) == expected) & (F.size(values) == len(LABELS))
    lookup = F.when(usable, F.map_from_arrays(classes, values)).otherwise(
        F.raise_error(F.lit("classes must be exactly ALLOW, ESCALATE and REJECT"))
    )
    return [
        F.element_at(lookup, F.lit(label)).alias(f"p_{label.lower()}") for label in LABELS
    ]


def outcome_class(expected: Column, predicted: Column) -> Column:
    """Error class. An escalation is ``escalated`` even where it was expected."""
    return (
        F.when((expected == REJECT) & (predicted == ALLOW), F.lit("false_accept"))
        .when((expected == ALLOW) & (predicted == REJECT), F.lit("false_reject"))
        .when(predicted == ESCALATE, F.lit("escalated"))
        .when(expected == predicted, F.lit("correct"))
        .otherwise(F.lit("other_error"))
    )


def result_contract(decision: Column, confidence: Column, review_required: Column) -> Column:
    """True where a result row is valid; null fields make it invalid."""
    return F.coalesce(
        decision.isin(*LABELS)
        & (confidence >= 0)
        & (confidence <= 1)
        & ((decision != ESCALATE) | review_required),
        F.lit(False),
    )


def request_contract(text: Column, reference: Column) -> Column:
    """Bounds of a moderation request, in characters."""
    return F.coalesce(
        F.length(text).between(1, 20_000) & F.length(reference).between(1, 500), F.lit(False)
    )


def resolution_contract(decision: Column, reviewer_id: Column) -> Column:
    return F.coalesce(
        decision.isin(*LABELS) & F.length(reviewer_id).between(1, 100), F.lit(False)
    )
