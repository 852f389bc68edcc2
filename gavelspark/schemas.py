"""Schemas and fixed values shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

ALLOW, ESCALATE, REJECT = "ALLOW", "ESCALATE", "REJECT"

# Canonical class order (matrices, probability columns, tie breaks).
LABELS = (ALLOW, ESCALATE, REJECT)

# Safety attributes of scored comments, and the slice cut.
SAFETY_ATTRIBUTES = (
    "severe_toxicity",
    "obscene",
    "threat",
    "insult",
    "identity_attack",
    "sexual_explicit",
)
SLICE_CUT = 0.5

PROBABILITY_COLUMNS = ("p_allow", "p_escalate", "p_reject")


_STRING, _DOUBLE, _INT, _BOOLEAN = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()
_STRINGS = T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


RULE_SCHEMA = _struct(
    version=_STRING,
    rule_id=_STRING,
    topic=_STRING,
    action=_STRING,
    terms=_STRINGS,
    text=_STRING,
    remediation=_STRING,
    ordinal=_INT,
)

CASE_SCHEMA = _struct(
    case_id=_STRING,
    policy_version=_STRING,
    slice_name=_STRING,
    language=_STRING,
    content=_STRING,
    expected_decision=_STRING,
    expected_rule_id=_STRING,
    expected_remediation=_STRING,
    label_budget=_INT,
)

RESULT_SCHEMA = _struct(
    decision=_STRING,
    policy=_STRING,
    reason=_STRING,
    evidence=_STRINGS,
    confidence=_DOUBLE,
    remediation=_STRING,
    review_required=_BOOLEAN,
    latency_ms=_DOUBLE,
)

COMMENT_SCHEMA = _struct(
    text=_STRING, toxicity=_DOUBLE, **{name: _DOUBLE for name in SAFETY_ATTRIBUTES}
)

VOTE_SCHEMA = _struct(
    prompt=_STRING,
    response=_STRING,
    is_safe=_BOOLEAN,
    category=T.MapType(T.StringType(), T.BooleanType()),
)

PROMPT_SCHEMA = _struct(
    user_input=_STRING, human_annotation=_STRING, toxicity=_STRING, jailbreaking=_STRING
)

ANNOTATION_SCHEMA = _struct(
    case_id=_STRING,
    policy_version=_STRING,
    slice_name=_STRING,
    language=_STRING,
    content=_STRING,
    annotated_decision=_STRING,
    annotated_rule_id=_STRING,
    supporting_passage=_STRING,
    reason=_STRING,
    remediation=_STRING,
    review_required=_BOOLEAN,
    annotation_confidence=_DOUBLE,
    ambiguity_note=_STRING,
)

ERROR_RECORD_SCHEMA = _struct(
    expected_decision=_STRING, predicted_decision=_STRING, categories=_STRINGS
)

METRIC_SCHEMA = _struct(
    model_id=_STRING, split=_STRING, slice=_STRING, metric=_STRING, value=_DOUBLE
)
