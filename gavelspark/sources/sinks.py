"""Sinks. None of them takes a column that holds source text unless asked to."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelspark.sources.storage import stage

#: String columns that hold names and codes, never source text. A column of any other name
#: counts as text if it is a string or could hold one inside.
REPORT_STRINGS = frozenset(
    (
        "accepted", "case_id", "category", "content_reference", "decision", "event_id", "language", "metric",
        "model_id", "policy_version", "proposed_decision", "reviewer_decision", "reviewer_id", "slice",
        "slice_name", "source", "split", "status", "transition",
    )
)


def text_columns(frame: DataFrame, allowed: Collection[str] = REPORT_STRINGS) -> list[str]:
    """Columns that may hold source text: strings, binaries and nested values not allowed by
    name."""
    plain = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return [
        field.name
        for field in frame.schema.fields
        if not isinstance(field.dataType, plain)
        and not (field.name in allowed and isinstance(field.dataType, T.StringType))
    ]


def text_free(frame: DataFrame, allowed: Collection[str] = REPORT_STRINGS) -> DataFrame:
    """Drop every column that may hold source text."""
    return frame.drop(*text_columns(frame, allowed))


def require_text_free(frame: DataFrame, allowed: Collection[str] = REPORT_STRINGS) -> DataFrame:
    held = text_columns(frame, allowed)
    if held:
        raise ValueError("report could contain source text: " + ", ".join(held))
    return frame


def write_jsonl(frame: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """JSON lines in UTF-8 with nulls kept."""
    frame.write.mode(mode).option("ignoreNullFields", "false").json(path)


def nested_receipt(metrics: DataFrame) -> DataFrame:
    """Long metrics (model_id, split, slice, metric, value) as one nested row per model:
    split -> slice -> metric -> value. Metrics without a value are kept as null."""
    by_slice = metrics.groupBy("model_id", "split", "slice").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("metrics")
    )
    by_split = by_slice.groupBy("model_id", "split").agg(
        F.map_from_entries(F.collect_list(F.struct("slice", "metrics"))).alias("slices")
    )
    return by_split.groupBy("model_id").agg(
        F.map_from_entries(F.collect_list(F.struct("split", "slices"))).alias("evaluations")
    ).withColumn("contains_source_text", F.lit(False))


def write_receipt(metrics: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    write_jsonl(nested_receipt(require_text_free(metrics)), path, mode=mode)


def write_reviewer_copies(
    selected: DataFrame, folder: str, reviewers: tuple[str, ...] = ("reviewer_a", "reviewer_b")
) -> None:
    """The same sample once per reviewer, in id order over its files. The sample is chosen
    once, so that the copies are equal whatever happens between the writes."""
    chosen = stage(selected)
    for reviewer in reviewers:
        write_jsonl(chosen.orderBy("case_id"), f"{folder.rstrip('/')}/{reviewer}")
