"""Pairing of two tables on the case id, and annotator agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavelspark.operators.metrics import rate
from gavelspark.operators.quality import guarded

# What a finished annotation must fill in.
REQUIRED_FIELDS = (
    "annotated_decision",
    "annotated_rule_id",
    "supporting_passage",
    "reason",
    "review_required",
    "annotation_confidence",
)


def missing_fields(rows: DataFrame, fields: tuple[str, ...] = REQUIRED_FIELDS) -> DataFrame:
    """Rows with unfilled required fields; ``missing`` names them, sorted."""
    gaps = F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in sorted(fields))))
    return rows.withColumn("missing", gaps).filter(F.size("missing") > 0)


def require_complete(rows: DataFrame, fields: tuple[str, ...] = REQUIRED_FIELDS, key: str = "case_id") -> DataFrame:
    """The rows themselves; an incomplete one fails the query and is named."""
    gaps = F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in sorted(fields))))
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    return guarded(rows, F.size(gaps) == 0, F.concat(name, F.lit(" is missing: "), F.array_join(gaps, ", ")))


def pair_results(cases: DataFrame, results: DataFrame, *, key: str = "case_id") -> DataFrame:
    """Each case with its result; a case or a result without partner, or an id that is null or
    repeated on one side, fails the query, whatever is read of it."""
    by_key = Window.partitionBy(key)
    left = cases.withColumn("_cases", F.count(F.lit(1)).over(by_key))
    right = results.withColumn("_results", F.count(F.lit(1)).over(by_key))
    joined = left.join(right, key, "full_outer")
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    checked = guarded(
        joined,
        (F.col("_cases") == 1) & (F.col("_results") == 1),
        F.concat(F.lit("case and result do not pair up: "), name),
    )
    return checked.drop("_cases", "_results")


def unpaired_ids(left: DataFrame, right: DataFrame, *, key: str = "case_id") -> DataFrame:
    """Ids found on one side only, with the side; empty when the id sets are equal.

    Distinct ids are counted per side in one aggregation, which an id repeated many
    times does not slow down the way a join would.
    """
    tagged = left.select(F.col(key).alias(key), F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(F.col(key).alias(key), F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    sides = tagged.groupBy(key).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return sides.filter(F.col("_l") != F.col("_r")).select(
        key, F.when(F.col("_l") == 1, F.lit("left")).otherwise(F.lit("right")).alias("only_in")
    )


def compare_annotations(
    first: DataFrame,
    second: DataFrame,
    *,
    key: str = "case_id",
    decision: str = "annotated_decision",
    rule: str = "annotated_rule_id",
) -> DataFrame:
    """One row per case: how many rows each annotator has, and whether they agree on the
    decision and the rule.

    A case agrees when each annotator has one row and there is a single (decision, rule)
    answer, so two aggregations over the union replace a join.
    """

    def side(frame: DataFrame, a: int) -> DataFrame:
        return frame.select(
            F.col(key).alias(key),
            F.col(decision).alias("_decision"),
            F.col(rule).alias("_rule"),
            F.lit(a).alias("_a"),
            F.lit(1 - a).alias("_b"),
        )

    answers = (
        side(first, 1).unionByName(side(second, 0))
        .groupBy(key, "_decision", "_rule")
        .agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    )
    return answers.groupBy(key).agg(
        F.sum("_a").alias("rows_a"), F.sum("_b").alias("rows_b"), F.count(F.lit(1)).alias("_answers")
    ).select(
        key,
        "rows_a",
        "rows_b",
        ((F.col("rows_a") == 1) & (F.col("rows_b") == 1) & (F.col("_answers") == 1)).alias("agreed"),
    )


def _labelled_once(compared: DataFrame, key: str) -> DataFrame:
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    return guarded(
        compared,
        (F.col("rows_a") == 1) & (F.col("rows_b") == 1),
        F.concat(F.lit("annotators must label the same case once each: "), name),
    )


def agreement_report(compared: DataFrame, *, key: str = "case_id") -> DataFrame:
    """Agreement over all cases; an id missing from one side or repeated fails."""
    totals = _labelled_once(compared, key).agg(
        F.count(F.lit(1)).alias("case_count"), F.count_if(~F.col("agreed")).alias("disagreement_count")
    )
    return totals.select(
        "case_count",
        rate(F.col("case_count") - F.col("disagreement_count"), F.col("case_count")).alias(
            "decision_and_rule_agreement"
        ),
        "disagreement_count",
        (F.col("disagreement_count") > 0).alias("requires_adjudication"),
    )


def disagreements(compared: DataFrame, *, key: str = "case_id") -> DataFrame:
    """Cases the annotators answer differently; an id missing from one side or repeated fails."""
    return _labelled_once(compared, key).filter(~F.col("agreed")).select(key).orderBy(key)
