"""Decision metrics.

Rows are reduced once to a cube of additive measures: one cell per combination of the
grouping columns, slice flags, expected and predicted class and confidence bin. Every
report is a roll-up of that cube, so overlapping slices and several grouping levels cost
one pass over the rows and no row is multiplied.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.functions.decisions import outcome_class
from gavelspark.operators.quality import guarded
from gavelspark.schemas import ALLOW, ESCALATE, LABELS, REJECT, SLICE_CUT

# Edges of ten confidence bins, each open below and closed above.
BIN_EDGES = (
    0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5,
    0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0,
)

MEASURES = (
    "n", "correct", "cited", "cited_right", "remedied", "remedied_right",
    "gap_sum", "confidence_sum", "latency_sum",
)


def rate(part: Column, whole: Column) -> Column:
    """part / whole as a double; null when the whole is zero."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def confidence_bin(name: str) -> Column:
    """1..10, or 0 for a confidence that falls in no bin."""
    above = " + ".join(f"int({name} > {edge}D)" for edge in BIN_EDGES[:-1])
    return F.expr(f"if({name} <= {BIN_EDGES[-1]}D, {above}, 0)")


def attribute_slices(attributes: Sequence[str], cut: float = SLICE_CUT) -> dict[str, Column]:
    """Overlapping safety slices: rows whose attribute reaches the cut."""
    return {name: F.coalesce(F.col(name) >= cut, F.lit(False)) for name in attributes}


def decision_cube(
    rows: DataFrame,
    *,
    by: Sequence[str] = (),
    slices: Mapping[str, Column] | None = None,
    expected: str = "expected_decision",
    predicted: str = "decision",
    confidence: str | Column | None = None,
    rule: tuple[str, str] | None = None,
    remediation: tuple[str, str] | None = None,
    latency: str | None = None,
) -> DataFrame:
    """Additive measures per cell. With ``slices``, a ``slice`` column with ``overall``
    first and each slice that has rows; a row counts in every slice it belongs to. A row whose
    expected or predicted decision is missing or unknown fails the query: it would count in
    the rows and in no cell of the confusion matrix."""
    flags = {f"_in_{i}": (name, test) for i, (name, test) in enumerate((slices or {}).items())}
    conf = F.lit(None).cast("double") if confidence is None else (
        F.col(confidence) if isinstance(confidence, str) else confidence
    )
    base = rows.select(
        *by,
        *(test.alias(flag) for flag, (_, test) in flags.items()),
        F.col(expected).alias("expected"),
        F.col(predicted).alias("predicted"),
        conf.alias("_confidence"),
        *([F.col(rule[0]).alias("_rule"), F.col(rule[1]).alias("_got_rule")] if rule else []),
        *([F.col(remediation[0]).alias("_fix"), F.col(remediation[1]).alias("_got_fix")] if remediation else []),
        *([F.col(latency).alias("_latency")] if latency else []),
    )
    known = F.col("expected").isin(*LABELS) & F.col("predicted").isin(*LABELS)
    right = F.col("expected") == F.col("predicted")
    zero = F.lit(0).cast("long")
    aggregates = [
        F.count(F.lit(1)).alias("n"),
        F.count_if(right).alias("correct"),
        (F.count("_rule") if rule else F.max(zero)).alias("cited"),
        (F.count_if(F.col("_rule").isNotNull() & F.col("_rule").eqNullSafe(F.col("_got_rule")))
         if rule else F.max(zero)).alias("cited_right"),
        (F.count("_fix") if remediation else F.max(zero)).alias("remedied"),
        (F.count_if(F.col("_fix").isNotNull() & F.col("_fix").eqNullSafe(F.col("_got_fix")))
         if remediation else F.max(zero)).alias("remedied_right"),
        F.sum(F.abs(F.col("_confidence") - right.cast("double"))).alias("gap_sum"),
        F.sum("_confidence").alias("confidence_sum"),
        (F.sum("_latency") if latency else F.max(F.lit(None).cast("double"))).alias("latency_sum"),
        F.count_if(~F.coalesce(known, F.lit(False))).alias("_unknown"),
    ]
    keys = [*by, *flags, "expected", "predicted", "bin"]
    cells = base.withColumn("bin", confidence_bin("_confidence")).groupBy(*keys).agg(*aggregates)
    # counted first: a test of the rows themselves would be evaluated for each of them
    cells = guarded(cells, F.col("_unknown") == 0, "a decision is missing or unknown").drop("_unknown")
    if slices is None:
        return cells
    names = F.array_compact(
        F.array(F.lit("overall"), *(F.when(F.col(flag), F.lit(name)) for flag, (name, _) in flags.items()))
    )
    return cells.select(
        *by, F.explode(names).alias("slice"), "expected", "predicted", "bin", *MEASURES
    )


def confusion_aggregates() -> list[Column]:
    return [
        F.expr(
            f"coalesce(sum(if(expected = '{e}' and predicted = '{p}', n, 0L)), 0L) as {_n(e, p)}"
        )
        for e in LABELS
        for p in LABELS
    ]


def _n(e: str, p: str) -> str:
    return f"n_{e.lower()}_{p.lower()}"


def _support(label: str) -> str:
    return "(" + " + ".join(_n(label, other) for other in LABELS) + ")"


def _predicted(label: str) -> str:
    return "(" + " + ".join(_n(other, label) for other in LABELS) + ")"


def _rate(part: str, whole: str) -> str:
    return f"double({part}) / nullif(double({whole}), 0D)"


def _ratio(part: str, whole: str) -> str:
    return f"coalesce({_rate(part, whole)}, 0D)"


def _f1(label: str) -> str:
    """2tp / (2tp + fp + fn): one division of integers, 0 for an absent label."""
    return _ratio(f"2 * {_n(label, label)}", f"{_support(label)} + {_predicted(label)}")


# Mean over all three labels, absent ones included.
MACRO_F1 = f"({_f1(ALLOW)} + {_f1(ESCALATE)} + {_f1(REJECT)}) / 3D"
FALSE_ACCEPTANCE = _rate(_n(REJECT, ALLOW), _support(REJECT))
FALSE_REJECTION = _rate(_n(ALLOW, REJECT), _support(ALLOW))
METRICS = {
    "rows": "rows",
    "accuracy": _rate("correct", "rows"),
    "macro_f1": MACRO_F1,
    "false_acceptance_rate": FALSE_ACCEPTANCE,
    "false_rejection_rate": FALSE_REJECTION,
    "escalation_rate": _rate(_predicted(ESCALATE), "rows"),
    "citation_accuracy": _rate("cited_right", "cited"),
    "remediation_accuracy": _rate("remedied_right", "remedied"),
    "mean_absolute_calibration": _rate("gap_sum", "rows"),
    "mean_latency_ms": _rate("latency_sum", "rows"),
}


def metric_row(
    cube: DataFrame,
    by: Sequence[str] = (),
    *,
    levels: Sequence[Sequence[str]] | None = None,
    binned: bool = False,
) -> DataFrame:
    """One metric row per group. ``levels`` are grouping sets over ``by``; the columns a
    level leaves out read ``all``. ``binned`` adds the binned calibration error, from the
    same cube."""
    measures = [m for m in MEASURES if m != "n"]
    sums = [
        *confusion_aggregates(),
        F.expr("sum(n) as rows"),
        *(F.expr(f"sum({m}) as {m}") for m in measures),
    ]
    if levels is not None:
        totals = cube.groupingSets([[F.col(c) for c in level] for level in levels], *by).agg(
            *sums, *(F.grouping(c).alias(f"_grouped_{c}") for c in by)
        )
        keys = [f"if(_grouped_{c} = 1, 'all', string({c})) as {c}" for c in by]
    else:
        totals = cube.groupBy(*by, *(["bin"] if binned else [])).agg(*sums)
        keys = list(by)
    columns = dict(METRICS)
    if binned:
        added = [_n(e, p) for e in LABELS for p in LABELS] + ["rows", *measures]
        totals = totals.groupBy(*by).agg(
            *(F.expr(f"sum({c}) as {c}") for c in added), F.expr(f"sum({BIN_GAP}) as bin_gap")
        )
        columns["expected_calibration_error"] = _rate("bin_gap", "rows")
    return totals.selectExpr(*keys, *(f"{sql} as {name}" for name, sql in columns.items()))


def confusion_matrix(cube: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Dense: nine rows per group, zeros included, in label order."""
    totals = cube.groupBy(*by).agg(*confusion_aggregates())
    entries = ", ".join(
        f"struct('{e}' as expected, '{p}' as predicted, {_n(e, p)} as n)" for e in LABELS for p in LABELS
    )
    return totals.selectExpr(*by, f"inline(array({entries}))")


def classification_report(cube: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and both averages."""
    totals = cube.groupBy(*by).agg(*confusion_aggregates())
    per_class = totals.selectExpr(
        *by,
        " + ".join(_support(label) for label in LABELS) + " as _rows",
        " + ".join(_n(label, label) for label in LABELS) + " as _right",
        *(
            f"""struct('{label}' as label, {_ratio(_n(label, label), _predicted(label))} as precision,
                {_ratio(_n(label, label), _support(label))} as recall,
                {_f1(label)} as f1_score, {_support(label)} as support) as _{label}"""
            for label in LABELS
        ),
    )
    accuracy = _rate("_right", "_rows")

    def macro(field: str) -> str:
        return "(" + " + ".join(f"_{label}.{field}" for label in LABELS) + f") / 3D as {field}"

    def weighted(field: str) -> str:
        parts = " + ".join(f"_{label}.{field} * _{label}.support" for label in LABELS)
        return f"({parts}) / nullif(double(_rows), 0D) as {field}"

    fields = ("precision", "recall", "f1_score")
    entries = [f"_{label}" for label in LABELS]
    entries.append(
        "struct('accuracy' as label, "
        + ", ".join(f"{accuracy} as {field}" for field in fields)
        + ", _rows as support)"
    )
    for name, average in (("macro avg", macro), ("weighted avg", weighted)):
        entries.append(
            f"struct('{name}' as label, " + ", ".join(map(average, fields)) + ", _rows as support)"
        )
    return per_class.selectExpr(*by, f"inline(array({', '.join(entries)}))")


# Distance between accuracy and mean confidence of one bin, times its rows.
BIN_GAP = "if(bin > 0, abs(correct - confidence_sum), 0D)"


def binned_calibration_error(cube: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Calibration error over the confidence bins. Rows in no bin still count in the total."""
    bins = cube.groupBy(*by, "bin").agg(
        *(F.expr(f"sum({c}) as {c}") for c in ("n", "correct", "confidence_sum"))
    )
    return bins.groupBy(*by).agg(
        F.expr("sum(n) as rows"), F.expr(f"sum({BIN_GAP}) / sum(n) as calibration_error")
    )


def metric_long(row: DataFrame, keys: Sequence[str], drop_null: bool = False) -> DataFrame:
    """Metric columns as (keys, metric, value) rows: the form gates and receipts read."""
    names = [c for c in row.columns if c not in keys]
    entries = ", ".join(f"struct('{c}' as metric, double({c}) as value)" for c in names)
    long = row.selectExpr(*keys, f"inline(array({entries}))")
    return long.filter(F.col("value").isNotNull()) if drop_null else long


def report_long(cube: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The classification report and the confusion matrix as (keys, metric, value) rows, named
    ``report.<label>.<measure>`` and ``confusion.<expected>.<predicted>``."""
    fields = ("precision", "recall", "f1_score", "support")
    entries = ", ".join(
        f"struct(concat('report.', label, '.{f}') as metric, double({f}) as value)" for f in fields
    )
    report = classification_report(cube, keys).selectExpr(*keys, f"inline(array({entries}))")
    matrix = confusion_matrix(cube, keys).selectExpr(
        *keys, "concat('confusion.', expected, '.', predicted) as metric", "double(n) as value"
    )
    return report.unionByName(matrix)


ALL_RECORDS = "all records"


def category_outcomes(records: DataFrame, *, total: bool = False) -> DataFrame:
    """Outcome counts per category; a row counts once per category it lists and an empty
    or missing list counts as ``uncategorized``. Absent outcomes have no row.

    ``total`` adds the outcomes of all records, each counted once, under ``all records``. A
    missing decision fails the query; with ``total`` an empty table does as well.
    """
    listed = F.when(F.size("categories") > 0, F.col("categories")).otherwise(
        F.array(F.lit("uncategorized"))
    )
    if total:
        listed = F.concat(F.array(F.lit(ALL_RECORDS)), listed)
    known = F.col("expected_decision").isNotNull() & F.col("predicted_decision").isNotNull()
    outcome = outcome_class(F.col("expected_decision"), F.col("predicted_decision"))
    counts = (
        records.select(F.explode(listed).alias("category"), outcome.alias("outcome"), known.alias("_known"))
        .groupBy("category", "outcome")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("_known")).alias("_missing"))
    )
    counts = guarded(
        counts, F.col("_missing") == 0, "every record needs an expected and a predicted decision"
    ).drop("_missing")
    if not total:
        return counts
    rows = records.agg(F.count(F.lit(1)).alias("records"))
    some = guarded(rows, F.col("records") > 0, "at least one decision record is required")
    # one row that fails where there is nothing to count
    return counts.unionByName(
        some.where(F.col("records") < 0).select(
            F.lit("").alias("category"), F.lit("").alias("outcome"), F.col("records").alias("n")
        )
    )


def false_acceptance_by_category(
    examples: DataFrame, *, safe: str = "safe", categories: str = "categories", predicted: str = "decision"
) -> DataFrame:
    """Share of unsafe examples allowed, per category."""
    return (
        examples.filter(~F.col(safe))
        .select(F.explode(categories).alias("category"), (F.col(predicted) == ALLOW).alias("_allowed"))
        .groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("unsafe"),
            F.count_if("_allowed").alias("allowed"),
        )
        .withColumn("false_acceptance_rate", rate(F.col("allowed"), F.col("unsafe")))
    )
