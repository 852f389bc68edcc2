"""Comparisons between two populations: shadow and canary reports, drift, latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.operators.metrics import rate
from gavelspark.operators.ranges import values_at
from gavelspark.schemas import ESCALATE
from gavelspark.sources.storage import stage

# Drift limits, rate floor, canary budget and load-test pass mark.
PSI_WARN = 0.10
PSI_BLOCK = 0.25
RATE_FLOOR = 1e-6
CANARY_BUDGET = 0.05
SUCCESS_MINIMUM = 0.99


def transitions(pairs: DataFrame, *, left: str = "production", right: str = "candidate") -> DataFrame:
    """Counts of ``left->right`` decisions. Both decisions sit in the same row, as when
    two models score it, or come from an equi-join of two decision tables."""
    return pairs.groupBy(F.concat_ws("->", left, right).alias("transition")).agg(
        F.count(F.lit(1)).alias("n")
    )


def shadow_report(
    pairs: DataFrame,
    *,
    left: str = "production",
    right: str = "candidate",
    left_review: Column | None = None,
    right_review: Column | None = None,
) -> DataFrame:
    """Rows, agreement and both review rates. Review defaults to an escalation."""
    left_review = F.col(left) == ESCALATE if left_review is None else left_review
    right_review = F.col(right) == ESCALATE if right_review is None else right_review
    counts = pairs.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(left) == F.col(right)).alias("_same"),
        F.count_if(left_review).alias("_left"),
        F.count_if(right_review).alias("_right"),
    )
    return counts.select(
        "rows",
        rate(F.col("_same"), F.col("rows")).alias("agreement_rate"),
        rate(F.col("_left"), F.col("rows")).alias(f"{left}_review_rate"),
        rate(F.col("_right"), F.col("rows")).alias(f"{right}_review_rate"),
    )


def exact_percentiles(frame: DataFrame, column: str, points: Sequence[float]) -> list[float | None]:
    """Linearly interpolated percentiles of one column, by one method at every size."""
    return values_at(frame, [column], points)[column]


def canary_report(
    pairs: DataFrame,
    *,
    left: str = "stable",
    right: str = "canary",
    left_latency: str = "stable_latency_ms",
    right_latency: str = "canary_latency_ms",
    budget: float = CANARY_BUDGET,
) -> DataFrame:
    """Disagreement rate, P95 latency per side and the verdict against the budget."""
    pairs = stage(pairs.select(left, right, left_latency, right_latency))
    latencies = values_at(pairs, [left_latency, right_latency], [0.95])
    (left_p95,), (right_p95,) = latencies[left_latency], latencies[right_latency]
    counts = pairs.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(left) != F.col(right)).alias("_differ")
    )
    disagreement = rate(F.col("_differ"), F.col("rows"))
    return counts.select(
        "rows",
        disagreement.alias("disagreement_rate"),
        F.lit(left_p95).cast("double").alias(f"{left}_p95_latency_ms"),
        F.lit(right_p95).cast("double").alias(f"{right}_p95_latency_ms"),
        (disagreement <= budget).alias("passed"),
    )


def latency_report(log: DataFrame, *, status: str = "status", latency: str = "latency_ms") -> DataFrame:
    """Requests, success rate, p50/p95/p99 and the pass mark."""
    p50, p95, p99 = exact_percentiles(log, latency, [0.5, 0.95, 0.99])
    counts = log.agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col(status) == 200).alias("_good")
    )
    success = rate(F.col("_good"), F.col("requests"))
    return counts.select(
        "requests",
        success.alias("success_rate"),
        *(F.lit(v).cast("double").alias(n) for n, v in (("p50", p50), ("p95", p95), ("p99", p99))),
        (success >= SUCCESS_MINIMUM).alias("passed"),
    )


def decision_distribution(log: DataFrame, *, decision: str = "decision", latency: str = "latency_ms") -> DataFrame:
    """Requests and mean latency per decision."""
    return log.groupBy(decision).agg(
        F.count(F.lit(1)).alias("requests"), F.avg(latency).alias("mean_latency_ms")
    )


def aligned_bins(
    reference: DataFrame, observed: DataFrame, *, keys: Sequence[str] = (), bin: str = "bin", count: str = "n"
) -> DataFrame:
    """Counts of both populations per bin; a bin one side lacks counts zero there."""
    def side(frame, own, other):
        return frame.select(*keys, bin, F.col(count).cast("long").alias(own), F.lit(0).cast("long").alias(other))

    both = side(reference, "reference", "observed").unionByName(side(observed, "observed", "reference"))
    return both.groupBy(*keys, bin).agg(
        F.sum("reference").alias("reference"), F.sum("observed").alias("observed")
    )


def stability_index(bins: DataFrame, *, keys: Sequence[str] = (), epsilon: float = RATE_FLOOR) -> DataFrame:
    """Population stability index per key of (reference, observed) bin counts.

    Negative counts and an empty population fail the query.
    """
    totals = bins.groupBy(*keys).agg(F.sum("reference").alias("_r"), F.sum("observed").alias("_o"))
    if keys:
        named = totals.select(*(F.col(k).alias(f"_key_{k}") for k in keys), "_r", "_o")
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
        with_totals = bins.join(named, same)
    else:
        with_totals = bins.withColumns({c: totals.select(c).scalar() for c in ("_r", "_o")})
    valid = (F.col("reference") >= 0) & (F.col("observed") >= 0) & (F.col("_r") > 0) & (F.col("_o") > 0)
    r = F.greatest(F.col("reference") / F.col("_r"), F.lit(epsilon))
    o = F.greatest(F.col("observed") / F.col("_o"), F.lit(epsilon))
    term = F.when(valid, (o - r) * F.log(o / r)).otherwise(
        F.raise_error(F.lit("counts must be non-negative and each population non-empty")).cast("double")
    )
    return (
        with_totals.select(*keys, term.alias("_term"))
        .groupBy(*keys)
        .agg(F.sum("_term").alias("psi"), F.count(F.lit(1)).alias("bins"))
        .filter(F.col("bins") > 0)
        .select(*keys, "psi", drift_verdict(F.col("psi")).alias("verdict"))
    )


def drift_verdict(psi: Column, warn: float = PSI_WARN, block: float = PSI_BLOCK) -> Column:
    return F.when(psi >= block, "block").when(psi >= warn, "warn").otherwise("ok")
