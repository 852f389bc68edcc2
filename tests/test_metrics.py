import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gavelspark.operators import metrics as mt
from gavelspark.operators import thresholds as th
from gavelspark.schemas import LABELS


def pairs(spark, rows):
    return spark.createDataFrame(rows, "expected_decision string, decision string, confidence double")


def test_certain_and_right_is_calibrated(spark):
    cube = mt.decision_cube(pairs(spark, [("ALLOW", "ALLOW", 1.0), ("REJECT", "REJECT", 1.0)]), confidence="confidence")
    assert mt.binned_calibration_error(cube).first().calibration_error == 0
    row = mt.metric_row(cube, binned=True).first()
    assert (row.expected_calibration_error, row.accuracy, row.mean_absolute_calibration) == (0, 1, 0)
    # Two of three labels are present; the absent one counts as zero.
    assert row.macro_f1 == pytest.approx(2 / 3)


def test_rates_without_a_denominator_are_null(spark):
    row = mt.metric_row(mt.decision_cube(pairs(spark, [("ESCALATE", "ALLOW", 0.5)]))).first()
    assert row.false_acceptance_rate is None and row.false_rejection_rate is None
    assert row.citation_accuracy is None and row.macro_f1 == 0


def test_bins_are_open_below_and_closed_above(spark):
    edges = np.linspace(0, 1, 11)
    values = [0.0, *edges[1:], *np.nextafter(edges[1:-1], 1), -0.1, 1.1]
    frame = spark.createDataFrame([(float(v),) for v in values], "c double")
    got = [r[0] for r in frame.select(mt.confidence_bin("c")).collect()]
    expected = []
    for v in values:
        inside = [i + 1 for i in range(10) if edges[i] < v <= edges[i + 1]]
        expected.append(inside[0] if inside else 0)
    assert got == expected


def test_random_rows_against_numpy(spark):
    rng = random.Random(1)
    rows = [(rng.choice(LABELS), rng.choice(LABELS), rng.random()) for _ in range(500)]
    cube = mt.decision_cube(pairs(spark, rows), confidence="confidence")
    e, p, c = (np.array(x) for x in zip(*rows))
    right = e == p
    ece = 0.0
    for low, high in zip(np.linspace(0, 1, 11)[:-1], np.linspace(0, 1, 11)[1:]):
        m = (c > low) & (c <= high)
        if m.any():
            ece += m.mean() * abs(right[m].mean() - c[m].mean())
    row = mt.metric_row(cube, binned=True).first()
    assert row.expected_calibration_error == pytest.approx(ece)
    assert row.mean_absolute_calibration == pytest.approx(np.abs(c - right).mean())
    assert row.false_acceptance_rate == pytest.approx((p[e == "REJECT"] == "ALLOW").mean())
    matrix = {(r.expected, r.predicted): r.n for r in mt.confusion_matrix(cube).collect()}
    assert matrix == {(a, b): int(((e == a) & (p == b)).sum()) for a in LABELS for b in LABELS}


def test_overlapping_slices_and_missing_slices(spark):
    rows = [("REJECT", "ALLOW", 0.9, 0.1), ("REJECT", "REJECT", 0.5, 0.2), ("ALLOW", "ALLOW", 0.4, 0.3)]
    frame = spark.createDataFrame(rows, "expected_decision string, decision string, threat double, insult double")
    cube = mt.decision_cube(frame, slices=mt.attribute_slices(["threat", "insult"]))
    got = {r.slice: (r.rows, r.false_acceptance_rate) for r in mt.metric_row(cube, ["slice"]).collect()}
    assert got == {"overall": (3, 0.5), "threat": (2, 0.5)}


def test_error_taxonomy(spark):
    rows = [
        ("REJECT", "ALLOW", ["threat", "insult"]), ("ALLOW", "REJECT", []), ("ESCALATE", "ESCALATE", ["threat"]),
        ("ALLOW", "ALLOW", None), ("ESCALATE", "ALLOW", ["insult"]),
    ]
    frame = spark.createDataFrame(rows, "expected_decision string, predicted_decision string, categories array<string>")
    got = {(r.category, r.outcome): r.n for r in mt.category_outcomes(frame).collect()}
    assert got == {
        ("threat", "false_accept"): 1, ("insult", "false_accept"): 1, ("uncategorized", "false_reject"): 1,
        ("threat", "escalated"): 1, ("uncategorized", "correct"): 1, ("insult", "other_error"): 1,
    }
    with pytest.raises(PySparkException):
        mt.category_outcomes(frame.withColumn("expected_decision", F.lit(None).cast("string"))).collect()
    totals = mt.category_outcomes(frame, total=True)
    assert sum(r.n for r in totals.where(F.col("category") == mt.ALL_RECORDS).collect()) == frame.count()
    with pytest.raises(PySparkException):
        mt.category_outcomes(frame.limit(0), total=True).collect()
    with pytest.raises(PySparkException):
        mt.category_outcomes(frame.withColumn("expected_decision", F.lit(None).cast("string"))).count()


FIXTURE = [
    ("ALLOW", 0.9, 0.08, 0.02, False), ("ALLOW", 0.8, 0.15, 0.05, False), ("ESCALATE", 0.3, 0.6, 0.1, False),
    ("REJECT", 0.2, 0.3, 0.5, True), ("REJECT", 0.1, 0.2, 0.7, True),
]
SCORED = "label string, p_allow double, p_escalate double, p_reject double, threat boolean"


def brute(rows, maximum, slice_index=4):
    best, feasible = None, 0
    for a in np.linspace(0.5, 0.95, 10):
        for r in np.linspace(0.2, 0.8, 13):
            for c in (0.05, 0.1, 0.15, 0.2):
                pred = ["REJECT" if x[3] >= r else "ALLOW" if x[1] >= a and x[3] <= c else "ESCALATE" for x in rows]

                def far(keep):
                    unsafe = [p for x, p in zip(rows, pred) if x[0] == "REJECT" and keep(x)]
                    return sum(p == "ALLOW" for p in unsafe) / len(unsafe) if unsafe else None

                rates = [far(lambda x: True), far(lambda x: x[slice_index])]
                if any(v is not None and v > maximum for v in rates):
                    continue
                feasible += 1
                f1 = 0
                for label in LABELS:
                    tp = sum(x[0] == label == p for x, p in zip(rows, pred))
                    total = sum(x[0] == label for x in rows) + pred.count(label)
                    f1 += (2 * tp / total if total else 0.0)
                key = (f1 / 3.0, -pred.count("ESCALATE") / len(rows))
                if best is None or key > best[0]:
                    best = (key, (a, r, c))
    return best, feasible


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_threshold_search_equals_brute_force(spark, seed):
    rows = FIXTURE
    if seed is not None:
        rng = np.random.default_rng(seed)
        # Probabilities on grid values, so that every boundary is met exactly.
        grid = [*th.ALLOW_MINIMA, *th.REJECT_MINIMA, *th.REJECT_CAPS]
        rows = [
            (str(rng.choice(LABELS)), float(rng.choice(grid)), 0.1, float(rng.choice(grid)), bool(rng.random() < 0.4))
            for _ in range(60)
        ]
    (best, choice), feasible = brute(rows, 0.2)
    got = th.select_thresholds(spark.createDataFrame(rows, SCORED), {"threat": F.col("threat")}, 0.2).first()
    assert (got.allow_minimum, got.reject_minimum, got.reject_cap) == tuple(map(float, choice))
    assert got.macro_f1 == pytest.approx(best[0]) and got.escalation_rate == pytest.approx(-best[1])
    assert got.feasible_candidates == feasible


def test_chosen_thresholds_never_allow_unsafe_rows(spark):
    frame = spark.createDataFrame(FIXTURE, SCORED)
    choice = th.chosen_thresholds(th.select_thresholds(frame, {"threat": F.col("threat")}, 0.0))
    from gavelspark.functions.decisions import threshold_decision

    decided = frame.withColumn("d", threshold_decision(F.col("p_allow"), F.col("p_reject"), choice))
    assert decided.filter("label = 'REJECT' and d = 'ALLOW'").isEmpty()


def test_no_feasible_candidate_is_an_error(spark):
    frame = spark.createDataFrame([("REJECT", 1.0, 0.0, 0.0, True)], SCORED)
    with pytest.raises(ValueError):
        th.chosen_thresholds(th.select_thresholds(frame, {"threat": F.col("threat")}, 0.05))


def test_rows_are_shuffled_once_as_counts(spark):
    frame = spark.createDataFrame(FIXTURE, SCORED)
    plan = th.threshold_cells(frame, {"threat": F.col("threat")})._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Join" not in plan
