import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gavelspark.operators import drift as dr
from gavelspark.operators import gates as gt
from gavelspark.streaming import monitoring as mn


def bins(spark, reference, observed):
    rows = [(str(i), r, o) for i, (r, o) in enumerate(zip(reference, observed))]
    return spark.createDataFrame(rows, "bin string, reference long, observed long")


def test_stability_index(spark):
    same = dr.stability_index(bins(spark, [80, 15, 5], [80, 15, 5])).first()
    assert (same.psi, same.verdict) == (0, "ok")
    moved = dr.stability_index(bins(spark, [80, 15, 5], [40, 30, 30])).first()
    assert moved.psi > 0.25 and moved.verdict == "block"
    empty_bin = dr.stability_index(bins(spark, [10, 0], [5, 5])).first().psi
    assert empty_bin == pytest.approx((0.5 - 1) * np.log(0.5) + (0.5 - 1e-6) * np.log(0.5 / 1e-6))
    for bad in (([1, -1], [1, 1]), ([0, 0], [1, 1]), ([1, 1], [0, 0])):
        with pytest.raises(PySparkException):
            dr.stability_index(bins(spark, *bad)).collect()


def test_shadow_report(spark):
    pairs = spark.createDataFrame([("ALLOW", "ESCALATE"), ("ALLOW", "ESCALATE")], "production string, candidate string")
    report = dr.shadow_report(pairs).first()
    assert (report.agreement_rate, report.candidate_review_rate, report.production_review_rate) == (0, 1, 0)
    assert [tuple(r) for r in dr.transitions(pairs).collect()] == [("ALLOW->ESCALATE", 2)]
    assert "text" not in dr.shadow_report(pairs).columns


@pytest.mark.parametrize("kind", ["distinct", "heavy", "two values", "constant"])
def test_exact_percentiles(spark, kind):
    """Rank selection against NumPy."""
    rng = np.random.default_rng(3)
    n = 20_001
    values = {
        "distinct": rng.normal(size=n),
        "heavy": np.where(rng.random(n) < 0.4, 5.0, rng.normal(5, 3, size=n)),
        "two values": np.where(rng.random(n) < 0.95, 1.0, 2.0),
        "constant": np.full(n, 7.0),
    }[kind]
    import pandas as pd

    frame = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(4)
    points = [0.0, 0.5, 0.95, 0.99, 1.0]
    assert dr.exact_percentiles(frame, "v", points) == pytest.approx(list(np.percentile(values, [p * 100 for p in points])))
    assert dr.exact_percentiles(frame.where("v is null"), "v", points) == [None] * 5


def test_latency_report(spark):
    log = spark.createDataFrame([(200, float(i)) for i in range(99)] + [(503, 99.0)], "status int, latency_ms double")
    report = dr.latency_report(log).first()
    assert (report.p50, report.success_rate, report.passed) == (49.5, 0.99, True)
    assert not dr.latency_report(log.filter("latency_ms > 50")).first().passed


def test_percentile_exceeds_equals_numpy(spark):
    rng = np.random.default_rng(0)
    rows, expected = [], []
    for i in range(300):
        values = np.round(rng.uniform(0, 300 if i % 2 else 262, size=rng.integers(1, 60)), 1)
        over = values[values > 250]
        under = values[values <= 250]
        rows.append((i, len(values), len(over), float(under.max()) if len(under) else None, float(over.min()) if len(over) else None))
        expected.append(bool(np.percentile(values, 95) > 250))
    frame = spark.createDataFrame(rows, "i int, n long, over long, below double, above double")
    test = mn.percentile_exceeds(*map(F.col, ("n", "over", "below", "above")), limit=250.0)
    assert [r[0] for r in frame.orderBy("i").select(test).collect()] == expected


# ---- gates ----


def evidence(spark, **changes):
    values = {
        (slice_name, metric): 0.01
        for slice_name, metric in [
            ("overall", "false_acceptance_rate"), ("overall", "false_rejection_rate"),
            ("overall", "expected_calibration_error"), ("threat", "false_acceptance_rate"),
            ("identity_attack", "false_acceptance_rate"), ("sexual_explicit", "false_acceptance_rate"),
        ]
    }
    values.update(changes.pop("values", {}))
    rows = [("m", "test", s, m, v) for (s, m), v in values.items() if v is not None]
    return spark.createDataFrame(rows, "model_id string, split string, slice string, metric string, value double")


def test_comment_release(spark):
    assert gt.comment_release(evidence(spark)).first().decision == "approved"
    edge = evidence(spark, values={("threat", "false_acceptance_rate"): 0.05})
    assert gt.comment_release(edge).first().decision == "approved"
    over = evidence(spark, values={("threat", "false_acceptance_rate"): 0.051})
    assert tuple(gt.comment_release(over).select("decision", "failed_checks").first()) == ("rejected", 1)
    missing = evidence(spark, values={("threat", "false_acceptance_rate"): None})
    assert gt.comment_release(missing).first().decision == "rejected"


def rate(spark, value):
    return spark.createDataFrame([("m", value)], "model_id string, false_acceptance_rate double")


def agreement(spark, cases=120, agreed=0.9, adjudicate=False):
    return spark.createDataFrame(
        [("m", cases, agreed, adjudicate)],
        "model_id string, case_count long, decision_and_rule_agreement double, requires_adjudication boolean",
    )


def test_complete_release(spark):
    def decide(candidate, external, review):
        return gt.complete_release(candidate, external, review)[1].first().decision

    good = evidence(spark)
    assert decide(good, rate(spark, 0.1), agreement(spark)) == "approved"
    assert decide(gt.comment_release(good), rate(spark, 0.1), agreement(spark)) == "approved"
    assert decide(good, rate(spark, 0.59), agreement(spark)) == "blocked"
    assert decide(good, None, agreement(spark)) == "blocked"
    assert decide(good, rate(spark, 0.1), None) == "blocked"
    assert decide(good, rate(spark, None), agreement(spark)) == "blocked"
    for change in ({"cases": 99}, {"agreed": 0.79}, {"adjudicate": True}, {"adjudicate": None}):
        assert decide(good, rate(spark, 0.1), agreement(spark, **change)) == "blocked"
    checks = {r.check: r.passed for r in gt.complete_release(good, None, None)[0].collect()}
    assert checks.pop("civil_comments_release") and not any(checks.values()) and len(checks) == 4
    with pytest.raises(ValueError):
        gt.complete_release(rate(spark, 0.1), None, None)
    other = spark.createDataFrame([("m", "other-policy", "approved")], "model_id string, policy string, decision string")
    with pytest.raises(PySparkException):
        decide(other, rate(spark, 0.1), agreement(spark))


def test_public_evidence(spark):
    audit = lambda n, done: spark.createDataFrame([("m", n, done)], "model_id string, case_count long, complete boolean")

    def decide(prompts, dialogues, sheet):
        return gt.public_evidence(evidence(spark), prompts, dialogues, sheet)[1].first().decision

    assert decide(rate(spark, 0.09), rate(spark, 0.08), audit(50, True)) == "supported"
    assert decide(rate(spark, 0.09), rate(spark, 0.08), audit(50, False)) == "blocked"
    assert decide(rate(spark, 0.09), rate(spark, 0.08), audit(49, True)) == "blocked"
    assert decide(rate(spark, 0.09), rate(spark, 0.08), None) == "blocked"
    assert decide(rate(spark, 0.11), rate(spark, 0.08), audit(50, True)) == "blocked"
    assert decide(rate(spark, 0.09), None, audit(50, True)) == "blocked"
