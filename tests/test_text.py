import re
import sys

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gavelspark.functions import decisions as dc
from gavelspark.functions import text as tx


def every_code_point():
    return [(i, f"a{chr(i)}Z") for i in range(1, sys.maxunicode + 1, 1) if not 0xD800 <= i <= 0xDFFF]


@pytest.fixture(scope="module")
def code_points(spark):
    import pandas as pd

    frame = pd.DataFrame(every_code_point(), columns=["i", "s"])
    return spark.createDataFrame(frame, "i int, s string").repartition(8)


def test_normalize_equals_python_for_every_code_point(code_points):
    rows = code_points.select("s", tx.normalize("s").alias("n")).filter("n <> 'az'").collect()
    found = {r.s: r.n for r in rows}
    expected = {}
    for _, s in every_code_point():
        n = re.sub(r"[^a-z0-9]+", "", s.casefold())
        if n != "az":
            expected[s] = n
    assert found == expected


def test_strip_equals_python_for_every_code_point(code_points):
    padded = F.concat(F.substring("s", 2, 1), F.lit("x"), F.substring("s", 2, 1))
    rows = code_points.select("i", tx.strip(padded).alias("b")).filter("b = 'x'").collect()
    assert {chr(r.i) for r in rows} == {chr(i) for i, s in every_code_point() if (chr(i) + "x" + chr(i)).strip() == "x"}


def test_boolean_like(spark):
    frame = spark.createDataFrame([("1",), (" True ",), ("0",), ("FALSE",), ("",), (" ",)], "v string")
    assert [r[0] for r in frame.select(tx.as_boolean(F.col("v"))).collect()] == [True, True, False, False, False, False]
    bad = spark.createDataFrame([("yes",)], "v string")
    assert bad.select(tx.is_boolean_like(F.col("v"))).first()[0] is False
    with pytest.raises(PySparkException):
        bad.select(tx.as_boolean(F.col("v"))).collect()
    kinds = spark.createDataFrame([(True, 1)], "b boolean, i int")
    assert tuple(kinds.select(tx.as_boolean(F.col("b")), tx.as_boolean(F.col("i"))).first()) == (True, True)


def test_required_text(spark):
    frame = spark.createDataFrame([("  a b ",)], "v string")
    assert frame.select(tx.required(F.col("v"), "text")).first()[0] == "a b"
    for value in (None, "   "):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(value,)], "v string").select(tx.required(F.col("v"), "text")).collect()


def test_score_decision(spark):
    rows = spark.createDataFrame([(0.0,), (0.1,), (0.2,), (0.5,), (1.0,)], "s double")
    got = [r[0] for r in rows.select(dc.score_decision(F.col("s"))).collect()]
    assert got == ["ALLOW", "ALLOW", "ESCALATE", "REJECT", "REJECT"]
    for bad in (-0.01, 1.01, float("nan"), None):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(bad,)], "s double").select(dc.score_decision(F.col("s"))).collect()
    with pytest.raises(ValueError):
        dc.ScoreCuts(0.5, 0.5)


def test_threshold_decision_order(spark):
    rows = [(0.9, 0.05, 0.05), (0.45, 0.1, 0.45), (0.8, 0.05, 0.15), (0.55, 0.4, 0.05), (0.2, 0.2, 0.6)]
    frame = spark.createDataFrame(rows, "a double, e double, r double")
    choice = dc.Thresholds(0.6, 0.4, 0.1)
    got = [x[0] for x in frame.select(dc.threshold_decision(F.col("a"), F.col("r"), choice)).collect()]
    assert got == ["ALLOW", "REJECT", "ESCALATE", "ESCALATE", "REJECT"]


def test_argmax_ties_go_by_label_order(spark):
    rows = [(0.4, 0.4, 0.2), (0.2, 0.4, 0.4), (0.4, 0.2, 0.4), (0.2, 0.3, 0.5)]
    frame = spark.createDataFrame(rows, "a double, e double, r double")
    got = [x[0] for x in frame.select(dc.argmax_decision(*map(F.col, "aer"))).collect()]
    assert got == ["ALLOW", "ESCALATE", "ALLOW", "REJECT"]


def test_reorder_requires_the_exact_classes(spark):
    frame = spark.createDataFrame(
        [(["REJECT", "ALLOW", "ESCALATE"], [0.3, 0.5, 0.2])], "c array<string>, v array<double>"
    )
    got = frame.select(*dc.reorder_probabilities(F.col("c"), F.col("v"))).first()
    assert (got.p_allow, got.p_escalate, got.p_reject) == (0.5, 0.2, 0.3)
    for classes in (["ALLOW", "REJECT"], ["ALLOW", "REJECT", "OTHER"], ["ALLOW", "ALLOW", "REJECT"]):
        wrong = spark.createDataFrame([(classes, [0.1] * len(classes))], "c array<string>, v array<double>")
        with pytest.raises(PySparkException):
            wrong.select(*dc.reorder_probabilities(F.col("c"), F.col("v"))).collect()


def test_contracts(spark):
    rows = [("ALLOW", 0.5, False), ("ESCALATE", 0.5, False), ("ESCALATE", 0.5, True), ("ALLOW", 1.5, False),
            ("BLOCK", 0.5, True), ("ALLOW", None, True)]
    frame = spark.createDataFrame(rows, "d string, c double, r boolean")
    got = [x[0] for x in frame.select(dc.result_contract(*map(F.col, "dcr"))).collect()]
    assert got == [True, False, True, False, False, False]
