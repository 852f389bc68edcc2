import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gavelspark.operators import agreement as ag
from gavelspark.operators import quality as ql
from gavelspark.operators import sampling as sp
from gavelspark.sources.policy_data import policy_cases, policy_rules


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def pack(spark):
    cases = policy_cases(spark.range(20).withColumnRenamed("id", "index"), policy_rules(spark))
    return sp.blind(sp.first_per_slice(cases, 20)).cache()


def test_blind_pack(pack):
    rows = pack.collect()
    assert len(rows) == 120
    assert not [c for c in pack.columns if c.startswith("expected")]
    assert all(r[c] is None for r in rows for c in sp.ANNOTATION_COLUMNS)
    counts = {r.slice_name: r["count"] for r in pack.groupBy("slice_name").count().collect()}
    assert set(counts.values()) == {20} and len(counts) == 6
    # The order of the reference set: the first version's cases come first.
    assert {r.policy_version for r in rows} == {"v1"}


def test_pilot_and_audit(pack):
    ids = {}
    for r in pack.collect():
        ids.setdefault(r.slice_name, []).append(r.case_id)
    expected = sorted(i for names in ids.values() for i in sorted(names, key=sha)[:4])
    assert [r.case_id for r in sp.hash_per_slice(pack, 4).orderBy("case_id").collect()] == expected
    audit = sp.audit_sheet(sp.hash_top(pack, 50, key="case_id")).collect()
    everything = sorted((i for names in ids.values() for i in names), key=sha)[:50]
    assert {r.case_id for r in audit} == set(everything) and len(audit) == 50
    assert {r.reviewer_role for r in audit} == {"project_author"}
    with pytest.raises(ValueError):
        sp.hash_top(pack, 121, key="case_id")
    with pytest.raises(ValueError):
        sp.hash_per_slice(pack, 0)
    manifest = sp.pilot_manifest(sp.hash_per_slice(pack, 4), per_slice=4, reviewers=2).first()
    assert (manifest.cases, manifest.human_reviews_completed) == (24, False)


def test_samples(spark):
    frame = spark.range(200).withColumn("text", F.col("id").cast("string"))
    expected = sorted(sorted(range(200), key=lambda i: sha(f"7:{i}"))[:30])
    first = [r.id for r in sp.sample_exact(frame, 30, key="id", seed=7).collect()]
    assert first == expected
    assert [r.id for r in sp.sample_exact(frame.repartition(5), 30, key="id", seed=7).collect()] == expected
    assert sp.sample_at_most(frame, 500, key="id").count() == 200
    assert sp.sample_at_most(frame, None, key="id").count() == 200
    for size in (0, 201):
        with pytest.raises(ValueError):
            sp.sample_exact(frame, size, key="id")


def test_repeated_and_null_keys_are_sampled_row_by_row(spark):
    rows = [(i, c) for i in range(40) for c in range(3)] + [(None, c) for c in range(7)]
    frame = spark.createDataFrame(rows + [(5, 0)] * 100, "id int, copy int").repartition(5)
    order = sorted({i for i, _ in rows if i is not None}, key=lambda i: sha(f"42:{i}"))
    for size in (1, 5, 50, 200, 224, 227):
        picked = sp.sample_at_most(frame, size, key="id").collect()
        expected = [i for i in order for _ in range(103 if i == 5 else 3)]
        expected = (expected + [None] * 7)[:size]
        assert sorted((r.id for r in picked), key=str) == sorted(expected, key=str)
        again = sp.sample_at_most(frame.repartition(3), size, key="id").collect()
        assert sorted(map(str, picked)) == sorted(map(str, again))
    assert sp.sample_exact(frame, 5, key="id").count() == 5
    assert sp.hash_top(frame, 227, key="id").count() == 227
    slices = frame.withColumn("slice_name", F.lit("one"))
    assert sp.hash_per_slice(slices, 225, key="id").count() == 225
    assert sp.first_per_slice(slices, 4, order_by="id").count() == 4


def test_first_rows_with_nulls_last(spark):
    frame = spark.createDataFrame([(None,), (3,), (1,), (None,), (2,)], "i int")
    assert [r.i for r in sp.first_rows(frame, 4, order_by="i").collect()] == [1, 2, 3, None]


def test_seeded_shuffle_order(spark):
    got = [r.id for r in sp.seeded_shuffle(spark.range(100), key="id", seed=3).collect()]
    assert got == sorted(range(100), key=lambda i: sha(f"3:{i}"))


def annotations(spark, rows):
    return spark.createDataFrame(rows, "case_id string, annotated_decision string, annotated_rule_id string")


def test_agreement(spark):
    a = annotations(spark, [("1", "ALLOW", "none"), ("2", "REJECT", "R1"), ("3", "REJECT", "R1")])
    b = annotations(spark, [("1", "ALLOW", "none"), ("2", "REJECT", "R2"), ("3", "ALLOW", "R1")])
    compared = ag.compare_annotations(a, b)
    report = ag.agreement_report(compared).first()
    assert report.case_count == 3 and report.disagreement_count == 2 and report.requires_adjudication
    assert report.decision_and_rule_agreement == pytest.approx(1 / 3)
    assert [r.case_id for r in ag.disagreements(compared).collect()] == ["2", "3"]
    assert not ag.agreement_report(ag.compare_annotations(a, a)).first().requires_adjudication


@pytest.mark.parametrize("other", [[("1", "ALLOW", "none")], [("1", "ALLOW", "none"), ("2", "ALLOW", "x"), ("2", "ALLOW", "x")]])
def test_annotators_must_label_each_case_once(spark, other):
    a = annotations(spark, [("1", "ALLOW", "none"), ("2", "REJECT", "R1")])
    with pytest.raises(PySparkException):
        ag.agreement_report(ag.compare_annotations(a, annotations(spark, other))).collect()
    compared = ag.compare_annotations(a, annotations(spark, other))
    assert [r.agreed for r in compared.where("case_id = '2'").collect()] == [False]
    with pytest.raises(PySparkException):
        ag.disagreements(compared).collect()


def test_id_sets_and_missing_fields(spark):
    a = spark.createDataFrame([("1",), ("2",), ("2",)], "case_id string")
    b = spark.createDataFrame([("2",), ("3",)], "case_id string")
    assert {(r.case_id, r.only_in) for r in ag.unpaired_ids(a, b).collect()} == {("1", "left"), ("3", "right")}
    assert ag.unpaired_ids(a, a.distinct()).isEmpty()
    row = spark.createDataFrame([("1", None, "x", None)], "case_id string, reason string, rule string, decision string")
    fields = ("reason", "rule", "decision")
    assert ag.missing_fields(row, fields).first().missing == ["decision", "reason"]
    with pytest.raises(PySparkException, match="decision, reason"):
        ag.require_complete(row, fields).collect()
    with pytest.raises(PySparkException):
        ag.require_complete(row, fields).count()
    with pytest.raises(PySparkException):
        ag.require_complete(row, fields).select("case_id").collect()
    complete = row.na.fill("x")
    assert ag.require_complete(complete, fields).count() == 1


def test_integrity(spark):
    frame = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, v int")
    assert tuple(ql.key_counts(frame, "k").first()) == (3, 2, 1)
    with pytest.raises(ValueError):
        ql.require_unique(frame, "k")
    with pytest.raises(ValueError):
        ql.require_unique(frame, "v", rows=4)
    assert ql.require_unique(frame, "v", rows=3) is frame
    with pytest.raises(ValueError):
        ql.require_labels(frame, "v")
    assert ql.require_labels(frame, "k") is frame
    with pytest.raises(ValueError):
        ql.require_rows(frame.limit(0), "frame")
    good, bad = ql.split_by(frame, F.col("v") > 1)
    assert (good.count(), bad.count()) == (2, 1)
    with pytest.raises(PySparkException):
        ql.require(frame, F.col("v") > 1, "too small").collect()
    with pytest.raises(PySparkException):
        ql.require(frame, F.col("v") > 1, "too small").select("v").count()
