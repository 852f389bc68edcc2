import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gavelspark.operators import labels as lb
from gavelspark.schemas import PROMPT_SCHEMA, VOTE_SCHEMA


def votes(spark, rows):
    return lb.vote_rows(spark.createDataFrame(rows, VOTE_SCHEMA))


def test_majority_and_ties(spark):
    rows = [
        ("p", " r ", True, {"b": True, "a": False}),
        ("p", "r", False, {"b": True, "a": True}),
        (" p", "r", False, {"a": True, "c": True}),
        ("tie", "r", True, {}),
        ("tie", "r", False, {"x": True}),
    ]
    (example,) = lb.majority_labels(votes(spark, rows)).collect()
    assert example.text == "User: p\nAssistant: r"
    assert (example.safe, example.annotation_count) == (False, 3)
    assert example.safe_label_agreement == pytest.approx(2 / 3)
    assert example.categories == ["a", "b"]
    assert example.example_id.startswith(lb.VOTE_ID_PREFIX)


def test_single_vote_and_summary(spark):
    examples = lb.majority_labels(votes(spark, [("p", "r", True, {"a": True}), ("q", "r", False, None)]))
    rows = {r.text: r for r in examples.collect()}
    assert rows["User: p\nAssistant: r"].categories == ["a"]
    assert rows["User: q\nAssistant: r"].categories == []
    assert lb.vote_summary(examples).first().mean_annotations_per_example == 1.0


@pytest.mark.parametrize("row", [("", "r", True, {}), ("p", " ", True, {}), (None, "r", True, {}), ("p", "r", None, {})])
def test_bad_votes_fail(spark, row):
    with pytest.raises(PySparkException):
        lb.majority_labels(votes(spark, [row])).collect()


def test_only_ties_is_an_error_if_asked(spark):
    tied = votes(spark, [("p", "r", True, {}), ("p", "r", False, {})])
    with pytest.raises(ValueError):
        lb.majority_labels(tied, require_rows=True)


def test_dominant_text_is_counted_before_the_shuffle(spark):
    """A third of all votes on one text: its votes are counted before the shuffle."""
    frame = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"),
        (F.col("id") % 9 != 0).alias("is_safe"),
        F.array(F.lit("c")).alias("categories"),
    )
    hot = lb.majority_labels(frame).filter("text = 'hot'").first()
    assert (hot.annotation_count, hot.safe, hot.categories) == (10_000, True, ["c"])
    plan = lb.majority_labels(frame)._jdf.queryExecution().sparkPlan().toString()
    assert "partial_count" in plan


def prompts(spark, rows):
    return spark.createDataFrame(rows, PROMPT_SCHEMA)


def test_human_rows(spark):
    rows = [
        ("reviewed safe", "true", "0", "0"),
        ("model labeled", "false", "1", "0"),
        (" reviewed toxic", "1", "1", "1"),
        ("reviewed toxic ", "True", "1", "TRUE"),
        ("no flag", None, "1", "1"),
    ]
    got = {r.text: (r.toxic, r.jailbreaking) for r in lb.human_reviewed(prompts(spark, rows)).collect()}
    assert got == {"reviewed safe": (False, False), "reviewed toxic": (True, True)}


def test_conflicts_and_empty_sets_fail(spark):
    with pytest.raises(PySparkException):
        lb.human_reviewed(prompts(spark, [("a", "1", "1", "0"), ("a", "1", "0", "0")])).collect()
    with pytest.raises(PySparkException):
        lb.human_reviewed(prompts(spark, [("a", "1", "1", "0"), ("a", "1", "1", "1")])).collect()
    with pytest.raises(PySparkException):
        lb.human_reviewed(prompts(spark, [(" ", "1", "1", "0")])).collect()
    with pytest.raises(ValueError):
        lb.human_reviewed(prompts(spark, [("a", "0", "1", "0")]), require_rows=True)


def test_comment_cases(spark):
    frame = spark.createDataFrame([(3, " hello ", 0.1), (4, "bad", 0.9)], "i int, text string, toxicity double")
    ok, bad = lb.comment_cases(frame, split="test", index="i").collect()
    assert ok.case_id.startswith("CC-test-0000003-") and len(ok.case_id) == len("CC-test-0000003-") + 12
    assert (ok.content, ok.expected_decision, ok.expected_rule_id) == ("hello", "ALLOW", None)
    assert (bad.expected_decision, bad.expected_rule_id) == ("REJECT", "P-TOX")
    assert bad.expected_remediation == "Remove or rewrite the toxic content."
