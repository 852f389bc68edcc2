import random
import re

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gavelspark.operators import agreement as ag
from gavelspark.operators import policy as po
from gavelspark.plans.policy_evaluation import evaluate_policies
from gavelspark.schemas import RULE_SCHEMA
from gavelspark.sources.policy_data import SLICES, policy_cases, policy_rules


@pytest.fixture(scope="module")
def rules(spark):
    return policy_rules(spark)


@pytest.fixture(scope="module")
def cases(spark, rules):
    return policy_cases(spark.range(20).withColumnRenamed("id", "index"), rules)


def test_case_set(cases):
    rows = cases.collect()
    assert len(rows) == len({r.case_id for r in rows}) == 360
    assert {r.slice_name for r in rows} == set(SLICES)
    actions = {r.expected_decision for r in rows if r.expected_rule_id == "P-ALC"}
    assert actions == {"ALLOW", "REJECT", "ESCALATE"}
    assert {r.label_budget for r in rows if r.slice_name == "low_resource"} == {8, 32, 128, 256}
    assert all(r.label_budget is None for r in rows if r.slice_name != "low_resource")
    hidden = next(r for r in rows if r.case_id == "PC-04-00-000")
    assert hidden.content == "Limited-time w i n e pr0m0tion for adults. Reference 0."


GOLDEN = {
    "static_policy": (0.6203703703703703, 0.2857142857142857, 0.0, 0.25, 1.0, 0.3333333333333333, 0.424),
    "versioned_policy": (1.0, 0.0, 0.0, 0.35, 1.0, 1.0, 0.132),
    "ranked_policy": (1.0, 0.0, 0.0, 0.35, 1.0, 1.0, 0.132),
}


def check_golden(rows):
    assert len(rows) == 21
    for r in rows:
        got = (r.macro_f1, r.false_acceptance_rate, r.false_rejection_rate, r.escalation_rate,
               r.citation_accuracy, r.remediation_accuracy, r.mean_absolute_calibration)
        assert got == pytest.approx(GOLDEN[r.system], abs=1e-12)


def test_published_numbers_in_one_pass(cases, rules):
    check_golden(evaluate_policies(cases, rules).collect())


def test_published_numbers_system_by_system(cases, rules):
    check_golden(evaluate_policies(cases, rules, systems=po.BUILT_IN_SYSTEMS).collect())


def test_current_policy_beats_the_static_one(cases, rules):
    rows = {(r.system, r.slice_name): r.macro_f1 for r in evaluate_policies(cases, rules).collect()}
    assert rows["versioned_policy", "policy_shift"] > rows["static_policy", "policy_shift"]


def normal(text):
    return re.sub(r"[^a-z0-9]+", "", text.casefold())


def brute_force(case, rules, version):
    hits = []
    for rule in sorted((r for r in rules if r[0] == version), key=lambda r: r[7]):
        count = sum(normal(t) in normal(case[2]) for t in rule[4])
        if count:
            hits.append((rule[1], count))
    first = hits[0] if hits else (None, None)
    best = sorted(hits, key=lambda h: -h[1])[0] if hits else (None, None)
    return first[0], best[0], best[1]


def test_matching_equals_brute_force_at_every_size_of_the_bitmap(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    rules = [
        (v, f"{v}-R{i}", "t", rng.choice(["ALLOW", "REJECT"]), [word(rng.randint(2, 9)) for _ in range(rng.randint(1, 4))], "text", "fix", i)
        for v in ("v1", "v2") for i in range(6)
    ]
    # Two thirds of the cases hold one text and version.
    cases = [(f"c{i}", "v1" if i % 3 else rng.choice(["v1", "v2", "v9"]), "Ab C! aBc-ba" if i % 3 else word(rng.randint(0, 30)))
             for i in range(150)]
    rule_frame = spark.createDataFrame(rules, "version string, rule_id string, topic string, action string, terms array<string>, text string, remediation string, ordinal int")
    case_frame = spark.createDataFrame(cases, "case_id string, policy_version string, content string")
    expected = {
        c[0]: (*brute_force(c, rules, c[1]), brute_force(c, rules, "v2")[0]) for c in cases
    }
    for bits in (po.MOST_BITS, 1 << 15):
        rows = po.match_rules(case_frame, rule_frame, pinned_version="v2", most_bits=bits).collect()
        got = {
            r.case_id: (
                r.first_rule and r.first_rule.rule_id,
                r.best_rule and r.best_rule.rule_id,
                r.best_rule and r.best_rule.hits,
                r.pinned_rule and r.pinned_rule.rule_id,
            )
            for r in rows
        }
        assert len(rows) == 150 and got == expected


def test_repeated_ids_nulls_and_tied_rules(spark):
    rules = [("v1", f"R{i}", "t", a, ["beer", "wine"], f"text {i % 2}", None, 1) for i, a in enumerate(["REJECT", "ALLOW", "ESCALATE"])]
    rules += [("v1", "R0", "t", "REJECT", ["wine cellar", "b"], "text 0", None, 1), ("v2", "R9", "t", "REJECT", ["beer"], "x", "y", 0)]
    frame = spark.createDataFrame(rules, "version string, rule_id string, topic string, action string, terms array<string>, text string, remediation string, ordinal int")
    cases = [("same", "v1", "good BEER"), ("same", "v1", "nothing"), ("same", "v2", "good beer"), (None, "v1", "wine cellar"),
             ("n", None, "beer"), ("m", "v1", None), ("same", "v1", "good BEER"), ("z", "v3", "beer")]
    table = spark.createDataFrame(cases, "case_id string, policy_version string, content string")
    found = [
        sorted(map(str, po.match_rules(table, frame, pinned_version="v1", most_bits=n).collect()))
        for n in (po.MOST_BITS, 1 << 15)
    ]
    assert found[0] == found[1] and len(found[0]) == len(cases)


def test_empty_terms_are_refused(spark, cases):
    rows = [("v1", "R", "t", "REJECT", ["वाइन"], "text", "fix", 0)]
    with pytest.raises(PySparkException):
        po.versioned_policy(cases, spark.createDataFrame(rows, RULE_SCHEMA)).collect()


def test_policy_without_evidence_is_escalated(spark):
    frame = spark.createDataFrame(
        [("REJECT", "R1", "r", [], 0.88, "fix", False), ("REJECT", "R1", "r", ["e"], 0.88, "fix", False),
         ("ALLOW", None, "r", [], 0.82, None, False)],
        "decision string, policy string, reason string, evidence array<string>, confidence double, remediation string, review_required boolean",
    ).select(F.struct("*").alias("r"))
    rows = frame.select(po.require_evidence("r").alias("x")).select("x.*").collect()
    assert [(r.decision, r.confidence, r.review_required) for r in rows] == [
        ("ESCALATE", 0.5, True), ("REJECT", 0.88, False), ("ALLOW", 0.82, False)
    ]


def test_pairing_needs_both_sides(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "case_id string, x int")
    right = spark.createDataFrame([("a", 3), ("b", 4)], "case_id string, y int")
    assert {(r.case_id, r.x, r.y) for r in ag.pair_results(left, right).collect()} == {("a", 1, 3), ("b", 2, 4)}
    with pytest.raises(PySparkException):
        ag.pair_results(left, right.filter("case_id = 'a'")).collect()
    with pytest.raises(PySparkException):
        ag.pair_results(left.filter("case_id = 'a'"), right).collect()
    with pytest.raises(PySparkException):
        ag.pair_results(left.filter("case_id = 'a'"), right).count()
    with pytest.raises(PySparkException):
        ag.pair_results(left, right.union(right)).select("x").collect()
    with pytest.raises(PySparkException):
        ag.pair_results(left.union(left), right.union(right)).count()


def test_no_shuffle_of_case_text(cases, rules):
    plan = po.match_rules(cases.repartition(4), rules)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert joins and "SortMergeJoin" not in plan and "CartesianProduct" not in plan


def test_a_hundred_thousand_terms(spark):
    """Long terms, terms that begin alike, and one text in a third of the cases."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghij0123") for _ in range(n))
    stem = word(14)
    rules = [
        ("v1", f"R{i:05d}", "t", "REJECT", [word(rng.randint(5, 16)) for _ in range(5)], "text", "fix", i) for i in range(20_000)
    ]
    rules += [("v1", f"S{i}", "t", "REJECT", [stem + word(6)], "text", "fix", 20_000 + i) for i in range(200)]
    texts = [word(400) for _ in range(30)]
    for i in range(30):
        at = rng.randrange(300)
        terms = [rng.choice(rules)[4][0], rng.choice(rules[-200:])[4][0]]
        texts[i] = texts[i][:at] + " " + terms[0].upper() + "-" + terms[1][:9] + "." + terms[1][9:] + texts[i][at:]
    texts = [t if i % 3 else texts[0] for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rules, "version string, rule_id string, topic string, action string, terms array<string>, text string, remediation string, ordinal int").repartition(8)
    table = spark.createDataFrame([(i, "v1", t) for i, t in enumerate(texts)], "case_id int, policy_version string, content string")
    matched = po.match_rules(table, frame)
    rows = {r.case_id: r for r in matched.collect()}
    for i, t in enumerate(texts):
        plain = normal(t)
        hits = [(sum(term in plain for term in r[4]), r[1]) for r in rules]
        first = next((rule for n, rule in hits if n), None)
        best = max(hits, key=lambda h: h[0])
        assert (rows[i].first_rule.rule_id, rows[i].best_rule.rule_id, rows[i].best_rule.hits) == (first, best[1], best[0])


def test_heads_are_exact_and_blocks_do_not_cut_them(monkeypatch):
    from gavelspark.operators import term_index as ti

    everything = ti.HeadFilter(64, np.full(8, 255, np.uint8), frozenset({1, 3, 12}), 12)
    text = "a0z" * 30
    whole = [(s, int(i), int(h)) for s, at, hs in ti.heads_in(text, everything) for i, h in zip(at, hs)]
    monkeypatch.setattr(ti, "BLOCK", 7)
    cut = [(s, int(i), int(h)) for s, at, hs in ti.heads_in(text, everything) for i, h in zip(at, hs)]
    assert sorted(whole) == sorted(cut) and len(whole) == 90 + 88 + 79
    assert len({h for _, _, h in whole}) == len({text[i : i + s] for s, i, _ in whole})
    assert list(ti.heads_in("", everything)) == []


def test_texts_of_a_batch_are_searched_together():
    """Each text at once took a call of every step for each of its sizes of heads."""
    import pyarrow as pa

    from gavelspark.operators import term_index as ti

    texts = ["Wine, WINE", None, "w-i-n", "", "E win", "é Wi|ne", "x" * 50 + "wine"]
    digits, ends = ti.normal_digits(pa.array(["left out", *texts])[1:])
    plain = [normal(t or "") for t in texts]
    assert ti.CHARACTERS[digits].tobytes().decode() == "".join(plain) and np.diff(ends, prepend=0).tolist() == list(map(len, plain))
    number = lambda word: sum((ord(c) - 86) * ti.BASE**i for i, c in enumerate(reversed(word)))
    begins = np.zeros(ti.BASE**3, bool)
    begins[number("win")] = True
    wanted = ti.HeadFilter(64, np.full(8, 255, np.uint8), frozenset({3, 4}), 4, 3, begins)
    found = sorted((int(t), size, int(h)) for size, of, _, heads in ti.heads_of(digits, ends, wanted) for t, h in zip(of, heads))
    expected = sorted(
        (t, size, number(text[i : i + size]))
        for t, text in enumerate(plain) for i in range(len(text)) for size in (3, 4)
        if text[i:].startswith("win") and len(text) >= i + size
    )
    assert found == expected and len(found) == 10
