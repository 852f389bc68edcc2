"""Metrics, error taxonomy and release gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelspark.functions import decisions as dc
from gavelspark.operators import gates as gt
from gavelspark.operators import metrics as mt
from gavelspark.plans.candidate import chosen_confidence, evidence, measure
from gavelspark.registry import registered
from gavelspark.registry.decisions import CHOSEN, SLICES, probabilities, slices, sql_threshold
from gavelspark.registry.fixtures import cte, fixture
from gavelspark.registry.policy import sql_metric_columns
from gavelspark.sources.sinks import nested_receipt
from gavelspark.sources.storage import new_folder, stage

LABELS_SQL = "(values ('ALLOW'), ('ESCALATE'), ('REJECT'))"


def decided(spark, folder):
    pa, pe, pr = probabilities()
    decision = dc.threshold_decision(pa, pr, CHOSEN)
    return fixture(spark, folder, "scored").select(
        F.col("label").alias("expected_decision"),
        *SLICES,
        decision.alias("decision"),
        dc.top_probability(pa, pe, pr).alias("top"),
        dc.chosen_probability(decision, pa, pe, pr).alias("chosen"),
    )


DECIDED = (
    cte("scored")[:-1]
    + f""", decided as (
  select *, greatest(p_allow, p_escalate, p_reject) as top,
         case decision when 'ALLOW' then p_allow when 'ESCALATE' then p_escalate else p_reject end as chosen
  from (select label as expected_decision, threat, insult, obscene, p_allow, p_escalate, p_reject, {sql_threshold(CHOSEN)} as decision from scored) s),
sliced as (select 'overall' as slice, * from decided {"".join(f" union all select '{s}', * from decided where {s}" for s in SLICES)})
"""
)


@registered(
    "confusion_matrix",
    DECIDED
    + f"""select e.x as expected, p.x as predicted, count(d.decision) as n
from {LABELS_SQL} as e(x) cross join {LABELS_SQL} as p(x) left join decided d on d.expected_decision = e.x and d.decision = p.x group by 1, 2""",
)
def confusion_matrix(spark, folder):
    return mt.confusion_matrix(mt.decision_cube(decided(spark, folder)))


REPORT = DECIDED.rstrip() + f""",
counts as (select e.x as label,
    (select count(*) from decided where expected_decision = e.x and decision = e.x) as tp,
    (select count(*) from decided where decision = e.x) as got,
    (select count(*) from decided where expected_decision = e.x) as support,
    (select count(*) from decided) as total from {LABELS_SQL} as e(x)),
per as (select label, coalesce(cast(tp as double) / nullif(got, 0), 0) as precision, coalesce(cast(tp as double) / nullif(support, 0), 0) as recall,
    coalesce(2.0e0 * tp / nullif(support + got, 0), 0) as f1_score, support, total, tp from counts)
select label, round(precision, 9) as precision, round(recall, 9) as recall, round(f1_score, 9) as f1_score, support from per
union all select 'accuracy', round(sum(tp) / cast(max(total) as double), 9), round(sum(tp) / cast(max(total) as double), 9), round(sum(tp) / cast(max(total) as double), 9), max(total) from per
union all select 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1_score), 9), max(total) from per
union all select 'weighted avg', round(sum(precision * support) / max(total), 9), round(sum(recall * support) / max(total), 9), round(sum(f1_score * support) / max(total), 9), max(total) from per
"""


@registered("classification_report", REPORT)
def classification_report(spark, folder):
    report = mt.classification_report(mt.decision_cube(decided(spark, folder)))
    return report.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1_score")})


@registered("decision_metrics", DECIDED + f"select {sql_metric_columns()} from decided")
def decision_metrics(spark, folder):
    """Macro F1, false acceptance, false rejection and escalation over all rows."""
    row = mt.metric_row(mt.decision_cube(decided(spark, folder)))
    return row.select(
        "rows", "accuracy", "macro_f1", "false_acceptance_rate", "false_rejection_rate", "escalation_rate"
    )


@registered(
    "slice_metrics",
    DECIDED
    + f"""select slice, {sql_metric_columns()},
       round(avg(abs(top - case when expected_decision = decision then 1 else 0 end)), 6) as mean_absolute_calibration from sliced group by 1""",
)
def slice_metrics(spark, folder):
    """Overall and overlapping safety slices from one pass."""
    cube = mt.decision_cube(decided(spark, folder), slices=slices(), confidence="top")
    return mt.metric_row(cube, ["slice"]).select(
        "slice", "rows", "accuracy", "macro_f1", "false_acceptance_rate", "false_rejection_rate",
        "escalation_rate", F.round("mean_absolute_calibration", 6).alias("mean_absolute_calibration"),
    )


@registered(
    "attribute_slices",
    cte("scored_comments")
    + """, labelled as (select *, case when toxicity <= 0.1 then 'ALLOW' when toxicity >= 0.5 then 'REJECT' else 'ESCALATE' end as label from scored_comments)
select slice, count(*) as rows, cast(count(*) filter (label = 'REJECT') as double) / count(*) as unsafe_share
from (select 'overall' as slice, label from labelled union all select 'threat', label from labelled where threat >= 0.5
      union all select 'insult', label from labelled where insult >= 0.5) s group by 1""",
)
def attribute_slices(spark, folder):
    """Slices by attribute score; a slice without rows has no row."""
    comments = fixture(spark, folder, "scored_comments").withColumn(
        "label", dc.score_decision(F.col("toxicity"))
    )
    cube = mt.decision_cube(
        comments, slices=mt.attribute_slices(["threat", "insult"]), expected="label", predicted="label"
    )
    counts = cube.groupBy("slice").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("expected") == "REJECT", F.col("n")).otherwise(0)).alias("_u")
    )
    return counts.select("slice", "rows", (F.col("_u") / F.col("rows")).alias("unsafe_share"))


EDGES = ", ".join(f"{e!r}e0" for e in mt.BIN_EDGES)


def _calibration_sql(confidence: str) -> str:
    return f"""
binned as (select slice, b.i as bin, count(*) as n, avg(case when expected_decision = decision then 1.0e0 else 0 end) as acc, avg({confidence}) as conf
  from sliced join (select unnest(range(1, 11)) as i) b on {confidence} > ([{EDGES}])[b.i] and {confidence} <= ([{EDGES}])[b.i + 1] group by all),
sizes as (select slice, count(*) as rows from sliced group by 1)
select s.slice, s.rows, round(coalesce(sum(n * abs(acc - conf)), 0) / s.rows, 6) as calibration_error
from sizes s left join binned b on s.slice = b.slice group by s.slice, s.rows"""


def _calibration(spark, folder, confidence):
    cube = mt.decision_cube(decided(spark, folder), slices=slices(), confidence=confidence)
    error = mt.binned_calibration_error(cube, ["slice"])
    return error.withColumn("calibration_error", F.round("calibration_error", 6))


@registered("top_calibration_error", DECIDED.rstrip() + "," + _calibration_sql("top"))
def top_calibration_error(spark, folder):
    return _calibration(spark, folder, "top")


@registered("chosen_calibration_error", DECIDED.rstrip() + "," + _calibration_sql("chosen"))
def chosen_calibration_error(spark, folder):
    return _calibration(spark, folder, "chosen")


OUTCOME = """case when expected_decision = 'REJECT' and predicted_decision = 'ALLOW' then 'false_accept'
     when expected_decision = 'ALLOW' and predicted_decision = 'REJECT' then 'false_reject'
     when predicted_decision = 'ESCALATE' then 'escalated'
     when expected_decision = predicted_decision then 'correct' else 'other_error' end"""


@registered("outcome_classes", cte("taxonomy") + f"select event_id, {OUTCOME} as outcome from taxonomy")
def outcome_classes(spark, folder):
    return fixture(spark, folder, "taxonomy").select(
        "event_id", dc.outcome_class(F.col("expected_decision"), F.col("predicted_decision")).alias("outcome")
    )


@registered(
    "error_taxonomy",
    cte("taxonomy")
    + f"""select category, outcome, count(*) as n from (
  select category_1 as category, {OUTCOME} as outcome from taxonomy where category_1 is not null
  union all select category_2, {OUTCOME} from taxonomy where category_2 is not null
  union all select 'uncategorized', {OUTCOME} from taxonomy where category_1 is null and category_2 is null
  union all select 'all records', {OUTCOME} from taxonomy) t group by all""",
)
def error_taxonomy(spark, folder):
    records = fixture(spark, folder, "taxonomy").withColumn(
        "categories", F.array_compact(F.array("category_1", "category_2"))
    )
    return mt.category_outcomes(records, total=True)


# ---- gates --------------------------------------------------------------------------


MODELS = {
    "strict": dc.Thresholds(0.95, 0.2, 0.05),
    "chosen": CHOSEN,
    "lenient": dc.Thresholds(0.5, 0.8, 0.2),
}


def metric_table(spark, folder):
    """Evidence of three threshold choices from one pass over the scored rows; one of the
    models lacks a slice. Written down, as a release gate would find it."""
    pa, _, pr = probabilities()
    choices = F.array(
        *(
            F.struct(F.lit(name).alias("model_id"), dc.threshold_decision(pa, pr, choice).alias("decision"))
            for name, choice in MODELS.items()
        )
    )
    decided = (
        fixture(spark, folder, "scored")
        .select(
            "label",
            F.col("threat").cast("double").alias("threat"),
            F.col("insult").cast("double").alias("identity_attack"),
            F.col("obscene").cast("double").alias("_explicit"),
            *probabilities(),
            F.inline(choices),
        )
        .withColumn("sexual_explicit", F.when(F.col("model_id") != "lenient", F.col("_explicit")))
        .withColumn("confidence", chosen_confidence())
    )
    return stage(
        measure(decided, split="test", attributes=["threat", "identity_attack", "sexual_explicit"])
    )


def _gate_sql() -> str:
    parts = " union all ".join(
        f"select '{m}' as model_id, label, threat, insult as identity_attack, "
        f"{'obscene' if m != 'lenient' else 'false'} as sexual_explicit, p_allow, p_escalate, p_reject, {sql_threshold(t)} as decision from scored"
        for m, t in MODELS.items()
    )
    far = "cast(count(*) filter (label = 'REJECT' and decision = 'ALLOW' and {w}) as double) / nullif(count(*) filter (label = 'REJECT' and {w}), 0)"
    checks = {
        "overall_false_acceptance_rate": far.format(w="true"),
        "overall_false_rejection_rate": "cast(count(*) filter (label = 'ALLOW' and decision = 'REJECT') as double) / nullif(count(*) filter (label = 'ALLOW'), 0)",
        "threat_false_acceptance_rate": far.format(w="threat"),
        "identity_attack_false_acceptance_rate": far.format(w="identity_attack"),
        "sexual_explicit_false_acceptance_rate": far.format(w="sexual_explicit"),
    }
    rows = " union all ".join(
        f"select model_id, '{check}' as \"check\", {sql} as value from answers group by model_id" for check, sql in checks.items()
    )
    return (
        cte("scored")[:-1]
        + f""", answers as (select *, case decision when 'ALLOW' then p_allow when 'ESCALATE' then p_escalate else p_reject end as conf from ({parts}) p),
binned as (select model_id, b.i as bin, count(*) as n, avg(case when label = decision then 1.0e0 else 0 end) as acc, avg(conf) as conf
  from answers join (select unnest(range(1, 11)) as i) b on conf > ([{EDGES}])[b.i] and conf <= ([{EDGES}])[b.i + 1] group by all),
ece as (select b.model_id, sum(n * abs(acc - conf)) / (select count(*) from scored) as value from binned b group by 1),
checks as (select model_id, "check", round(value, 6) as value, 0.05 as maximum, coalesce(value <= 0.05, false) as passed
  from ({rows} union all select model_id, 'expected_calibration_error', value from ece) r)
"""
    )


GATES = _gate_sql()


@registered("gate_checks", GATES + 'select model_id, "check", value, cast(maximum as double) as maximum, passed from checks')
def gate_checks(spark, folder):
    checks = gt.gate_checks(metric_table(spark, folder))
    return checks.withColumn("value", F.round("value", 6))


VERDICTS = """select model_id, 'civil-comments-release-v1' as policy, case when bool_and(passed) then 'approved' else 'rejected' end as decision,
       count(*) filter (not passed) as failed_checks from checks group by 1"""


@registered("comment_release", GATES + VERDICTS)
def comment_release(spark, folder):
    return gt.comment_release(metric_table(spark, folder))


def _agreement(spark, folder):
    """Review evidence per model from the annotated orders; one model has none."""
    annotators = fixture(spark, folder, "annotators")
    same = (F.col("decision_a") == F.col("decision_b")) & (F.col("rule_a") == F.col("rule_b"))
    counts = annotators.agg(F.count(F.lit(1)).alias("case_count"), F.count_if(same).alias("_same"))
    report = counts.select(
        "case_count",
        (F.col("_same") / F.col("case_count")).alias("decision_and_rule_agreement"),
        (F.col("_same") < F.col("case_count")).alias("requires_adjudication"),
    )
    models = F.explode(F.array(F.lit("strict"), F.lit("chosen"))).alias("model_id")
    return report.select(models, "*")


def _external(metrics):
    """False acceptance on an outside set; half the model's own stands in."""
    metrics = metrics.filter(
        (F.col("slice") == "overall") & (F.col("metric") == "false_acceptance_rate")
    )
    return metrics.select("model_id", (F.col("value") / 2).alias("false_acceptance_rate"))


COMPLETE = GATES.rstrip() + ", verdicts as (" + VERDICTS + "), " + cte("annotators")[5:].rstrip() + """,
review as (select count(*) as n, cast(count(*) filter (decision_a = decision_b and rule_a = rule_b) as double) / count(*) as agreement from annotators),
outside as (select model_id, value / 2 as far from (select model_id, cast(count(*) filter (label = 'REJECT' and decision = 'ALLOW') as double) / nullif(count(*) filter (label = 'REJECT'), 0) as value from answers group by 1) v),
complete as (
  select model_id, 'civil_comments_release' as "check", decision = 'approved' as passed from verdicts
  union all select model_id, 'external_shift_false_acceptance', far <= 0.1 from outside
  union all select model_id, 'independent_human_review_size', model_id <> 'lenient' and n >= 100 from verdicts, review
  union all select model_id, 'independent_human_agreement', model_id <> 'lenient' and agreement >= 0.8 from verdicts, review
  union all select model_id, 'human_disagreements_adjudicated', model_id <> 'lenient' and agreement = 1 from verdicts, review)
"""


@registered("complete_release_checks", COMPLETE + "select * from complete")
def complete_release_checks(spark, folder):
    metrics = metric_table(spark, folder)
    checks, _ = gt.complete_release(metrics, _external(metrics), _agreement(spark, folder))
    return checks.drop("value")


@registered(
    "complete_release",
    COMPLETE
    + """select model_id, 'complete-release-v1' as policy, case when bool_and(passed) then 'approved' else 'blocked' end as decision,
       count(*) filter (not passed) as failed_checks from complete group by 1""",
)
def complete_release(spark, folder):
    """The model side is the earlier verdict here, and raw metrics in the check list."""
    metrics = metric_table(spark, folder)
    earlier = gt.comment_release(metrics)
    _, verdict = gt.complete_release(earlier, _external(metrics), _agreement(spark, folder))
    return verdict


@registered(
    "public_evidence",
    COMPLETE.rstrip()
    + """, public as (
  select v.model_id, v.decision = 'approved' as a, far <= 0.1 as b, far * 2 <= 0.1 as c, v.model_id <> 'lenient' and n >= 50 and v.model_id = 'strict' as d
  from verdicts v join outside o using (model_id), review)
select model_id, 'public-evidence-v1' as policy, case when a and b and c and d then 'supported' else 'blocked' end as decision,
       cast((not a)::int + (not b)::int + (not c)::int + (not d)::int as bigint) as failed_checks from public""",
)
def public_evidence(spark, folder):
    metrics = metric_table(spark, folder)
    external = _external(metrics)
    doubled = external.withColumn("false_acceptance_rate", F.col("false_acceptance_rate") * 2)
    audit = _agreement(spark, folder).select(
        "model_id", "case_count", (F.col("model_id") == "strict").alias("complete")
    )
    _, verdict = gt.public_evidence(metrics, external, doubled, audit)
    return verdict


@registered(
    "receipt_round_trip",
    DECIDED
    + """select slice, round(macro_f1, 9) as macro_f1, false_acceptance_rate, allowed_in_error, round(allow_precision, 9) as allow_precision from (
  select slice, """
    + sql_metric_columns()
    + """, cast(count(*) filter (expected_decision = 'REJECT' and decision = 'ALLOW') as double) as allowed_in_error,
       coalesce(count(*) filter (expected_decision = 'ALLOW' and decision = 'ALLOW') / cast(nullif(count(*) filter (decision = 'ALLOW'), 0) as double), 0) as allow_precision
  from sliced group by 1) m""",
)
def receipt_round_trip(spark, folder):
    """Metrics written as nested JSON and read back."""
    scored = fixture(spark, folder, "scored").withColumns(
        {c: F.col(c).cast("double") for c in SLICES}
    )
    long = evidence(scored, model_id="m", split="test", thresholds=CHOSEN, attributes=list(SLICES))
    path = new_folder(spark, "receipt")
    nested = nested_receipt(long)
    nested.write.option("ignoreNullFields", "false").json(path)
    read = spark.read.schema(nested.schema).option("mode", "FAILFAST").json(path)
    by_slice = read.select(F.explode(F.col("evaluations")["test"]).alias("slice", "m"))
    return by_slice.select(
        "slice", F.round(F.col("m")["macro_f1"], 9).alias("macro_f1"),
        F.col("m")["false_acceptance_rate"].alias("false_acceptance_rate"),
        F.col("m")["confusion.REJECT.ALLOW"].alias("allowed_in_error"),
        F.round(F.col("m")["report.ALLOW.precision"], 9).alias("allow_precision"),
    )
