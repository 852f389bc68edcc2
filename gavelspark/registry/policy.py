"""Policy retrieval and the policy evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelspark.functions import text as tx
from gavelspark.functions.decisions import result_contract
from gavelspark.operators import agreement as ag
from gavelspark.operators import policy as po
from gavelspark.plans.policy_evaluation import evaluate_decisions, evaluate_policies
from gavelspark.registry import registered
from gavelspark.registry.fixtures import cte, fixture
from gavelspark.registry.text import sql_normal, sql_string
from gavelspark.sources import policy_data as pd
from gavelspark.sources.readers import table
from gavelspark.sources.storage import spread_small


def document_rules(spark, folder):
    """The fixture's (version, rule, term) rows as a rule table."""
    first = F.min("ordinal").alias("ordinal")
    return (
        fixture(spark, folder, "doc_rules")
        .groupBy("version", "rule_id")
        .agg(first, F.sort_array(F.collect_list("term")).alias("terms"))
        .select(
            "version", "rule_id", F.lit("words").alias("topic"),
            F.when(F.col("ordinal") == 1, "REJECT").otherwise("ESCALATE").alias("action"),
            "terms",
            F.concat(F.lit("Rule "), "rule_id", F.lit(" of "), "version").alias("text"),
            F.concat(F.lit("Fix "), "rule_id").alias("remediation"),
            F.col("ordinal").cast("int").alias("ordinal"),
        )
    )


def document_cases(spark, folder):
    documents = spread_small(table(spark, folder, "documents"), "doc_id")
    return documents.select(
        F.concat(F.lit("D-"), "doc_id").alias("case_id"),
        F.col("lang").alias("policy_version"),
        F.col("source").alias("slice_name"),
        F.col("text").alias("content"),
    )


# Matches of documents and rules in plain SQL: version, or pinned to one version.
MATCHES = f"""
norms as (select doc_id, lang, {sql_normal('text')} as norm from documents),
hits as (select n.doc_id, r.rule_id, r.version, r.ordinal, count(distinct r.term) as hits
         from norms n join doc_rules r on n.lang = r.version and contains(n.norm, r.term) group by all),
pinned_hits as (select n.doc_id, r.rule_id, r.version, r.ordinal, count(distinct r.term) as hits
         from norms n join doc_rules r on r.version = 'en' and contains(n.norm, r.term) group by all),
first_rule as (select * from hits qualify row_number() over (partition by doc_id order by ordinal) = 1),
best_rule as (select * from hits qualify row_number() over (partition by doc_id order by hits desc, ordinal) = 1),
pinned_rule as (select * from pinned_hits qualify row_number() over (partition by doc_id order by ordinal) = 1)
"""


def sql_verdict(rule: str, evidence: bool) -> str:
    confidence = 0.88 if evidence else 0.68
    return f"""
select 'D-' || d.doc_id as case_id,
       case when r.rule_id is null then 'ALLOW' when r.ordinal = 1 then 'REJECT' else 'ESCALATE' end as decision,
       r.rule_id as policy,
       case when r.rule_id is null then 'No restricted policy topic was detected.'
            else 'The content matches ' || r.rule_id || ' under policy ' || r.version || '.' end as reason,
       {"case when r.rule_id is null then '' else 'Rule ' || r.rule_id || ' of ' || r.version end" if evidence else "''"} as evidence,
       cast(case when r.rule_id is null then 0.82 else {confidence} end as double) as confidence,
       'Fix ' || r.rule_id as remediation,
       r.rule_id is not null and r.ordinal = 2 as review_required
from documents d left join {rule} r on d.doc_id = r.doc_id"""


def _flat(decided):
    return decided.select(
        "case_id", "decision", "policy", "reason", F.array_join("evidence", "|").alias("evidence"),
        "confidence", "remediation", "review_required",
    )


@registered("versioned_policy", cte("doc_rules")[:-1] + "," + MATCHES + sql_verdict("first_rule", True))
def versioned_policy(spark, folder):
    return _flat(po.versioned_policy(document_cases(spark, folder), document_rules(spark, folder)))


@registered("static_policy", cte("doc_rules")[:-1] + "," + MATCHES + sql_verdict("pinned_rule", False))
def static_policy(spark, folder):
    return _flat(po.static_policy(document_cases(spark, folder), document_rules(spark, folder), "en"))


@registered("ranked_policy", cte("doc_rules")[:-1] + "," + MATCHES + sql_verdict("best_rule", True))
def ranked_policy(spark, folder):
    return _flat(po.ranked_policy(document_cases(spark, folder), document_rules(spark, folder)))


RULE_MATCHES = (
    cte("doc_rules")[:-1] + "," + MATCHES + """
select 'D-' || d.doc_id as case_id, f.rule_id as first_rule, cast(f.hits as bigint) as first_hits,
       b.rule_id as best_rule, cast(b.hits as bigint) as best_hits, p.rule_id as pinned_rule
from documents d left join first_rule f on d.doc_id = f.doc_id left join best_rule b on d.doc_id = b.doc_id
     left join pinned_rule p on d.doc_id = p.doc_id"""
)


def _matches(spark, folder, **options):
    matched = po.match_rules(
        document_cases(spark, folder), document_rules(spark, folder), pinned_version="en", **options
    )
    return matched.select(
        "case_id",
        F.col("first_rule.rule_id").alias("first_rule"),
        F.col("first_rule.hits").cast("long").alias("first_hits"),
        F.col("best_rule.rule_id").alias("best_rule"),
        F.col("best_rule.hits").cast("long").alias("best_hits"),
        F.col("pinned_rule.rule_id").alias("pinned_rule"),
    )


@registered("rule_matches", RULE_MATCHES)
def rule_matches(spark, folder):
    return _matches(spark, folder)


@registered("rule_matches_without_broadcast", RULE_MATCHES)
def rule_matches_without_broadcast(spark, folder):
    """The same with a bitmap of 4 KiB, which lets many positions pass in vain."""
    return _matches(spark, folder, most_bits=1 << 15)


@registered(
    "rules_of_version",
    cte("doc_rules")
    + """select d.doc_id, r.rule_id, cast(count(*) as bigint) as terms from documents d join doc_rules r on r.version = d.lang and r.version = 'en'
group by all""",
)
def rules_of_version(spark, folder):
    rules = po.rules_of(document_rules(spark, folder), "en")
    return table(spark, folder, "documents").join(rules, F.col("lang") == F.col("version")).select(
        "doc_id", "rule_id", F.size("terms").cast("long").alias("terms")
    )


@registered(
    "evidence_check",
    cte("doc_rules")[:-1] + "," + MATCHES + """
select 'D-' || d.doc_id as case_id,
       case when f.rule_id is null then 'ALLOW' when d.doc_id % 2 = 0 or f.ordinal = 2 then 'ESCALATE' else 'REJECT' end as decision,
       cast(case when f.rule_id is null then 0.82 when d.doc_id % 2 = 0 then 0.5 else 0.88 end as double) as confidence,
       f.rule_id is not null and (d.doc_id % 2 = 0 or f.ordinal = 2) as review_required
from documents d left join first_rule f on d.doc_id = f.doc_id""",
)
def evidence_check(spark, folder):
    """A system that loses its evidence on every other document."""
    cases = document_cases(spark, folder)
    matched = po.match_rules(cases, document_rules(spark, folder))
    result = po.verdict("first_rule", with_evidence=True)
    even = F.substring("case_id", 3, 20).cast("long") % 2 == 0
    lost = matched.withColumn("_r", result).withColumn(
        "_r", F.when(even, F.col("_r").withField("evidence", F.array().cast("array<string>"))).otherwise(F.col("_r"))
    )
    return lost.withColumn("_r", po.require_evidence("_r")).select(
        "case_id", "_r.decision", "_r.confidence", "_r.review_required"
    )


@registered(
    "result_contract",
    """select event_id, coalesce(value / 100 between 0 and 1, false) and (event_type <> 'click' or user_id % 2 = 0) as valid from events""",
)
def contract_rows(spark, folder):
    decision = F.when(F.col("event_type") == "click", "ESCALATE").otherwise("ALLOW")
    return table(spark, folder, "events").select(
        "event_id",
        result_contract(decision, F.col("value") / 100, F.col("user_id") % 2 == 0).alias("valid"),
    )


# ---- generated cases --------------------------------------------------------------


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else sql_string(v) if v else "''" for v in row) + ")" for row in rows)


def _rules_sql() -> str:
    numbered, seen = [], {}
    for ordinal, (version, rule_id, action, text, remedy) in enumerate(pd.POLICY_RULES):
        position = seen.setdefault(version, 0)
        seen[version] += 1
        terms = pd.POLICY_TERMS[rule_id][1]
        numbered.append((version, rule_id, action, text, remedy, ordinal, position, *terms))
    return f"(values {_values(numbered)}) as r(version, rule_id, action, rule_text, remedy, ordinal, position, t0, t1, t2)"


CASES_SQL = f"""
rules as (select * from {_rules_sql()}),
slices as (select * from (values {_values([(i, s) for i, s in enumerate(pd.SLICES)])}) as s(si, slice_name)),
cells as (
  select p.p_partkey as i, s.si, s.slice_name, r.*, cast(substr(r.version, 2) as int) - 1 as vi,
         case p.p_partkey % 3 when 0 then t0 when 1 then t1 else t2 end as term,
         case when s.slice_name = 'multilingual' then ['en','es','fr','hi'][1 + p.p_partkey % 4] else 'en' end as language,
         p.p_partkey % 5 = 4 as neutral
  from part p cross join slices s join rules r on r.position = p.p_partkey % 3),
texts as (select *, 'Limited-time ' || term || ' promotion for adults. Reference ' || i || '.' as base from cells),
cases as (
  select printf('PC-%02d-%02d-%03d', si, vi, i) as case_id, version as policy_version, slice_name, language,
         case when neutral then 'A neutral post about hiking boots. Reference ' || i || '.'
              when slice_name = 'long_context' then repeat('{tx.FILLER}', {tx.FILLER_REPEATS}) || base || repeat('{tx.FILLER}', {tx.FILLER_REPEATS})
              when slice_name = 'multilingual' then case language {" ".join(f"when '{c}' then {sql_string(h)} || term || {sql_string(t)}" for c, (h, t) in ((c, p.split('{term}')) for c, p in tx.LANGUAGE_PATTERNS.items()))} end
              when slice_name = 'adversarial' then replace(replace(base, term, array_to_string(string_split(term, ''), ' ')), 'promotion', 'pr0m0tion')
              else base end as content,
         case when neutral then 'ALLOW' else action end as expected_decision,
         case when not neutral then rule_id end as expected_rule_id,
         case when not neutral then remedy end as expected_remediation,
         cast(case when slice_name = 'low_resource' then [8, 32, 128, 256][1 + i % 4] end as bigint) as label_budget
  from texts)
"""


def part_cases(spark, folder):
    indices = table(spark, folder, "part").select(F.col("p_partkey").alias("index"))
    return pd.policy_cases(indices, pd.policy_rules(spark))


@registered(
    "policy_cases",
    f"with {CASES_SQL} select case_id, policy_version, slice_name, language, md5(content) as content, expected_decision, "
    "expected_rule_id, expected_remediation, label_budget from cases",
)
def policy_cases(spark, folder):
    return part_cases(spark, folder).withColumns(
        {"content": F.md5("content"), "label_budget": F.col("label_budget").cast("long")}
    )


DECIDED_SQL = f"""
{CASES_SQL},
folded as (select *, {sql_normal('content')} as norm from cases),
terms as (select version, rule_id, action, remedy, ordinal, unnest([t0, t1, t2]) as term from rules),
found as (select f.case_id, t.version, t.rule_id, t.action, t.remedy, t.ordinal, count(*) as hits
          from folded f join terms t on contains(f.norm, t.term) and t.version in ('v1', f.policy_version)
          group by all),
picks as (
  select case_id, 'static_policy' as system, rule_id, action, remedy, 0.68 as sure,
         row_number() over (partition by case_id order by ordinal) as rn
  from found where version = 'v1'
  union all
  select f.case_id, 'versioned_policy', rule_id, action, remedy, 0.88,
         row_number() over (partition by f.case_id order by ordinal)
  from found f join cases c on f.case_id = c.case_id and f.version = c.policy_version
  union all
  select f.case_id, 'ranked_policy', rule_id, action, remedy, 0.88,
         row_number() over (partition by f.case_id order by hits desc, ordinal)
  from found f join cases c on f.case_id = c.case_id and f.version = c.policy_version),
decided as (
  select c.*, s.system, coalesce(p.action, 'ALLOW') as decision, p.rule_id as policy, p.remedy as remediation,
         cast(coalesce(p.sure, 0.82) as double) as confidence
  from cases c cross join (values ('static_policy'), ('versioned_policy'), ('ranked_policy')) as s(system)
       left join picks p on p.case_id = c.case_id and p.system = s.system and p.rn = 1)
"""


def sql_metric_columns() -> str:
    def f1(label):
        return (
            f"coalesce(2.0e0 * count(*) filter (expected_decision = '{label}' and decision = '{label}') / "
            f"nullif(count(*) filter (expected_decision = '{label}') + count(*) filter (decision = '{label}'), 0), 0.0e0)"
        )

    return f"""count(*) as rows,
       cast(count(*) filter (expected_decision = decision) as double) / count(*) as accuracy,
       ({f1('ALLOW')} + {f1('ESCALATE')} + {f1('REJECT')}) / 3.0e0 as macro_f1,
       cast(count(*) filter (expected_decision = 'REJECT' and decision = 'ALLOW') as double) / nullif(count(*) filter (expected_decision = 'REJECT'), 0) as false_acceptance_rate,
       cast(count(*) filter (expected_decision = 'ALLOW' and decision = 'REJECT') as double) / nullif(count(*) filter (expected_decision = 'ALLOW'), 0) as false_rejection_rate,
       cast(count(*) filter (decision = 'ESCALATE') as double) / count(*) as escalation_rate"""


POLICY_METRICS = (
    sql_metric_columns()
    + """,
       cast(count(*) filter (expected_rule_id = policy) as double) / nullif(count(expected_rule_id), 0) as citation_accuracy,
       cast(count(*) filter (expected_remediation = remediation) as double) / nullif(count(expected_remediation), 0) as remediation_accuracy,
       round(avg(abs(confidence - case when expected_decision = decision then 1 else 0 end)), 6) as mean_absolute_calibration"""
)


def _rounded(metrics):
    return metrics.withColumn(
        "mean_absolute_calibration", F.round("mean_absolute_calibration", 6)
    ).drop("mean_latency_ms")


@registered(
    "policy_evaluation",
    f"with {DECIDED_SQL} select system, coalesce(slice_name, 'all') as slice_name, {POLICY_METRICS} "
    "from decided group by grouping sets ((system), (system, slice_name))",
)
def policy_evaluation(spark, folder):
    """Three policy systems on generated cases, overall and by slice."""
    return _rounded(evaluate_policies(part_cases(spark, folder), pd.policy_rules(spark)))


@registered(
    "policy_evaluation_by_dimension",
    f"""with {DECIDED_SQL} select system, case when grouping(slice_name) = 0 then slice_name else 'all' end as slice_name,
       case when grouping(language) = 0 then language else 'all' end as language,
       case when grouping(policy_version) = 0 then policy_version else 'all' end as policy_version,
       case when grouping(label_budget) = 0 then cast(label_budget as varchar) else 'all' end as label_budget, {POLICY_METRICS}
from decided group by grouping sets ((system), (system, slice_name), (system, language), (system, policy_version), (system, label_budget))""",
)
def policy_evaluation_by_dimension(spark, folder):
    dimensions = ("language", "policy_version", "label_budget")
    return _rounded(
        evaluate_policies(part_cases(spark, folder), pd.policy_rules(spark), dimensions=dimensions)
    )


@registered(
    "named_systems",
    cte("doc_rules")[:-1] + "," + MATCHES + """
select 'first' as system, case when r.rule_id is null then 'ALLOW' when r.ordinal = 1 then 'REJECT' else 'ESCALATE' end as decision, count(*) as cases
from documents d left join first_rule r on d.doc_id = r.doc_id group by 1, 2
union all
select 'length', case when length(text) > 1000 then 'ESCALATE' else 'ALLOW' end, count(*) from documents group by 1, 2""",
)
def named_systems(spark, folder):
    """A user's system next to a built-in one."""

    def by_length(cases, rules):
        return cases.withColumn(
            "decision", F.when(F.length("content") > 1000, "ESCALATE").otherwise("ALLOW")
        ).select("case_id", "decision")

    def first(cases, rules):
        return po.versioned_policy(cases, rules).select("case_id", "decision")

    decided = po.run_systems(
        document_cases(spark, folder), document_rules(spark, folder), {"first": first, "length": by_length}
    )
    return decided.groupBy("system", "decision").agg(F.count(F.lit(1)).alias("cases"))


@registered(
    "paired_results",
    f"""with {DECIDED_SQL} select coalesce(slice_name, 'all') as slice_name, {sql_metric_columns()}
from decided where system = 'versioned_policy' group by rollup (slice_name)""",
)
def paired_results(spark, folder):
    """Expected and predicted decisions from two tables, paired by case id."""
    cases = part_cases(spark, folder)
    results = po.versioned_policy(cases, pd.policy_rules(spark)).select(
        "case_id", "decision", "policy", "remediation", "confidence"
    )
    paired = ag.pair_results(cases.drop("content"), results).withColumn("system", F.lit("versioned_policy"))
    keep = [
        "slice_name", "rows", "accuracy", "macro_f1", "false_acceptance_rate", "false_rejection_rate",
        "escalation_rate",
    ]
    return evaluate_decisions(paired).select(*keep)
