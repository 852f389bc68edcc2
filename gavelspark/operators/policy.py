"""Policy retrieval: match cases against versioned lexical rules and decide.

Each text is folded once and never shuffled. Inside its task the positions of its normal form
where a term can begin are found with a bitmap of all terms' heads (``operators.term_index``); those are joined
with the terms by an equi-join, verified and reduced to the rules that match. The plan is the
same for ten terms and for ten million: nothing is broadcast but the bitmap of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.functions.text import folded_sql, normal_sql
from gavelspark.operators.term_index import HEAD, MOST_BITS, head_filter, head_number, term_starts
from gavelspark.schemas import ALLOW, ESCALATE
from gavelspark.sources.storage import stage

# Confidence of a verdict, with and without evidence and without a match.
MATCHED_WITH_EVIDENCE = 0.88
MATCHED_WITHOUT_EVIDENCE = 0.68
UNMATCHED = 0.82
INSUFFICIENT_EVIDENCE = 0.5

System = Callable[[DataFrame, DataFrame], DataFrame]


def rules_of(rules: DataFrame, version: str) -> DataFrame:
    return rules.filter(F.col("version") == version)


def with_normal_terms(rules: DataFrame) -> DataFrame:
    """Normalize the terms. One that becomes empty would match every text: refuse it."""
    return rules.withColumn(
        "terms",
        F.expr(
            f"""transform(transform(terms, t -> struct(t as raw, {normal_sql('t')} as plain)),
                t -> if(length(t.plain) > 0, t.plain,
                        raise_error(concat('rule term has no letter or digit: ', t.raw))))"""
        ),
    )


RULE = ["rule_id", "version", "action", "text", "remediation", "ordinal"]


def matching_rules(asked: DataFrame, rules: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The rules found in folded texts: ``version``, ``digest``, ``first_rule``,
    ``best_rule``, for each of ``asked`` (``versions``, ``digest``, ``content``) that has one.

    ``first_rule`` is the first in declaration order, ``best_rule`` the one with the most terms
    found, declaration order breaking a tie; each has its number of terms found in ``hits``.
    ``most_bits`` bounds the bitmap of heads; with fewer bits more positions are joined in vain.
    """
    order = ["ordinal", "rule_id", "action", "text", "remediation"]
    numbered = stage(
        # numbers that ascend in declaration order, over partitions as well
        with_normal_terms(rules).orderBy(*order).withColumn("number", F.monotonically_increasing_id())
    )
    terms = stage(
        numbered.select("version", "number", F.posexplode("terms").alias("position", "term")).withColumn(
            "head", head_number("term")
        )
    )
    starts = term_starts(asked, head_filter(terms.select("head", "term"), most_bits), "content")
    starts = starts.select(F.explode("versions").alias("asked"), "digest", F.col("head").alias("found"), "rest")
    whole = F.length("term") <= HEAD
    pairs = starts.join(
        terms,
        (F.col("asked") == F.col("version"))
        & (F.col("found") == F.col("head"))
        & (whole | F.startswith(F.col("rest"), F.col("term"))),
    )
    # copies of a text fall together before anything is dealt by text; one exchange then
    # serves both groupings
    counted = (
        pairs.select("version", "digest", "number", "position")
        .distinct()
        .repartition("digest")
        .groupBy("version", "digest", "number")
        .agg(F.count("*").cast("int").alias("hits"))
        .groupBy("version", "digest")
        .agg(
            F.min(F.struct("number", "hits")).alias("first"),
            F.min(F.struct((-F.col("hits")).alias("less"), "number")).alias("best"),
        )
        .select(
            "version", "digest", "first.number", F.col("first.hits").alias("first_hits"),
            F.col("best.number").alias("best_number"), (-F.col("best.less")).alias("best_hits"),
        )
    )
    rule = numbered.drop("terms")
    best = rule.withColumnRenamed("number", "best_number").select(
        "best_number", F.struct(*RULE).alias("best_rule")
    )
    first = rule.select("number", F.struct(*RULE).alias("first_rule"))
    return counted.join(first, "number").join(best, "best_number").select(
        "version",
        "digest",
        F.col("first_rule").withField("hits", F.col("first_hits")).alias("first_rule"),
        F.col("best_rule").withField("hits", F.col("best_hits")).alias("best_rule"),
    )


def match_rules(
    cases: DataFrame,
    rules: DataFrame,
    *,
    content: str = "content",
    version: str = "policy_version",
    pinned_version: str | None = None,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """Add ``first_rule`` and ``best_rule`` (null without a match) to every case.

    ``pinned_version`` adds ``pinned_rule``: the first match under that one version,
    whatever version the case names. Rules with the same ordinal are ordered by id, action,
    text and remedy. A case without text or version matches nothing. Matches belong to a
    version and a digest of the text, so case ids may repeat, and a text that many cases share
    is matched by its digest. The matches are written to the shared folder;
    the cases are joined with them without being moved as long as the matches are small.
    """
    digest = F.unhex(F.sha2(F.col(content), 256))
    versions = F.array(F.col(version), *([] if pinned_version is None else [F.lit(pinned_version)]))
    asked = cases.select(
        F.array_distinct(F.array_compact(versions)).alias("versions"),
        digest.alias("digest"),
        F.expr(folded_sql(content)).alias("content"),  # the index deletes the rest itself
    )
    hits = stage(matching_rules(asked, rules, most_bits))
    own = hits.select(F.col("version").alias("_version"), F.col("digest").alias("_exact"), "first_rule", "best_rule")
    matched = cases.withColumn("_digest", digest).join(
        own, (F.col(version) == F.col("_version")) & (F.col("_digest") == F.col("_exact")), "left"
    )
    answers = ["first_rule", "best_rule"]
    if pinned_version is not None:
        pinned = hits.where(F.col("version") == pinned_version).select(
            F.col("digest").alias("_pinned_digest"), F.col("first_rule").alias("pinned_rule")
        )
        matched = matched.join(pinned, F.col("_digest") == F.col("_pinned_digest"), "left")
        answers.append("pinned_rule")
    return matched.select(*cases.columns, *answers)


def verdict(rule: str, *, with_evidence: bool, check_evidence: bool = False) -> Column:
    """Result struct of a matched rule column (null: nothing restricted was found)."""
    return F.expr(verdict_sql(rule, with_evidence=with_evidence, check_evidence=check_evidence))


def verdict_sql(rule: str, *, with_evidence: bool, check_evidence: bool = False) -> str:
    none = "cast(array() as array<string>)"
    evidence = f"if({rule} is null, {none}, array({rule}.text))" if with_evidence else none
    sure = MATCHED_WITH_EVIDENCE if with_evidence else MATCHED_WITHOUT_EVIDENCE
    result = f"""struct(
        coalesce({rule}.action, '{ALLOW}') as decision,
        {rule}.rule_id as policy,
        if({rule} is null, 'No restricted policy topic was detected.',
           concat('The content matches ', {rule}.rule_id, ' under policy ', {rule}.version, '.')) as reason,
        {evidence} as evidence,
        if({rule} is null, {UNMATCHED}D, {sure}D) as confidence,
        {rule}.remediation as remediation,
        coalesce({rule}.action = '{ESCALATE}', false) as review_required)"""
    return require_evidence_sql(result) if check_evidence else result


def require_evidence_sql(result: str) -> str:
    """A policy without evidence becomes an escalation for review."""
    return f"""transform(array({result}), r -> if(r.policy is not null and size(r.evidence) = 0,
        struct('{ESCALATE}' as decision, r.policy as policy,
               'A rule matched, but policy evidence was insufficient.' as reason,
               r.evidence as evidence, {INSUFFICIENT_EVIDENCE}D as confidence,
               r.remediation as remediation, true as review_required),
        r))[0]"""


def require_evidence(result: str) -> Column:
    return F.expr(require_evidence_sql(result))


def _decided(matched: DataFrame, rule: str, cases: DataFrame, **options) -> DataFrame:
    return matched.select(
        *cases.columns, verdict(rule, **options).alias("_result")
    ).select(*cases.columns, "_result.*")


def static_policy(cases: DataFrame, rules: DataFrame, version: str = "v1") -> DataFrame:
    """First matching rule of one frozen policy version; cites no evidence."""
    matched = match_rules(cases, rules, pinned_version=version)
    return _decided(matched, "pinned_rule", cases, with_evidence=False)


def versioned_policy(cases: DataFrame, rules: DataFrame) -> DataFrame:
    """First matching rule of the version each case names."""
    return _decided(match_rules(cases, rules), "first_rule", cases, with_evidence=True)


def ranked_policy(cases: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule with the most matching terms, then the evidence check."""
    return _decided(
        match_rules(cases, rules), "best_rule", cases, with_evidence=True, check_evidence=True
    )


BUILT_IN_SYSTEMS: dict[str, System] = {
    "static_policy": static_policy,
    "versioned_policy": versioned_policy,
    "ranked_policy": ranked_policy,
}


def decide_all(cases: DataFrame, rules: DataFrame, pinned_version: str = "v1", **options) -> DataFrame:
    """The three built-in systems in one pass over the cases, one row per case and system."""
    matched = match_rules(cases, rules, pinned_version=pinned_version, **options)

    answers = [
        ("static_policy", verdict_sql("pinned_rule", with_evidence=False)),
        ("versioned_policy", verdict_sql("first_rule", with_evidence=True)),
        ("ranked_policy", verdict_sql("best_rule", with_evidence=True, check_evidence=True)),
    ]
    entries = ", ".join(f"struct('{name}' as system, {result} as result)" for name, result in answers)
    return matched.select(*cases.columns, F.expr(f"inline(array({entries}))")).select(
        *cases.columns, "system", "result.*"
    )


def run_systems(cases: DataFrame, rules: DataFrame, systems: Mapping[str, System]) -> DataFrame:
    """Any named systems: functions of (cases, rules) that return the decided cases."""
    combined = None
    for name, system in systems.items():
        answer = system(cases, rules).withColumn("system", F.lit(name))
        combined = answer if combined is None else combined.unionByName(answer)
    if combined is None:
        raise ValueError("at least one system is required")
    return combined
