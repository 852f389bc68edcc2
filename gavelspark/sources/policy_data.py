"""The versioned policy table and the policy-case generator."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelspark.functions import text as tx
from gavelspark.schemas import ALLOW, ESCALATE, REJECT, RULE_SCHEMA
from gavelspark.sources.storage import spread_small

# The policy table, in declaration order.
POLICY_TERMS = {
    "P-ALC": ("alcohol", ("wine", "beer", "whisky")),
    "P-GAM": ("gambling", ("casino", "bet", "jackpot")),
    "P-MED": ("medical", ("cure", "treatment", "diagnosis")),
}
POLICY_RULES = (
    ("v1", "P-ALC", ALLOW, "Alcohol advertising is allowed when it does not target minors.", "Remove youth targeting."),
    ("v2", "P-ALC", REJECT, "Paid alcohol promotion is prohibited.", "Remove the alcohol promotion."),
    ("v3", "P-ALC", ESCALATE, "Alcohol references require review unless clearly educational.", "Clarify the educational context."),
    ("v1", "P-GAM", REJECT, "Gambling promotion is prohibited.", "Remove gambling promotion and incentives."),
    ("v2", "P-GAM", ESCALATE, "Licensed gambling content requires human review.", "Add licensing and age-gating details."),
    ("v3", "P-GAM", REJECT, "Gambling promotion and referral incentives are prohibited.", "Remove the gambling offer."),
    ("v1", "P-MED", ESCALATE, "Medical efficacy claims require substantiation review.", "Add evidence and remove guarantees."),
    ("v2", "P-MED", REJECT, "Guaranteed medical outcomes are prohibited.", "Replace the guarantee with a supported claim."),
    ("v3", "P-MED", ESCALATE, "Medical claims require review for evidence and risk disclosure.", "Add evidence and risk disclosure."),
)

# Slices, versions, languages and label budgets of generated cases.
SLICES = ("standard", "policy_shift", "long_context", "multilingual", "adversarial", "low_resource")
VERSIONS = ("v1", "v2", "v3")
LANGUAGES = ("en", "es", "fr", "hi")
LABEL_BUDGETS = (8, 32, 128, 256)
NEUTRAL_EVERY = 5


def policy_rules(spark: SparkSession) -> DataFrame:
    columns = {name: [] for name in RULE_SCHEMA.fieldNames()}
    for ordinal, (version, rule_id, action, text, remedy) in enumerate(POLICY_RULES):
        topic, terms = POLICY_TERMS[rule_id]
        row = (version, rule_id, topic, action, list(terms), text, remedy, ordinal)
        for name, value in zip(columns, row):
            columns[name].append(value)
    # An Arrow table becomes a local relation, whose small size the planner knows.
    return spark.createDataFrame(pa.table(columns), RULE_SCHEMA)


def _literals(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def policy_cases(
    indices: DataFrame,
    rules: DataFrame,
    *,
    index: str = "index",
    slices: tuple[str, ...] = SLICES,
    versions: tuple[str, ...] = VERSIONS,
    id_prefix: str = "PC",
) -> DataFrame:
    """One labelled case per index, slice and policy version.

    ``indices`` sets the size: ``spark.range(20)`` gives the small frozen set, a key
    column of a table gives as many cases as the table has rows. The rules of one
    version rotate with the index, their terms too; every fifth case is neutral.
    """
    by_version = rules.groupBy(F.col("version").alias("policy_version")).agg(
        F.sort_array(
            F.collect_list(F.struct("ordinal", "rule_id", "action", "terms", "remediation"))
        ).alias("_rules")
    )
    i = F.col("_i")
    cells = (
        spread_small(indices.select(F.col(index).cast("long").alias("_i")), "_i")
        .select("_i", F.posexplode(_literals(slices)).alias("_s", "slice_name"))
        .select("_i", "_s", "slice_name", F.posexplode(_literals(versions)).alias("_v", "policy_version"))
        .join(by_version, "policy_version")
        .withColumn("_rule", F.get("_rules", (i % F.size("_rules")).cast("int")))
        .withColumn("_term", F.get("_rule.terms", (i % F.size("_rule.terms")).cast("int")))
    )
    neutral = i % NEUTRAL_EVERY == NEUTRAL_EVERY - 1
    slice_is = {name: F.col("slice_name") == name for name in SLICES}
    language = F.when(
        slice_is["multilingual"], F.get(_literals(LANGUAGES), (i % len(LANGUAGES)).cast("int"))
    ).otherwise(F.lit("en"))
    base = tx.base_text(F.col("_term"), i)
    content = (
        F.when(neutral, tx.neutral_text(i))
        .when(slice_is["long_context"], tx.long_context(base))
        .when(slice_is["multilingual"], tx.translated(F.col("_term"), language))
        .when(slice_is["adversarial"], tx.adversarial(base, F.col("_term")))
        .otherwise(base)
    )
    return cells.select(
        F.format_string(f"{id_prefix}-%02d-%02d-%03d", "_s", "_v", i).alias("case_id"),
        "policy_version",
        "slice_name",
        language.alias("language"),
        content.alias("content"),
        F.when(neutral, F.lit(ALLOW)).otherwise(F.col("_rule.action")).alias("expected_decision"),
        F.when(~neutral, F.col("_rule.rule_id")).alias("expected_rule_id"),
        F.when(~neutral, F.col("_rule.remediation")).alias("expected_remediation"),
        F.when(
            slice_is["low_resource"],
            F.get(_literals(LABEL_BUDGETS), (i % len(LABEL_BUDGETS)).cast("int")),
        ).alias("label_budget"),
    )
