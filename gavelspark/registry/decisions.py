"""Decisions from class probabilities, thresholds and the threshold search."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from gavelspark.functions import decisions as dc
from gavelspark.operators import drift as dr
from gavelspark.operators import model as md
from gavelspark.operators import thresholds as th
from gavelspark.registry import registered
from gavelspark.registry.fixtures import cte, fixture
from gavelspark.sources.readers import table

CHOSEN = dc.Thresholds(0.6, 0.3, 0.2)
OTHER = dc.Thresholds(0.75, 0.25, 0.1)


def sql_threshold(t: dc.Thresholds, pa: str = "p_allow", pr: str = "p_reject") -> str:
    return (
        f"case when {pr} >= {t.reject_minimum!r}e0 then 'REJECT' when {pa} >= {t.allow_minimum!r}e0 "
        f"and {pr} <= {t.reject_cap!r}e0 then 'ALLOW' else 'ESCALATE' end"
    )


ARGMAX = (
    "case when p_allow >= greatest(p_escalate, p_reject) then 'ALLOW' "
    "when p_escalate >= p_reject then 'ESCALATE' else 'REJECT' end"
)
P = ("p_allow", "p_escalate", "p_reject")


def probabilities():
    return [F.col(c) for c in P]


@registered(
    "threshold_decisions",
    cte("scored")
    + f"""select label, {sql_threshold(CHOSEN)} as decision, {sql_threshold(OTHER)} as stricter, count(*) as n
from scored group by all""",
)
def threshold_decisions(spark, folder):
    pa, _, pr = probabilities()
    return (
        fixture(spark, folder, "scored")
        .select(
            "label",
            dc.threshold_decision(pa, pr, CHOSEN).alias("decision"),
            dc.threshold_decision(pa, pr, OTHER).alias("stricter"),
        )
        .groupBy("label", "decision", "stricter")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@registered(
    "decisions_with_and_without_thresholds",
    cte("scored")
    + f"""select {ARGMAX} as argmax, {sql_threshold(CHOSEN)} as chosen, {sql_threshold(OTHER)} as mapped, count(*) as n
from scored group by all""",
)
def decisions_with_and_without_thresholds(spark, folder):
    mapping = {"allow_minimum": 0.75, "reject_minimum": 0.25, "reject_cap": 0.1}
    return (
        fixture(spark, folder, "scored")
        .select(
            dc.decide(*probabilities()).alias("argmax"),
            dc.decide(*probabilities(), CHOSEN).alias("chosen"),
            dc.decide(*probabilities(), mapping).alias("mapped"),
        )
        .groupBy("argmax", "chosen", "mapped")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@registered(
    "confidences",
    cte("scored")
    + f"""select label, {sql_threshold(CHOSEN)} as decision, count(*) as n,
       round(avg(greatest(p_allow, p_escalate, p_reject)), 6) as mean_top,
       round(avg(case {sql_threshold(CHOSEN)} when 'ALLOW' then p_allow when 'ESCALATE' then p_escalate else p_reject end), 6) as mean_chosen,
       min(greatest(p_allow, p_escalate, p_reject)) as lowest_top
from scored group by 1, 2""",
)
def confidences(spark, folder):
    pa, pe, pr = probabilities()
    decision = dc.threshold_decision(pa, pr, CHOSEN)
    return (
        fixture(spark, folder, "scored")
        .select(
            "label",
            decision.alias("decision"),
            dc.top_probability(pa, pe, pr).alias("top"),
            dc.chosen_probability(decision, pa, pe, pr).alias("chosen"),
        )
        .groupBy("label", "decision")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.avg("top"), 6).alias("mean_top"),
            F.round(F.avg("chosen"), 6).alias("mean_chosen"),
            F.min("top").alias("lowest_top"),
        )
    )


@registered(
    "reordered_probabilities",
    cte("scored")
    + """select label, count(*) as n, round(sum(p_allow), 4) as allow_sum, round(sum(p_escalate), 4) as escalate_sum,
       round(sum(p_reject), 4) as reject_sum from scored group by 1""",
)
def reordered_probabilities(spark, folder):
    """Classes arrive in another order, which differs from row to row."""
    pa, pe, pr = probabilities()
    flipped = F.col("threat")
    classes = F.when(flipped, F.array(F.lit("REJECT"), F.lit("ALLOW"), F.lit("ESCALATE"))).otherwise(
        F.array(F.lit("ESCALATE"), F.lit("REJECT"), F.lit("ALLOW"))
    )
    values = F.when(flipped, F.array(pr, pa, pe)).otherwise(F.array(pe, pr, pa))
    return (
        fixture(spark, folder, "scored")
        .select("label", *dc.reorder_probabilities(classes, values))
        .groupBy("label")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.sum("p_allow"), 4).alias("allow_sum"),
            F.round(F.sum("p_escalate"), 4).alias("escalate_sum"),
            F.round(F.sum("p_reject"), 4).alias("reject_sum"),
        )
    )


@registered(
    "user_predictor",
    """select doc_id, case when length(text) % 10 >= 7 then 'REJECT' when length(text) % 10 <= 3 then 'ALLOW' else 'ESCALATE' end as decision
from documents""",
)
def user_predictor(spark, folder):
    """A user's model, called with batches of texts."""

    def by_length(texts: pd.Series) -> pd.DataFrame:
        last = texts.str.len() % 10
        reject = (last >= 7).astype(float)
        allow = (last <= 3).astype(float)
        return pd.DataFrame({"p_allow": allow, "p_escalate": 1 - allow - reject, "p_reject": reject})

    scored = md.predict_with(table(spark, folder, "documents"), by_length)
    return md.with_decision(scored).select("doc_id", "decision")


# ---- threshold search -------------------------------------------------------------

SLICES = ("threat", "insult", "obscene")


def slices():
    return {name: F.col(name) for name in SLICES}


def _grid_sql() -> str:
    rows = []
    for a in th.ALLOW_MINIMA:
        for r in th.REJECT_MINIMA:
            for c in th.REJECT_CAPS:
                rows.append(f"({len(rows)}, {a!r}e0, {r!r}e0, {c!r}e0)")
    return f"(values {', '.join(rows)}) as g(candidate, allow_minimum, reject_minimum, reject_cap)"


def _f1_sql(label: str) -> str:
    return (
        f"coalesce(2.0e0 * count(*) filter (label = '{label}' and d = '{label}') / "
        f"nullif(count(*) filter (label = '{label}') + count(*) filter (d = '{label}'), 0), 0.0e0)"
    )


def _far_sql(extra: str = "true") -> str:
    return (
        f"cast(count(*) filter (label = 'REJECT' and d = 'ALLOW' and {extra}) as double) / "
        f"nullif(count(*) filter (label = 'REJECT' and {extra}), 0)"
    )


# Brute force: every row against every candidate.
GRID_SQL = (
    cte("scored")[:-1]
    + f""",
judged as (
  select candidate, allow_minimum, reject_minimum, reject_cap, label, threat, insult, obscene,
         case when p_reject >= reject_minimum then 'REJECT' when p_allow >= allow_minimum and p_reject <= reject_cap then 'ALLOW' else 'ESCALATE' end as d
  from scored cross join {_grid_sql()}),
rated as (
  select cast(candidate as bigint) as candidate, allow_minimum, reject_minimum, reject_cap,
         {_far_sql()} as false_acceptance_rate,
         {", ".join(f"{_far_sql(s)} as {s}_false_acceptance_rate" for s in SLICES)},
         ({_f1_sql('ALLOW')} + {_f1_sql('ESCALATE')} + {_f1_sql('REJECT')}) / 3.0e0 as macro_f1,
         cast(count(*) filter (d = 'ESCALATE') as double) / count(*) as escalation_rate
  from judged group by all),
table_ as (
  select *, coalesce(greatest(false_acceptance_rate, {", ".join(f"{s}_false_acceptance_rate" for s in SLICES)}), 0) <= 0.05 as feasible
  from rated)
"""
)


@registered("threshold_candidates", GRID_SQL + "select * from table_")
def threshold_candidates(spark, folder):
    table_ = th.candidate_table(fixture(spark, folder, "scored"), slices(), 0.05)
    return table_.withColumn("candidate", F.col("candidate").cast("long"))


@registered(
    "threshold_search",
    GRID_SQL
    + """select * exclude (feasible), (select count(*) from table_ where feasible) as feasible_candidates
from table_ where feasible order by macro_f1 desc, escalation_rate, candidate limit 1""",
)
def threshold_search(spark, folder):
    chosen = th.select_thresholds(fixture(spark, folder, "scored"), slices(), 0.05)
    return chosen.withColumn("candidate", F.col("candidate").cast("long"))


@registered(
    "feasible_candidates",
    GRID_SQL + "select feasible, count(*) as candidates, max(macro_f1) as best_macro_f1 from table_ group by 1",
)
def feasible_candidates(spark, folder):
    return (
        th.candidate_table(fixture(spark, folder, "scored"), slices(), 0.05)
        .groupBy("feasible")
        .agg(F.count(F.lit(1)).alias("candidates"), F.max("macro_f1").alias("best_macro_f1"))
    )


# ---- shadow, canary, drift, latency -------------------------------------------------


def decision_pairs(spark, folder):
    pa, _, pr = probabilities()
    return fixture(spark, folder, "scored").select(
        dc.threshold_decision(pa, pr, CHOSEN).alias("production"),
        dc.threshold_decision(pa, pr, OTHER).alias("candidate"),
    )


PAIRS = cte("scored")[:-1] + f", pairs as (select {sql_threshold(CHOSEN)} as production, {sql_threshold(OTHER)} as candidate from scored)\n"


@registered(
    "shadow_report",
    PAIRS
    + """select count(*) as rows, cast(count(*) filter (production = candidate) as double) / count(*) as agreement_rate,
       cast(count(*) filter (production = 'ESCALATE') as double) / count(*) as production_review_rate,
       cast(count(*) filter (candidate = 'ESCALATE') as double) / count(*) as candidate_review_rate from pairs""",
)
def shadow_report(spark, folder):
    return dr.shadow_report(decision_pairs(spark, folder))


@registered(
    "shadow_transitions",
    PAIRS + "select production || '->' || candidate as transition, count(*) as n from pairs group by 1",
)
def shadow_transitions(spark, folder):
    return dr.transitions(decision_pairs(spark, folder))


CANARY = """
with stable as (select event_id, value as stable_latency_ms, case when value > 50 then 'REJECT' when value > 20 then 'ESCALATE' else 'ALLOW' end as stable from events),
canary as (select event_id, value * 1.1 + event_id % 7 as canary_latency_ms, case when value > 52 then 'REJECT' when value > 20.5 then 'ESCALATE' else 'ALLOW' end as canary from events),
pairs as (select * from stable join canary using (event_id))
"""


def _canary_pairs(spark, folder):
    events = table(spark, folder, "events")

    def decided(high, middle):
        return F.when(F.col("value") > high, "REJECT").when(F.col("value") > middle, "ESCALATE").otherwise("ALLOW")

    stable = events.select("event_id", F.col("value").alias("stable_latency_ms"), decided(50, 20).alias("stable"))
    canary = events.select(
        "event_id",
        (F.col("value") * 1.1 + F.col("event_id") % 7).alias("canary_latency_ms"),
        decided(52, 20.5).alias("canary"),
    )
    return stable.join(canary, "event_id")


@registered(
    "canary_report",
    CANARY
    + """select count(*) as rows, cast(count(*) filter (stable <> canary) as double) / count(*) as disagreement_rate,
       round(quantile_cont(stable_latency_ms, 0.95), 6) as stable_p95_latency_ms,
       round(quantile_cont(canary_latency_ms, 0.95), 6) as canary_p95_latency_ms,
       cast(count(*) filter (stable <> canary) as double) / count(*) <= 0.05 as passed from pairs""",
)
def canary_report(spark, folder):
    report = dr.canary_report(_canary_pairs(spark, folder))
    return report.withColumns(
        {c: F.round(c, 6) for c in ("stable_p95_latency_ms", "canary_p95_latency_ms")}
    )


@registered(
    "canary_transitions",
    CANARY + "select stable || '->' || canary as transition, count(*) as n from pairs group by 1",
)
def canary_transitions(spark, folder):
    return dr.transitions(_canary_pairs(spark, folder), left="stable", right="canary")


def _populations(spark, folder):
    drift = fixture(spark, folder, "drift")
    # A bin that only one side has.
    missing = (F.col("population") == "reference") & (F.col("bin") == "purchase")
    drift = drift.withColumn("bin", F.when(missing, "gift").otherwise(F.col("bin")))
    side = {p: drift.filter(F.col("population") == p).select("bin", "n") for p in ("reference", "observed")}
    return side["reference"], side["observed"]


BINS = (
    cte("drift")[:-1]
    + """, named as (select population, case when population = 'reference' and bin = 'purchase' then 'gift' else bin end as bin, n from drift),
bins as (select bin, cast(coalesce(sum(n) filter (population = 'reference'), 0) as bigint) as reference,
                cast(coalesce(sum(n) filter (population = 'observed'), 0) as bigint) as observed from named group by 1)
"""
)


@registered("aligned_bins", BINS + "select * from bins")
def aligned_bins(spark, folder):
    return dr.aligned_bins(*_populations(spark, folder))


PSI = """rates as (select {keys} greatest(cast(reference as double) / sum(reference) over (partition by {part}), 1e-6) as r,
                greatest(cast(observed as double) / sum(observed) over (partition by {part}), 1e-6) as o from {bins})
select {keys} round(sum((o - r) * ln(o / r)), 9) as psi,
       case when sum((o - r) * ln(o / r)) >= 0.25 then 'block' when sum((o - r) * ln(o / r)) >= 0.1 then 'warn' else 'ok' end as verdict
from rates {group}"""


@registered("stability_index", BINS.rstrip() + ",\n" + PSI.format(keys="", part="1", bins="bins", group=""))
def stability_index(spark, folder):
    psi = dr.stability_index(dr.aligned_bins(*_populations(spark, folder)))
    return psi.withColumn("psi", F.round("psi", 9))


@registered(
    "latency_report",
    cte("request_log")
    + """select count(*) as requests, cast(count(*) filter (status = 200) as double) / count(*) as success_rate,
       round(quantile_cont(latency_ms, 0.5), 6) as p50, round(quantile_cont(latency_ms, 0.95), 6) as p95, round(quantile_cont(latency_ms, 0.99), 6) as p99,
       cast(count(*) filter (status = 200) as double) / count(*) >= 0.99 as passed from request_log""",
)
def latency_report(spark, folder):
    report = dr.latency_report(fixture(spark, folder, "request_log"))
    return report.withColumns({c: F.round(c, 6) for c in ("p50", "p95", "p99")})


@registered(
    "decision_distribution",
    cte("request_log")
    + "select decision, count(*) as requests, round(avg(latency_ms), 6) as mean_latency_ms from request_log group by 1",
)
def decision_distribution(spark, folder):
    counts = dr.decision_distribution(fixture(spark, folder, "request_log"))
    return counts.withColumn("mean_latency_ms", F.round("mean_latency_ms", 6))
