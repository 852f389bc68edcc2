"""Streaming operators, run over the tables as streams until their input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavelspark.functions.decisions import Thresholds
from gavelspark.operators import drift as dr
from gavelspark.registry import ORACLES, QUERIES, registered
from gavelspark.registry import decisions as _decisions  # noqa: F401  their queries are used below
from gavelspark.registry import metrics as _metrics  # noqa: F401
from gavelspark.registry.fixtures import cte, fixture
from gavelspark.sources.readers import file_manifest, stream_table, table, unpaired_files
from gavelspark.streaming import moderation as mo
from gavelspark.streaming import monitoring as mn
from gavelspark.streaming.runner import latest_available, write_available

FORMAT = "yyyy-MM-dd HH:mm:ss"


def _at(column: str):
    return F.date_format(column, FORMAT).alias(column)


def sql_at(expression: str, name: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S') as {name}"


def log_columns(events):
    decision = (
        F.when(F.col("event_type") == "purchase", "REJECT")
        .when(F.col("event_type") == "click", "ESCALATE")
        .otherwise("ALLOW")
    )
    return events.select(
        "event_id",
        "ts",
        F.when(F.col("event_type") == "error", 503).otherwise(200).alias("status"),
        F.col("value").alias("latency_ms"),
        decision.alias("decision"),
        F.col("event_type").alias("bin"),
    )


def log_stream(spark, folder):
    return log_columns(stream_table(spark, folder, "events"))


@registered(
    "streamed_counts",
    cte("request_log")
    + "select decision, count(*) as requests, round(avg(latency_ms), 6) as mean_latency_ms from request_log group by 1",
)
def streamed_counts(spark, folder):
    counts = latest_available(mo.running_counts(log_stream(spark, folder)), "counts", ["decision"])
    return counts.withColumn("mean_latency_ms", F.round("mean_latency_ms", 6))


@registered(
    "streamed_window_counts",
    cte("request_log")
    + f"""select {sql_at("time_bucket(interval '1 hour', ts)", 'window_start')}, decision, count(*) as n, round(sum(latency_ms), 4) as latency_sum
from request_log group by all""",
)
def streamed_window_counts(spark, folder):
    windows = mo.windowed_counts(log_stream(spark, folder), width="1 hour", latency="latency_ms")
    return latest_available(windows, "window-counts", ["window_start", "decision"]).select(
        _at("window_start"), "decision", "n", F.round("latency_sum", 4).alias("latency_sum")
    )


THRESHOLDS = Thresholds(0.6, 0.5, 0.2)


def _request_scores(documents):
    """Stand-in scores from the document id."""
    weights = [(F.col("doc_id") * 7) % 40 + 1, (F.col("doc_id") * 13) % 45 + 1, (F.col("doc_id") * 17) % 50 + 1]
    total = (weights[0] + weights[1] + weights[2]).cast("double")
    return documents.select(
        "doc_id",
        "text",
        F.col("source").alias("content_reference"),
        *((w / total).alias(c) for w, c in zip(weights, ("p_allow", "p_escalate", "p_reject"))),
    )


@registered(
    "moderated_stream",
    """with w as (select *, (doc_id * 7) % 40 + 1 as a, (doc_id * 13) % 45 + 1 as e, (doc_id * 17) % 50 + 1 as r from documents),
p as (select *, a / cast(a + e + r as double) as pa, r / cast(a + e + r as double) as pr, greatest(a, e, r) / cast(a + e + r as double) as top,
             length(text) between 1 and 20000 and length(source) between 1 and 500 as accepted from w)
select doc_id, substr(sha256(text), 1, 16) as case_id, accepted,
       case when not accepted then null when pr >= 0.5e0 then 'REJECT' when pa >= 0.6e0 and pr <= 0.2e0 then 'ALLOW' else 'ESCALATE' end as decision,
       case when accepted then round(top, 9) end as confidence, 'm' as model_id,
       accepted and not (pr >= 0.5e0) and not (pa >= 0.6e0 and pr <= 0.2e0) as review_required from p""",
)
def moderated_stream(spark, folder):
    requests = _request_scores(stream_table(spark, folder, "documents"))
    decided = write_available(mo.moderate(requests, model_id="m", thresholds=THRESHOLDS), "moderated")
    return decided.select(
        "doc_id", "case_id", "accepted", "decision", F.round("confidence", 9).alias("confidence"),
        "model_id", "review_required",
    )


def review_columns(events):
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("c"), "user_id", F.lit("-"), F.col("event_id") % 20).alias("case_id"),
        F.when(F.col("event_type").isin("view", "click"), "enqueue").otherwise("resolve").alias("kind"),
        F.when(F.col("event_type") == "purchase", "REJECT")
        .when(F.col("event_type") == "error", "ALLOW")
        .when(F.col("event_type") == "signup", "ESCALATE")
        .alias("reviewer_decision"),
        F.concat(F.lit("ref-"), "event_id").alias("content_reference"),
        F.concat(F.lit("m"), F.col("user_id") % 3).alias("model_id"),
        F.when(F.col("event_type") == "click", "REJECT")
        .when(F.col("event_type") == "view", "ESCALATE")
        .alias("proposed_decision"),
    )


QUEUE = (
    cte("review_events")[:-1]
    + """, opened as (select case_id, ts, seq, content_reference, model_id, proposed_decision from review_events where kind = 'enqueue' qualify row_number() over (partition by case_id order by ts, seq) = 1),
closed as (select r.case_id, r.reviewer_decision from review_events r join opened o on r.case_id = o.case_id
           where r.kind = 'resolve' and (r.ts > o.ts or (r.ts = o.ts and r.seq > o.seq))
           qualify row_number() over (partition by r.case_id order by r.ts, r.seq) = 1),
totals as (select case_id, count(*) as n from review_events group by 1),
queue as (select t.case_id, case when o.case_id is null then 'unknown' when c.case_id is null then 'pending' else 'resolved' end as status, o.content_reference, o.model_id, o.proposed_decision, c.reviewer_decision,
          n - case when o.case_id is null then 0 else 1 end - case when c.case_id is null then 0 else 1 end as rejected_events
   from totals t left join opened o on t.case_id = o.case_id left join closed c on t.case_id = c.case_id)
"""
)


@registered("review_queue", QUEUE + "select * from queue where status <> 'unknown'")
def review_queue(spark, folder):
    """The queue from the table of events."""
    return mo.review_queue(review_columns(table(spark, folder, "events")))


@registered("streamed_review_queue", QUEUE + "select * from queue")
def streamed_review_queue(spark, folder):
    """Events arrive as a stream, each one twice; the log keeps one copy."""
    events = review_columns(stream_table(spark, folder, "events"))
    redelivered = events.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    log = write_available(mo.review_log(redelivered), "review-log")
    return mo.review_queue(log, keep_unknown=True)


@registered("pending_reviews", QUEUE + "select count(*) filter (status = 'pending') as pending from queue")
def pending_reviews(spark, folder):
    return mo.pending_count(mo.review_queue(review_columns(table(spark, folder, "events"))))


def _reference_counts(spark, folder):
    drift = fixture(spark, folder, "drift")
    return drift.filter(F.col("population") == "reference").select("bin", "n")


@registered(
    "drift_by_window",
    cte("drift")[:-1]
    + f""", windows as (select date_trunc('day', ts) as w, event_type as bin, count(*) as n from events group by 1, 2),
days as (select distinct w from windows), names as (select bin from drift where population = 'reference' union select bin from windows),
bins as (select d.w, b.bin, coalesce(x.n, 0) as observed, coalesce(r.n, 0) as reference from days d cross join names b
         left join windows x on x.w = d.w and x.bin = b.bin left join drift r on r.bin = b.bin and r.population = 'reference'),
rates as (select w, greatest(cast(reference as double) / sum(reference) over (partition by w), 1e-6) as r,
                 greatest(cast(observed as double) / sum(observed) over (partition by w), 1e-6) as o from bins)
select {sql_at('w', 'window_start')}, round(sum((o - r) * ln(o / r)), 9) as psi,
       case when sum((o - r) * ln(o / r)) >= 0.25 then 'block' when sum((o - r) * ln(o / r)) >= 0.1 then 'warn' else 'ok' end as verdict
from rates group by w""",
)
def drift_by_window(spark, folder):
    windows = mo.windowed_counts(log_stream(spark, folder), width="1 day", by="bin")
    counts = latest_available(windows, "drift-windows", ["window_start", "bin"])
    psi = mn.drift_by_window(counts, _reference_counts(spark, folder))
    return psi.select(_at("window_start"), F.round("psi", 9).alias("psi"), "verdict")


# Four times the events' values are latencies on both sides of the limit.
SCALE = 4


@registered(
    "latency_breaches",
    f"""select {sql_at("time_bucket(interval '15 minutes', ts)", 'window_start')}, count(*) as n, count(*) filter (value * {SCALE} > {mn.P95_LIMIT_MS}) as over,
       quantile_cont(value * {SCALE}, 0.95) > {mn.P95_LIMIT_MS} as breached
from events group by 1""",
)
def latency_breaches(spark, folder):
    log = log_stream(spark, folder).withColumn("latency_ms", F.col("latency_ms") * SCALE)
    seen = latest_available(mn.latency_windows(log), "latency-windows", ["window_start"])
    return mn.latency_breaches(seen).select(_at("window_start"), "n", "over", "breached")


# An incident: a month of events within an hour, the first third of it an outage in which
# clicks fail too, then healthy traffic.
BASE, FASTER = 1_704_067_200_000_000, 720
INCIDENT = f"""incident as (
  select make_timestamp({BASE} + (epoch_us(ts) - {BASE}) // {FASTER}) as ts,
         case when event_type in ('error', 'click') and ts < timestamp '2024-01-11 00:00:00' then 503 else 200 end as status
  from events)"""


def incident(events):
    failed = F.col("event_type").isin("error", "click") & (F.col("ts") < F.lit("2024-01-11 00:00:00").cast("timestamp"))
    return events.select(
        F.expr(f"timestamp_micros({BASE} + (unix_micros(cast(ts as timestamp)) - {BASE}) div {FASTER})").alias("ts"),
        F.when(failed, 503).otherwise(200).alias("status"),
    )


@registered(
    "error_alarms",
    f"""with {INCIDENT}, m as (select date_trunc('minute', ts) as minute from incident where status >= 500 group by 1 having count(*) >= {mn.ERRORS_PER_MINUTE})
select {sql_at('a.minute', 'alarm_at')} from m a join m b on a.minute = b.minute + interval 1 minute""",
)
def error_alarms(spark, folder):
    log = incident(stream_table(spark, folder, "events"))
    minutes = latest_available(mn.error_minutes(log), "error-minutes", ["minute"])
    return mn.error_alarms(minutes).select(_at("alarm_at"))


def _rollback_sql(calm: bool) -> str:
    backlog, budget, ceiling, psi, p95 = LIMITS[calm]
    asked = {n: ORACLES[n] for n in ("decision_metrics", "stability_index", "pending_reviews")}
    return f"""with flags as (
  select 'backlog over capacity' as reason, (select pending > {backlog} from ({asked["pending_reviews"]}) q) as triggered
  union all select 'disagreement over budget', (select count(*) filter (value > 20 and value <= 20.5) + count(*) filter (value > 50 and value <= 52) from events) > {budget} * (select count(*) from events)
  union all select 'drift', (select psi >= {psi} from ({asked["stability_index"]}) q)
  union all select 'false acceptance over ceiling', (select false_acceptance_rate > {ceiling} from ({asked["decision_metrics"]}) q)
  union all select 'model hash not verified', {str(not calm).lower()}
  union all select 'p95 latency', exists (select 1 from (select quantile_cont(value * {SCALE}, 0.95) as p from events group by time_bucket(interval '15 minutes', ts)) q where p > {p95}))
select bool_or(triggered) as roll_back, coalesce(string_agg(case when triggered then reason end, ',' order by reason), '') as reasons from flags"""


# Backlog, canary budget, false-acceptance ceiling, PSI and P95 limit: the runbook's own, and
# limits beyond everything the tables hold, at which no trigger may fire.
LIMITS = {
    False: (10, dr.CANARY_BUDGET, 0.025, dr.PSI_BLOCK, mn.P95_LIMIT_MS),
    True: (10**12, 1.0, 1.0, 1e9, 1e12),
}


def _rollback(spark, folder, calm: bool):
    from gavelspark.registry.decisions import _canary_pairs

    backlog, budget, ceiling, psi, p95 = LIMITS[calm]
    events = table(spark, folder, "events")
    actual = file_manifest(spark, f"{folder}/events.parquet")
    recorded = actual if calm else actual.withColumn("sha256", F.reverse("sha256"))
    log = log_columns(events).withColumn("latency_ms", F.col("latency_ms") * SCALE)
    latency = mn.latency_breaches(mn.latency_windows(log, limit=p95), limit=p95)
    return mn.rollback_verdict(
        [
            mn.trigger(QUERIES["pending_reviews"](spark, folder), "backlog over capacity", F.col("pending") > backlog),
            mn.trigger(dr.canary_report(_canary_pairs(spark, folder), budget=budget), "disagreement over budget", ~F.col("passed")),
            mn.trigger(QUERIES["stability_index"](spark, folder), "drift", F.col("psi") >= psi),
            mn.trigger(QUERIES["decision_metrics"](spark, folder), "false acceptance over ceiling", F.col("false_acceptance_rate") > ceiling),
            mn.trigger(unpaired_files(recorded, actual), "model hash not verified", F.lit(True)),
            mn.trigger(latency, "p95 latency", F.col("breached")),
        ]
    )


@registered("rollback_verdict", _rollback_sql(calm=False))
def rollback_verdict(spark, folder):
    """All six triggers at the runbook's limits, the recorded hash altered."""
    return _rollback(spark, folder, calm=False)


@registered("rollback_not_needed", _rollback_sql(calm=True))
def rollback_not_needed(spark, folder):
    """The same triggers where none may fire."""
    return _rollback(spark, folder, calm=True)
