"""Decisions on a stream, running counts, and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelspark.functions.decisions import (
    Thresholds,
    decide,
    request_contract,
    top_probability,
)
from gavelspark.functions.text import digest_id
from gavelspark.schemas import PROBABILITY_COLUMNS
from gavelspark.sources.sinks import text_free

LATE = "1 hour"
SPLIT_EVENTS = 10_000_000


def moderate(
    requests: DataFrame,
    *,
    model_id: str,
    thresholds: Thresholds | None = None,
    text: str = "text",
    reference: str = "content_reference",
) -> DataFrame:
    """Scored requests to decisions, on a stream or a table: contract, thresholds, review
    flag. The case id is a digest of the text; every column that may hold text is dropped.
    Requests outside the
    contract come out with ``accepted`` false and no decision."""
    columns = [F.col(c) for c in PROBABILITY_COLUMNS]
    accepted = request_contract(F.col(text), F.col(reference))
    decided = requests.withColumns(
        {
            "case_id": digest_id(F.col(text)),
            "accepted": accepted,
            "decision": F.when(accepted, decide(*columns, thresholds)),
            "confidence": F.when(accepted, top_probability(*columns)),
            "model_id": F.lit(model_id),
        }
    ).withColumn("review_required", F.coalesce(F.col("decision") == "ESCALATE", F.lit(False)))
    return text_free(decided)


def running_counts(log: DataFrame, *, decision: str = "decision", latency: str = "latency_ms") -> DataFrame:
    """Requests and mean latency per decision, since the start of the stream."""
    return log.groupBy(decision).agg(
        F.count(F.lit(1)).alias("requests"),
        (F.sum(latency) / F.count(latency)).alias("mean_latency_ms"),
    )


def windowed_counts(
    log: DataFrame,
    *,
    width: str,
    by: str = "decision",
    ts: str = "ts",
    late: str = LATE,
    latency: str | None = None,
) -> DataFrame:
    """Counts (and latency sums) per tumbling window, emitted once the window is closed."""
    aggregates = [F.count(F.lit(1)).alias("n")]
    if latency:
        aggregates.append(F.sum(latency).alias("latency_sum"))
    return (
        log.withColumn("_ts", F.col(ts).cast("timestamp"))
        .withWatermark("_ts", late)
        .groupBy(F.window("_ts", width).alias("_w"), F.col(by).alias(by))
        .agg(*aggregates)
        .select(F.col("_w.start").alias("window_start"), by, "n", *(["latency_sum"] if latency else []))
    )


# ---- review queue ----------------------------------------------------------------


def enqueue_events(decided: DataFrame, *, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Queue entries for decisions that need a review; metadata only."""
    return decided.filter("review_required").select(
        F.col(seq).alias("seq"),
        F.col(ts).alias("ts"),
        "case_id",
        F.lit("enqueue").alias("kind"),
        "content_reference",
        "model_id",
        F.col("decision").alias("proposed_decision"),
        F.lit(None).cast("string").alias("reviewer_decision"),
        F.lit(None).cast("string").alias("reviewer_id"),
    )


def review_log(events: DataFrame, *, ts: str = "ts", seq: str = "seq", late: str = LATE) -> DataFrame:
    """The stream of review events without redeliveries, to be appended to a table.

    Deduplication state is dropped once the watermark has passed; the queue itself lives
    in the table, because a case may be resolved at any later time.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, late).dropDuplicatesWithinWatermark([seq])


def review_queue(log: DataFrame, *, ts: str = "ts", seq: str = "seq", keep_unknown: bool = False) -> DataFrame:
    """State of every case after its events in (ts, seq) order.

    The first enqueue opens a case, the first later resolve closes it, everything else is
    rejected. Both steps are minima with partial aggregation, so no case's history is
    collected, however long it is. A case shows what its first enqueue says about it (content
    reference, model, proposed decision) and what its closing says. The join between them spreads a case with very many
    events over several tasks.
    """
    # Stated here as well, so that the joins below infer nothing new and the aggregation is
    # shuffled once for its three uses.
    log = log.filter(F.col("case_id").isNotNull())
    at = _order_key(log, ts, seq)
    entered = F.when(F.col("kind") == "enqueue", at)
    entry = [c for c in ("content_reference", "model_id", "proposed_decision") if c in log.columns]
    first = [F.min_by(F.struct(*entry), entered).alias("_entry")] if entry else []
    opened = log.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("events"), F.min(entered).alias("opened"), *first
    )
    answer = [c for c in ("reviewer_decision", "reviewer_id") if c in log.columns]
    closings = log.filter(F.col("kind") == "resolve").select(
        "case_id", at.alias("_at"), F.xxhash64(seq).alias("_spread"), *answer
    )
    # At most one case in SPLIT_EVENTS events is this long, which bounds the broadcast.
    long_cases = opened.filter(F.col("events") > SPLIT_EVENTS).select(
        "case_id", F.when(F.col("opened").isNotNull(), _parts()).alias("_parts")
    )
    closings = closings.join(F.broadcast(long_cases), "case_id", "left").withColumn(
        "_part", F.expr("if(_parts is null, 0, int(pmod(_spread, _parts)))")
    )
    openings = opened.filter(F.col("opened").isNotNull()).select(
        "case_id",
        "opened",
        F.explode(F.sequence(F.lit(0), F.when(F.col("events") > SPLIT_EVENTS, _parts() - 1).otherwise(0))).alias("_part"),
    )
    closed = (
        closings.join(openings, ["case_id", "_part"])
        .filter(F.col("_at") > F.col("opened"))
        .groupBy("case_id")
        .agg(F.min(F.struct("_at", *answer)).alias("_closed"))
    )
    state = opened.join(closed, "case_id", "left")
    if not keep_unknown:
        state = state.filter(F.col("opened").isNotNull())
    status = (
        F.when(F.col("opened").isNull(), "unknown")
        .when(F.col("_closed").isNull(), "pending")
        .otherwise("resolved")
    )
    return state.select(
        "case_id",
        status.alias("status"),
        *(F.col(f"_entry.{c}").alias(c) for c in entry),
        *(F.col(f"_closed.{c}").alias(c) for c in answer),
        (
            F.col("events")
            - F.col("opened").isNotNull().cast("long")
            - F.col("_closed").isNotNull().cast("long")
        ).alias("rejected_events"),
    )


def _order_key(log: DataFrame, ts: str, seq: str) -> Column:
    """One value that orders like (ts, seq). For whole-number sequences it is a decimal,
    which a hash aggregation can hold; a pair would have to be sorted."""
    if not isinstance(log.schema[seq].dataType, T.IntegralType):
        return F.struct(F.col(ts).alias("ts"), F.col(seq).alias("seq"))
    return F.expr(
        f"""cast(unix_micros(cast({ts} as timestamp)) as decimal(17, 0)) * 20000000000000000000BD
            + cast({seq} as decimal(20, 0)) + 9223372036854775808BD"""
    )


def _parts() -> Column:
    return (F.col("events") / SPLIT_EVENTS).cast("int") + 1


def pending_count(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count_if(F.col("status") == "pending").alias("pending"))
