"""Runbook triggers: drift, latency, server errors and the rollback verdict.

The streaming part of each is one windowed aggregate with small, bounded state. Written with
``latest_available`` its table also has the windows that are still open; with
``write_available`` each window is appended once it closes. The rest reads that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.operators.drift import RATE_FLOOR, drift_verdict
from gavelspark.operators.quality import guarded
from gavelspark.streaming.moderation import LATE

# Latency trigger and server-error alarm.
P95_LIMIT_MS = 250.0
P95_WINDOW = "15 minutes"
ERRORS_PER_MINUTE = 5
CONSECUTIVE_MINUTES = 2
#: How late a request may arrive and still count for an alarm.
ALARM_LATE = "2 minutes"


def drift_by_window(
    counts: DataFrame, reference: DataFrame, *, window: str = "window_start", bin: str = "bin", count: str = "n"
) -> DataFrame:
    """Stability index of every window's bins against fixed reference counts.

    Every window is compared over the reference's bins and its own. What a bin adds that a
    window lacks does not depend on the window, so the sum over all reference bins is taken
    once, and each window corrects it for the bins it has: no window meets bins it has no row
    of. Negative counts and an empty population fail the query.
    """
    expected = reference.groupBy(F.col(bin).alias("_bin")).agg(F.sum(count).alias("_n"))
    total = expected.agg(F.sum("_n").alias("t"), F.min("_n").alias("least"))
    floor = F.lit(RATE_FLOOR)

    def term(r: Column, o: Column) -> Column:
        return (o - r) * F.log(o / r)

    share = expected.withColumn("_t", total.select("t").scalar()).select(
        "_bin", F.greatest(F.col("_n") / F.col("_t"), floor).alias("_r")
    )
    absent = share.agg(F.sum(term(F.col("_r"), floor)).alias("s"), F.count("*").alias("k"))
    seen = counts.groupBy(window, bin).agg(F.sum(count).alias("_seen"))
    sizes = seen.groupBy(F.col(window).alias("_w")).agg(F.sum("_seen").alias("_size"), F.min("_seen").alias("_least"))
    valid = (F.col("_size") > 0) & (F.col("_least") >= 0) & (F.col("_t") > 0) & (F.col("_t_least") >= 0)
    sizes = guarded(
        sizes.withColumns({"_t": total.select("t").scalar(), "_t_least": total.select("least").scalar()}),
        valid,
        "counts must be non-negative and each population non-empty",
    ).select("_w", "_size")
    joined = seen.join(sizes, F.col(window).eqNullSafe(F.col("_w"))).join(
        share, F.col(bin) == F.col("_bin"), "left"
    )
    o = F.greatest(F.col("_seen") / F.col("_size"), floor)
    r = F.coalesce("_r", floor)
    correction = term(r, o) - F.when(F.col("_r").isNotNull(), term(F.col("_r"), floor)).otherwise(0.0)
    psi = F.coalesce(F.col("_absent"), F.lit(0.0)) + F.col("_sum")
    return (
        joined.groupBy(window)
        .agg(F.sum(correction).alias("_sum"))
        .withColumn("_absent", absent.select("s").scalar())
        .select(window, psi.alias("psi"))
        .withColumn("verdict", drift_verdict(F.col("psi")))
    )


def latency_windows(
    log: DataFrame, *, limit: float = P95_LIMIT_MS, width: str = P95_WINDOW, ts: str = "ts",
    latency: str = "latency_ms", late: str = LATE,
) -> DataFrame:
    """Per window: requests, how many exceed the limit, and the two values next to it.

    That is enough to decide exactly whether the interpolated P95 exceeds the limit, so
    the state of a window is four numbers and not its latencies.
    """
    value = F.col(latency)
    return (
        log.withColumn("_ts", F.col(ts).cast("timestamp"))
        .withWatermark("_ts", late)
        .groupBy(F.window("_ts", width).alias("_w"))
        .agg(
            F.count(value).alias("n"),
            F.count_if(value > limit).alias("over"),
            F.max(F.when(value <= limit, value)).alias("below"),
            F.min(F.when(value > limit, value)).alias("above"),
        )
        .select(F.col("_w.start").alias("window_start"), "n", "over", "below", "above")
    )


def percentile_exceeds(
    n: Column, over: Column, below: Column, above: Column, *, limit: float, point: float = 0.95
) -> Column:
    """Whether the interpolated percentile exceeds the limit.

    ``over`` values exceed it; ``below`` is the largest that does not, ``above`` the
    smallest that does.
    """
    position = F.lit(point) * (n - 1)
    rank = F.floor(position)
    share = position - rank
    within = n - over
    return (
        F.when(rank >= within, F.lit(True))
        .when((rank + 1 < within) | (share == 0) | (over == 0), F.lit(False))
        .otherwise(below + share * (above - below) > limit)
    )


def latency_breaches(windows: DataFrame, *, limit: float = P95_LIMIT_MS) -> DataFrame:
    breached = percentile_exceeds(
        F.col("n"), F.col("over"), F.col("below"), F.col("above"), limit=limit
    )
    return windows.select("window_start", "n", "over", breached.alias("breached"))


def error_minutes(
    log: DataFrame, *, ts: str = "ts", status: str = "status", late: str = ALARM_LATE
) -> DataFrame:
    """Server errors per minute; minutes without errors have no row.

    Every request moves the watermark on, healthy ones too, so an outage is reported when
    traffic is healthy again. That is why errors are counted among all rows: a filter before
    the aggregate would let time stand still between errors.
    """
    return (
        log.withColumn("_ts", F.col(ts).cast("timestamp"))
        .withWatermark("_ts", late)
        .groupBy(F.window("_ts", "1 minute").alias("_w"))
        .agg(F.count_if(F.col(status) >= 500).alias("errors"))
        .filter(F.col("errors") > 0)
        .select(F.col("_w.start").alias("minute"), "errors")
    )


def error_alarms(
    minutes: DataFrame, *, minimum: int = ERRORS_PER_MINUTE, consecutive: int = CONSECUTIVE_MINUTES,
    width: str = "1 minute",
) -> DataFrame:
    """Minutes at which the last ``consecutive`` minutes all reached the minimum.

    A breaching minute counts for itself and the minutes after it, so the check is one
    aggregation by minute; a minute without a row does not breach.
    """
    step = F.expr(f"INTERVAL {width}")
    breaching = minutes.filter(F.col("errors") >= minimum)
    shifted = breaching.select(
        F.explode(F.array(*(F.col("minute") + step * i for i in range(consecutive)))).alias("alarm_at")
    )
    return (
        shifted.groupBy("alarm_at").agg(F.count(F.lit(1)).alias("breaching"))
        .filter(F.col("breaching") == consecutive)
        .select("alarm_at")
    )


def trigger(frame: DataFrame, reason: str, test: Column) -> DataFrame:
    """One named trigger: true when any row meets the test; no rows, no trigger."""
    return frame.agg(F.coalesce(F.bool_or(test), F.lit(False)).alias("triggered")).select(
        F.lit(reason).alias("reason"), "triggered"
    )


def rollback_verdict(triggers: list[DataFrame]) -> DataFrame:
    """Roll back when any trigger fired, with the reasons in name order."""
    combined = triggers[0]
    for more in triggers[1:]:
        combined = combined.unionByName(more)
    fired = F.sort_array(F.collect_list(F.when(F.col("triggered"), F.col("reason"))))
    return combined.agg(
        F.coalesce(F.bool_or("triggered"), F.lit(False)).alias("roll_back"),
        F.array_join(fired, ",").alias("reasons"),
    )
