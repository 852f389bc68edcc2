"""Ranks and running totals over groups of any size.

Rows are dealt into ranges of an order, so a hot group is cut like any other stretch of rows;
what crosses a range's border is one row for each range and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelspark.sources.storage import stage

PART = "__part"


def in_ranges(frame: DataFrame, *order: Column) -> DataFrame:
    """``frame`` dealt into ranges of ``order`` with the range's number in ``__part``, written
    to the shared folder, so that a number never changes when a task is run again.

    Later ranges hold later rows. Rows with equal ``order`` share a range.
    """
    return stage(frame.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def values_at(frame: DataFrame, columns: Sequence[str], points: Sequence[float]) -> dict[str, list[float | None]]:
    """Linearly interpolated percentiles of several columns, exact at any size.

    Values are counted before they are ordered: equal ones become one row. Ranges of distinct
    values then carry their totals forward, and only the rows at the wanted ranks are fetched,
    two for each column and point. Nulls are left out; a column without values has no
    percentile. NaN comes after all numbers.
    """
    entries = F.inline(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns)))
    counted = frame.select(entries).where("v IS NOT NULL").groupBy("c", "v").agg(F.count("*").alias("n"))
    ranged = in_ranges(counted, F.col("c"), F.col("v"))
    parts = ranged.groupBy("c", PART).agg(F.sum("n").alias("__n"))
    earlier = Window.partitionBy("c").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        "c",
        PART,
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy("c")).alias("__total"),
    )
    within = Window.partitionBy(PART, "c").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.withColumn("__own", F.coalesce(F.sum("n").over(within), F.lit(0))).join(
        carried, ["c", PART]
    )
    start = F.col("__before") + F.col("__own")
    wanted = F.array(
        *(
            edge
            for p in points
            for edge in (
                F.floor(F.lit(p) * (F.col("__total") - 1)),
                F.ceil(F.lit(p) * (F.col("__total") - 1)),
            )
        )
    )
    hit = F.filter(wanted, lambda rank: (rank >= start) & (rank < start + F.col("n")))
    rows = (
        ranked.select("c", "v", "__total", F.explode(F.array_distinct(hit)).alias("rank")).collect()
    )  # two for each column and point at most
    found: dict[str, list[float | None]] = {}
    for c in columns:
        at = {r["rank"]: r["v"] for r in rows if r["c"] == c}
        total = next((r["__total"] for r in rows if r["c"] == c), 0)
        found[c] = []
        for p in points:
            position = p * (total - 1)
            low = int(position)
            if not total:
                found[c].append(None)
            elif position == low:
                found[c].append(at[low])
            else:
                found[c].append(at[low] + (at[low + 1] - at[low]) * (position - low))
    return found
