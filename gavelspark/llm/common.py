"""What several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelspark.operators.ranges import PART
from gavelspark.sources.storage import stage


def picked(frame: DataFrame, **columns: str | Column) -> DataFrame:
    """The named columns only, under internal names (by position: other columns of any name,
    also equal to these, play no part)."""
    return frame.select(
        *(
            (frame[source] if isinstance(source, str) else source).alias(name)
            for name, source in columns.items()
        )
    )


def documents(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


#: Rows a Python worker gets at a time where texts are long: what it holds stays small.
BATCH_ROWS = 1_000


def stage_in_batches(frame: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """``stage`` with at most ``rows`` rows in an Arrow batch, for this write only."""
    conf, name = frame.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        return stage(frame)
    finally:
        conf.set(name, before)


def running_totals(
    ranged: DataFrame, group: list[str], order: list[Column], values: dict[str, Column]
) -> DataFrame:
    """For each name in ``values`` its sum over the earlier rows of the group (0 at first).

    ``ranged`` comes from ``operators.ranges.in_ranges`` by ``group`` and ``order``. A group that spans several
    ranges is summed range by range: one row for each range and group carries the earlier
    ranges' total forward, so no task ever holds more of a group than a range has.
    """
    names = list(values)
    sums = ranged.groupBy(*group, PART).agg(
        *(F.sum(values[n]).alias(f"__sum_{n}") for n in names)
    )
    before = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        *(F.col(g).alias(f"__{g}") for g in group),
        F.col(PART).alias("__from"),
        *(F.coalesce(F.sum(f"__sum_{n}").over(before), F.lit(0)).alias(f"__carry_{n}") for n in names),
    ).where(F.greatest(*(F.col(f"__carry_{n}") for n in names), F.lit(0)) > 0)
    within = (
        Window.partitionBy(PART, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    summed = ranged.withColumns(
        {f"__own_{n}": F.coalesce(F.sum(values[n]).over(within), F.lit(0)) for n in names}
    )
    same = (F.col(PART) == F.col("__from")) & F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    joined = summed.join(carried, same, "left")
    return joined.withColumns(
        {n: F.col(f"__own_{n}") + F.coalesce(F.col(f"__carry_{n}"), F.lit(0)) for n in names}
    ).drop(
        "__from",
        *(f"__{g}" for g in group),
        *(f"__own_{n}" for n in names),
        *(f"__carry_{n}" for n in names),
    )


def as_text(key: Column) -> Column:
    """A key that null joins as well."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))
