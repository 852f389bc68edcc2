"""Integrity checks and valid/rejected splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_by(frame: DataFrame, contract: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the contract and rows that do not; null counts as not."""
    met = F.coalesce(contract, F.lit(False))
    return frame.filter(met), frame.filter(~met)


def guarded(frame: DataFrame, contract: Column, message: str | Column) -> DataFrame:
    """The rows themselves; one that breaks the contract fails the query.

    The check is a filter that no optimizer may drop, so it holds whichever columns are read
    afterwards, and for a mere count.
    """
    text = F.lit(message) if isinstance(message, str) else message
    failed = F.raise_error(F.coalesce(text, F.lit("a row breaks its contract"))).cast("boolean")
    return frame.filter(F.when(F.coalesce(contract, F.lit(False)), F.lit(True)).otherwise(failed))


def require(frame: DataFrame, contract: Column, message: str) -> DataFrame:
    """The rows themselves; one that breaks the contract fails the query."""
    return guarded(frame, contract, message)


def key_counts(frame: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and keys that occur more than once.

    Counted over per-key partial sums, which spreads even when one key dominates.
    """
    per_key = frame.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"),
        F.count(F.lit(1)).alias("keys"),
        F.count_if(F.col("n") > 1).alias("repeated_keys"),
    )


def require_unique(frame: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """Raise unless the ids are unique (and, if given, exactly ``rows`` many)."""
    found = key_counts(frame, key).first()
    if found["repeated_keys"] or (rows is not None and found["rows"] != rows):
        raise ValueError(
            f"expected {'unique' if rows is None else f'{rows} unique'} ids, found "
            f"{found['rows']} rows with {found['repeated_keys']} repeated ids"
        )
    return frame


def require_rows(frame: DataFrame, what: str) -> DataFrame:
    if frame.isEmpty():
        raise ValueError(f"{what} must not be empty")
    return frame


def require_labels(frame: DataFrame, label: str = "label", distinct: int = 2) -> DataFrame:
    """Raise unless the training labels have exactly this many values."""
    found = frame.select(label).distinct().limit(distinct + 1).count()
    if found != distinct:
        raise ValueError(f"training labels must have exactly {distinct} values, found {found}")
    return frame
