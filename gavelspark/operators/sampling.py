"""Repeatable samples and review packs.

A sample is a bottom-k by a salted SHA-256 of the row id: exact in size, uniform, and the
same on any cluster. Rows are ranked by that hash, then by id, then by a digest of the whole
row; null ids come last. So repeated and null ids are chosen row by row, and only copies that
are equal in every column are interchangeable. Ranking carries hash, id and digest alone; the
wide columns are fetched afterwards for the chosen rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The blind case columns and the empty annotation columns.
BLIND_COLUMNS = ("case_id", "policy_version", "slice_name", "language", "content")
ANNOTATION_COLUMNS = {
    "annotated_decision": "string",
    "annotated_rule_id": "string",
    "supporting_passage": "string",
    "reason": "string",
    "remediation": "string",
    "review_required": "boolean",
    "annotation_confidence": "double",
    "ambiguity_note": "string",
}


def hash_order(key: Column, seed: int | None = None) -> Column:
    text = key.cast("string")
    return F.sha2(text if seed is None else F.concat(F.lit(f"{seed}:"), text), 256)


def _tagged(frame: DataFrame, key: str, seed: int | None) -> DataFrame:
    return frame.withColumns(
        {"_hash": hash_order(F.col(key), seed), "_digest": F.xxhash64(*(F.col(f"`{c}`") for c in frame.columns))}
    )


def _order(key: str) -> list[Column]:
    return [F.col("_hash").asc_nulls_last(), F.col(key), F.col("_digest")]


def _fetched(tagged: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``tagged`` that ``chosen`` names by hash and digest, each as often as named.

    Equal rows fall together to one before they are dealt, and its copies are made afterwards:
    a row that makes up a third of the table costs no task more than others.
    """
    name = [F.coalesce("_hash", F.lit("")).alias("_h"), F.col("_digest").alias("_d")]
    wanted = chosen.select(*name).groupBy("_h", "_d").agg(F.count("*").cast("int").alias("_n"))
    rows = tagged.withColumn("_h", F.coalesce("_hash", F.lit(""))).withColumn("_d", F.col("_digest"))
    return (
        rows.join(wanted, ["_h", "_d"])
        .dropDuplicates(["_h", "_d"])
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
        .drop("_h", "_d", "_n", "_copy", "_hash", "_digest")
    )


def smallest_hashes(frame: DataFrame, key: str, size: int, seed: int | None = None) -> DataFrame:
    """The ``size`` first rows in hash order."""
    tagged = _tagged(frame, key, seed)
    return _fetched(tagged, tagged.select("_hash", key, "_digest").orderBy(*_order(key)).limit(size))


def sample_exact(
    frame: DataFrame, size: int, *, key: str, seed: int = 42, order_by: str | None = None
) -> DataFrame:
    """Exactly ``size`` rows in source order (``order_by``); fewer source rows is an error."""
    if size <= 0:
        raise ValueError("sample size must be positive")
    if frame.select(key).limit(size).count() < size:
        raise ValueError("source is smaller than the requested sample")
    return sample_at_most(frame, size, key=key, seed=seed).orderBy(order_by or key)


def sample_at_most(frame: DataFrame, size: int | None, *, key: str, seed: int = 42) -> DataFrame:
    """Down-sample only when there are more than ``size`` rows; ``None`` keeps all."""
    return smallest_hashes(frame, key, size, seed) if size else frame


def hash_top(frame: DataFrame, size: int, *, key: str, check: bool = True) -> DataFrame:
    """The first ``size`` rows in hash order; ``check`` requires that many."""
    if check and (size < 1 or frame.select(key).limit(size).count() < size):
        raise ValueError("size must fit within the source")
    return smallest_hashes(frame, key, size)


def _ranked(frame: DataFrame, by: str, order: list[Column], size: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return frame.withColumn("_rank", rank).filter(F.col("_rank") <= size).drop("_rank")


def first_per_slice(frame: DataFrame, size: int, *, by: str = "slice_name", order_by: str = "case_id") -> DataFrame:
    """First rows of each slice in the given order, ties by a digest of the row. Each task
    keeps its own first rows before the shuffle, and only slice, order and digest travel; a
    dominant slice moves no more than a small one."""
    tagged = _tagged(frame, order_by, None)
    thin = tagged.select(by, order_by, "_hash", "_digest")
    return _fetched(tagged, _ranked(thin, by, [F.col(order_by).asc_nulls_last(), F.col("_digest")], size))


def hash_per_slice(frame: DataFrame, size: int, *, by: str = "slice_name", key: str = "case_id") -> DataFrame:
    """First rows of each slice in hash order, ties by id and digest of the row."""
    if size < 1:
        raise ValueError("rows per slice must be positive")
    tagged = _tagged(frame, key, None)
    thin = tagged.select(by, key, "_hash", "_digest")
    return _fetched(tagged, _ranked(thin, by, _order(key), size))


def first_rows(frame: DataFrame, size: int, *, order_by: str) -> DataFrame:
    """First rows by an order column, nulls last. Each task hands on its own first rows only."""
    return frame.orderBy(F.col(order_by).asc_nulls_last()).limit(size)


def seeded_shuffle(frame: DataFrame, *, key: str, seed: int = 42) -> DataFrame:
    """Repeatable random order; a range-partitioned distributed sort."""
    return frame.orderBy(hash_order(F.col(key), seed), F.col(key))


def distinct_slices(frame: DataFrame, *, by: str = "slice_name") -> DataFrame:
    return frame.select(by).distinct().orderBy(by)


def blind(cases: DataFrame) -> DataFrame:
    """Case columns a reviewer may see, plus the empty columns to fill in."""
    return cases.select(
        *BLIND_COLUMNS, *(F.lit(None).cast(kind).alias(name) for name, kind in ANNOTATION_COLUMNS.items())
    )


def audit_sheet(cases: DataFrame, *, reviewer_role: str = "project_author") -> DataFrame:
    empty = ("model_decision", "reference_decision", "error_category", "error_notes")
    return cases.select(
        "case_id",
        F.lit(reviewer_role).alias("reviewer_role"),
        *(F.lit(None).cast("string").alias(name) for name in empty),
    )


DIGEST_WORDS = 8


def content_digest(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with ``sha256``, a digest of a table's content whatever the order of its rows.

    Each row has a SHA-256; its eight 32-bit words are summed over all rows, and the digest is
    that of the number of rows and the sums. Sums merge, so no task sees more than its part.
    Null and the empty text differ.
    """
    values = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in columns]
    rows = frame.select(F.sha2(F.concat_ws("|", *values), 256).alias("_row"))
    words = [F.conv(F.substring("_row", 8 * i + 1, 8), 16, 10).cast("long") for i in range(DIGEST_WORDS)]
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *(F.coalesce(F.sum(w.cast("decimal(38,0)")), F.lit(0)).alias(f"_{i}") for i, w in enumerate(words)),
    )
    parts = [F.col("n").cast("string"), *(F.col(f"_{i}").cast("string") for i in range(DIGEST_WORDS))]
    return sums.select(F.sha2(F.concat_ws(":", *parts), 256).alias("sha256"))


def pilot_manifest(
    selected: DataFrame, *, per_slice: int, reviewers: int, source: DataFrame | None = None
) -> DataFrame:
    """What a pilot consists of. ``source`` is a frame with the source's ``sha256`` in one row."""
    digest = F.lit(None).cast("string") if source is None else source.select("sha256").scalar()
    return selected.agg(F.count(F.lit(1)).alias("cases")).select(
        F.lit("unpaid_volunteer_pilot").alias("purpose"),
        "cases",
        F.lit(per_slice).alias("cases_per_slice"),
        F.lit(reviewers).alias("reviewers_required"),
        F.lit("none").alias("compensation"),
        F.lit(False).alias("human_reviews_completed"),
        digest.alias("source_sha256"),
    )
