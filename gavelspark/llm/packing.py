"""Packing into length buckets that minimise padding, and token-budget batches inside them.

A histogram of all lengths, no longer than the longest sequence, is all that is gathered. On it
dynamic programming finds the bucket boundaries with the least padding there is. Inside a bucket
every sequence is padded to the boundary, so a batch takes as many as the token budget holds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.llm.common import picked, running_totals
from gavelspark.operators.ranges import in_ranges
from gavelspark.sources.storage import stage


def best_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """At most ``buckets`` boundaries, ascending, for which padding every length up to the next
    boundary adds the fewest tokens; of equally good choices the one with smaller boundaries.

    The cheapest cover of the first j lengths by k buckets is the least, over the place of the
    last boundary but one, of the cheapest cover before it and one bucket more.
    """
    lengths = np.array(sorted(n for n in histogram if n > 0), dtype=np.int64)
    if not len(lengths):
        return []
    n = len(lengths)
    counts = np.concatenate([[0], np.cumsum([histogram[int(v)] for v in lengths])])
    best = lengths * counts[1:]  # cost of covering lengths 0..j by one bucket
    chosen = [np.full(n, -1)]
    for _ in range(min(buckets, n) - 1):
        following, place = best.copy(), np.full(n, -1)
        for j in range(1, n):
            cost = best[:j] + lengths[j] * (counts[j + 1] - counts[1 : j + 1])
            i = int(np.argmin(cost))
            if cost[i] < following[j]:
                following[j], place[j] = cost[i], i
        best = following
        chosen.append(place)
    found, j = [], n - 1
    for place in reversed(chosen):
        if j >= 0 and (place[j] >= 0 or place is chosen[0]):
            found.append(int(lengths[j]))
            j = int(place[j])
    return found[::-1]


def packed(
    docs: DataFrame,
    length: Column,
    longest: int = 2048,
    budget: int = 65_536,
    buckets: int = 16,
    key: str = "doc_id",
) -> DataFrame:
    """``key``, ``piece`` (from 0), ``first_token``, ``n_tokens``, ``bucket``, ``batch``, ``slot``.

    ``length`` is the number of tokens of a row of ``docs``. A row longer than ``longest`` is
    cut into pieces of that length and a rest: nothing is dropped. ``bucket`` is the length a
    piece is padded to. ``batch`` numbers the batches of a bucket: pieces in the order of a hash
    of key and piece, ``budget`` tokens with their padding, all full but the bucket's last; a
    batch has one piece at least. A row without tokens (null, 0 or less) is kept as a piece of
    no tokens without bucket and batch. Repeated rows are packed each. An empty table gives an
    empty result.
    """
    if longest < 1 or buckets < 1 or budget < 1:
        raise ValueError("longest, buckets and budget are at least 1")
    rows = stage(picked(docs, id=key, size=F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long")))
    cut = rows.where("size > 0").select(
        "id", "size", F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / longest).cast("long"))).alias("piece")
    )
    pieces = cut.select(
        "id",
        F.col("piece").cast("long").alias("piece"),
        (F.col("piece") * longest).cast("long").alias("first_token"),
        F.least(F.lit(longest), F.col("size") - F.col("piece") * longest).cast("long").alias("n_tokens"),
    )
    histogram = {r.n_tokens: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}
    bounds = best_boundaries(histogram, buckets)  # from at most ``longest`` rows
    bucket = F.lit(None).cast("long")
    for bound in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= bound, F.lit(bound).cast("long")).otherwise(bucket)
    placed = pieces.select("*", bucket.alias("bucket"), F.xxhash64("id", "piece").alias("spread"))
    order = [F.col(c) for c in ("spread", "id", "piece", "n_tokens", "tie")]
    ranged = in_ranges(
        placed.withColumn("tie", F.monotonically_increasing_id()), F.col("bucket"), *order
    )
    ranked = running_totals(ranged, ["bucket"], order, {"rank": F.lit(1)})
    capacity = F.greatest(F.floor(F.lit(budget) / F.col("bucket")), F.lit(1))
    full = ranked.select(
        F.col("id").alias(key),
        "piece",
        "first_token",
        "n_tokens",
        "bucket",
        F.floor(F.col("rank") / capacity).cast("long").alias("batch"),
        (F.col("rank") % capacity).cast("long").alias("slot"),
    )
    none = F.lit(None).cast("long")
    empty = rows.where("size = 0").select(
        F.col("id").alias(key),
        F.lit(0).cast("long").alias("piece"),
        F.lit(0).cast("long").alias("first_token"),
        F.lit(0).cast("long").alias("n_tokens"),
        none.alias("bucket"),
        none.alias("batch"),
        none.alias("slot"),
    )
    return full.unionByName(empty)
