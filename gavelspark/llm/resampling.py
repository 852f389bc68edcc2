"""Resampling towards a target distribution by importance weights of hashed word features.

A feature is a run of words; its bucket is the CRC-32 of its bytes modulo the number of
buckets. The weight of a document sums, over its features, how much likelier their buckets are
in the target than in the source; Gumbel noise on top of the weight draws without replacement.

The CRCs of many features are taken at once. Distinct features of equal length form a matrix
of bytes, one row each; all rows' CRCs are updated column by column through the table of the
polynomial, and the buckets go back to the places the features came from.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelspark.llm.common import picked, stage_in_batches
from gavelspark.operators.ranges import PART, in_ranges

#: The reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: All bytes but those of words, which become spaces.
BETWEEN = bytes(
    b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 else 0x20 for b in range(256)
)
#: Bytes of a text that are cut into words at a time.
BLOCK = 1 << 20
#: Bytes of distinct features whose buckets a task remembers before it starts anew.
REMEMBERED = 16 << 20


def crc_table() -> np.ndarray:
    """The remainder of each byte."""
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = np.where(values & 1, (values >> 1) ^ np.uint32(POLYNOMIAL), values >> 1)
    return values


TABLE = crc_table()


def crc_matrix(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a two-dimensional array of bytes, column by column."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in rows.T:
        crc = TABLE[(crc ^ column) & 0xFF] ^ (crc >> 8)
    return crc ^ np.uint32(0xFFFFFFFF)


def crcs(features: list[bytes]) -> np.ndarray:
    """CRC-32 of each feature: those of one length go through one matrix."""
    lengths = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(lengths, kind="stable")
    found = np.empty(len(features), np.uint32)
    edges = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    for first, last in zip(edges, [*edges[1:], len(order)]):
        places = order[first:last]
        data = b"".join([features[i] for i in places])
        matrix = np.frombuffer(data, np.uint8).reshape(len(places), -1)
        found[places] = crc_matrix(matrix)
    return found


def word_blocks(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text in lower case (A to Z only), some ``BLOCK`` bytes at a time; a word
    is never cut. UTF-8 keeps all bytes of other scripts' characters above 127."""
    if not text:
        return
    at = 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text):
            part = text[at:end].lower().translate(BETWEEN)
            space = part.rfind(b" ")
            while space < 0 and end < len(text):  # one word longer than the block
                end += BLOCK
                part = text[at:end].lower().translate(BETWEEN)
                space = part.rfind(b" ")
            if end < len(text):
                part, end = part[:space], at + space + 1
        else:
            part = text[at:].lower().translate(BETWEEN)
        yield part.split()
        at = end


def feature_blocks(text: bytes | None, longest: int) -> Iterator[tuple[int, list[bytes]]]:
    """The number of words and the features, runs of 1 to ``longest`` words, of each block."""
    tail: list[bytes] = []
    for words in word_blocks(text):
        found = list(words)
        joined = tail + words
        for size in range(2, longest + 1):
            # runs that end in this block
            start = max(len(tail) - size + 1, 0)
            runs = zip(*(joined[start + i :] for i in range(size)))
            found += map(b" ".join, runs)
        yield len(words), found
        tail = joined[len(joined) - longest + 1 :] if longest > 1 else []


class Buckets:
    """The buckets of features, each distinct one hashed once while it is remembered."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.known: dict[bytes, int] = {}
        self.held = 0

    def learn(self, features: set[bytes]) -> dict[bytes, int]:
        """A table that holds ``features`` at least."""
        new = [f for f in features if f not in self.known]
        if new:
            size = sum(map(len, new))
            if self.held + size > REMEMBERED:
                self.known, self.held = {}, 0
                new = list(features)
                size = sum(map(len, new))
            self.known.update(zip(new, (crcs(new) % self.buckets).tolist()))
            self.held += size
        return self.known


def bucket_counts(rows: DataFrame, buckets: int, longest: int) -> DataFrame:
    """``bucket``, ``n``: the features of all texts of ``rows`` (``text``), repeats counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, totals = Buckets(buckets), np.zeros(buckets, np.int64)

        def add(counts: Counter) -> None:
            known = table.learn(set(counts))
            places = np.fromiter(map(known.__getitem__, counts), np.int64, len(counts))
            np.add.at(totals, places, np.fromiter(counts.values(), np.int64, len(counts)))

        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0):
                for _, features in feature_blocks(text.as_py(), longest):
                    counts.update(features)
                    if len(counts) > BLOCK // 8:
                        add(counts)
                        counts = Counter()
            add(counts)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array(totals[used], pa.int64())], ["bucket", "n"]
        )

    return (
        rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    )


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket, in thousandths: how much likelier a feature of the target is to
    fall into it than one of the source, each count raised by one."""
    both = (
        source.withColumnRenamed("n", "s")
        .join(target.withColumnRenamed("n", "t"), "bucket", "full")
        .select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
        .collect()
    )  # one row for each bucket at most
    s, t = np.zeros(buckets), np.zeros(buckets)
    for row in both:
        s[row["bucket"]], t[row["bucket"]] = row["s"], row["t"]
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighted(rows: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """``id``, ``n_words``, ``n_features``, ``weight`` of each of ``rows`` (``id``, ``text``)."""
    shared = SparkContext.getOrCreate().broadcast(gain)  # one number for each bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        table = Buckets(len(gain))
        for batch in batches:
            n_words, n_features, weights = [], [], []
            pending: list[tuple[int, list[bytes]]] = []
            size = 0

            def settle() -> None:
                known = table.learn(set().union(*(f for _, f in pending)))
                for row, features in pending:
                    places = np.fromiter(map(known.__getitem__, features), np.int64, len(features))
                    weights[row] += int(gain[places].sum())

            for row, text in enumerate(batch.column(1)):
                n_words.append(0)
                n_features.append(0)
                weights.append(0)
                for words, features in feature_blocks(text.as_py(), longest):
                    n_words[row] += words
                    n_features[row] += len(features)
                    pending.append((row, features))
                    size += len(features)
                    if size > BLOCK // 8:
                        settle()
                        pending, size = [], 0
            if pending:
                settle()
            columns = [pa.array(c, pa.int64()) for c in (n_words, n_features, weights)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns], ["id", "n_words", "n_features", "weight"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text").mapInArrow(
        weigh, f"id {kind}, n_words long, n_features long, weight long"
    )


def noise(key: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, drawn from a digest of the seed and the key."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), text), 256)
    drawn = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0)))).cast("long")


def resampled(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    longest: int = 1,
    buckets: int = 10_000,
    seed: str = "2024",
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """``key``, ``n_features``, ``weight``, ``score``, ``rank`` for every row of ``docs``.

    Features are runs of 1 to ``longest`` consecutive words in lower case. ``weight`` sums the
    gains of their buckets, ``score`` adds the noise of the key. Of the N rows with at least
    ``least_words`` words the floor(``percent`` * N / 100) of the highest scores are drawn and
    ranked 1, 2, 3, ...; equal scores go by the smaller key (null first), rows that share both
    by their number of features, equal rows in any order. Rows that are not drawn have a null
    rank. A null or empty text has no features and weight 0; a null key draws its noise as the
    word null. Repeated rows each take part. An empty target makes all gains follow from the
    source alone; an empty table gives an empty result.
    """
    if longest < 1 or buckets < 1 or not 0 <= percent <= 100:
        raise ValueError("longest and buckets are at least 1, percent is from 0 to 100")
    rows = picked(docs, id=key, text=docs[text].cast("binary"))
    wanted = picked(target, text=target[target_text].cast("binary"))
    gain = gains(
        bucket_counts(rows, buckets, longest), bucket_counts(wanted, buckets, longest), buckets
    )
    scored = stage_in_batches(
        weighted(rows, gain, longest).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    )
    eligible = scored.where(F.col("n_words") >= least_words)
    n_drawn = eligible.count() * percent // 100
    order = [F.desc("score"), F.col("id"), F.col("n_features"), F.col("tie")]
    ranged = in_ranges(eligible.withColumn("tie", F.monotonically_increasing_id()), *order)
    # the ranges that hold a drawn row, and the rank before each: one number for each range
    sizes = ranged.groupBy(PART).count()
    before = F.sum("count").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col(PART).alias("from"), F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy(PART).orderBy(*order))
    ranked = (
        ranged.join(starts.where(F.col("before") < n_drawn), F.col(PART) == F.col("from"))
        .withColumn("rank", (F.col("before") + within).cast("long"))
    )
    rest = scored.where(F.col("n_words") < least_words)
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= n_drawn, F.col("rank")))
    unranked = ranged.join(
        starts.where(F.col("before") >= n_drawn), F.col(PART) == F.col("from"), "left_semi"
    )
    none = F.lit(None).cast("long")
    columns = ["id", "n_features", "weight", "score"]
    return (
        drawn.select(*columns, "rank")
        .unionByName(unranked.select(*columns, none.alias("rank")))
        .unionByName(rest.select(*columns, none.alias("rank")))
        .withColumnRenamed("id", key)
    )
