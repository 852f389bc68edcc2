"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of words, a window into shingles. A window lies in a document only
if all its shingles do, so one of them is a sufficient prefix: the rarest over all documents.
Only documents' occurrences of such prefix shingles are joined with windows; the length and
position bounds drop what cannot fit, and the rest is compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavelspark.llm.common import as_text, picked, stage_in_batches
from gavelspark.sources.storage import stage

SHINGLE = 3
#: Bytes of words in lower case; 0 for bytes between words.
LOWERED = np.array(
    [b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 else b + 32 if 65 <= b <= 90 else 0 for b in range(256)],
    np.uint8,
)
FACTOR = np.uint64(0x9E3779B97F4A7C15)
POWERS = np.cumprod(np.full(4096, FACTOR, np.uint64))
BLOCK = 1 << 17
#: Bits of the filter on shingles that a task tests before anything is joined: 16 MiB at most,
#: whatever the number of items. A false hit costs one row, which the join drops.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
BITS_PER_KEY = 64
class Words:
    """The words of a text, as stretches of its UTF-8 bytes. All bytes of a word character
    outside ASCII are word bytes, so bytes and characters are cut alike."""

    def __init__(self, text: str | None):
        self.bytes = LOWERED[np.frombuffer((text or "").encode(), np.uint8)]
        inside = np.concatenate([[0], (self.bytes > 0).view(np.int8), [0]])
        edges = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
        self.hashes: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, span: slice) -> list[str]:
        ends = zip(self.starts[span].tolist(), self.ends[span].tolist())
        return [self.bytes[i:j].tobytes().decode() for i, j in ends]

    def single(self) -> np.ndarray:
        """A 64-bit hash of each word: a sum of its bytes times powers of an odd number, taken
        over about ``BLOCK`` bytes at a time."""
        if self.hashes is None:
            parts, first, n = [], 0, len(self)
            while first < n:
                limit = self.starts[first] + BLOCK
                last = max(int(np.searchsorted(self.ends, limit, "right")), first + 1)
                starts = self.starts[first:last]
                values = self.bytes[starts[0] : self.ends[last - 1]]
                starts = starts - starts[0]
                within = np.arange(len(values)) - np.repeat(starts, np.diff(starts, append=len(values)))
                parts.append(np.add.reduceat(values * POWERS[within % len(POWERS)], starts))
                first = last
            self.hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        return self.hashes

    def shingles(self, size: int) -> np.ndarray:
        """A 64-bit hash for each run of ``size`` words, as signed numbers. What hashes alike
        is compared word by word in the end."""
        n = len(self) - size + 1
        if n < 1:
            return np.zeros(0, np.int64)
        single = self.single()
        total = np.full(n, size, np.uint64)
        for i in range(size):
            total = (total ^ single[i : i + n]) * FACTOR
            total ^= total >> np.uint64(29)
        return total.view(np.int64)


def windows(items: DataFrame, width: int) -> DataFrame:
    """``item_id``, ``words``: every window of every item, and its id, a digest of its words;
    an item of fewer words, but not none, is one window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = Words(text)[:]
                starts = range(max(len(words) - width + 1, min(len(words), 1)))
                ids += [item] * len(starts)
                found += [words[i : i + width] for i in starts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.column(0).type), pa.array(found, pa.list_(pa.string()))],
                ["item_id", "words"],
            )

    kind = items.schema["item_id"].dataType.simpleString()
    cutting = items.select("item_id", "text").mapInArrow(cut, f"item_id {kind}, words array<string>")
    return cutting.withColumn("window", F.sha2(F.array_join("words", " "), 256))


def shingled(distinct: DataFrame) -> DataFrame:
    """``window``, ``length``, ``words``, and each of its shingles: ``hash``, ``offset``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for window, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size = min(SHINGLE, len(words))
                for offset, value in enumerate(Words(" ".join(words)).shingles(size).tolist()):
                    rows.append((window, words, size, value, offset))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.string(), pa.list_(pa.string()), pa.int32(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["window", "words", "size", "hash", "offset"],
            )

    return distinct.select("window", "words").mapInArrow(
        cut, "window string, words array<string>, size int, hash long, offset int"
    )


class ShingleFilter:
    """Bits of the shingles looked for, and the sizes in use."""

    def __init__(self, bits: int, blocks: dict[int, bytes], sizes: list[int]):
        self.bits, self.sizes = bits, sizes
        self.table = np.zeros(bits // 8, np.uint8)
        for number, block in blocks.items():
            self.table[number * len(block) : (number + 1) * len(block)] = np.frombuffer(block, np.uint8)

    def found(self, hashes: np.ndarray) -> np.ndarray:
        """Indices of the hashes that may be looked for."""
        places = (hashes & (self.bits - 1)).astype(np.int64)
        return np.flatnonzero((self.table[places >> 3] >> (places & 7).astype(np.uint8)) & 1)


def shingle_filter(keys: DataFrame):
    """Broadcast filter over the column ``hash`` of ``keys``; built from bitmaps of 4 KiB that
    Spark aggregates, of which there are 4096 at most."""
    sizes = [r["size"] for r in keys.select("size").distinct().collect()]  # 1, 2 and 3 at most
    n = keys.select("hash").distinct().count()
    bits = LEAST_BITS
    while bits < min(n * BITS_PER_KEY, MOST_BITS):
        bits *= 2
    place = F.col("hash").bitwiseAND(F.lit(bits - 1)) + 1
    rows = (
        keys.select(place.alias("place"))
        .groupBy(F.bitmap_bucket_number("place").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("block"))
        .collect()
    )
    blocks = {r["bucket"] - 1: bytes(r["block"]) for r in rows}
    return SparkContext.getOrCreate().broadcast(ShingleFilter(bits, blocks, sorted(sizes)))


def occurrences(docs: DataFrame, shared) -> DataFrame:
    """How often each shingle looked for occurs in all documents: ``hash``, ``n``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            hits = []
            for text in batch.column(0):
                words = Words(text.as_py())
                for size in wanted.sizes:
                    hashes = words.shingles(size)
                    hits.append(hashes[wanted.found(hashes)])
            values, counts = np.unique(np.concatenate(hits or [np.zeros(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, pa.int64()), pa.array(counts, pa.int64())], ["hash", "n"]
            )

    counted = docs.select("text").mapInArrow(count, "hash long, n long")
    return counted.groupBy("hash").agg(F.sum("n").alias("n"))


def prefix_hits(rows: DataFrame, shared, width: int) -> DataFrame:
    """``rows`` (``id``, ``doc``, ``digest``, ``text``) with ``n_words`` and ``hits`` in place of
    the text: the occurrences of prefix shingles, each with the words around it that a window
    holding it can have."""
    reach = width - SHINGLE
    words_type = pa.list_(pa.string())
    hit = pa.struct([("at", pa.int32()), ("hash", pa.int64()), ("before", words_type), ("words", words_type)])

    def found(text: str | None) -> tuple[int, list[dict]]:
        words, hits = Words(text), []
        for size in shared.value.sizes:
            around = reach if size == SHINGLE else 0  # a shorter window is all shingle
            hashes = words.shingles(size)
            for at in shared.value.found(hashes).tolist():
                hits.append(
                    {
                        "at": at,
                        "hash": int(hashes[at]),
                        "before": words[max(at - around, 0) : at],
                        "words": words[at : at + size + around],
                    }
                )
        return len(words), hits

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [found(text.as_py()) for text in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array([n for n, _ in results], pa.int64()),
                    pa.array([hits for _, hits in results], pa.list_(hit)),
                ],
                ["id", "doc", "digest", "n_words", "hits"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "doc", "digest", "text").mapInArrow(
        find,
        f"id {kind}, doc string, digest long, n_words long, hits array<struct<at:int,hash:long,"
        "before:array<string>,words:array<string>>>",
    )


def judged(
    docs: DataFrame,
    items: DataFrame,
    width: int = 13,
    share: int = 20,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``id``, ``digest``, ``n_words``, ``n_hit``, ``n_items``, ``items``, ``items_sha256``,
    ``contaminated`` for each row of ``docs``; the digest is of the text.

    A document word is hit if it lies in an occurrence of any window of ``width`` words of any
    item; ``items`` are the ids of items with an occurring window, as sorted strings, and the
    digest is of these, comma-joined. A document is contaminated if a ``share``-th of its words
    or more, and at least one, is hit. Null texts have no words, on either side; an item with a
    null id counts as the id ``null``. Repeated document rows each get their result; documents
    that share a key but not a text are told apart by a digest of the text. Items without
    words, or an empty table of items, hit nothing.
    """
    items = picked(items, item_id=item_key, text=item_text).withColumn(
        "item_id", F.coalesce(F.col("item_id").cast("string"), F.lit("null"))
    )
    rows = picked(docs, id=key, text=text)
    found = stage(windows(items, width))
    cut = stage(shingled(found.dropDuplicates(["window"])))
    counts = occurrences(rows, shingle_filter(cut))
    prefixes = stage_in_batches(
        cut.join(counts, "hash", "left")
        .groupBy("window")
        .agg(
            F.min_by(
                F.struct("words", "size", "hash", "offset"),
                F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "offset"),
            ).alias("rarest"),
            F.min(F.coalesce("n", F.lit(0))).alias("n"),
        )
        .where(F.col("n") > 0)
        .select("window", "rarest.*")
    )
    shared = shingle_filter(prefixes)
    named = rows.select("id", as_text(F.col("id")).alias("doc"), F.xxhash64("text").alias("digest"), "text")
    seen = stage_in_batches(prefix_hits(named, shared, width))
    hits = seen.where(F.size("hits") > 0).select(
        "doc", "digest", "n_words", F.explode("hits").alias("hit")
    )
    offset = F.col("offset")
    held = F.concat(
        F.slice("hit.before", F.size("hit.before") - offset + 1, offset), F.col("hit.words")
    )
    placed = stage(
        hits.join(prefixes.withColumnRenamed("words", "wanted"), F.col("hit.hash") == F.col("hash"))
        .where((F.col("hit.at") >= offset) & (F.size("hit.before") >= offset))
        .where(F.col("hit.at") - offset + F.size("wanted") <= F.col("n_words"))
        .where(F.slice(held, 1, F.size("wanted")) == F.col("wanted"))
        .select(
            "doc",
            "digest",
            "window",
            (F.col("hit.at") - offset).alias("start"),
            (F.col("hit.at") - offset + F.size("wanted")).alias("end"),
        )
    )
    earlier = (
        Window.partitionBy("doc", "digest")
        .orderBy("start", "end")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    covered = F.greatest(
        F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(earlier), F.lit(0))), F.lit(0)
    )
    n_hit = (
        placed.select("doc", "digest", "start", "end")
        .distinct()
        .select("doc", "digest", covered.alias("new"))
        .groupBy("doc", "digest")
        .agg(F.sum("new").alias("n_hit"))
    )
    hit_items = (
        placed.select("doc", "digest", "window")
        .distinct()
        .join(found.select("item_id", "window").distinct(), "window")
        .groupBy("doc", "digest")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    both = n_hit.join(hit_items, ["doc", "digest"])
    none = F.array().cast("array<string>")
    return (
        seen.drop("hits")
        .join(both, ["doc", "digest"], "left")
        .select(
            "id",
            "digest",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", none).alias("items"),
        )
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    )


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The result of ``judged`` (where the options are described) with ``key`` for ``id``."""
    return judged(docs, items, key=key, **options).drop("digest").withColumnRenamed("id", key)


def without_contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all columns as they came."""
    found = judged(docs, items, key=key, text=text, **options).where("contaminated")
    dropped = found.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"))
    same = docs[key].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text]) == F.col("__digest"))
    return docs.join(dropped, same, "left_anti")
