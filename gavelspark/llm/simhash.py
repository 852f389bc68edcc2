"""SimHash near-duplicates through an inverted index on byte positions, with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits share at least 5 of their 8 positional
bytes. A posting list for each single positional byte would hold a 256th of all fingerprints,
so the tally would look at a fixed share of all pairs. The index is therefore keyed by several
positional bytes at once: a family of position sets of which every 5 positions contain one.
No pair that can reach the count is missed, and pairs that cannot are not met. Each pair met
is tallied (how many positional bytes are equal), kept at 5 or more, and verified bit by bit.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelspark.llm.common import as_text, picked
from gavelspark.sources.storage import stage

SEED = 42
SHINGLE = 3
BYTES = 8
#: Posting lists longer than this are dealt anew by two further bytes.
LONG_LIST = 256
#: A fingerprint of more than one in so many rows is looked up apart: there are no more of
#: these than this, so their table has a bound of its own.
HOT_SHARE = 1000
#: Shingles hashed at a time, so that a very long text needs no more memory than this.
BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """SimHash of the 3-word shingles, repeats included, as a signed 64-bit number; 0 without
    words. A bit is 1 if it is set in over half the shingles' hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
        n = len(words) - SHINGLE + 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for start in range(0, n, BLOCK):
        size = min(BLOCK, n - start)
        hashes = np.fromiter((digest(next(shingles), SEED) for _ in range(size)), ">u8", size)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())


def fingerprints(text: Column) -> Column:
    return F.arrow_udf(_fingerprints, T.LongType())(text)


def position_sets(width: int, shared: int) -> list[tuple[int, ...]]:
    """Sets of ``width`` byte positions such that any ``shared`` positions contain one, chosen
    greedily: 8 sets of three positions, for instance, where five are shared."""
    unmet = set(combinations(range(BYTES), shared))
    chosen: list[tuple[int, ...]] = []
    if width == 3 and shared == 5:  # five of eight positions leave three in one half
        return [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
    options = list(combinations(range(BYTES), width))
    while unmet:
        best = max(options, key=lambda o: sum(set(o) <= set(u) for u in unmet))
        chosen.append(best)
        unmet = {u for u in unmet if not set(best) <= set(u)}
    return chosen


def mask_of(positions: tuple[int, ...]) -> int:
    value = sum(0xFF << (8 * p) for p in positions)
    return value - (1 << 64) if value >= 1 << 63 else value


def equal_bytes(a: Column, b: Column) -> Column:
    """The tally: positional bytes that two fingerprints share."""
    different = a.bitwiseXOR(b)
    return sum(
        F.when(different.bitwiseAND(F.lit(mask_of((p,)))) == 0, 1).otherwise(0)
        for p in range(BYTES)
    )


def links(distinct: DataFrame, n: int, bits: int = 3) -> DataFrame:
    """Pairs (``a`` < ``b``) of different fingerprints of the column ``fp`` that differ in at
    most ``bits`` (up to 3) bits. ``n`` is their number: it sets how many bytes make a key.

    A list of more than ``LONG_LIST`` fingerprints is not paired: its members are dealt anew by
    the listed bytes and two more of the others, for all choices of two. A pair with 5 equal
    bytes meets in one of these lists.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the byte tally finds up to 3 different bits")
    shared = BYTES - bits
    width = 3 if n < 1 << 26 else 4 if n < 1 << 33 else 5
    masks = [mask_of(s) for s in position_sets(width, 5)]
    index = distinct.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask")).withColumn(
        "key", F.col("fp").bitwiseAND(F.col("mask"))
    )
    listed = index.withColumn("size", F.count("*").over(Window.partitionBy("mask", "key")))
    listed = stage(listed.where(F.col("size") > 1))
    short = listed.where(F.col("size") <= LONG_LIST).select("fp", "mask", "key")
    dealt = listed.where(F.col("size") > LONG_LIST)
    if width < 5:
        wider = {
            mask_of(s): [
                mask_of((*s, *more))
                for more in combinations([p for p in range(BYTES) if p not in s], 5 - width)
            ]
            for s in position_sets(width, 5)
        }
        options = F.array()
        for mask, extended in wider.items():
            options = F.when(
                F.col("mask") == F.lit(mask), F.array(*map(F.lit, extended))
            ).otherwise(options)
        dealt = dealt.select("fp", F.explode(options).alias("mask")).distinct()
        dealt = dealt.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    else:
        dealt = dealt.select("fp", "mask", "key")
    posted = short.unionByName(dealt)
    other = posted.select(F.col("fp").alias("b"), F.col("mask").alias("m"), F.col("key").alias("k"))
    a, b = F.col("fp"), F.col("b")
    met = posted.join(
        other,
        (F.col("mask") == F.col("m"))
        & (F.col("key") == F.col("k"))
        & (a < b)
        & (equal_bytes(a, b) >= shared)
        & (F.bit_count(a.bitwiseXOR(b)) <= bits),
    )
    return met.select(a.alias("a"), b).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is connected with, for every node of
    ``edges`` (``a``, ``b``).

    Alternating large and small stars: each round hangs a node's larger neighbours, then its
    smaller ones, below its smallest neighbour; the rounds grow with the logarithm of the
    longest path. Each round is written to the shared folder, so that neither lineage nor lost
    executors add up.
    """
    stars = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    seen = None
    while True:
        state = stars.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if state == seen:
            break
        seen = state
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where(F.col("v") > F.col("u"))
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        large = stage(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        stars = stage(small)
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def grouped(rows: DataFrame, bits: int) -> DataFrame:
    """Every fingerprint of ``rows`` (``id``, ``digest``, ``fp``), written to the shared folder:
    ``fp``, ``n`` rows, ``first`` (smallest id and digest), ``n_links``, and of its component
    ``root`` and ``chosen``, the smallest ``first``.

    Equal fingerprints are one node throughout, so copies are never paired.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("first")
    firsts = stage(rows.groupBy("fp").agg(first, F.count("*").alias("n")))
    found = stage(links(firsts.select("fp"), firsts.count(), bits))
    roots = connected(found)
    linked = stage(roots.join(firsts, roots["node"] == firsts["fp"]).select("fp", "root", "first"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("chosen"))
    ends = found.select(F.explode(F.array("a", "b")).alias("fp"))
    degrees = ends.groupBy("fp").agg(F.count("*").alias("n_links"))
    known = linked.select("fp", "root").join(smallest, "root").join(degrees, "fp")
    return stage(
        firsts.join(known, "fp", "left").select(
            "fp",
            "n",
            "first",
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            F.coalesce("root", "fp").alias("root"),
            F.coalesce("chosen", "first").alias("chosen"),
        )
    )


def fingerprinted(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = picked(docs, id=key, text=text)
    return stage(
        rows.select("id", F.xxhash64("text").alias("digest"), fingerprints(F.col("text")).alias("fp"))
    )


def components(
    docs: DataFrame, bits: int = 3, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key``, ``fp`` (signed), ``fingerprint`` (16 hex digits), ``component_id``, ``n_links``.

    Two documents are linked if their fingerprints differ in at most ``bits`` bits, and
    ``component_id`` is the smallest key reachable over links, the document's own included.
    ``n_links`` counts the different fingerprints linked with the document's own. Each row
    gets a result row, repeated ones too. Texts without words (null, empty, white space) have
    fingerprint zero and are linked like any other. A null key stays null, and its row takes
    part like the others; a component of null keys only has a null id.

    Fingerprints of a large share of all rows are joined to their component apart from the
    others.
    """
    rows = fingerprinted(docs, key, text)
    nodes = grouped(rows, bits).select("fp", "n", F.col("chosen.id").alias("component_id"), "n_links")
    is_hot = (F.col("n") > 1) & (F.col("n") * HOT_SHARE > F.lit(rows.count()))
    hot = nodes.where(is_hot).drop("n")
    hot_values = [r.fp for r in hot.select("fp").collect()]  # fewer than HOT_SHARE
    apart = F.col("fp").isin(hot_values) if hot_values else F.lit(False)
    plain = rows.where(~apart).join(nodes.drop("n"), "fp")
    often = rows.where(apart).join(F.broadcast(hot), "fp")
    return plain.unionByName(often).select(
        F.col("id").alias(key),
        "fp",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "n_links",
    )


def without_near_duplicates(
    docs: DataFrame, bits: int = 3, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that remain when one document of each component stays: the one with
    the smallest key (null last), of rows with that key and different texts the one with the
    smaller digest, of equal rows any one. All columns are returned as they came."""
    chosen = (
        grouped(fingerprinted(docs, key, text), bits)
        .where(F.col("first") == F.col("chosen"))
        .select(as_text(F.col("first.id")).alias("__key"), F.col("first.digest").alias("__digest"))
    )
    marked = docs.withColumns({"__key": as_text(docs[key]), "__digest": F.xxhash64(docs[text])})
    alike = Window.partitionBy("__key", "__digest").orderBy("__key")
    return (
        marked.join(chosen, ["__key", "__digest"], "left_semi")
        .withColumn("__copy", F.row_number().over(alike))
        .where(F.col("__copy") == 1)
        .select(*(F.col(f"`{c}`") for c in docs.columns))
    )
