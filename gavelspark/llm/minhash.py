"""MinHash near-duplicates with banding.

Each part of two collections of ``PARTS`` parts is the key of a table and joins ``ROWS``
minhashes. Two sets meet in a table if one part agrees.

Stars come first: of the members that its tables put at their centres, each set is compared
with two at most. What that connects is settled among itself. The tables that still hold several
components overlap widely, so those around the same member become one group, where two sets meet
once and not in every table they share; only members of different components are compared pair by
pair there, and groups too long for that are dealt anew by the parts of a further collection. All
links are confirmed on the full sets: a set is sent once to each cell of pairs that meet around one
member, not once for each pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.llm.common import as_text, picked, stage_in_batches
from gavelspark.llm.simhash import HOT_SHARE
from gavelspark.sources.storage import stage

SHINGLE = 4
#: Minhashes of a part that is a key.
ROWS = 4
#: Parts of a collection. At the least similarity, 0.8, two sets miss each other in all tables
#: with a chance of (1 - 0.8⁴)²⁴ = 0.000003.
PARTS = 12
#: Two collections make the keys, each further one deals long groups of tables anew.
COLLECTIONS = 3
#: Minhashes of a part of a further collection, which joins the same ones anew. Two sets miss each
#: other in one with a chance of (1 - 0.8³)¹² = 0.0002.
FURTHER_ROWS = 3
#: A group of more sets than this is dealt anew.
LONG_TABLE = 1 << 14
#: Members of a group that one task compares with all others of it.
BLOCK_MEMBERS = 1024
#: Two bits of each of 64 minhashes make a sketch. At similarity 0.8 both agree with a chance of 0.85;
#: fewer than this do about twice in a million.
LEAST_AGREEING = 40
#: Bits of the parity sketch, 64 in each of its columns.
PARITY_BITS = 256
PARITY = [f"parity_{i}" for i in range(PARITY_BITS // 64)]
#: Comparisons around one member that a task makes before others share them: a cell has about so many.
STAR = 1024
#: Sets on a side of a cell, and the shingles of all of them.
CELL_MEMBERS = 256
CELL_SHINGLES = 1 << 21
#: Classes that may be sent to every task, 24 bytes each: with more of them, a join shuffles texts.
PRUNED = 1 << 20
SEED = 42
BLOCK = 1 << 16
_draw = np.random.default_rng(SEED)
#: Odd factors of the hash functions, for the lower and the upper half of a shingle's hash.
FACTORS = _draw.integers(0, 1 << 31, 2 * ROWS * PARTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
OTHERS = _draw.integers(0, 1 << 31, 2 * ROWS * PARTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which all bits depend on all bits."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def shingle_set(text: bytes | None) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes, made of their words' hashes."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    length = min(SHINGLE, len(words))
    shingles = np.zeros(len(words) - length + 1, np.uint64)
    for i in range(length):
        shingles = mixed(shingles + hashes[i : i + len(shingles)])
    return np.unique(shingles)


def minhashes(hashes: np.ndarray) -> np.ndarray:
    least = np.full(len(FACTORS), np.iinfo(np.uint32).max, np.uint32)
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(hashes), BLOCK // len(FACTORS)):
        end = start + BLOCK // len(FACTORS)
        seen = (low[start:end, None] * FACTORS) ^ (high[start:end, None] * OTHERS)
        least = np.minimum(least, seen.min(0))
    return mixed(least.astype(np.uint64) + np.uint64(1))


def joined(least: np.ndarray, rows: int) -> np.ndarray:
    """One number for each ``rows`` minhashes."""
    numbers = np.zeros(len(least) // rows, np.uint64)
    for row in least.reshape(-1, rows).T:
        numbers = mixed(numbers ^ row)
    return numbers


def parts_of(least: np.ndarray) -> np.ndarray:
    """The parts of all collections, as signed numbers."""
    further = least[: (COLLECTIONS - 2) * PARTS * FURTHER_ROWS]
    return np.concatenate((joined(least, ROWS), joined(further, FURTHER_ROWS))).view(np.int64)


def bits_of(least: np.ndarray, place: int) -> int:
    """One bit of each of the first 64 minhashes, as a signed number."""
    bits = (least[:64] >> np.uint64(place)).astype(np.uint8) & 1
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def parity_of(hashes: np.ndarray) -> list[int]:
    """For each of ``PARITY_BITS`` places whether an odd number of shingles falls there, as
    signed numbers. A shingle that only one of two sets has changes one place, so the sketches
    differ in no more places than there are such shingles."""
    fallen = np.bincount((hashes % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS)
    return np.packbits((fallen & 1).astype(np.uint8)).view(">i8").tolist()


def sketched(docs: DataFrame, key: str, text: str) -> DataFrame:
    """For each row ``id``, ``text_digest``, ``n_shingles``, and of its set ``digest``, ``parts``
    and the sketches ``low``, ``high`` and ``PARITY`` (null without shingles), written to the
    shared folder."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sketches = [], []
            for text in batch.column(2):
                found = shingle_set(text.as_py())
                sizes.append(len(found))
                if len(found):
                    digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                    least = minhashes(found)
                    bits = (bits_of(least, 0), bits_of(least, 1), *parity_of(found))
                    sketches.append((digest, parts_of(least), *bits))
                else:
                    sketches.append((None,) * (4 + len(PARITY)))
            digests, parts, *bits = zip(*sketches) if sketches else ((),) * (4 + len(PARITY))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(parts, pa.list_(pa.int64())),
                    *(pa.array(b, pa.int64()) for b in bits),
                ],
                ["id", "text_digest", "n_shingles", "digest", "parts", "low", "high", *PARITY],
            )

    rows = picked(docs, id=key, text=text).select("id", F.xxhash64("text").alias("text_digest"), F.col("text").cast("binary"))
    kind = rows.schema["id"].dataType.simpleString()
    return stage_in_batches(
        rows.mapInArrow(
            sketch,
            f"id {kind}, text_digest long, n_shingles long, digest binary, parts array<long>, "
            + ", ".join(f"{c} long" for c in ["low", "high", *PARITY]),
        )
    )


def collection(number: int) -> Column:
    return F.slice("parts", number * PARTS + 1, PARTS)


SKETCH = ["n_shingles", "low", "high", *PARITY]


def tables(classes: DataFrame) -> DataFrame:
    """``key``, ``cid``, its ``weight`` and its sketch: the classes (``cid``, ``parts``, the sketch)
    under each key that two of them share at least. The weight counts the classes that each key
    is shared with: the more like the others around it a class is, the larger."""
    both = F.slice("parts", 1, 2 * PARTS)
    listed = classes.select("cid", F.posexplode(both).alias("at", "part")).select(F.xxhash64("at", "part").alias("key"), "cid")
    common = listed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # 2 * PARTS keys of a class at most
    held = listed.join(common, "key").groupBy("cid").agg(F.collect_list("key").alias("keys"), F.sum("n").alias("weight"))
    return held.join(classes.select("cid", *SKETCH), "cid").select(F.explode("keys").alias("key"), "cid", "weight", *SKETCH)


def alike(a: str, b: str, percent: int) -> Column:
    """Whether sizes and sketches of two members allow a link. With ``percent`` of the union
    shared, the shingles that only one of two sets has are (100 - percent) in 100 + percent of
    both sizes at most, and the parity sketches differ in no more places."""
    size_a, size_b = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    different = (
        F.col(f"{a}.low").bitwiseXOR(F.col(f"{b}.low")).bitwiseOR(F.col(f"{a}.high").bitwiseXOR(F.col(f"{b}.high")))
    )
    sizes = 100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b)
    places = reduce(
        Column.__add__,
        (F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in PARITY),
    )
    parity = (100 + percent) * places <= (100 - percent) * (size_a + size_b)
    return sizes & parity & (F.bit_count(different) <= 64 - LEAST_AGREEING)


def in_cells(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``a``, ``b``, ``cell``: the pairs around a member (``at``) in one cell, or if these are many,
    their sets are many or long, in a square of cells, by ``a`` and by ``b``."""
    ends = pairs.select("at", F.col("a").alias("cid")).union(pairs.select("at", "b")).distinct()
    sizes = ends.join(classes.select("cid", "n_shingles"), "cid").groupBy("at").agg(
        F.greatest(F.count("*") / CELL_MEMBERS, F.sum("n_shingles") / CELL_SHINGLES).alias("size")
    )
    counts = pairs.groupBy("at").agg(F.sqrt(F.count("*") / STAR).alias("root"))
    sides = counts.join(sizes, "at").select("at", F.ceil(F.greatest("size", "root")).alias("sides"))
    # few: each stands for more than STAR pairs, CELL_MEMBERS sets or CELL_SHINGLES shingles
    split = F.broadcast(sides.where("sides > 1"))
    place = [F.pmod(F.xxhash64(end), F.coalesce("sides", F.lit(1))) for end in ("a", "b")]
    return pairs.join(split, "at", "left").select("a", "b", F.xxhash64("at", *place).alias("cell"))


def sets_of(celled: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """``cell``, ``cid`` and ``shingles`` of every class in a pair of a cell, from one document of each."""
    needed = celled.select(F.col("a").alias("cid"), "cell").union(celled.select("b", "cell")).distinct()
    wanted = stage(needed.groupBy("cid").agg(F.collect_list("cell").alias("cells")))
    firsts = classes.join(wanted, "cid", "left_semi").select(
        "cid", as_text(F.col("first.id")).alias("doc"), F.col("first.text_digest").alias("text_digest")
    )
    texts = picked(docs, id=key, text=text).select(
        as_text(F.col("id")).alias("doc"), F.xxhash64("text").alias("text_digest"), F.col("text").cast("binary")
    )
    if wanted.count() <= PRUNED:
        # before any text is moved
        few = F.broadcast(firsts.select("text_digest", "cid", F.xxhash64("doc").alias("of")))
        found = texts.join(few, "text_digest").where(F.xxhash64("doc") == F.col("of"))
    else:
        found = texts.join(firsts, ["doc", "text_digest"])
    found = found.dropDuplicates(["cid"])  # repeated rows of one document are equal

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()).view(np.int64) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sets, pa.list_(pa.int64()))], ["cells", "cid", "shingles"]
            )

    sets = found.join(wanted, "cid").select("cells", "cid", "text")
    return sets.mapInArrow(cut, "cells array<long>, cid long, shingles array<long>").select(
        F.explode("cells").alias("cell"), "cid", "shingles"
    )


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, key: str, text: str) -> DataFrame:
    """``a``, ``b``: those of ``pairs`` whose full sets have the similarity, written to the shared folder."""

    def compare(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        shingles = dict(zip(sets["cid"].to_pylist(), map(list_values, sets["shingles"])))
        linked = []
        for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist()):
            listed = np.concatenate((shingles[a], shingles[b]))
            listed.sort()
            both = int(np.count_nonzero(listed[1:] == listed[:-1]))
            linked.append(100 * both >= percent * (len(listed) - both))
        return pairs.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    celled = stage(in_cells(pairs, classes))
    sets = sets_of(celled, classes, docs, key, text)
    return stage_in_batches(
        sets.groupBy("cell").cogroup(celled.groupBy("cell")).applyInArrow(compare, "a long, b long")
    )


def list_values(value: pa.ListScalar) -> np.ndarray:
    return value.values.to_numpy(zero_copy_only=False)


def once(pairs: DataFrame) -> DataFrame:
    """Each of ``pairs`` once, around the smallest of the members (``at``) where it was found."""
    return pairs.groupBy("a", "b").agg(F.min("at").alias("at"))


def star_pairs(rooted: DataFrame, percent: int) -> DataFrame:
    """Two pairs (``a`` < ``b``, the centre as ``at``) at most for each member (``key``, ``cid``, ``weight``, its
    sketch, ``root``). A table's centres are its member of most weight and its smallest; of those
    that a member may be linked with and is not connected with yet, it is paired with the one of
    most weight and the smallest. What one centre leaves apart the other may connect,
    before members are paired."""
    smallest = F.min(F.struct("cid", "weight", "root", *SKETCH))
    most = F.max(F.struct("weight", "cid", "root", *SKETCH))
    centres = (
        rooted.groupBy("key")
        .agg(smallest.alias("smallest"), most.alias("most"), F.min("root").alias("__least"), F.max("root").alias("__most"))
        .where("__least < __most")
        .withColumn("most", F.struct(*(F.col(f"most.{c}") for c in ["cid", "weight", "root", *SKETCH])))
        .select(F.col("key").alias("__key"), F.explode(F.array("smallest", "most")).alias("centre"))
    )
    met = rooted.select("key", F.struct("cid", "root", *SKETCH).alias("member")).join(
        centres, F.col("key") == F.col("__key")
    )
    met = met.where((F.col("member.root") != F.col("centre.root")) & alike("member", "centre", percent))
    chosen = met.groupBy(F.col("member.cid").alias("cid")).agg(
        F.array_distinct(
            F.array(F.min("centre.cid"), F.max(F.struct("centre.weight", "centre.cid")).getField("cid"))
        ).alias("centres")
    )
    pairs = chosen.select("cid", F.explode("centres").alias("centre"))
    return once(
        pairs.select(F.least("cid", "centre").alias("a"), F.greatest("cid", "centre").alias("b"), F.col("centre").alias("at"))
    )


def open_groups(rooted: DataFrame) -> DataFrame:
    """``key``, ``n``, ``cid``, ``root`` of the tables (``key``, ``cid``, ``weight``, ``root``)
    that hold more than one component. Tables around the same member, the one of most weight,
    become one group of ``n`` members under that member's ``cid``: members of a table
    are members of its group, each of them once."""
    split = (
        rooted.groupBy("key")
        .agg(F.max(F.struct("weight", "cid")).alias("centre"), F.min("root").alias("__least"), F.max("root").alias("__most"))
        .where("__least < __most")
        .select("key", F.col("centre.cid").alias("group"))
    )
    members = rooted.select("key", "cid", "root").join(split, "key").select(F.col("group").alias("key"), "cid", "root")
    members = stage(members.distinct())
    return members.join(members.groupBy("key").agg(F.count("*").alias("n")), "key")


def table_pairs(groups: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a`` < ``b``, the key as ``at``) of members of a group (``key``, ``n``, ``cid``, ``root``, the
    sketch) that may be linked and are not connected. A long group's members are dealt into blocks,
    and each block meets all members, so no task makes all comparisons of a group."""
    blocks = F.ceil(F.col("n") / BLOCK_MEMBERS)
    one, other = (F.struct("cid", "root", *SKETCH).alias(side) for side in ("one", "other"))
    members = groups.select("key", F.pmod(F.xxhash64("cid"), blocks).alias("block"), one)
    others = groups.select(
        F.col("key").alias("__key"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("__block"), other
    )
    met = members.join(
        others,
        (F.col("key") == F.col("__key"))
        & (F.col("block") == F.col("__block"))
        & (F.col("one.cid") < F.col("other.cid"))
        & (F.col("one.root") != F.col("other.root"))
        & alike("one", "other", percent),
    )
    return once(met.select(F.col("one.cid").alias("a"), F.col("other.cid").alias("b"), F.col("key").alias("at")))


def starred(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is connected with, for every node of ``links``
    (``a``, ``b``), written to the shared folder.

    Alternating large and small stars, each round written. They end as soon as every node is
    either a root or hangs below one root only, which one count by node tells.
    """
    ends = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    stars = stage(ends.where("u != v"))
    while True:
        up = stars.select(F.col("u").alias("node"), F.col("v").alias("above"))
        down = stars.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("above"))
        places = up.unionByName(down).groupBy("node").agg(
            F.min("above").alias("__least"), F.max("above").alias("__most"), F.count("above").alias("n_above"), F.count("*").alias("n")
        )
        unsettled = (F.col("__least") < F.col("__most")) | F.col("n_above").between(1, F.col("n") - 1)
        if places.agg(F.count_if(unsettled)).first()[0] == 0:
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stage(
            stars.join(least.withColumnRenamed("u", "at"), F.col("v") == F.col("at")).select("u", F.col("m").alias("v"))
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        stars = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stage(nodes.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())


def dealt_anew(long: DataFrame, classes: DataFrame, number: int) -> DataFrame:
    """The members of long groups (``key``, ``cid``, the sketch) in tables by the parts of a
    further collection. The join makes one row for each member, its parts come after it."""
    further = classes.select("cid", collection(number).alias("further"))
    return (
        long.select("key", "cid", *SKETCH)
        .join(further, "cid")
        .select("key", "cid", *SKETCH, F.posexplode("further").alias("at", "part"))
        .select(F.xxhash64("key", "at", "part").alias("key"), "cid", *SKETCH)
    )


def linked_classes(
    classes: DataFrame, docs: DataFrame, percent: int, key: str, text: str
) -> DataFrame:
    """``node`` and ``root`` of all ``classes`` that are linked with others: the components of
    confirmed pairs. Those connect all classes that met in a table and have the similarity; what
    others connect already is not compared."""
    seen, roots = [], None

    def judge(pairs: DataFrame) -> None:
        """Add the links among ``pairs``; what an earlier step compared is not compared again."""
        nonlocal roots
        if seen:
            pairs = pairs.join(reduce(DataFrame.unionByName, seen), ["a", "b"], "left_anti")
        pairs = stage(pairs)
        seen.append(pairs)
        new = confirmed(pairs, classes, docs, percent, key, text)
        if not new.isEmpty():
            # the components so far are stars already: each round has their nodes, not all links
            known = [] if roots is None else [roots.select(F.col("node").alias("a"), F.col("root").alias("b"))]
            roots = starred(reduce(DataFrame.unionByName, known, new))

    def rooted(listed: DataFrame) -> DataFrame:
        """The members with the component that the links so far give them."""
        if roots is None:
            return listed.withColumn("root", F.col("cid"))
        joined = listed.join(roots.withColumnRenamed("node", "cid"), "cid", "left")
        return joined.withColumn("root", F.coalesce("root", "cid"))

    def groups_of(listed: DataFrame) -> DataFrame:
        """The groups of tables that still hold more than one component, with the sketches."""
        members = open_groups(rooted(listed.select("key", "cid", "weight")))
        return stage(members.join(classes.select("cid", *SKETCH), "cid"))

    listed, waiting = stage(tables(classes)), None
    for number in range(2, COLLECTIONS + 1):
        pairs = star_pairs(rooted(listed), percent)
        # the short groups' pairs are compared along with the long ones' next stars
        judge(pairs if waiting is None else once(pairs.unionByName(waiting)))
        groups = groups_of(listed)
        if number == COLLECTIONS:
            judge(table_pairs(groups, percent))
            break
        waiting = table_pairs(groups.where(F.col("n") <= LONG_TABLE), percent)
        long = groups.where(F.col("n") > LONG_TABLE)
        if long.isEmpty():
            judge(waiting)
            break
        listed = stage(dealt_anew(long, classes, number).withColumn("weight", F.lit(1)))
    if roots is None:
        return classes.select(F.col("cid").alias("node"), F.col("cid").alias("root")).where(F.lit(False))
    return roots


def components(
    docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id``, ``kept`` for every row of ``docs``.

    A document's set holds its distinct shingles of four words, lower-cased from A to Z only;
    fewer words make one shingle together. Two documents are linked if their sets' intersection
    has at least ``percent`` (80 or more) in a hundred of their union; ``component_id`` is the
    smallest key reachable, the document's own included, and ``kept`` marks the documents of
    that key. Equal sets are one class throughout, so copies are never paired. Texts without
    words (null, empty, white space) have an empty set, are linked with nothing and are kept.
    Repeated rows each get their row. A row with a null key takes part; a component of null
    keys only has a null id, and ``kept`` compares null with null as equal.

    Two sets of similarity 0.8 miss each other in all tables with a chance of 0.000003, where groups
    are dealt anew of 0.0002, at 0.9 with less than one in a million. Shingles are compared as 64-bit hashes.
    """
    if percent < 80:
        raise ValueError("the tables are made for a similarity of 0.8 or more")
    rows = sketched(docs, key, text)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_digest")).alias("first")
    classes = stage(
        rows.where("n_shingles > 0")
        .groupBy("digest")
        .agg(first, F.count("*").alias("n"), F.first("parts").alias("parts"), *(F.max(c).alias(c) for c in SKETCH))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    members = linked_classes(classes.drop("digest", "n"), docs, percent, key, text)
    linked = stage(members.join(classes.select("cid", "first"), F.col("node") == F.col("cid")).select("cid", "root", "first"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("chosen"))
    known = linked.select("cid", "root").join(smallest, "root").select("cid", "chosen")
    nodes = stage(
        classes.join(known, "cid", "left").select(
            F.col("digest").alias("class_digest"), "n", F.coalesce("chosen", "first").getField("id").alias("component_id")
        )
    )
    # a class that holds a large share of all rows is joined apart: fewer than HOT_SHARE are
    is_hot = (F.col("n") > 1) & (F.col("n") * HOT_SHARE > F.lit(rows.count()))
    hot = nodes.where(is_hot).select("class_digest", "component_id")
    hot_values = [bytes(r.class_digest) for r in hot.select("class_digest").collect()]
    thin = rows.select("id", "n_shingles", "digest")
    apart = F.coalesce(F.col("digest").isin(hot_values), F.lit(False)) if hot_values else F.lit(False)
    same = F.col("digest") == F.col("class_digest")
    often = thin.where(apart).join(F.broadcast(hot), same)
    plain = thin.where(~apart & F.col("digest").isNotNull()).join(nodes.drop("n"), same)
    empty = thin.where("digest IS NULL")
    columns = ["id", "n_shingles", "component_id"]
    return (
        often.select(*columns)
        .unionByName(plain.select(*columns))
        .unionByName(empty.select("id", "n_shingles", F.col("id").alias("component_id")))
        .select(F.col("id").alias(key), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    )
