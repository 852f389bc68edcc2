"""Spelling variants: words one insertion, deletion or replacement apart, and their common form.

Near words are found on a bit-sliced position index: for each position and letter a set of bits
over a block of the vocabulary, one bit a word. A query word walks through the index letter by
letter with four sets: words that agree so far, and words with one error so far, whose letters
stand at the same place (replacement), one place on (a letter more) or one place back (a letter
less). Each step is a few operations on whole sets.

Words one error apart share their first three letters or their last three, as words have six or
more: the vocabulary is dealt by both, so that near words meet in a block of bounded size.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.llm.common import picked
from gavelspark.sources.storage import stage

EDGE = 3
#: Words of a block, the width of its bit sets.
BLOCK = 1 << 13
#: Distinct words a task counts before it hands the counts on.
COUNTED = 1 << 17
#: Characters of a text that are cut into runs at a time.
PIECE = 1 << 22


def runs_of(text: str, least: int) -> Iterator[list[str]]:
    """The runs of ``least`` letters or more, lower-cased from A to Z only, of some ``PIECE``
    characters at a time; a run is never cut."""
    letter = re.compile(r"[A-Za-zÀ-ÿ]+")
    runs = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % least)
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        if end < len(text) and (cut := letter.match(text, end)):
            end = cut.end()
        part = text[at:end]
        part = part.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        yield runs.findall(part)
        at = end


def observed(key: bytes, run: str, damage: int) -> str:
    """The run as it counts: one code point is missing if the CRC-32 of key and run says so."""
    h = zlib.crc32(run.encode(), zlib.crc32(key + b":"))
    if h % damage:
        return run
    place = h % len(run)
    return run[:place] + run[place + 1 :]


def word_counts(docs: DataFrame, least_length: int, damage: int) -> DataFrame:
    """``word``, ``n``: how often each word of ``docs`` (``key``, ``text``) occurs."""

    def emit(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                key, text = key.as_py().encode(), text.as_py()
                for runs in runs_of(text or "", least_length):
                    for run, n in Counter(runs).items():
                        word = observed(key, run, damage) if damage else run
                        if len(word) >= least_length:
                            counts[word] += n
                    if len(counts) > COUNTED:
                        yield emit(counts)
                        counts = Counter()
        if counts:
            yield emit(counts)

    return (
        docs.select("key", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    )


class PositionIndex:
    """Bit sets over ``words``: by position and letter, and by length. Bit i is word i."""

    def __init__(self, words: list[str]):
        self.letters: list[dict[str, int]] = []
        self.lengths: dict[int, int] = {}
        places: list[dict[str, list[int]]] = []
        for i, word in enumerate(words):
            self.lengths[len(word)] = self.lengths.get(len(word), 0) | 1 << i
            while len(places) < len(word):
                places.append({})
            for at, letter in enumerate(word):
                places[at].setdefault(letter, []).append(i)
        n_bytes = len(words) // 8 + 1
        for at_place in places:
            sets = {}
            for letter, members in at_place.items():
                bits = bytearray(n_bytes)
                for i in members:
                    bits[i >> 3] |= 1 << (i & 7)
                sets[letter] = int.from_bytes(bits, "little")
            self.letters.append(sets)
        self.all = (1 << len(words)) - 1

    def at(self, position: int, letter: str) -> int:
        if 0 <= position < len(self.letters):
            return self.letters[position].get(letter, 0)
        return 0

    def near(self, word: str) -> int:
        """The words exactly one insertion, deletion or replacement away, as a bit set."""
        equal, replaced, longer, shorter = self.all, 0, 0, 0
        for i, letter in enumerate(word):
            here, behind, ahead = self.at(i, letter), self.at(i - 1, letter), self.at(i + 1, letter)
            replaced = replaced & here | equal & ~here
            longer = (longer | equal) & ahead
            shorter = shorter & behind | equal
            equal &= here
            if not (equal or replaced or longer or shorter):
                return 0
        size = self.lengths.get
        return (
            replaced & size(len(word), 0)
            | (longer | equal) & size(len(word) + 1, 0)
            | shorter & size(len(word) - 1, 0)
        )


def members(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def edges(word: Column) -> Column:
    """The two shards of a word: its first letters and its last."""
    return F.array(
        F.concat(F.lit("<"), F.substring(word, 1, EDGE)), F.concat(F.substring(word, -EDGE, EDGE), F.lit(">"))
    )


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs of ``words`` (``word``, ``n``; distinct words of six code points or more) exactly
    one edit apart, in both directions: ``word``, ``n``, ``other``, ``other_n``.

    A shard is a stretch of the vocabulary that shares its first or last letters. Small shards
    fill a block together; one of more than ``block`` words is dealt over several blocks, each
    of which meets each, so no task holds more than two blocks whatever a shard's size.
    """
    n = words.count()
    together = max(2 * n // block, 1)
    dealt = words.select("word", "n", F.explode(edges(F.col("word"))).alias("shard"))
    sizes = dealt.groupBy("shard").agg(F.ceil(F.count("*") / block).alias("blocks"))
    sharded = dealt.join(sizes, "shard")
    small = sharded.where("blocks = 1").select(
        "word", "n", F.pmod(F.xxhash64("shard"), F.lit(together)).cast("string").alias("cell"), F.lit(0).alias("side")
    )
    own = F.pmod(F.xxhash64("word"), F.col("blocks"))
    large = (
        sharded.where("blocks > 1")
        .withColumn("own", own)
        .withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(
            "word",
            "n",
            F.concat_ws(
                "|", "shard", F.least("own", "met").cast("string"), F.greatest("own", "met").cast("string")
            ).alias("cell"),
            # the lower block is indexed, the higher one asks; a block that meets itself does both
            F.when(F.col("own") == F.col("met"), 0).when(F.col("own") < F.col("met"), 1).otherwise(2).alias("side"),
        )
    )

    def found(rows: list[tuple[str, int, int]]) -> tuple[list, list, list, list]:
        indexed = [(w, n) for w, n, side in rows if side < 2]
        asking = [(w, n) for w, n, side in rows if side != 1]
        itself = rows[0][2] == 0
        columns: tuple[list, list, list, list] = ([], [], [], [])
        if not indexed or not asking:
            return columns
        index = PositionIndex([w for w, _ in indexed])
        for word, n in asking:
            for i in members(index.near(word)):
                other, other_n = indexed[i]
                if itself and other < word:  # this one asks as well
                    continue
                for column, value in zip(columns, (word, n, other, other_n)):
                    column.append(value)
        return columns

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []

        def pairs() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(found(rows), kinds)], ["word", "n", "other", "other_n"]
            )

        for batch in batches:
            for name, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if name != cell:
                    if rows:
                        yield pairs()
                    cell, rows = name, []
                rows.append(tuple(row))
        if rows:
            yield pairs()

    cells = small.unionByName(large).repartition("cell").sortWithinPartitions("cell")
    pairs = cells.select("cell", "word", "n", "side").mapInArrow(
        search, "word string, n long, other string, other_n long"
    )
    turned = pairs.select(
        F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")
    )
    # a pair meets twice where the words share both ends
    return pairs.unionByName(turned).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: where following ``forms`` (``word``, ``form``) ends. Each round
    doubles the steps taken; a form is several times as frequent as its word, so chains are
    short and have no circles."""
    state = stage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = state.select(F.col("word").alias("at"), F.col("root").alias("further"))
        moved = stage(
            state.join(onward, F.col("root") == F.col("at"), "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
            )
        )
        state = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return state


def variants(
    docs: DataFrame,
    least_length: int = 6,
    least_count: int = 5,
    ratio: int = 5,
    damage: int = 0,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` for every word of the texts.

    Words are runs of letters from A to Z and U+00C0 to U+00FF, lower-cased from A to Z only,
    of ``least_length`` (six or more) code points and ``least_count`` occurrences. Two are near
    if exactly one inserted, deleted or replaced code point lies between them. A word's form is
    its near word of the largest ``n``, the smallest of equally frequent ones, if that is at
    least ``ratio`` (two or more) times the word's own; its root is where its forms end, itself
    without any. With ``damage``, one code point of a run is left out wherever that number
    divides the CRC-32 of ``<key>:<run>``, at the place the CRC names. Null and empty texts have
    no words; a null key counts as the word null; each repeated row counts. Without any word
    the result is empty.
    """
    if least_length < 2 * EDGE or ratio < 2:
        raise ValueError("words have six code points or more, forms are at least twice as frequent")
    named = picked(docs, key=F.coalesce(docs[key].cast("string"), F.lit("null")), text=text)
    words = stage(word_counts(named, least_length, damage).where(F.col("n") >= least_count))
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    judged = stage(
        near_pairs(words)
        .groupBy("word", "n")
        .agg(F.count("*").alias("n_near"), best.alias("best"))
        .withColumn("formed", -F.col("best.n") >= ratio * F.col("n"))
        .select(
            "word",
            "n_near",
            F.when(F.col("formed"), F.col("best.word")).alias("form"),
            F.when(F.col("formed"), -F.col("best.n")).alias("form_n"),
        )
    )
    ends = roots(judged.where("form IS NOT NULL"))
    return (
        words.join(judged, "word", "left")
        .join(ends, "word", "left")
        .select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            "form",
            "form_n",
            F.coalesce("root", "word").alias("root"),
        )
    )
