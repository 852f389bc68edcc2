"""A filtered positional index: where terms can begin in normalized texts.

A term's head is its first ``HEAD`` characters as one number, exact, since normalized text has
36 different characters. A task normalizes folded texts by deleting all other characters, many
texts in one array. Positions where no term's first ``PREFIX`` characters stand go first; of the
others the numbers of the heads that can begin there are tested against a bitmap of all terms'
heads, of bounded size. Only positions that pass leave the task, so what is joined with the
terms follows the matches, neither the length of the texts nor the number of terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a head: the longest whose number fits in 63 bits.
HEAD = 12
BASE = 37
#: Bits of the bitmap: 16 MiB at most, whatever the number of terms. A position that passes by
#: chance costs one row, which the join drops.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
BITS_PER_HEAD = 64
#: Characters that tell at first whether a term can begin: a table of 50,653 places.
PREFIX = 3
#: Positions looked at together, bytes of texts taken together (a longer text by itself), and
#: rows handed on together.
BLOCK = 1 << 16
TEXTS = 1 << 22
ROWS = 1 << 15
#: The digit of each byte: 1 to 36 for 0-9 and a-z (A-Z like a-z), 0 for what normal text lacks.
DIGITS = np.array(
    [b - 47 if 48 <= b <= 57 else (b | 32) - 86 if 97 <= b | 32 <= 122 and b < 128 else 0 for b in range(256)], np.uint8
)
CHARACTERS = np.frombuffer(b" 0123456789abcdefghijklmnopqrstuvwxyz", np.uint8)


def head_number(term: str) -> Column:
    """The number of the head of a normalized term column."""
    return F.expr(
        f"""aggregate(filter(split(substring({term}, 1, {HEAD}), ''), c -> c <> ''), 0L,
            (k, c) -> k * {BASE} + if(c <= '9', ascii(c) - 47, ascii(c) - 86))"""
    )


@dataclass(frozen=True)
class HeadFilter:
    """A bitmap of the heads, the sizes of heads in use, the length of the longest term, and
    which numbers of ``prefix`` characters begin a term."""

    bits: int
    table: np.ndarray
    sizes: frozenset[int]
    longest: int
    prefix: int = 1
    begins: np.ndarray = field(default_factory=lambda: np.ones(BASE, bool))

    def passing(self, numbers: np.ndarray) -> np.ndarray:
        places = (numbers ^ (numbers >> 13) ^ (numbers >> 31)) & (self.bits - 1)
        return np.flatnonzero((self.table[places >> 3] >> (places & 7).astype(np.uint8)) & 1)


def head_filter(terms: DataFrame, most_bits: int = MOST_BITS) -> HeadFilter:
    """The filter of ``terms`` (``head``, ``term``). Spark builds the bitmap in pieces of 4 KiB,
    of which ``most_bits`` allow 4096."""
    found = terms.groupBy(F.least(F.length("term"), F.lit(HEAD)).alias("size")).agg(
        F.count("*").alias("n"), F.max(F.length("term")).alias("longest")
    ).collect()  # a row for each size of head
    n = sum(r["n"] for r in found)
    prefix = min([PREFIX, *(r["size"] for r in found)])
    begins = np.zeros(BASE**prefix, bool)
    first = head_number(f"substring(term, 1, {prefix})").cast("int")
    begins[[r["first"] for r in terms.select(first.alias("first")).distinct().collect()]] = True  # 50,653 at most
    bits = min(LEAST_BITS, most_bits)
    while bits < min(n * BITS_PER_HEAD, most_bits):
        bits *= 2
    mixed = F.col("head").bitwiseXOR(F.shiftright("head", 13)).bitwiseXOR(F.shiftright("head", 31))
    place = mixed.bitwiseAND(F.lit(bits - 1)) + 1
    rows = (
        terms.select(place.alias("place"))
        .groupBy(F.bitmap_bucket_number("place").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("block"))
        .collect()
    )
    width = len(rows[0]["block"]) if rows else 1
    table = np.zeros(max(bits // 8, width), np.uint8)
    for row in rows:
        start = (row["bucket"] - 1) * width
        table[start : start + width] = np.frombuffer(row["block"], np.uint8)
    sizes = frozenset(r["size"] for r in found)
    return HeadFilter(bits, table, sizes, max((r["longest"] for r in found), default=0), prefix, begins)


def heads_of(
    digits: np.ndarray, ends: np.ndarray, wanted: HeadFilter
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Size of head, texts, positions and numbers of the heads that pass the filter, block by
    block, in ``digits`` of texts that end at ``ends`` and lie behind one another."""
    for start in range(0, len(digits), BLOCK):
        block = digits[start : start + BLOCK + wanted.prefix - 1]
        numbers = np.zeros(max(len(block) - wanted.prefix + 1, 0), np.int64)
        for i in range(wanted.prefix):
            numbers = numbers * BASE + block[i : i + len(numbers)]
        at = np.flatnonzero(wanted.begins[numbers])
        numbers, at = numbers[at], at + start
        texts = np.searchsorted(ends, at, "right")
        left = ends[texts] - at
        for size in range(wanted.prefix, max(wanted.sizes, default=0) + 1):
            inside = left >= size
            if not inside.all():
                numbers, at, texts, left = numbers[inside], at[inside], texts[inside], left[inside]
            if size > wanted.prefix:
                numbers = numbers * BASE + digits[at + (size - 1)]
            if size in wanted.sizes:
                passing = wanted.passing(numbers)
                yield size, texts[passing], at[passing], numbers[passing]


def heads_in(text: str, wanted: HeadFilter) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Size of head, positions and numbers of the heads in one text that pass the filter."""
    for size, _, at, heads in heads_of(*normal_digits(pa.array([text])), wanted):
        yield size, at, heads


def normal_digits(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The digits of folded texts, those of other characters left out, and where each ends."""
    values = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    codes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    digits = DIGITS[codes]
    kept = digits > 0
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(kept, dtype=np.int64)])
    return digits[kept], before[offsets[1:] - offsets[0]]


def term_starts(rows: DataFrame, wanted: HeadFilter, text: str) -> DataFrame:
    """``rows`` without the folded ``text``, once for each different head of its normal form that
    passes: ``head``, and ``rest``, the normal text from there as far as the longest term goes,
    where a term may be longer than its head."""
    context = SparkContext.getOrCreate()
    shared = context.broadcast(wanted)  # a bitmap of 16 MiB at most
    kept = [c for c in rows.columns if c != text]

    def starts(texts: pa.Array, wanted: HeadFilter) -> Iterator[tuple[int, int, str | None]]:
        """Number of the text, head and rest."""
        digits, ends = normal_digits(texts)
        for size, numbers, at, heads in heads_of(digits, ends, wanted):
            if size == HEAD and wanted.longest > HEAD:
                for number, i, head in zip(numbers.tolist(), at.tolist(), heads.tolist()):
                    rest = digits[i : min(i + wanted.longest, ends[number])]
                    yield number, head, CHARACTERS[rest].tobytes().decode()
            else:
                yield from zip(numbers.tolist(), heads.tolist(), [None] * len(heads))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value

        def built(batch: pa.RecordBatch, found: list[tuple[int, int, str | None]]) -> pa.RecordBatch:
            numbers, heads, rests = zip(*found)
            at = pa.array(numbers, pa.int64())
            columns = [batch.column(c).take(at) for c in kept]
            columns += [pa.array(heads, pa.int64()), pa.array(rests, pa.string())]
            return pa.RecordBatch.from_arrays(columns, [*kept, "head", "rest"])

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
            groups = np.cumsum(lengths, dtype=np.int64) // TEXTS
            bounds = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
            for first, end in zip(bounds, bounds[1:]):
                part = batch.slice(first, end - first)
                # a dictionary keeps each head of a text once
                found: dict[tuple[int, int, str | None], None] = {}
                for start in starts(part.column(text), wanted):
                    found[start] = None
                    if len(found) >= ROWS:
                        yield built(part, list(found))
                        found = {}
                if found:
                    yield built(part, list(found))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != text)
    return rows.select(*kept, text).mapInArrow(find, f"{schema}, head long, rest string")
