"""Token counts of byte-level BPE vocabularies, with a shortcut for whole tokens.

The merges of a vocabulary prove, without any text, which of its strings come out as one token
when they stand alone. A pre-token among these counts one and needs no merging; only the rest
is merged, each distinct pre-token once while a worker remembers it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Fixed value: how byte-level BPE cuts a text into pre-tokens. White space is the Unicode
#: property, as in the library; Python's own class would add four control characters.
PRE_TOKENS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: The same cut where all characters are below U+0250 and no superscript or fraction: these
#: classes are then the property classes, and the plain engine is three times as fast.
LATIN = r"[\x00-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]*"
LATIN_LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
LATIN_SPACE = r"\t-\r \x85\xa0"
LATIN_PRE_TOKENS = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN_LETTERS}]+| ?[0-9]+| ?[^{LATIN_SPACE}{LATIN_LETTERS}0-9]+"
    rf"|[{LATIN_SPACE}]+(?![^{LATIN_SPACE}])|[{LATIN_SPACE}]+"
)
#: Merged pre-tokens a worker remembers before it starts anew.
REMEMBERED = 600_000
#: Longer pre-tokens are not remembered.
SHORT = 40


def byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the
    characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@dataclass(frozen=True)
class Vocabulary:
    """What counting needs. Its size is the vocabulary's, whatever the amount of text."""

    described: str  # the tokenizer file
    whole: frozenset[str]  # pre-tokens proven to be one token
    specials: tuple[str, ...]


def symbols_of_bytes() -> list[str]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the
    characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def merger(described: str) -> Callable[[str], int]:
    """The number of tokens the vocabulary's merges leave of one pre-token."""
    merge = Tokenizer.from_str(described).model.tokenize
    symbols = dict(enumerate(symbols_of_bytes()))
    return lambda piece: len(merge(piece.encode().decode("latin-1").translate(symbols)))


@lru_cache(maxsize=4)
def read_vocabulary(path: str) -> Vocabulary:
    """Read a tokenizer file and prove its whole tokens. Files with a normalizer or another
    cut than byte-level BPE's are refused, as their counts would differ."""
    with open(path, encoding="utf-8") as file:
        described = file.read()
    content = json.loads(described)
    cut = content["pre_tokenizer"] or {}
    if (
        content["model"]["type"] != "BPE"
        or content["normalizer"]
        or cut.get("type") != "ByteLevel"
        or cut.get("add_prefix_space")
        or not cut.get("use_regex", True)
        or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in content["added_tokens"])
    ):
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    bytes_of = {ord(s): b for b, s in enumerate(symbols_of_bytes())}
    merge, whole = merger(described), set()
    for token in content["model"]["vocab"]:
        if all(ord(c) in bytes_of for c in token):
            try:
                piece = bytes(bytes_of[ord(c)] for c in token).decode()
            except UnicodeDecodeError:
                continue  # part of a character: never a pre-token of its own
            if merge(piece) == 1:
                whole.add(piece)
    specials = tuple(t["content"] for t in content["added_tokens"])
    return Vocabulary(described, frozenset(whole), specials)


class Counter:
    """Counts tokens of texts inside a task."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.merged = merger(vocabulary.described)
        self.latin = re.compile(LATIN).fullmatch
        self.cut_latin = re.compile(LATIN_PRE_TOKENS).findall
        self.cut = regex.compile(PRE_TOKENS).findall
        self.specials = re.compile(
            "|".join(map(re.escape, sorted(vocabulary.specials, key=len, reverse=True)))
        )
        self.known = dict.fromkeys(vocabulary.whole, 1)

    def merge(self, piece: str) -> int:
        n = self.merged(piece)
        if len(piece) <= SHORT:
            if len(self.known) >= len(self.vocabulary.whole) + REMEMBERED:
                self.known = dict.fromkeys(self.vocabulary.whole, 1)
            self.known[piece] = n
        return n

    def plain(self, text: str) -> int:
        pieces = (self.cut_latin if self.latin(text) else self.cut)(text)
        counts = list(map(self.known.get, pieces))
        total = sum(filter(None, counts))
        if None in counts:
            total += sum(self.merge(p) for p, n in zip(pieces, counts) if n is None)
        return total

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if not any(s in text for s in self.vocabulary.specials):
            return self.plain(text)
        parts = self.specials.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


_counters: dict[str, Counter] = {}


def _count(texts: pa.Array, path: str, shared) -> pa.Array:
    """One counter for each worker, which remembers merged pre-tokens from task to task."""
    if path not in _counters:
        _counters[path] = Counter(shared.value)
    counter = _counters[path]
    return pa.array([counter(t.as_py()) for t in texts], pa.int64())


def n_tokens(text: Column, path: str) -> Column:
    """Tokens of a text (null: none) as the vocabulary file at ``path`` gives them, without
    begin, end or padding tokens. A special token's string inside a text is that token, as is
    the library's default. The file is read on the driver; executors get its content."""
    shared = SparkContext.getOrCreate().broadcast(read_vocabulary(path))

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return _count(texts, path, shared)

    return count(text)


def token_counts(
    docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``).

    One row for each row of ``docs``, repeated ones included; null and empty texts count 0.
    Texts may be of any length. An empty table
    gives an empty result.
    """
    frame = docs.select(
        docs[key].alias(key),
        F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long").alias("n_bytes"),
        n_tokens(docs[text], path).alias("n_tokens"),
    )
    return frame.withColumn("over_limit", F.col("n_tokens") > limit)
