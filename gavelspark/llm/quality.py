"""Weak supervision of text quality: rules vote or abstain, expectation-maximisation finds how
far each can be trusted, and the posterior probability decides.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelspark.sources.storage import stage

WINDOW = 5
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\v\f\r"
BASE = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper_words",
    "n_exclaimed",
    "n_distinct",
    "n_alnum",
    "n_plain_words",
)
#: A word of letters with at most one mark behind it.
PLAIN = re.compile(r"(?<![^ \t\n\v\f\r])[^\W\d_]+[.,;:!?]?(?![^ \t\n\v\f\r])")
NOT_ALNUM = re.compile(r"[\W_]+")
BASE_TYPE = T.StructType([T.StructField(n, T.LongType()) for n in BASE])
GOOD, ABSTAIN, BAD = 1, 0, -1


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of 5 that occur twice or more in the text, the first included."""
    if len(words) <= WINDOW:
        return 0
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    total = end = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + WINDOW - max(i, end)
            end = i + WINDOW
    return total


def base_counts(text: str | None) -> tuple[int, ...]:
    """The counts named in ``BASE`` for one whole text."""
    if not text:
        return (0,) * len(BASE)
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(map(bytes.isupper, words)),
        text.count("!"),
        len(set(words)),
        len(NOT_ALNUM.sub("", text)),
        len(PLAIN.findall(text)),
    )


def _base(texts: pa.Array) -> pa.Array:
    rows = [base_counts(t.as_py()) for t in texts]
    columns = zip(*rows) if rows else ((),) * len(BASE)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(BASE))


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the base counts."""
    frame = docs.select(docs[key].alias(key), F.arrow_udf(_base, BASE_TYPE)(docs[text]).alias("__base"))
    return frame.select(key, "__base.*")


def share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def between(value: Column, good: Column, bad: Column) -> Column:
    return F.when(good, GOOD).when(bad, BAD).otherwise(ABSTAIN)


def votes() -> dict[str, Column]:
    """Each rule's vote: good, bad, or an abstention where the text says too little. Every kind
    of junk is met by two rules or more, as accuracies are learnt from what rules agree on."""
    length = share("word_chars", "n_words")
    symbols, shouted = share("n_symbols", "n_words"), share("n_upper_words", "n_words")
    exclaimed, repeated = share("n_exclaimed", "n_words"), share("n_repeat_words", "n_words")
    variety, copied = share("n_distinct", "n_words"), share("n_dup_lines", "n_lines")
    plain, marks = share("n_plain_words", "n_words"), 1 - share("n_alnum", "word_chars")
    enough = F.col("n_words") >= 50
    return {
        "word_length": between(length, length.between(3, 12), (length < 2) | (length > 20)),
        "plain_words": between(plain, plain > 0.9, plain < 0.6),
        "marks": between(marks, marks < 0.06, marks > 0.15),
        "symbols": between(symbols, symbols < 0.02, symbols > 0.1),
        "capitals": between(shouted, shouted < 0.1, shouted > 0.4),
        "exclamations": between(exclaimed, exclaimed < 0.02, exclaimed > 0.2),
        "repeats": between(repeated, repeated < 0.05, repeated > 0.2),
        "variety": between(variety, enough & (variety > 0.3), enough & (variety < 0.15)),
        "lines": between(copied, copied < 0.1, (F.col("n_lines") >= 4) & (copied > 0.3)),
        "length": between(length, enough, F.col("n_words") < 10),
    }


@dataclass(frozen=True)
class LabelModel:
    """Log evidence for good against bad: of each rule's good and bad votes, and before any."""

    prior: float
    evidence: dict[str, dict[int, float]]

    def probability(self, voted: dict[str, Column]) -> Column:
        """Posterior probability that a text is good. An abstention says nothing."""
        total = F.lit(self.prior)
        for rule, value in voted.items():
            total = total + F.when(value == GOOD, self.evidence[rule][GOOD]).when(
                value == BAD, self.evidence[rule][BAD]
            ).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def patterns(frame: DataFrame, voted: dict[str, Column]) -> DataFrame:
    """How often each combination of votes occurs: 3 to the number of rules rows at most."""
    rows = frame.select(*(v.alias(n) for n, v in voted.items()))
    return rows.groupBy(*voted).agg(F.count("*").alias("n"))


def fit(counts: DataFrame, rules: list[str], rounds: int = 100) -> LabelModel:
    """Accuracies by expectation-maximisation over the counted vote combinations.

    A rule has two of them: how often its vote is right on good texts and how often on bad
    ones, where it does not abstain. Junk has many kinds and a rule knows one, so a bad vote
    is rare even on bad texts; the rounds therefore start from the belief that a text with a
    bad vote is probably bad. Pseudo-votes keep accuracies off 0 and 1, and a vote's evidence
    never turns against its meaning. Without texts the model rests on the pseudo-votes.
    """
    if len(rules) > 10:
        raise ValueError("vote combinations of more than ten rules are not collected")
    table = np.array([[r[n] for n in (*rules, "n")] for r in counts.collect()], dtype=np.int64)
    table = table.reshape(-1, len(rules) + 1)
    table = table[np.lexsort(table.T)]
    seen, n = table[:, :-1], table[:, -1].astype(float)
    is_good, is_bad = seen == GOOD, seen == BAD
    good = np.where(is_bad.any(1), 0.1, 0.99)
    for _ in range(rounds):
        prior = float(np.clip((n @ good + 9) / (n.sum() + 10), 0.5, 0.99))
        weight = n * good
        right_on_good = (weight @ is_good + 1.9) / (weight @ (is_good | is_bad) + 2)
        weight = n * (1 - good)
        right_on_bad = (weight @ is_bad + 0.4) / (weight @ (is_good | is_bad) + 2)
        for_good = np.maximum(np.log(right_on_good / (1 - right_on_bad)), 0)
        for_bad = np.minimum(np.log((1 - right_on_good) / right_on_bad), 0)
        odds = np.log(prior / (1 - prior)) + is_good @ for_good + is_bad @ for_bad
        good = 1 / (1 + np.exp(-odds))
    return LabelModel(
        math.log(prior / (1 - prior)),
        {r: {GOOD: float(for_good[i]), BAD: float(for_bad[i])} for i, r in enumerate(rules)},
    )


def assess(
    docs: DataFrame,
    threshold: float = 0.5,
    model: LabelModel | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``key``, the base counts, ``base_failed``, ``probability``, ``kept``.

    A text fails the base rules with fewer than 10 words, or with more than a fifth of its
    words in repeated windows; otherwise it is kept if its posterior probability of being good
    reaches ``threshold``. Without ``model`` the rules' accuracies are learnt from the votes
    over all of ``docs``. Null and empty texts have no words and fail. Every row gets a result
    row; an empty table gives an empty result.
    """
    counts = stage(counted(docs, key, text))
    voted = votes()
    model = model or fit(patterns(counts, voted), list(voted))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counts.select(
        key,
        *BASE,
        failed.alias("base_failed"),
        model.probability(voted).alias("probability"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= threshold))
