"""Language identification by words first, backing off to shorter and shorter character n-grams.

A known word scores its log frequency in each language. A word never seen in training scores
the mean log frequency of its known 5-grams; if it has none, of its 4-grams, and so on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelspark.llm.common import picked
from gavelspark.sources.storage import stage

UNKNOWN = "und"
LONGEST = 5
#: A longer run of letters is not listed as a word; training counts its n-grams like any other's.
WORD_LIMIT = 40
#: A letter and what follows it: letters and the marks that combine with them.
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*+")
ASCII_WORDS = re.compile(r"[a-z]+")
#: Bytes of words a task remembers the n-grams of before it starts anew.
REMEMBERED = 8 << 20
#: Texts differ from those that training has read.
SLACK = 0.75


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    return (ASCII_WORDS if text.isascii() else WORDS).findall(text)


def marked(word: str) -> str:
    return f"^{word}$"


@dataclass(frozen=True)
class Model:
    """Rows of log frequencies by language; ``grams[n]`` maps n-grams to rows, ``words`` words."""

    languages: tuple[str, ...]
    scores: np.ndarray  # row, language
    words: dict[str, int]
    grams: tuple[dict[str, int], ...]  # by length, from 1
    seen: np.ndarray | None = None  # row, language: how often training met it there


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.update((lang, w) for w in words_of(text))
        langs, words = zip(*counts) if counts else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts.values(), pa.int64())],
            ["lang", "gram", "n"],
        )


def training_sample(
    docs: DataFrame, per_language: int, languages: int, key: str, text: str, lang: str
) -> tuple[tuple[str, ...], DataFrame]:
    """The languages of ``docs`` and ``lang``, ``text`` of about ``per_language`` rows of each,
    chosen by a hash of key and text, so that neither null nor repeated keys are taken or left
    together. Rows equal in key and text count as one."""
    rows = picked(docs, id=key, text=text, lang=lang).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = rows.groupBy("lang").count().limit(languages + 1).collect()
    if len(sizes) > languages:
        raise ValueError(f"more than {languages} languages")
    names = tuple(sorted(r.lang for r in sizes))
    if not names:
        return names, rows.select("lang", "text")
    scale = 1 << 30
    share = reduce(
        lambda otherwise, r: F.when(
            F.col("lang") == r.lang, min(scale, scale * per_language // r["count"] + 1)
        ).otherwise(otherwise),
        sizes,
        F.lit(scale),
    )
    taken = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(scale)) < share)
    return names, taken.dropDuplicates(["id", "text", "lang"]).select("lang", "text")


def training_rows(docs: DataFrame, languages: int, key: str, text: str, lang: str) -> tuple[tuple[str, ...], DataFrame]:
    """The languages of ``docs``, and ``lang`` and ``text`` of all rows that have both."""
    rows = picked(docs, text=text, lang=lang).where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    names = [r.lang for r in rows.select("lang").distinct().limit(languages + 1).collect()]
    if len(names) > languages:
        raise ValueError(f"more than {languages} languages")
    return tuple(sorted(names)), rows


def commonest(grams: DataFrame, share: Column) -> DataFrame:
    """The ``share`` commonest n-grams of each size and language (``size``, ``lang``, ``gram``,
    ``n``), ties by n-gram. A histogram of the counts on a logarithmic scale tells what they must
    reach, so that few others are sorted."""
    levels = grams.groupBy("size", "lang", F.floor(F.log2("n") * 8).alias("level")).agg(
        F.count("*").alias("grams"), F.min("n").alias("lowest")
    )
    above = F.sum("grams").over(Window.partitionBy("size", "lang").orderBy(F.desc("level")))
    # 512 levels for each size and language at most
    bounds = levels.withColumn("__above", above).groupBy("size", "lang").agg(
        F.coalesce(F.max(F.when(F.col("__above") >= share, F.col("lowest"))), F.lit(0)).alias("__bound")
    )
    reaching = grams.join(F.broadcast(bounds), ["size", "lang"]).where("n >= __bound").drop("__bound")
    place = F.row_number().over(Window.partitionBy("size", "lang").orderBy(F.desc("n"), "gram"))
    return reaching.withColumn("__place", place).where(F.col("__place") <= share).drop("__place")


def train(
    docs: DataFrame,
    per_language: int | None = None,
    most_words: int = 40_000,
    most_grams: int = 15_000,
    languages: int = 200,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> Model:
    """Learn from the rows of ``docs`` that have a text and a language.

    All of them are counted; only a caller who names ``per_language`` gets a model of about so
    many documents of each language (``training_sample``). ``most_words`` words and, for each length,
    ``most_grams`` n-grams are kept, the commonest of each language in equal shares: these
    bounds are the model's size, whatever the amount of text, and no language crowds out
    another. More than ``languages`` values in ``lang`` are refused. Without any row the model
    knows no language.
    """
    if per_language is None:
        names, read = training_rows(docs, languages, key, text, lang)
    else:
        names, read = training_sample(docs, per_language, languages, key, text, lang)
    if not names:
        return Model((), np.zeros((1, 0)), {}, tuple({} for _ in range(LONGEST)))
    words = stage(
        read.mapInArrow(_word_counts, "lang string, gram string, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    edged = F.concat(F.lit("^"), "gram", F.lit("$"))
    grams = reduce(
        DataFrame.unionByName,
        (
            words.where(F.length(edged) >= size)
            .withColumn("at", F.explode(F.sequence(F.lit(1), F.length(edged) - size + 1)))
            .select("lang", F.substring(edged, F.col("at"), F.lit(size)).alias("gram"), "n")
            .groupBy("lang", "gram")
            .agg(F.sum("n").alias("n"))
            .withColumn("size", F.lit(size))
            for size in range(1, LONGEST + 1)
        ),
    ).unionByName(words.where(F.length("gram") <= WORD_LIMIT).withColumn("size", F.lit(0)))
    grams = stage(grams)
    totals = {(r.size, r.lang): r.n for r in grams.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()}
    share = {size: -(-(most_grams if size else most_words) // len(names)) for size in range(LONGEST + 1)}
    listed = commonest(grams, F.when(F.col("size") == 0, share[0]).otherwise(share[1]))
    kept = grams.join(listed.select("size", "gram").distinct(), ["size", "gram"]).toPandas()
    words_by: dict[str, int] = {}
    grams_by: list[dict[str, int]] = [{} for _ in range(LONGEST)]
    table, seen = [], []
    number = {v: i for i, v in enumerate(names)}
    first = 0
    for size in range(LONGEST + 1):
        of_size = kept[kept["size"] == size]
        listed_grams = sorted(set(of_size["gram"]))
        into = grams_by[size - 1] if size else words_by
        into.update(zip(listed_grams, range(first, first + len(listed_grams))))
        counts = np.zeros((len(listed_grams), len(names)))
        counts[[into[g] - first for g in of_size["gram"]], [number[v] for v in of_size["lang"]]] = of_size["n"]
        total = np.array([totals.get((size, v), 0) for v in names])
        seen.append(counts)
        table.append(np.log((counts + 0.5) / (total + 0.5 * len(listed_grams) + 1)))
        first += len(listed_grams)
    scores = np.concatenate(table).astype(np.float32)
    return Model(names, scores, words_by, tuple(grams_by), np.concatenate(seen).astype(np.float32))


@dataclass(frozen=True)
class Reading:
    """What a text says: its ``language`` and ``score``, how well it ``fits`` that language,
    its number of ``words`` and whether any of its letters is ``known``."""

    language: str = UNKNOWN
    score: float = 0.0
    fit: float = 0.0
    words: int = 0
    known: bool = False


class Scorer:
    """Scores texts inside a task."""

    def __init__(self, model: Model):
        self.model = model
        self.unseen: dict[str, tuple[int, list[int]]] = {}
        self.held = 0

    def back_off(self, word: str) -> tuple[int, list[int]]:
        """The length of the word's longest known n-grams and their rows; 0 and none if no
        n-gram is known."""
        edged = marked(word)
        for size in range(min(LONGEST, len(edged)), 0, -1):
            grams = [edged[i : i + size] for i in range(len(edged) - size + 1)]
            found = [r for r in map(self.model.grams[size - 1].get, grams) if r is not None]
            if found:
                return size, found
        return 0, []

    def remembered(self, word: str) -> tuple[int, list[int]]:
        found = self.unseen.get(word)
        if found is None:
            found = self.back_off(word)
            if len(word) <= WORD_LIMIT:
                size = 250 + 2 * len(word) + 8 * len(found[1])  # of the word, the list and the entry
                if self.held + size > REMEMBERED:
                    self.unseen, self.held = {}, 0
                self.unseen[word] = found
                self.held += size
        return found

    def read(self, text: str | None, lang: str | None = None, trained: bool = False) -> Reading:
        """One pass over a text: the best language, and the fit to it or to ``lang``, see
        ``read_both``."""
        found, own = self.read_both(text, lang, trained)
        return found if lang is None else replace(found, fit=own or 0.0)

    def read_both(self, text: str | None, lang: str | None, trained: bool = True) -> tuple[Reading, float | None]:
        """One pass over a text: the best language and the fit to it, and with ``lang`` the fit to
        that as well.

        The fit says how much of the text training has met in the language, from 0 to 1: a
        known word counts 1, another the share of its longest known n-grams by their length.
        Of a text that training has read (``trained``), what only the text itself has taught
        does not count for ``lang``.
        """
        counts, model = Counter(words_of(text)), self.model
        n_words = counts.total()
        if not n_words or not model.languages:
            return Reading(words=n_words), None
        found = list(map(model.words.get, counts))
        rows = np.array([r for r in found if r is not None], np.int64)
        times = np.array([n for n, r in zip(counts.values(), found) if r is not None], np.float64)
        total = times @ model.scores[rows] if len(rows) else np.zeros(len(model.languages))
        unseen = [(w, n) for (w, n), r in zip(counts.items(), found) if r is None]
        if unseen:
            # every unseen word weighs as one word: its n-grams share the weight
            grams, weights = [], []
            for word, n in unseen:
                known = self.remembered(word)[1]
                if known:
                    grams += known
                    weights += [n / len(known)] * len(known)
            if grams:
                total = total + np.array(weights) @ model.scores[grams]
        best = int(np.argmax(total))
        odds = np.exp((total - total[best]) / n_words**0.5)
        score = float(odds[best] / odds.sum())
        if model.seen is None:
            return Reading(model.languages[best], score, 0.0, n_words, True), None
        words = [w for w, r in zip(counts, found) if r is not None]

        def fit(i: int, trained: bool) -> float:
            met = model.seen[rows, i] > (times if trained else 0)
            sum_met = float(times[met].sum())
            for word, n in [*unseen, *((words[j], counts[words[j]]) for j in np.flatnonzero(~met).tolist())]:
                size, known = self.remembered(word)
                if size == 1:  # the marks of the edges are no letters
                    known = [r for r in map(model.grams[0].get, word) if r is not None]
                if known:
                    met_grams = int((model.seen[known, i] > (n if trained else 0)).sum())
                    sum_met += n * met_grams / (len(word) + 3 - size) * size / (LONGEST + 1)
            return sum_met / n_words

        any_known = bool(len(rows)) or any(letter in model.grams[0] for w in counts for letter in w)
        own = None if lang is None else fit(model.languages.index(lang), trained)
        return Reading(model.languages[best], score, fit(best, False), n_words, any_known), own

    def __call__(self, text: str | None) -> tuple[str, float]:
        found = self.read(text)
        return found.language, found.score


READING = "lang_pred string, score double, fit double, words long, known boolean"


def _readings(found: list[Reading]) -> pa.Array:
    columns = [
        pa.array([r.language for r in found], pa.string()),
        pa.array([r.score for r in found], pa.float64()),
        pa.array([r.fit for r in found], pa.float64()),
        pa.array([r.words for r in found], pa.int64()),
        pa.array([r.known for r in found], pa.bool_()),
    ]
    return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "fit", "words", "known"])


def predicted(text: Column, model: Model) -> Column:
    """``lang_pred`` and ``score`` of a whole text, its ``fit`` to that language, its number of
    ``words`` and whether any of its letters is ``known``, as a struct.

    Null, empty and letterless texts are ``und`` with score 0, as is any text for a model that
    knows no language. The score is the share of the best language when evidence grows with
    the root of the number of words; equal scores go to the first language by name. A model
    without ``seen`` tells no fit (0).
    """
    shared = SparkContext.getOrCreate().broadcast(model)  # of bounded size, see ``train``

    @F.arrow_udf(READING)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)  # its memory ends with the task
        for texts in batches:
            yield _readings([scorer.read(t.as_py()) for t in texts])

    return predict(text)


def read_and_fitted(text: Column, lang: Column, model: Model) -> Column:
    """``found``, the reading of a text as ``predicted`` gives it, and ``own``, where ``lang`` is
    not null the fit of a text that training has read to that language, as a struct."""
    shared = SparkContext.getOrCreate().broadcast(model)

    @F.arrow_udf(f"found struct<{READING.replace(' ', ': ').replace(',: ', ', ')}>, own double")
    def fit(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts, langs in batches:
            both = [scorer.read_both(t.as_py(), v.as_py()) for t, v in zip(texts, langs)]
            found = _readings([reading for reading, _ in both])
            yield pa.StructArray.from_arrays([found, pa.array([own for _, own in both], pa.float64())], ["found", "own"])

    return fit(text, lang)


def held_out(key: Column) -> Column:
    """Documents that training never reads: CRC-32 of the key as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """``key``, ``held_out``, ``lang_pred``, ``score``.

    The model learns from the rows of ``docs`` that are not held out and have a language. A
    row with a null key is not held out. Each row gets a result row, repeated ones too.
    """
    model = train(docs.where(~held_out(docs[key])), key=key, text=text, lang=lang)
    return docs.select(
        docs[key].alias(key),
        held_out(docs[key]).alias("held_out"),
        predicted(docs[text], replace(model, seen=None)).alias("__predicted"),
    ).select(key, "held_out", "__predicted.lang_pred", "__predicted.score")


def in_known_language(
    docs: DataFrame,
    least: float | None = None,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """The rows of ``docs`` whose text has letters and fits the language found, with all
    columns as they came; with ``least``, only those with such a score or more.

    How well a text fits does not depend on the number of languages: it has to reach
    ``SLACK`` of what all but a hundredth of the language's training documents reach, less
    one by the root of its words, as few words say little.
    """
    learned = ~held_out(docs[key])
    model = train(docs.where(learned), key=key, text=text, lang=lang)
    # all texts are read once, for what they say and for the floors
    own = F.when(learned & docs[text].isNotNull(), docs[lang].cast("string"))
    frame = stage(docs.withColumn("__read", read_and_fitted(docs[text], own, model)))
    fits = frame.where("__read.own IS NOT NULL").groupBy(F.col(lang).cast("string").alias("lang"))
    floors = {
        r.lang: r.floor or 0.0
        for r in fits.agg(F.percentile_approx("__read.own", 0.01, 10_000).alias("floor")).collect()  # a row for each language
    }
    found = F.col("__read.found")
    floor = reduce(
        lambda otherwise, v: F.when(found["lang_pred"] == v, floors[v] * SLACK).otherwise(otherwise),
        floors,
        F.lit(0.0),
    )
    enough = found["known"] & (found["fit"] >= floor - 1 / F.sqrt(found["words"]))
    if least is not None:
        enough = enough & (found["score"] >= least)
    return frame.where((found["lang_pred"] != UNKNOWN) & enough).drop("__read")
