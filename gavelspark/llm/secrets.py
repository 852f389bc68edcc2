"""Secret scans: a random forest removes the false positives of a wide pattern.

Everything is column expressions: candidates are cut out of the text where they stand, their
features are built on the spot, and the trained trees become nested conditions. Only training
reads more than the row at hand, and what it reads is bounded.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelspark.llm.common import picked
from gavelspark.sources.storage import stage

#: Words that stand before a secret, and before what only looks like one.
SECRET_WORDS = r"(?i)(api|auth|key|token|secret|passw|pwd|credential|bearer|private|access)"
OTHER_WORDS = r"(?i)(commit|revision|checksum|sha1|sha256|md5|digest|etag|uuid|build|version|order|phone|card)"
TEST_PATHS = r"(?i)(test|example|sample|fixture|mock|docs?/)"
#: Formats whose issuer is known by their beginning.
FORMATS = (
    r"(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{20,}"
    r"|xox[abprs]-[A-Za-z0-9-]{20,}|AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])|glpat-[A-Za-z0-9_-]{20,})"
)
ISSUED = rf"(?<![A-Za-z0-9]){FORMATS}"
PEM_HEAD = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
#: A whole private key; without its last line, as far as lines of a key go on.
PEM = (
    rf"{PEM_HEAD}(?:(?:[^-]|-(?!----))*+-----END [A-Z0-9 ]{{0,40}}PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:(?:[ \t\r\n]|\\[nr])*+[A-Za-z0-9+/=]{16,}+)*+)"
)
KNOWN = rf"^{FORMATS}$|^{PEM_HEAD}"
#: What ends any other candidate.
STOP = rf"{ISSUED}|{PEM_HEAD}"
NAME = r"[A-Za-z0-9_.\-]"
SCHEME = r"(?:(?i:bearer|basic|token)[ \t]++)?+"
#: A credential word, the sign or quote behind it, and the quote that opens the value.
LEAD = (
    rf"(?<!{NAME})(?={NAME}*?{SECRET_WORDS.replace('(?i)(', '(?i:')}){NAME}++(?:\\*+[\"'`\])])*+[ \t]*+"
    rf"(?:[:=]++>?+[ \t]*+(?:\r?\n[ \t]*+)?+{SCHEME}(?:\\*+[\"'`])?+|(?:(?i:is|was)[ \t]++)?+\\*+[\"'`])"
)
#: Up to the quote that the value was opened with, or else up to white space, the next
#: NAME=value of a list, or the punctuation of the sentence.
QUOTED = "|".join(
    rf"(?<=\\{q})(?:(?!{STOP}|\\{q})[^{q}\r\n])++(?=\\{q}|{STOP})"
    rf"|(?<={q})(?<!\\{q})(?:(?!{STOP})(?:\\[^\r\n]|[^{q}\\\r\n]))++(?={q}|{STOP})"
    for q in "\"'`"
)
#: Loops are possessive: the engine walks them, where a greedy loop over characters of one and
#: two code units recurses.
BOUND = rf"(?!{STOP}|[,;&|]{NAME}++=)"
BARE = rf"(?:(?:{BOUND}[.,;:?)\]}}])*+{BOUND}[^\s\"'`<>.,;:?)\]}}])++"
#: Characters of keys and tokens; an equals sign only fills up the end.
RUN = (
    rf"(?<![A-Za-z0-9])(?:(?!{STOP})[A-Za-z0-9_+/.\-]){{11,}}(?!{STOP})[A-Za-z0-9_+/\-]"
    r"(?:={1,2}(?![A-Za-z0-9_+/.=\-]))?"
)
#: A candidate; one behind a credential word is matched with its ``LEAD``.
CANDIDATE = rf"{LEAD}(?:{PEM}|{ISSUED}|{QUOTED}|{BARE})|{PEM}|{ISSUED}|{RUN}"
WORD_BEFORE = r"([\w.\-]+)[\"'`\])\\]*(?:\s+(?:is|was))?\s*[:=>\"'`(\\]*\s*[:=\"'`(\\]*\s*$"
PLACEHOLDER = "[SECRET]"
#: Characters of text looked at on either side of a candidate.
NEAR = 40

FEATURES = (
    "length",
    "transitions",
    "digit_share",
    "hex_share",
    "upper_share",
    "distinct_share",
    "dictionary_share",
    "sign_share",
    "known_format",
    "test_path",
    "assigned",
    "secret_word",
    "other_word",
)


def kept(value: Column, pattern: str) -> Column:
    """Characters of ``value`` in the class ``pattern``."""
    return F.length(F.regexp_replace(value, f"[^{pattern}]", ""))


def transitions(value: Column) -> Column:
    """How often the kind of character changes from one to the next, for each character: a run
    of one kind is shortened to one mark and the marks are counted."""
    marks = value
    for kind, mark in (("[a-z]+", "\u0001"), ("[A-Z]+", "\u0002"), ("[0-9]+", "\u0003"), ("[_+/=.-]+", "\u0004")):
        marks = F.regexp_replace(marks, kind, mark)
    return (F.length(marks) - 1) / F.length(value)


def features(found: Column, path: Column, dictionary: list[str]) -> dict[str, Column]:
    """Features of a candidate: ``found`` is a struct of ``value``, ``before`` and ``after``."""
    value, before = found["value"], found["before"]
    length = F.length(value)
    letters = F.regexp_extract_all(F.lower(value), F.lit("([a-z]{3,})"), F.lit(1))
    words = F.array(*map(F.lit, dictionary)) if dictionary else F.array().cast("array<string>")
    known = F.filter(letters, lambda word: F.array_contains(words, word))
    word = F.regexp_extract(before, WORD_BEFORE, 1)
    return {
        "length": F.least(length, F.lit(200)),
        "transitions": transitions(value),
        "digit_share": kept(value, "0-9") / length,
        "hex_share": kept(value, "0-9a-fA-F") / length,
        "upper_share": kept(value, "A-Z") / length,
        "distinct_share": F.size(F.array_distinct(F.split(F.substring(value, 1, 64), ""))) / F.least(length, F.lit(64)),
        "dictionary_share": F.aggregate(known, F.lit(0), lambda n, w: n + F.length(w)) / length,
        "sign_share": (length - kept(value, r"A-Za-z0-9_+/=.\-")) / length,
        "known_format": value.rlike(KNOWN).cast("int"),
        "test_path": F.coalesce(path.rlike(TEST_PATHS), F.lit(False)).cast("int"),
        "assigned": before.rlike(rf"[:=]>?\s*{SCHEME}\\*[\"'`]?$").cast("int"),
        "secret_word": word.rlike(SECRET_WORDS).cast("int"),
        "other_word": word.rlike(OTHER_WORDS).cast("int"),
    }


def with_candidates(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``__found``: structs of ``value``, ``before``, ``after``; the texts around
    the values are ``__gaps``."""
    body = F.coalesce(F.col(text), F.lit(""))
    frame = docs.withColumn("__matches", F.regexp_extract_all(body, F.lit(f"({CANDIDATE})"), F.lit(1)))
    # texts without a candidate are not split
    between = F.when(F.size("__matches") > 0, F.split(body, CANDIDATE, -1)).otherwise(F.array(body))
    cut = F.zip_with(
        "__matches",
        between,
        lambda match, gap: F.struct(
            match.alias("match"), gap.alias("gap"), F.regexp_extract(match, rf"^({LEAD})[\s\S]", 1).alias("lead")
        ),
    )
    pieces = F.transform(
        cut,
        lambda c: F.struct(
            F.substr(c["match"], F.length(c["lead"]) + 1).alias("value"),
            c["gap"].alias("between"),
            F.concat(c["gap"], F.coalesce(c["lead"], F.lit(""))).alias("gap"),
        ),
    )
    frame = frame.withColumn("__pieces", pieces)
    frame = frame.withColumn("__values", F.slice(F.col("__pieces")["value"], 1, F.size("__pieces") - 1))
    frame = frame.withColumn("__gaps", F.col("__pieces")["gap"])
    found = F.transform(
        F.slice("__pieces", 1, F.size("__pieces") - 1),
        lambda piece, i: F.struct(
            piece["value"].alias("value"),
            # a candidate may be the word that the next one stands behind
            F.substring(
                F.concat(
                    F.when(i > 0, F.substring(F.get("__pieces", i - 1)["value"], -NEAR, NEAR)).otherwise(""),
                    piece["gap"],
                ),
                -NEAR,
                NEAR,
            ).alias("before"),
            F.substring(F.get("__pieces", i + 1)["between"], 1, NEAR).alias("after"),
            piece["gap"].alias("gap"),
        ),
    )
    return frame.withColumn("__found", found)


@dataclass(frozen=True)
class Forest:
    """Trees as text over feature names, and the dictionary the features were built with."""

    trees: tuple[str, ...]
    dictionary: tuple[str, ...]

    def score(self, named: dict[str, Column]) -> Column:
        """Share of the trees that call a candidate a secret."""
        if not self.trees:
            return named["known_format"].cast("double")
        votes = [tree_of(tree.splitlines(), named)[0] for tree in self.trees]
        return reduce(lambda a, b: a + b, votes) / F.lit(float(len(votes)))


CONDITION = re.compile(r"\s*If \(feature (\d+) (<=|>) (\S+)\)")
LEAF = re.compile(r"\s*Predict: (\S+)")


def tree_of(lines: list[str], named: dict[str, Column]) -> tuple[Column, list[str]]:
    """A printed tree as a nested condition."""
    if leaf := LEAF.match(lines[0]):
        return F.lit(float(leaf[1])), lines[1:]
    condition = CONDITION.match(lines[0])
    feature, limit = named[FEATURES[int(condition[1])]], float(condition[3])
    yes, rest = tree_of(lines[1:], named)
    no, rest = tree_of(rest[1:], named)  # behind the line of the other case
    return F.when(feature <= limit, yes).otherwise(no), rest


def common_words(docs: DataFrame, text: str, most: int) -> list[str]:
    """The commonest words of three letters or more in all rows."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit("([a-z]{3,})"), F.lit(1))
    counted = docs.select(F.explode(words).alias("word")).groupBy("word").count()
    return [r.word for r in counted.orderBy(F.desc("count"), "word").limit(most).collect()]


def share_of(docs: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows of ``docs``, chosen by a hash of key and text, rows equal in all
    columns counted as one; all if there are fewer."""
    scale = 1 << 30
    total = docs.count()
    limit = scale if total <= most else scale * most // total
    return docs.where(F.pmod(F.xxhash64("id", "text"), F.lit(scale)) < limit).distinct()


def labelled_findings(found: DataFrame) -> DataFrame:
    """Findings with a label, from candidates of the corpus.

    No table of reviewed findings exists, so labels come from what is certain about a candidate:
    a known format or a long hexadecimal or mixed value assigned to a credential is a secret; a
    number alone, or a value that nothing is said about, is not. Each secret is also shown as
    the reviewers' usual false alarm, the same value behind a word like commit or checksum, and
    with other credential words, as other encodings and in a known format behind any word, so
    that the trees do not hang on the words and shapes of this corpus.
    """
    value, before = F.col("found.value"), F.col("found.before")
    behind = r"\w*\\*[\"'`]?\s*[:=]>?\s*" + SCHEME + r"\\*[\"'`]?$"
    credential = before.rlike(SECRET_WORDS + behind)
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.length(value) >= 16)
    password = before.rlike(r"(?i)(passw|pwd|secret|credential)" + behind) & ~value.rlike(r"\s")
    signs = value.rlike("[A-Za-z]") & value.rlike(r"[0-9!@#$%^&*?~]") & (F.length(value) >= 6)
    secret = value.rlike(KNOWN) | (credential & mixed & ~value.rlike(r"\s")) | (password & signs)
    rows = found.withColumn("label", secret.cast("double")).select("id", "path", "found", "label")
    pick = F.xxhash64("id", "found.value")
    secrets = rows.where("label = 1")

    def shown(words: tuple[str, ...], shape: Column, label: float) -> DataFrame:
        word = F.get(F.array(*map(F.lit, words)), F.pmod(pick, F.lit(len(words))).cast("int"))
        new = F.struct(shape.alias("value"), word.alias("before"), F.col("found.after").alias("after"))
        return secrets.select("id", "path", new.alias("found"), F.lit(label).alias("label"))

    encoded = F.regexp_replace(F.base64(F.unhex(F.sha2(value, 256))), "=+$", "")
    upper = F.concat(F.lit("AKIA"), F.substring(F.upper(F.sha2(value, 256)), 1, 16))
    letters = F.translate(encoded, "0123456789+/", "gHiJkLmNoPqR")
    key_without_digit = F.translate(upper, "0123456789", "GHIJKLMNOP")
    sign = F.substring(F.lit("!@#$%^&*?~"), (F.pmod(pick, F.lit(10)) + 1).cast("int"), F.lit(1))
    short = F.concat(F.substring(encoded, 1, 5), sign, F.substring(F.sha2(value, 256), 1, 3))
    word = F.concat(F.regexp_extract(F.lower("found.after"), "[a-z]{3,}", 0), F.substring(F.sha2(value, 256), 1, 1), sign, F.lit("7"))
    block = F.concat(F.lit("-----BEGIN PRIVATE KEY-----\n"), F.repeat(encoded, 4), F.lit("\n-----END PRIVATE KEY-----"))
    prose = F.coalesce(F.nullif(F.regexp_extract("found.after", "[^\\W\\d_]{3,}", 0), F.lit("")), F.lit("value"))
    credentials = (
        'api_key = "', "password: '", "SECRET=", 'auth_token: "', "access key = ", 'private_key="',
        "?token=", "&access_token=", "export API_KEY=", "Authorization: Bearer ",
    )
    passwords = ("password: '", 'passwd = "', "DB_PASSWORD=", 'pwd: "', "secret = '", "password=", 'password is "')
    anything = ("then ", "see ", "", "(", "with ", "- ")
    harmless = ("commit ", "checksum: ", "sha1 = ", "digest=", "build version: ", "revision ")
    return reduce(
        DataFrame.unionByName,
        (
            rows,
            shown(credentials, value, 1.0),
            shown(credentials, encoded, 1.0),
            shown(credentials, upper, 1.0),
            shown(anything, upper, 1.0),
            shown(anything, key_without_digit, 1.0),
            shown(anything, block, 1.0),
            shown(credentials, letters, 1.0),
            shown(passwords, short, 1.0),
            shown(passwords, word, 1.0),
            shown(credentials, prose, 0.0),
            shown(passwords, prose, 0.0),
            shown(harmless, letters, 0.0),
            shown(harmless, short, 0.0),
            shown(harmless, value, 0.0),
            shown(harmless, encoded, 0.0),
        ),
    )


def train(
    docs: DataFrame,
    sample: int = 20_000,
    findings: int = 20_000,
    words: int = 1_000,
    trees: int = 15,
    depth: int = 5,
    seed: int = 7,
    key: str = "doc_id",
    text: str = "text",
    path: str = "source",
) -> Forest:
    """A forest from the candidates of about ``sample`` rows, at most ``findings`` of them, and
    a dictionary of the ``words`` commonest words, which are counted over all rows.

    Without any secret, or nothing but secrets, among the findings, there is nothing to learn,
    and only known formats are called secrets.
    """
    rows = picked(docs, id=key, text=text, path=F.col(path) if path else F.lit(None).cast("string"))
    rows = rows.where("text IS NOT NULL")
    dictionary = common_words(rows, "text", words)
    taken = share_of(rows, sample)
    found = with_candidates(taken, "text").select("id", "path", F.explode_outer("__found").alias("found"))
    # outer: an inner explode filters by the size of all candidates first, and cuts them twice
    found = found.where("found.value IS NOT NULL").withColumn("found", F.col("found").dropFields("gap"))
    found = found.orderBy(F.xxhash64("id", "found.value", "found.before"), "found.value").limit(findings)
    named = features(F.col("found"), F.col("path"), dictionary)
    rows = labelled_findings(stage(found)).select(
        *(c.cast("double").alias(n) for n, c in named.items()), "label"
    )
    # one partition in a fixed order: the forest is then the same for the same findings
    rows = stage(rows.coalesce(1).sortWithinPartitions(*FEATURES, "label"))
    labels = [r.label for r in rows.select("label").distinct().collect()]
    if len(labels) < 2:
        return Forest((), tuple(dictionary))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    model = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", cacheNodeIds=False
    ).fit(vectors)
    printed = re.split(r"\n\s*Tree \d+ \(weight [^)]*\):\n", model.toDebugString.rstrip() + "\n")[1:]
    return Forest(tuple(p.rstrip("\n") for p in printed), tuple(dictionary))


def scanned(
    docs: DataFrame,
    forest: Forest,
    threshold: float = 0.5,
    text: str = "text",
    path: str = "source",
) -> DataFrame:
    """``docs`` with ``n_candidates``, ``secrets`` (structs of ``start``, ``value``, ``score``)
    and ``redacted``, the text with each secret replaced by ``[SECRET]``.

    Columns of these names are replaced. ``start`` counts code points from 0. A null text has
    no candidates and stays null. Rows are judged one by one, so repeated rows get the same
    result and nothing is moved between tasks.
    """
    where = F.col(path) if path else F.lit(None).cast("string")
    frame = with_candidates(docs, text)
    # features first, so that each is evaluated once however many trees ask for it
    described = F.transform(
        F.col("__found"),
        lambda found: F.struct(
            found["value"].alias("value"),
            found["gap"].alias("gap"),
            F.struct(
                *(c.alias(n) for n, c in features(found, where, list(forest.dictionary)).items())
            ).alias("features"),
        ),
    )
    judged = F.transform(
        described,
        lambda c: F.struct(
            c["value"].alias("value"),
            c["gap"].alias("gap"),
            forest.score({n: c["features"][n] for n in FEATURES}).alias("score"),
        ),
    )
    frame = frame.withColumn("__judged", judged)
    ends = F.aggregate(
        F.col("__judged"),
        F.struct(
            F.lit(0).alias("at"),
            F.array().cast("array<struct<start:int,value:string,score:double>>").alias("all"),
        ),
        lambda so_far, c: F.struct(
            (so_far["at"] + F.length(c["gap"]) + F.length(c["value"])).alias("at"),
            F.concat(
                so_far["all"],
                F.array(
                    F.struct(
                        (so_far["at"] + F.length(c["gap"])).alias("start"),
                        c["value"].alias("value"),
                        c["score"].alias("score"),
                    )
                ),
            ).alias("all"),
        ),
    )["all"]
    secrets = F.filter(ends, lambda c: c["score"] >= threshold)
    shown = F.transform(
        F.col("__judged"),
        lambda c: F.concat(c["gap"], F.when(c["score"] >= threshold, PLACEHOLDER).otherwise(c["value"])),
    )
    rebuilt = F.concat(F.array_join(shown, ""), F.element_at("__gaps", -1))
    redacted = F.when(F.size("secrets") > 0, rebuilt).otherwise(F.col(text))
    return (
        frame.withColumn("n_candidates", F.size("__values").cast("long"))
        .withColumn("secrets", secrets)
        .withColumn("redacted", redacted)
        .drop("__matches", "__pieces", "__values", "__gaps", "__found", "__judged")
    )


def secret_scan(
    docs: DataFrame,
    threshold: float = 0.5,
    key: str = "doc_id",
    text: str = "text",
    path: str = "source",
) -> DataFrame:
    """``key``, ``n_candidates``, ``n_secrets``, ``secrets`` and ``redacted`` for each row,
    with a forest trained on a bounded part of ``docs``."""
    forest = train(docs, key=key, text=text, path=path)
    rows = picked(docs, id=key, text=text, path=path)
    found = scanned(rows, forest, threshold, "text", "path")
    return found.select(
        F.col("id").alias(key),
        "n_candidates",
        F.size("secrets").cast("long").alias("n_secrets"),
        "secrets",
        "redacted",
    )


def without_secrets(
    docs: DataFrame,
    threshold: float = 0.5,
    key: str = "doc_id",
    text: str = "text",
    path: str = "source",
    length: str = "n_chars",
) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced and ``length`` set anew where they were;
    other rows and columns stay as they came."""
    found = scanned(docs, train(docs, key=key, text=text, path=path), threshold, text, path)
    changed = F.size("secrets") > 0
    return found.withColumns(
        {
            length: F.when(changed, F.length("redacted")).otherwise(F.col(length)).cast(docs.schema[length].dataType),
            text: F.col("redacted"),
        }
    ).select(*(F.col(f"`{c}`") for c in docs.columns))
