"""Text expressions. All are built-in Spark functions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points whose Unicode case folding keeps an ASCII letter
# that lower-casing alone would lose.
CASEFOLD_EXPANSIONS = {
    "ß": "ss",
    "ẞ": "ss",
    "ŉ": "n",
    "ſ": "s",
    "ǰ": "j",
    "ẖ": "h",
    "ẗ": "t",
    "ẘ": "w",
    "ẙ": "y",
    "ẚ": "a",
    "ﬀ": "ff",
    "ﬁ": "fi",
    "ﬂ": "fl",
    "ﬃ": "ffi",
    "ﬄ": "ffl",
    "ﬅ": "st",
    "ﬆ": "st",
}

# The white space a Unicode-aware strip removes.
UNICODE_SPACES = "".join(
    map(
        chr,
        [
            *range(0x09, 0x0E),
            *range(0x1C, 0x21),
            0x85,
            0xA0,
            0x1680,
            *range(0x2000, 0x200B),
            0x2028,
            0x2029,
            0x202F,
            0x205F,
            0x3000,
        ],
    )
)

SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def fold_sql(text: str) -> str:
    """SQL for lower case with full case folding; pure ASCII skips the expansions."""
    expanded = text
    for source, target in CASEFOLD_EXPANSIONS.items():
        expanded = f"replace({expanded}, '{source}', '{target}')"
    return f"if(length({text}) = octet_length({text}), lower({text}), lower({expanded}))"


def folded_sql(text: str) -> str:
    """``fold_sql``, but pure ASCII stays as it is, for readers to whom A-Z are like a-z."""
    return fold_sql(text).replace(f", lower({text}), ", f", {text}, ", 1)


def normal_sql(text: str) -> str:
    """SQL for case-folded text with everything but ``a-z0-9`` deleted."""
    return f"regexp_replace({fold_sql(text)}, '[^a-z0-9]+', '')"


def normalize(name: str) -> Column:
    return F.expr(normal_sql(name))


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends (linear, unlike an end-anchored regex)."""
    return F.btrim(text, F.lit(UNICODE_SPACES))


def digest_id(text: Column, prefix: str = "", digits: int = 16) -> Column:
    """Readable id: the first hex digits of the SHA-256 of the UTF-8 text."""
    head = F.substring(F.sha2(text, 256), 1, digits)
    return F.concat(F.lit(prefix), head) if prefix else head


def comment_case_id(split: Column | str, index: Column, text: Column) -> Column:
    split = F.lit(split) if isinstance(split, str) else split
    return F.format_string("CC-%s-%07d-%s", split, index, digest_id(text, digits=12))


def as_boolean(value: Column) -> Column:
    """``1``/``true`` and ``0``/``false``/empty, any case, spaces allowed; else an error.

    A null is an error as well; callers that have a default coalesce first.
    """
    word = F.lower(strip(value.cast("string")))
    return (
        F.when(word.isin("1", "true"), F.lit(True))
        .when(word.isin("0", "false", ""), F.lit(False))
        .otherwise(
            F.raise_error(
                F.concat(F.lit("not a boolean-like value: "), F.coalesce(word, F.lit("null")))
            ).cast("boolean")
        )
    )


def is_boolean_like(value: Column) -> Column:
    word = F.lower(strip(value.cast("string")))
    return F.coalesce(word.isin("1", "true", "0", "false", ""), F.lit(False))


def required(text: Column, what: str) -> Column:
    """Stripped text; a null or empty one fails the query."""
    bare = strip(text)
    return F.when(F.length(bare) > 0, bare).otherwise(
        F.raise_error(F.lit(f"{what} must not be empty"))
    )


def dialogue(prompt: Column, response: Column) -> Column:
    return F.concat(F.lit("User: "), prompt, F.lit("\nAssistant: "), response)


def true_keys(flags: Column) -> Column:
    """Sorted names whose flag is true."""
    return F.array_sort(F.map_keys(F.map_filter(flags, lambda _, flag: F.coalesce(flag, F.lit(False)))))


# Sentence patterns of generated policy cases.
BASE_PATTERN = "Limited-time {term} promotion for adults. Reference {index}."
NEUTRAL_PATTERN = "A neutral post about hiking boots. Reference {index}."
FILLER = "Product specifications and delivery details. "
FILLER_REPEATS = 80
LANGUAGE_PATTERNS = {
    "en": "Special {term} promotion for adults.",
    "es": "Oferta especial de {term} para adultos.",
    "fr": "Offre spéciale de {term} réservée aux adultes.",
    "hi": "वयस्कों के लिए {term} का विशेष प्रचार।",
}
OBFUSCATED = ("promotion", "pr0m0tion")


def filled(pattern: str, **values: Column) -> Column:
    """The pattern with each value in the place of its name."""
    text = F.lit(pattern)
    for name, value in values.items():
        text = F.replace(text, F.lit(f"{{{name}}}"), value)
    return text


def spaced(term: Column) -> Column:
    return F.array_join(F.split(term, ""), " ")


def base_text(term: Column, index: Column) -> Column:
    return filled(BASE_PATTERN, index=index.cast("string"), term=term)


def neutral_text(index: Column) -> Column:
    return filled(NEUTRAL_PATTERN, index=index.cast("string"))


def long_context(text: Column) -> Column:
    filler = F.repeat(F.lit(FILLER), FILLER_REPEATS)
    return F.concat(filler, text, filler)


def translated(term: Column, language: Column) -> Column:
    choice = None
    for code, pattern in LANGUAGE_PATTERNS.items():
        text = filled(pattern, term=term)
        choice = F.when(language == code, text) if choice is None else choice.when(language == code, text)
    return choice


def adversarial(text: Column, term: Column) -> Column:
    return F.replace(F.replace(text, term, spaced(term)), F.lit(OBFUSCATED[0]), F.lit(OBFUSCATED[1]))
