"""Tables with nulls, empty and long texts, ties, repeats and columns of clashing names."""

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, "
    "fp long, id long, hash long, digest string, __key string, found string, hits string"
)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i + i * seed) % len(WORDS)] + ("." if i % 9 == 8 else "") for i in range(n))


def rows():
    texts = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "two words"), (6, prose(1, 60)), (7, prose(1, 60)),
        (7, prose(1, 60)), (8, prose(2, 300)), (8, prose(3, 80)), (None, prose(4, 50)), (9, prose(5, 30_000)),
        (10, "x" * 300_000), (11, "1234567 !!! 42"), (12, 'say token = "0123456789abcdef0123456789abcdef01234567" now'),
    ]
    return [
        (i, t, None if n % 5 == 4 else "en", None if n % 4 == 3 else "src", None, 5, 6, 7, 8, "d", "k", "f", "h")
        for n, (i, t) in enumerate(texts)
    ]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
