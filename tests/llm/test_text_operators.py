"""Token counts, page texts, quality and languages."""

import itertools
import random
import sys
from pathlib import Path

import pytest
import regex
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import edge_cases  # noqa: E402

from gavelspark.llm import html_text, language, quality, token_counts  # noqa: E402
from gavelspark.llm.queries import tokenizer_file  # noqa: E402

VOCABULARY = tokenizer_file("byte_bpe_50k.json")


def test_tokens_equal_the_library(spark, tables):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    docs = edge_cases.docs(spark).select("doc_id", "text").union(
        spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").limit(200)
    )
    found = token_counts.token_counts(docs, VOCABULARY).collect()
    texts = [r.text or "" for r in docs.collect()]
    expected = sorted((len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for t in texts)
    assert sorted((r.n_bytes, r.n_tokens) for r in found) == expected
    assert all(r.over_limit == (r.n_tokens > 512) for r in found)


def test_tokens_of_odd_texts():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    counter = token_counts.Counter(token_counts.read_vocabulary(VOCABULARY))
    random.seed(3)
    letters = "a Ä1²\n\t'sé  \x1c_漢😀<|endoftext|>½"
    for _ in range(2000):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 30)))
        assert counter(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    assert counter("<|endoftext|><|endoftext|>") == 2


def test_whole_tokens_are_proven():
    vocabulary = token_counts.read_vocabulary(VOCABULARY)
    merge = token_counts.merger(vocabulary.described)
    assert all(merge(piece) == 1 for piece in itertools.islice(sorted(vocabulary.whole), 0, None, 50))


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.read_vocabulary(tokenizer_file("word_bpe_49k.json"))


def test_no_documents(spark):
    none = edge_cases.no_docs(spark)
    assert token_counts.token_counts(none, VOCABULARY).count() == 0
    assert quality.assess(none).count() == 0
    assert language.identify(none).count() == 0
    assert language.in_known_language(none).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header class="site"><h1>Site</h1></header><nav><a href="/">Home</a></nav>
<div class="cookie-notice">We use cookies</div>
<article><header><h1>A  title &amp; more</h1></header><p>First paragraph with a <a href="#">link</a> in it.<p>Second&nbsp;one
 goes on &lt;here&gt;, long enough.<script>var x = "</p>";</script>
<div class="ad">Buy now</div><ul><li>Point one<li>Point two</ul>
<form><input value="q">Search</form><section id="comments"><p>Reader says no</p></section></article>
<aside>Other</aside><footer>Imprint</footer></body></html>"""


def test_page_without_what_surrounds_the_article():
    assert html_text.main_text(PAGE) == (
        "A title & more\nFirst paragraph with a link in it.\nSecond one goes on <here>, long enough.\n"
        "Point one\nPoint two"
    )


def test_densest_subtree_without_any_hint():
    words = "Long running text that has no links and many characters. " * 4
    menu = "".join(f"<li><a href='/{i}'>Entry {i}</a></li>" for i in range(12))
    page = f"<body><div><ul>{menu}</ul></div><div><div><p>{words}</p><p>{words}</p><p>Short.</p></div></div></body>"
    assert html_text.main_text(page) == f"{words.strip()}\n{words.strip()}\nShort."


LINES = ["Long running text that has no links and many characters. " * 4] * 3
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Entry {i}</a></li>" for i in range(12)) + "</ul>"


@pytest.mark.parametrize("wrapper", ["div id='page' class='site has-sidebar'", "div class='content with-sidebar'", "form action='/'"])
def test_named_wrappers_keep_the_main_text(wrapper):
    text = "".join(f"<p>{line}</p>" for line in LINES)
    side = f"<div class='sidebar'>{MENU}</div><div class='widget'><p>Small notes</p></div>"
    page = f"<body><{wrapper}>{side}<div>{text}</div></{wrapper.split()[0]}></body>"
    assert html_text.main_text(page) == "\n".join(line.strip() for line in LINES)


def test_named_headings_and_paragraphs_of_an_article_stay():
    text = "".join(f"<p>{line}</p>" for line in LINES)
    page = (
        f"<body><article><h1 class='page-header'>Headline</h1><div class='post-header'><h2>Below</h2></div>"
        f"<p class='notice'>Mind the step.</p>{text}<div class='share'>{MENU}</div></article></body>"
    )
    assert html_text.main_text(page).startswith("Headline\nBelow\nMind the step.\nLong")
    assert "Entry" not in html_text.main_text(page)


def test_sibling_articles_and_bare_texts_stay():
    one, two, bare = (f"{word} text that has no links and many characters. " * 5 for word in ("First", "Second", "Bare"))
    many = f"<p>{one}</p>" * 8
    page = f"<body><article>{many}</article>{bare}<article><p>{two}</p></article>{MENU}<div>{two}</div></body>"
    assert html_text.main_text(page) == "\n".join(t.strip() for t in [one] * 8 + [bare, two, two])
    page = f"<body><div>{many}</div>{bare}<br>{MENU}</body>"
    assert html_text.main_text(page) == "\n".join(t.strip() for t in [one] * 8 + [bare])


@pytest.mark.parametrize("page", [None, "", "<", "<<<>>>", "<p", "</p></div>", "<!--", "<script>x", "&#xD800;&bogus;"])
def test_broken_pages(page):
    assert isinstance(html_text.main_text(page), str)


def test_deep_and_long_pages():
    assert html_text.main_text("<div>" * 20_000 + "deep") == "deep"
    assert len(html_text.main_text("<p>" + "word " * 200_000)) == 999_999
    html_text.main_text("<div " * 50_000)


def test_pages_table(spark):
    rows = [(1, "u", None, "x"), (None, None, PAGE, "y"), (1, "u", None, "x"), (2, "v", "plain", None)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, text string")
    found = html_text.page_texts(pages).collect()
    assert sorted(r.n_chars for r in found)[:3] == [0, 0, 5] and len(found) == 4
    assert html_text.page_texts(pages.limit(0)).count() == 0


def plain_repeats(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return len(hit)


def test_base_counts_by_brute_force():
    random.seed(5)
    for _ in range(300):
        text = "".join(random.choice(["a", "b", "é", " ", "\n", "#", "a b c d e ", "\t", " "]) for _ in range(40))
        words = [w for w in text.translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if w]
        lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
        got = dict(zip(quality.BASE, quality.base_counts(text)))
        assert got["n_words"] == len(words)
        assert got["word_chars"] == sum(map(len, words))
        assert got["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert got["n_dup_lines"] == sum(x in lines[:i] for i, x in enumerate(lines))
        assert got["n_repeat_words"] == plain_repeats(words)


def test_quality_agrees_with_labels(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet".replace("sf0.001", "sf0.01"))
    labels = spark.read.parquet(f"{tables}/labels.parquet".replace("sf0.001", "sf0.01"))
    found = quality.assess(docs).join(labels, "doc_id")
    right = F.avg(((F.col("quality") == 1) == F.col("kept")).cast("double"))
    long = F.col("n_words") >= 10
    clean = F.avg(F.when((F.col("quality") == 1) & long, F.col("kept").cast("double")))
    row = found.agg(right.alias("right"), clean.alias("clean")).first()
    assert row.right > 0.95 and row.clean > 0.97


def test_quality_of_odd_rows(spark):
    docs = edge_cases.docs(spark)
    found = quality.assess(docs).collect()
    assert len(found) == docs.count()
    assert all(r.base_failed and not r.kept for r in found if r.n_words < 10)


def test_languages_of_held_out_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet".replace("sf0.001", "sf0.01"))
    found = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() >= 0.98 * found.count() > 100
    import zlib

    assert all(r.held_out for r in found.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_predictions_do_not_read_lang_or_source(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = language.train(docs.where(~language.held_out(docs["doc_id"])))
    one = docs.select("doc_id", language.predicted(docs["text"], model).alias("p")).collect()
    scorer = language.Scorer(model)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(scorer(texts[r.doc_id]) == (r.p.lang_pred, r.p.score) for r in one)


def test_languages_of_odd_rows(spark):
    found = language.identify(edge_cases.docs(spark)).collect()
    assert len(found) == len(edge_cases.rows())
    texts = {1: "und", 2: "und", 3: "und", 11: "und", 6: "en"}
    assert all(r.lang_pred == texts[r.doc_id] for r in found if r.doc_id in texts)
    assert all(0 <= r.score <= 1 for r in found)


def test_texts_in_no_learned_language_go(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    strange = docs.limit(2).withColumns({"doc_id": F.lit(-1).cast("long"), "text": F.lit("漢字仮名 交じり文"), "lang": F.lit(None).cast("string")})
    kept = language.in_known_language(docs.unionByName(strange))
    assert kept.columns == docs.columns
    assert kept.where("doc_id = -1").count() == 0 and kept.count() == docs.count()


def test_backing_off_goes_to_the_longest_known_gram():
    import numpy as np

    scores = np.array([[-1.0, -5.0], [-5.0, -1.0], [-3.0, -2.0]], dtype=np.float32)
    model = language.Model(("aa", "bb"), scores, {"known": 0}, ({"x": 2}, {}, {"^xy": 1}, {}, {}))
    scorer = language.Scorer(model)
    assert scorer("known")[0] == "aa"
    assert scorer.back_off("xyz") == (3, [1])  # the 3-gram, not the 1-gram
    assert scorer.back_off("zx") == (1, [2])
    assert scorer.back_off("qq") == (0, [])
    assert scorer("xyz")[0] == scorer("zx")[0] == "bb"
    assert scorer("qq") == ("aa", 0.5)
    assert scorer("")[0] == "und"


def plain_scores(model, text):
    """The model's log scores of a text, word by word and n-gram by n-gram."""
    totals = [0.0] * len(model.languages)
    words = ["".join(g) for g in regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower())]
    for word in words:
        rows = [model.words[word]] if word in model.words else []
        size = language.LONGEST
        while not rows and size:
            edged = f"^{word}$"
            grams = [edged[i : i + size] for i in range(len(edged) - size + 1)]
            rows = [model.grams[size - 1][g] for g in grams if g in model.grams[size - 1]]
            size -= 1
        for i in range(len(totals)):
            totals[i] += sum(float(model.scores[r, i]) for r in rows) / max(len(rows), 1)
    return totals, len(words)


def test_scores_by_brute_force(spark, tables):
    import math

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = language.train(docs, most_words=400, most_grams=300)
    scorer = language.Scorer(model)
    for row in docs.select("text").collect():
        totals, n = plain_scores(model, row.text or "")
        lang, score = scorer(row.text)
        if not n:
            assert (lang, score) == ("und", 0.0)
            continue
        odds = [math.exp((t - max(totals)) / n**0.5) for t in totals]
        assert abs(score - max(odds) / sum(odds)) < 1e-6
        assert totals[model.languages.index(lang)] >= max(totals) - 1e-4


def test_letters_marks_and_numbers(spark):
    docs = spark.createDataFrame(
        [(i, "हिन्दी भाषा में लिखा गया पाठ", "hi") for i in range(6)] + [(i, "plain english text here", "en") for i in range(6, 12)]
        + [(20, "½ ² ⅷ Ⅳ ٣", None), (21, "हिन्दी", None)],
        "doc_id long, text string, lang string",
    )
    found = {r.doc_id: r for r in language.identify(docs).collect()}
    assert (found[20].lang_pred, found[20].score) == ("und", 0.0)
    assert found[21].lang_pred == "hi"
    assert language.words_of("हिन्दी e\u0301te") == ["हिन्दी", "e\u0301te"]


def test_samples_keep_their_bound_whatever_the_keys(spark):
    rows = [(None if i % 2 else i, f"text number {i}", "en") for i in range(4_000)] + [(None, "same", "en")] * 2_000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    _, taken = language.training_sample(docs, 100, 10, "doc_id", "text", "lang")
    assert 40 < taken.count() < 200


def test_every_language_keeps_its_share_of_the_lists(spark):
    rows = [(i, " ".join(f"{a}{b}rule" for a in "abcdefghij" for b in "klmnopqrst"), "big") for i in range(50)]
    rows += [(100 + i, "ene mene muh und raus bist du", "small") for i in range(2)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_words=20, most_grams=20)
    assert {"ene", "mene", "muh"} <= set(model.words) and len(model.words) <= 20


def test_long_runs_teach_their_grams(spark):
    rows = [(1, "天地玄黃" * 30, "zh"), (2, "a few words", "en")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert "天地玄" in model.grams[2] and language.Scorer(model)("玄黃天地")[0] == "zh"


ENGLISH = "the house stands near river people walk through green fields every morning while children play under old trees".split()
FRENCH = "la maison est dans une rue tranquille où les enfants jouent avec leurs amis pendant que le soleil brille".split()
ITALIAN = "il gatto dorme sopra il divano mentre fuori piove forte e nessuno vuole uscire perché fa freddo stasera".split()


@pytest.mark.parametrize("learned", [{"en": ENGLISH}, {"en": ENGLISH, "fr": FRENCH}])
def test_unlearned_languages_of_the_same_script_go(spark, learned):
    draw = random.Random(5)
    text = lambda words: " ".join(draw.choices(words, k=80))
    rows = [(i, text(words), v) for v, words in learned.items() for i in range(40)]
    rows += [(1_000 + i, text(ITALIAN), None) for i in range(5)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows += [(2_000 + i, " ".join("".join(draw.choices(letters, k=7)) for _ in range(80)), None) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = language.in_known_language(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, _, v in rows if v)


def test_every_learned_document_counts(spark):
    """Of more than 4,000 documents of a language, only so many were read."""
    rows = [(i, f"common words here and one like {'abcdefghij'[i % 10]}rest", "en") for i in range(9_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language.train(docs)
    assert model.seen[model.words["common"], 0] == 9_000
    assert all(model.seen[model.words[f"{c}rest"], 0] == 900 for c in "abcdefghij")


def test_commonest_grams_are_exact(spark):
    draw = random.Random(3)
    rows = [(draw.randrange(2), draw.choice("ab"), f"g{i:04d}", int(2 ** (draw.random() * 9))) for i in range(2_000)]
    grams = spark.createDataFrame(rows, "size int, lang string, gram string, n long")
    found = language.commonest(grams, F.when(F.col("size") == 0, 30).otherwise(700))
    expected = []
    for size, lang in ((s, v) for s in (0, 1) for v in "ab"):
        of = sorted((r for r in rows if r[:2] == (size, lang)), key=lambda r: (-r[3], r[2]))
        expected += of[: 700 if size else 30]
    assert sorted((r.size, r.lang, r.gram, r.n) for r in found.collect()) == sorted(expected)


def test_floors_come_from_all_learned_documents(spark, monkeypatch):
    """One reading of every document serves the floors and the verdict."""
    monkeypatch.setattr(language, "training_sample", None)
    rows = [(i, " ".join(ENGLISH[i % 7 :]), "en") for i in range(50)] + [(100, "漢字仮名", None), (101, None, "en"), (102, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in language.in_known_language(docs).collect()) == list(range(50))
