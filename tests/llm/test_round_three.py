"""Resampling, spelling variants, MinHash near-duplicates; hostile pages and secrets."""

import hashlib
import math
import random
import re
import sys
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import edge_cases  # noqa: E402

from gavelspark.llm import html_text, minhash, resampling, secrets, spelling  # noqa: E402


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Resampling


def test_crc_matrices_equal_the_library():
    draw = random.Random(1)
    features = [bytes(draw.randrange(256) for _ in range(draw.randrange(40))) for _ in range(500)]
    assert resampling.crcs(features).tolist() == [zlib.crc32(f) for f in features]
    assert resampling.crcs([]).tolist() == []


def plain_features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return words, runs


def plain_resampled(docs, target, longest, buckets, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, plain_features(text, longest)[1]))
    for text in target:
        t.update(map(bucket, plain_features(text, longest)[1]))
    n_s, n_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    rows = []
    for key, text in docs:
        words, runs = plain_features(text, longest)
        weight = sum(gain(bucket(f)) for f in runs)
        h = int(hashlib.sha256(f"2024:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((key, len(runs), weight, score, len(words)))
    eligible = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    drawn = eligible[: len(eligible) * percent // 100]
    ranked = [(*r[:4], i + 1) for i, r in enumerate(drawn)]
    return Counter(ranked + [(*r[:4], None) for r in rows]) - Counter((*r[:4], None) for r in drawn)


@pytest.mark.parametrize(("longest", "percent"), [(1, 50), (3, 100)])
def test_resampling_by_brute_force(spark, monkeypatch, longest, percent):
    monkeypatch.setattr(resampling, "BLOCK", 64)
    docs = [(r[0], r[1]) for r in edge_cases.rows() if len(r[1] or "") < 10_000]
    target = ["Alpha beta éta gamma", None, "", "alpha alpha zeta"]
    items = spark.createDataFrame([(t,) for t in target], "text string")
    found = resampling.resampled(
        spark.createDataFrame(docs, "doc_id long, text string"), items, longest=longest, buckets=97, percent=percent
    )
    assert Counter(map(tuple, found.collect())) == plain_resampled(docs, target, longest, 97, percent)


def test_features_across_blocks(monkeypatch):
    text = ("ab cdé " * 30 + "x" * 200 + " end").encode()
    whole = [f for _, found in resampling.feature_blocks(text, 3) for f in found]
    monkeypatch.setattr(resampling, "BLOCK", 16)
    cut = [f for _, found in resampling.feature_blocks(text, 3) for f in found]
    assert Counter(cut) == Counter(whole)


def test_resampling_of_odd_rows(spark):
    items = spark.createDataFrame([("alpha beta",)], "text string")
    found = resampling.resampled(edge_cases.docs(spark), items).collect()
    assert sorted(r.n_features for r in found if r.doc_id in (1, 2, 3)) == [0, 0, 0]
    assert len(found) == len(edge_cases.rows())
    assert resampling.resampled(edge_cases.no_docs(spark), items).count() == 0
    assert resampling.resampled(edge_cases.docs(spark), items.limit(0)).count() == len(found)


# Spelling variants


def edits(a, b):
    """Exactly one insertion, deletion or replacement."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(docs, damage, least_count, ratio):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'null' if key is None else key}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= least_count}
    near = {w: [o for o in words if edits(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    rows = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return rows


def misspelt(draw, words):
    word = draw.choice(words)
    if draw.random() < 0.7:
        return word
    i, letter = draw.randrange(len(word)), draw.choice("abéÉx")
    return draw.choice([word[:i] + word[i + 1 :], word[:i] + letter + word[i:], word[:i] + letter + word[i + 1 :]])


@pytest.mark.parametrize("block", [1 << 13, 5])
def test_variants_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (block,))
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdeé", k=draw.randrange(6, 11))) for _ in range(12)] + ["strasse", "strassen"]
    docs = [(i if i else None, " ".join(misspelt(draw, words) for _ in range(120))) for i in range(30)]
    docs += [(99, None), (98, ""), (97, "Ünïcode×÷ 1234567 " * 6), (96, "A" * 7 + " " + "a" * 7), (96, "AAAAAAA")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = spelling.variants(frame, least_count=2, ratio=3, damage=7)
    columns = ["word", "n", "n_near", "form", "form_n", "root"]
    rows = {tuple(r[c] for c in columns) for r in found.collect()}
    wanted = plain_variants(docs, 7, 2, 3)
    assert rows == wanted and any(r[5] != r[3] for r in wanted if r[3])  # chains of forms as well


def test_runs_are_not_cut(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 7)
    text = "Wörterbuch und Bücherwurm, naïveté; " * 3
    assert [w for p in spelling.runs_of(text, 6) for w in p] == ["wörterbuch", "bücherwurm", "naïveté"] * 3


def test_variants_of_odd_rows(spark):
    assert spelling.variants(edge_cases.no_docs(spark)).count() == 0
    found = {r.word: r for r in spelling.variants(edge_cases.docs(spark), damage=199).collect()}
    assert found["lambda"].n_near == 0 and found["lambda"].root == "lambda"


# MinHash


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))} if words else set()


def plain_components(docs):
    sets = [plain_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (key, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(key)
    least = {r: min((k for k in keys if k is not None), default=None) for r, keys in groups.items()}
    return Counter(
        (key, len(sets[i]), least[find(i)], key == least[find(i)]) for i, (key, _) in enumerate(docs)
    )


def near_copies(seed, groups, copies, length, changed):
    draw = random.Random(seed)
    docs = []
    for _ in range(groups):
        base = [f"w{draw.randrange(5_000)}" for _ in range(length)]
        for _ in range(copies):
            words = list(base)
            for _ in range(draw.randrange(changed + 1)):
                words[draw.randrange(length)] = f"v{draw.randrange(10**6)}"
            docs.append(" ".join(words))
    draw.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("groups", "copies", "changed"), [(30, 6, 4), (2, 150, 3)])
def test_near_copies_by_brute_force(spark, monkeypatch, groups, copies, changed):
    monkeypatch.setattr(minhash, "LONG_TABLE", 20)
    monkeypatch.setattr(minhash, "STAR", 16)
    docs = near_copies(7, groups, copies, 60, changed)
    found = minhash.components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert Counter(map(tuple, found.collect())) == plain_components(docs)


def test_long_tables_are_dealt_anew(spark, monkeypatch):
    """One passage in all documents, near pairs among them: no table is short."""
    monkeypatch.setattr(minhash, "LONG_TABLE", 2)
    draw = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = []
    for i in range(40):
        own = " ".join(f"o{draw.randrange(10**6)}" for _ in range(45))
        docs += [(3 * i + 2, f"{passage} {own}"), (3 * i + 1, f"{passage} {own} more")]
    found = minhash.components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert Counter(map(tuple, found.collect())) == plain_components(docs)


def test_minhash_of_odd_rows(spark):
    rows = edge_cases.rows()
    found = minhash.components(edge_cases.docs(spark))
    wanted = plain_components([(r[0], r[1]) for r in rows])
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in found.collect())
    assert got == Counter({k[:3]: n for k, n in wanted.items()})
    assert minhash.components(edge_cases.no_docs(spark)).count() == 0


def test_sets_and_sketches_are_alike_at_every_block_size(monkeypatch):
    hashes = minhash.shingle_set((" ".join(f"w{i}" for i in range(500))).encode())
    whole = minhash.minhashes(hashes)
    monkeypatch.setattr(minhash, "BLOCK", 64 * 3)
    assert (minhash.minhashes(hashes) == whole).all()


def test_parity_sketches_differ_in_no_more_places_than_the_sets():
    draw = random.Random(13)
    for size in (1, 5, 100, 3000):
        one = {draw.randrange(2**64) for _ in range(size)}
        for changed in (0, 1, size // 10, size):
            kept = sorted(one)[changed:]
            other = set(kept) | {draw.randrange(2**64) for _ in range(changed)}
            sketches = [minhash.parity_of(np.array(sorted(s), np.uint64)) for s in (one, other)]
            places = sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(*sketches))
            assert places <= len(one ^ other)
            assert places % 2 == len(one ^ other) % 2


# Hostile pages and secrets

PARAGRAPH = "This is a long paragraph of the article, with many words and hardly any markup in it. " * 4


@pytest.mark.parametrize(
    "page",
    [
        "<span>" * 100_000 + "x" + "</i>" * 100_000,
        "<i><div>" + "<span>" * 50_000 + "x" + "</i>" * 100_000,
        "<div class=header>" * 100_000 + "x",
        "<article>" * 100_000 + "x",
        "<ul><li>" * 100_000 + "x",
        "<!" * 500_000,
    ],
)
def test_hostile_pages_take_linear_time(page):
    start = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - start < 60


def test_link_lists_inside_an_article_go():
    links = "".join(f"<li><a href=/x>Other title number {i}</a></li>" for i in range(5))
    article = f"<article><h1><a href=/>Head</a></h1><p>{PARAGRAPH}</p><p>With <a href=/y>one link</a> {PARAGRAPH}</p></article>"
    text = html_text.main_text(f"<body><main>{article}<ul>{links}</ul></main></body>")
    assert "Other title" not in text and text.startswith("Head\nThis is") and "one link" in text
    more = f"<body><article><p>{PARAGRAPH}</p><div class=more>{links}</div><p>{PARAGRAPH}</p></article></body>"
    assert "Other title" not in html_text.main_text(more)


def test_reader_comments_go_however_long():
    page = f"<body><div><h1>Head</h1><p>{PARAGRAPH}</p></div><section id='comments'>" + f"<p>I say {PARAGRAPH}</p>" * 6
    assert "I say" not in html_text.main_text(page + "</section></body>")
    assert html_text.main_text(page + "</section></body>").startswith("Head\n")
    kept = f"<body><div class='post has-comments'><h1>Head</h1><p>{PARAGRAPH}</p></div><p>{PARAGRAPH}</p></body>"
    assert html_text.main_text(kept).startswith("Head\n")


def test_densities_by_plain_recomputation():
    """Densities of every node against counts taken from the node's subtree anew."""
    page = f"<body><div><p>{PARAGRAPH}</p><a href=/>menu</a></div><div><a href=/>one</a> <a href=/>two</a> x</div></body>"
    body = next(n for n in html_text.in_order(html_text.parse(page)) if n.tag == "body")
    nodes = html_text.in_order(body)
    html_text.measure(nodes, body)

    def plain(node, inside=False):
        inside = inside or node.tag == "a"
        chars = tags = link_chars = link_tags = 0
        for child in node.children:
            if isinstance(child, str):
                n = len(" ".join(child.split()))
                chars, link_chars = chars + n, link_chars + (n if inside else 0)
            else:
                c = plain(child, inside)
                chars, tags = chars + c[0], tags + c[1] + 1
                link_chars, link_tags = link_chars + c[2], link_tags + c[3] + (child.tag == "a")
        return chars, tags, link_chars, link_tags

    share = plain(body)[2] / plain(body)[0]
    for node in nodes:
        chars, tags, link_chars, link_tags = plain(node)
        base = math.log(chars * link_chars / max(chars - link_chars, 1) + share * chars + math.e)
        links = max(chars / max(link_chars, 1) * max(tags, 1) / max(link_tags + (node.tag == "a"), 1), 1.0)
        assert node.density == pytest.approx(chars / max(tags, 1) * math.log(links) / base)


def test_runs_of_mixed_width_are_scanned(spark):
    run = "a\U0001F600"
    texts = [
        "password=" + run * 500_000,
        'password="' + run * 500_000 + '"',
        "password='" + run * 500_000,
        "-----BEGIN PRIVATE KEY-----\n" + run * 300_000,
        "password=" + ".\U0001F600" * 300_000,
        "key: `" + ("\\" + run) * 300_000 + "`",
        "pass" * 200_000 + "=" + run * 100_000,
        "password=hunter2!x9.",
    ]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    found = secrets.with_candidates(docs.repartition(8), "text").select(
        "doc_id", F.transform("__found", lambda c: F.length(c["value"])).alias("n"), "__found"
    )
    got = {r.doc_id: r for r in found.select("doc_id", "n").collect()}
    assert got[0].n == got[1].n == got[2].n == [1_000_000] and got[4].n == [600_000]
    assert got[7].n == [len("hunter2!x9")]  # without the full stop


def test_findings_sample_keeps_its_bound(spark):
    rows = [(None, f"text {i}", "s") for i in range(3_000)] + [(1, "same", "s")] * 3_000
    docs = spark.createDataFrame(rows, "id long, text string, path string")
    assert 40 < secrets.share_of(docs, 200).count() < 200


def test_long_tables_are_joined_before_their_parts_are_dealt(spark):
    """The join made a row for each part of a member."""
    sketch = ", ".join(f"{c} long" for c in minhash.SKETCH)
    blank = (0,) * len(minhash.SKETCH)
    parts = [list(range(i, i + minhash.PARTS * minhash.COLLECTIONS)) for i in range(3)]
    classes = spark.createDataFrame([(i, parts[i], *blank) for i in range(3)], f"cid long, parts array<long>, {sketch}")
    long = spark.createDataFrame([(k, i, *blank) for k in (7, 8) for i in range(3)], f"key long, cid long, {sketch}")
    found = minhash.dealt_anew(long, classes, 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("Join Inner")
    further = classes.select("cid", F.posexplode(minhash.collection(2)).alias("at", "part"))
    plain = long.join(further, "cid").select(F.xxhash64("key", "at", "part").alias("key"), "cid")
    assert Counter(map(tuple, found.select("key", "cid").collect())) == Counter(map(tuple, plain.collect()))
    assert found.count() == 6 * minhash.PARTS


def test_tables_around_one_member_become_one_group(spark):
    """Members were met again in every table they share, long tables' twelve times as often."""
    rows = [(key, cid, cid, root) for key in range(50) for cid, root in ((10, 10), (11, 11), (12, 10))]
    rows += [(100, 5, 5, 5), (100, 12, 12, 10), (200, 21, 21, 20), (200, 22, 22, 20)]
    found = minhash.open_groups(spark.createDataFrame(rows, "key long, cid long, weight long, root long"))
    wanted = Counter((12, 4, cid, root) for cid, root in ((5, 5), (10, 10), (11, 11), (12, 10)))
    assert Counter(map(tuple, found.select("key", "n", "cid", "root").collect())) == wanted


def test_blocks_of_a_long_group_meet_all_its_members(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 3)
    docs = near_copies(9, 3, 60, 60, 4)
    found = minhash.components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert Counter(map(tuple, found.collect())) == plain_components(docs)


def test_a_class_has_one_row_for_each_part_of_its_tables(spark):
    """Tables were pairs of parts: 144 rows for a class whose 24 parts are shared."""
    sketch = ", ".join(f"{c} long" for c in minhash.SKETCH)
    blank = (0,) * len(minhash.SKETCH)
    n_parts = minhash.PARTS * minhash.COLLECTIONS
    lone = list(range(n_parts, 2 * n_parts))
    rows = [(1, list(range(n_parts)), *blank), (2, list(range(n_parts)), *blank), (3, lone, *blank)]
    found = minhash.tables(spark.createDataFrame(rows, f"cid long, parts array<long>, {sketch}"))
    assert Counter(r.cid for r in found.collect()) == {1: 2 * minhash.PARTS, 2: 2 * minhash.PARTS}
    assert found.select("key").distinct().count() == 2 * minhash.PARTS


def test_a_set_is_sent_once_to_a_cell(spark):
    """A set was copied for each pair: the shuffle grew with the pairs, not with the sets."""
    n = 40
    docs = spark.createDataFrame([(i, f"w{i} and some more words") for i in range(n)], "id long, text string")
    digests = docs.select(F.col("id").alias("cid"), F.struct("id", F.xxhash64("text").alias("text_digest")).alias("first"))
    classes = digests.withColumn("n_shingles", F.lit(2).cast("long"))
    pairs = spark.createDataFrame([(a, b, 7) for a in range(n) for b in range(a + 1, n)], "a long, b long, at long")
    sets = minhash.sets_of(minhash.in_cells(pairs, classes), classes, docs, "id", "text")
    assert sets.count() == n
    linked = minhash.confirmed(pairs, classes, docs, 80, "id", "text")
    assert linked.count() == 0


def test_cells_of_many_pairs_or_long_sets_are_split_and_keep_all_pairs(spark, monkeypatch):
    pairs = spark.createDataFrame([(a, b, 7) for a in range(20) for b in range(a + 1, 20)], "a long, b long, at long")
    for name, value, least in (("STAR", 10, 10), ("CELL_MEMBERS", 5, 8), ("CELL_SHINGLES", 1000, 2)):
        with monkeypatch.context() as patched:
            patched.setattr(minhash, name, value)
            classes = spark.createDataFrame([(i, 100) for i in range(20)], "cid long, n_shingles long")
            found = minhash.in_cells(pairs, classes)
            assert Counter(map(tuple, found.select("a", "b").collect())) == Counter(
                map(tuple, pairs.select("a", "b").collect())
            )
            assert found.select("cell").distinct().count() >= least


def test_pairs_get_their_cells_without_a_shuffle_by_group(spark):
    """The pairs of one large group went to one task."""
    pairs = spark.createDataFrame([(1, 2, 7)], "a long, b long, at long")
    classes = spark.createDataFrame([(1, 100), (2, 100)], "cid long, n_shingles long")
    plan = minhash.in_cells(pairs, classes)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and "strategy=broadcast" in plan
