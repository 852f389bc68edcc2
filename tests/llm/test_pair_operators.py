"""SimHash components and decontamination."""

import hashlib
import random
import re
import sys
from itertools import combinations
from pathlib import Path

import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).parent))

import edge_cases  # noqa: E402

from gavelspark.llm import decontamination, simhash  # noqa: E402


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            parent[root(i)] = root(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(root(i), []).append(ids[i])
    return sorted(
        ((ids[i] is None, ids[i]), min((x for x in groups[root(i)] if x is not None), default=None))
        for i in range(len(ids))
    )


def check(spark, rows, docs):
    found = simhash.components(docs).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    assert sorted(r.fingerprint for r in found) == sorted(f"{p:016x}" for p in prints)
    got = sorted(((r.doc_id is None, r.doc_id), r.component_id) for r in found)
    assert got == plain_components([i for i, _ in rows], prints)


def test_components_by_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.collect()], docs)


def test_components_of_odd_rows(spark):
    check(spark, [r[:2] for r in edge_cases.rows()], edge_cases.docs(spark))
    assert simhash.components(edge_cases.no_docs(spark)).count() == 0


def near(rng, value, bits):
    for b in rng.sample(range(64), bits):
        value ^= 1 << b
    return value


def signed(value):
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("n", [100, 1 << 27, 1 << 34])
def test_links_of_every_key_width(spark, n):
    """Random clusters, one larger than a posting list may be; ``n`` chooses the key width."""
    rng = random.Random(n)
    values = {0, (1 << 64) - 1}
    for _ in range(15):
        center = rng.getrandbits(64)
        values |= {near(rng, center, rng.randint(0, 4)) for _ in range(12)}
    center = rng.getrandbits(64)
    values |= {near(rng, center, rng.randint(1, 3)) for _ in range(600)}
    values = sorted(signed(v) for v in values)
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    found = {(r.a, r.b) for r in simhash.links(frame, n).collect()}
    mask = (1 << 64) - 1
    assert found == {(a, b) for a, b in combinations(values, 2) if ((a ^ b) & mask).bit_count() <= 3}


@pytest.mark.parametrize("width", [3, 4, 5])
def test_position_sets_cover(width):
    sets = simhash.position_sets(width, 5)
    assert all(any(set(s) <= set(five) for s in sets) for five in combinations(range(8), 5))


def test_connected_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(-5, 7_000)]
    frame = spark.createDataFrame(edges, "a long, b long")
    roots = {r.node: r.root for r in simhash.connected(frame).collect()}
    assert all(roots[i] == 0 for i in range(61)) and all(roots[100 + i] == 100 for i in range(40))
    assert roots[7_000] == -5 and len(roots) == 103
    assert simhash.connected(frame.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    docs = edge_cases.docs(spark)
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    texts = [plain_fingerprint(r.text) for r in rows]
    assert all((a ^ b).bit_count() > 3 for a, b in combinations(texts, 2))
    assert {r.doc_id for r in rows} >= {1, 4, 5, 6, None} and not {2, 3, 7} & {r.doc_id for r in rows}
    assert simhash.without_near_duplicates(edge_cases.no_docs(spark)).count() == 0


def plain_words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def plain_contamination(docs, items):
    wins = {}
    for item, text in items:
        words = plain_words(text)
        for i in range(max(len(words) - 12, 1)):
            if words:
                wins.setdefault(tuple(words[i : i + 13]), set()).add("null" if item is None else str(item))
    result = []
    for _, text in docs:
        words, hit, names = plain_words(text), set(), set()
        for n in {len(w) for w in wins}:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    names |= wins[w]
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        result.append((len(words), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(result)


def check_contamination(spark, docs, items, **options):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, window string, n long")
    bench = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, hash string")
    found = decontamination.contamination(frame, bench, **options).collect()
    got = sorted((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found)
    assert got == plain_contamination(docs, items)
    kept = decontamination.without_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert kept.count() == sum(not r[-1] for r in got)


def test_contamination_by_brute_force(spark):
    rng = random.Random(8)
    words = ["aa", "bb", "cc", "dd", "Éa", "x1"]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(13, 22)))) for i in range(6)]
    items += [(20, "aa bb"), (21, "zz"), (22, "Aa-BB, cc dd"), (None, items[0][1]), (3, items[1][1]), (23, None), (24, "  ")]
    docs = [(i, " ".join(rng.choices([*words, items[i % 6][1], "zz"], k=rng.randint(0, 30)))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, items[2][1]), (102, items[2][1]), (102, items[3][1]), (None, items[4][1])]
    docs += [(103, items[5][1].replace(" ", "; ").upper().replace("É", "É")), (104, "w " * 9_000 + items[0][1])]
    check_contamination(spark, docs, items)


def test_without_items_or_documents(spark):
    docs = [(1, "some words here"), (2, None)]
    check_contamination(spark, docs, [])
    check_contamination(spark, docs, [(1, None)])
    check_contamination(spark, [], [(1, "some words")])


def test_false_hits_of_the_filter_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "LEAST_BITS", 1 << 16)
    monkeypatch.setattr(decontamination, "MOST_BITS", 1 << 16)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=40))) for i in range(30)]
    docs = [(i, " ".join([*rng.choices(words, k=50), *items[i % 30][1].split()[: rng.randint(5, 40)]])) for i in range(60)]
    check_contamination(spark, docs, items)
