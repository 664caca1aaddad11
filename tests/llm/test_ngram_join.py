import itertools
import random
import re

import numpy as np
import pytest

from lexloom.llm.graph import components
from lexloom.llm import ngram_join
from lexloom.llm.ngram_join import keep_one, link_components, linked_sets, subset_keys

SF = "/root/testdata/sf0.001"


def brute(rows, width=4, percent=85):
    sets = []
    for doc, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            up[root(i)] = root(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), doc), doc)
    return sorted((doc, len(sets[i]), low[root(i)]) for i, (doc, _) in enumerate(rows))


def edited(words, k, rng):
    out = list(words)
    for _ in range(k):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


def family_rows(rng):
    rows = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "ONE two"), (1005, "One Two three"), (1006, "two one")]
    doc = 0
    for n in (5, 8, 12, 18, 22, 27, 35, 60, 150, 400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for k in (0, 0, 1, 1, 2, 3, 4, 6):
            rows.append((doc, " ".join(edited(base, k if n > 20 else k // 2, rng))))
            doc += 1
        for cut in (1, 2, 3):
            rows.append((doc, " ".join(base[cut:])))
            doc += 1
    common = [f"c{i}" for i in range(40)]
    for _ in range(30):
        rows.append((doc, " ".join([f"u{rng.randrange(10**6)}" for _ in range(30)] + common)))
        doc += 1
    return rows


def test_against_brute_force(spark):
    rows = family_rows(random.Random(5))
    got = sorted(map(tuple, link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, link_components(docs).collect())) == brute(rows)


def test_hub_family(spark):
    """Copies that link with a hub and not with each other still end in one component."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(edited(base, 7, rng))) for i in range(1, 40)] + [(100, " ".join(base))]
    got = sorted(map(tuple, link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows)


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_shingles string, key string")
    assert link_components(empty).collect() == []
    two = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y")], "doc_id long, text string, key string")
    kept = keep_one(two)
    assert kept.columns == ["doc_id", "text", "key"] and [r.doc_id for r in kept.collect()] == [1]


@pytest.mark.parametrize("size", [7, 14, 20, 26])
def test_light_sets_share_a_subset(size):
    rng = np.random.default_rng(size)
    for _ in range(50):
        common = rng.integers(0, 2**63, size, dtype=np.uint64)
        a = np.unique(common)
        gone = rng.integers(0, size * 15 // 100 + 1)
        b = np.unique(np.append(a[gone:], rng.integers(0, 2**63, gone // 2, dtype=np.uint64)))
        i = len(np.intersect1d(a, b))
        if 100 * i >= 85 * (len(a) + len(b) - i):
            (ka, na), (kb, nb) = subset_keys(a, 85), subset_keys(b, 85)
            shared = np.intersect1d(ka, kb)
            assert shared.size and max(na[np.isin(ka, shared)]) == i == max(nb[np.isin(kb, shared)])


@pytest.mark.parametrize("common", [1 << 18, 100, 1])
def test_many_small_buckets_give_the_same(spark, monkeypatch, common):
    """With every, some and no n-gram counted as common."""
    rows = family_rows(random.Random(11))
    monkeypatch.setattr(ngram_join, "BUCKET_GRAMS", 100)
    monkeypatch.setattr(ngram_join, "MOST_COMMON", common)
    for width, percent in ((4, 85), (5, 80), (2, 60)):
        got = sorted(map(tuple, link_components(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()))
        assert got == brute(rows, width, percent)


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_every_pair_of_linked_sets(spark, percent):
    rng = random.Random(percent)
    rows = family_rows(rng) + [(5000 + i, " ".join(edited([f"b{k}" for k in range(n)], 1, rng))) for i, n in enumerate([9, 10, 11, 13, 16, 20, 25] * 4)]
    pairs, members = linked_sets(spark.createDataFrame(rows, "doc_id long, text string"), 4, percent)
    node = {r.doc_id: r.node for r in members.collect()}
    sets = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        if w:
            sets[node[doc]] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or {tuple(w)}
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert {(min(r), max(r)) for r in map(tuple, pairs.collect())} == want


def test_near_copies_without_a_centre(spark):
    """Copies whose differences overlap in part, so that most lists hold several components at first."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(200)]
    shared = [edited(base, 3, rng) for _ in range(6)]
    rows = [(i, " ".join(edited(rng.choice(shared), rng.randrange(9), rng))) for i in range(150)]
    got = sorted(map(tuple, link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows)


def test_very_long_text(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**5)}" for _ in range(150_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:140_000])), (3, " ".join(words[:70_000])), (4, "x" * 3_000_000), (5, "X" * 3_000_000)]
    got = {r.doc_id: r.component_id for r in link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_keep_one_judges_rows(spark):
    """Repeated and null ids: every row is a document of its own."""
    a = " ".join(f"a{i}" for i in range(50))
    b = " ".join(f"b{i}" for i in range(50))
    c = " ".join(f"c{i}" for i in range(50))
    rows = [(1, a, "p"), (5, a, "q"), (5, b, "r"), (7, c, "s"), (7, c, "t"), (None, a, "u"), (None, "only here " * 9, "v"), (None, None, "w"), (8, "", "x"), (8, None, "y"), (8, b, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string").withColumnRenamed("k1", "id")
    docs = docs.withColumns({"k1": docs["id"], "verdict": docs["id"]})
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(r.id for r in kept.collect())
    assert got in (["p", "r", "s", "v", "w", "x", "y"], ["p", "r", "t", "v", "w", "x", "y"])


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_one_id_with_several_texts_and_null_ids(spark):
    rng = random.Random(8)
    text = [[f"t{k}w{i}" for i in range(120)] for k in range(6)]
    near = [" ".join(edited(t, 1, rng)) for t in text]
    text = [" ".join(t) for t in text]
    rows = [(1, text[0]), (1, text[1]), (1, text[2]), (5, near[0]), (6, near[1]), (7, near[2]), (None, text[3]), (None, text[4]), (9, near[3]), (8, near[4]), (None, text[5]), (None, "")]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [(1, 117, 1)] * 3 + [(5, 117, 1), (6, 117, 1), (7, 117, 1), (None, 117, 9), (None, 117, 8), (9, 117, 9), (8, 117, 8), (None, 117, None), (None, 0, None)]
    assert sorted(got, key=str) == sorted(want, key=str)
