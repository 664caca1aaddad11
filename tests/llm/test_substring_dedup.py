import hashlib
import random
import re

import pytest

from lexloom.llm import substring_dedup as S

SF = "/root/testdata/sf0.001"


def brute(rows, width=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    at = {}
    for d, w in enumerate(words):
        for i in range(len(w) - width + 1):
            at.setdefault(tuple(w[i : i + width]), []).append((d, i))
    gone = [set() for _ in rows]
    for v in at.values():
        if len(v) > 1:
            for d, i in v:
                gone[d].update(range(i, i + width))
    return sorted(
        ((doc, len(w), len(g), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in g).encode()).hexdigest()) for (doc, _), w, g in zip(rows, words, gone, strict=True)), key=str
    )


def planted(rng):
    def fresh(n):
        return [f"w{rng.randrange(10**7)}" for _ in range(n)]

    passages = [fresh(n) for n in (34, 35, 36, 50, 70, 200)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "a " * 100), (4, "a " * 35), (5, " ".join(fresh(30)))]
    for i in range(60):
        body = fresh(rng.randrange(0, 120))
        for p in rng.sample(passages, 2):
            a = rng.randrange(0, len(p) // 3)
            cut = p[a:] if rng.random() < 0.5 else p
            at = rng.randrange(len(body) + 1)
            body[at:at] = cut
        rows.append((10 + i, "\n".join(body) if i % 2 else " ".join(body)))
    rows += [rows[20], rows[20], (rows[21][0], "another text"), (500, rows[22][1]), (None, rows[23][1])]
    once = fresh(80)
    rows.append((600, " ".join(once + fresh(5) + once)))
    return rows


@pytest.mark.parametrize("crowd", [5000, 3])
def test_against_brute_force(spark, crowd, monkeypatch):
    monkeypatch.setattr(S, "CROWD", crowd)
    monkeypatch.setattr(S, "AUTOMATON_WORDS", 2000)
    rows = planted(random.Random(crowd))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", S.F.lit("clash"))
    assert sorted(map(tuple, S.summary(docs).collect()), key=str) == brute(rows)


def test_whole_table_and_cleaned_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert sorted(map(tuple, S.summary(docs).collect()), key=str) == want
    cleaned = S.remove_repeats(docs)
    assert cleaned.columns == docs.columns
    left = {r.doc_id: r.text for r in cleaned.collect()}
    source = dict(rows)
    for doc, _, removed, sha in want:
        words = " ".join(re.findall(r"[^\x20\x09-\x0D]+", left[doc] or ""))
        assert hashlib.sha256(words.encode()).hexdigest() == sha
        if not removed:
            assert left[doc] == source[doc]


def test_empty(spark):
    assert S.summary(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_clashing_names_null_ids_and_long_texts(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(60))
    filler = [" ".join(f"f{rng.randrange(10**6)}" for _ in range(n)) for n in (120_000, 50, 3)]
    rows = [(1, f"{filler[0]} {passage} end"), (1, f"{passage} {filler[1]}"), (None, f"{filler[2]}\n{passage}"), (None, None), (4, "same words " * 30), (4, "same words " * 30)]
    docs = spark.createDataFrame([(d, t, "x", 1, "y", "z") for d, t in rows], "doc_id long, text string, firsts string, ends int, row string, _row string")
    got = S.remove_repeats(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    left = [(r.doc_id, r.text) for r in got.collect()]
    want = [(1, f"{filler[0]} end"), (1, filler[1]), (None, filler[2]), (None, None), (4, ""), (4, "")]
    assert sorted(left, key=str) == sorted(want, key=str)
    assert sorted(map(tuple, S.summary(docs).collect()), key=str) == brute(rows)


def test_windows_of_equal_hash_are_compared_by_words(monkeypatch):
    monkeypatch.setattr(S, "window_hashes", lambda words, width: S.np.zeros(max(0, len(words) - width + 1), S.np.uint64))
    shard = S._Shard(3)
    for text in ("a b c d", "x y z", "b c d", "q r s t"):
        shard.add(text.encode(), 1, [(len(shard.texts), 0)])
    assert sorted(shard.locate()) == [(0, 1, 4), (2, 0, 3)]
