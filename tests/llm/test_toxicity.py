import random
import zlib

import numpy as np
import pyarrow as pa

from lexloom.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def test_subwords_have_a_bucket_per_ngram():
    first, bucket = T.subwords(pa.array(["ab", "idiot", "é", ""]))
    assert np.diff(first).tolist() == [2 + 1, 5 + 4 + 3, 1, 1] and len(bucket) == first[-1]


def test_misspellings_share_vectors():
    rng = random.Random(1)
    plain = [f"{a}{b}{c}" for a in ("ta", "lo", "mi", "re") for b in ("ber", "nat", "sil") for c in ("o", "en", "us")]
    texts, labels = [], []
    for i in range(300):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        if i % 2:
            words[rng.randrange(len(words))] = rng.choice(["grumblor", "snivelit"])
        texts.append(" ".join(words))
        labels.append(i % 2)
    m = T.train(texts, labels)
    s = m.scores(pa.array(["taber grumbl0r loneno", "Taber GRUMBLORR misilus", "taber lonaten misilus", "", None]))
    assert s[0] > 0.5 and s[1] > 0.5 and s[2] < 0.5 and 0 <= s[3] <= 1 and s[3] == s[4]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in T.predictions(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    seen = [(r.toxic, got[r.doc_id].predicted) for r in labels.collect() if not got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in seen]) > 0.97
    unseen = [(r.toxic, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in unseen]) > 0.8


def test_one_class_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (None, "c", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert [r.predicted for r in T.predictions(docs, labels).collect()] == [0, 0, 0]
    assert T.predictions(docs.limit(0), labels).collect() == []
    assert T.keep_clean(docs, labels).columns == docs.columns


def test_a_toxic_word_of_few_documents_counts(monkeypatch):
    """What has a vector does not depend on the size of the sample, and pieces of clean documents don't count."""
    monkeypatch.setattr(T, "PIECES", 8)
    rng = random.Random(2)
    plain = [f"{a}{b}{c}" for a in ("ta", "lo", "mi", "re") for b in ("ber", "nat", "sil") for c in ("o", "en", "us")]
    texts, labels = [], []
    for i in range(1200):
        words = [rng.choice(plain) for _ in range(rng.randrange(10, 30))]
        if i % 2:
            words[rng.randrange(len(words))] = "quizzwack" if i % 100 == 1 else "grumblor"
        if i in (0, 2):
            words = ["zyxovurp"] * 10 + words
        texts.append(" ".join(words))
        labels.append(i % 2)
    m = T.train(texts, labels)
    s = m.scores(pa.array(["taber quizzwack loneno misilo", "taber loneno misilo renatus"]))
    assert s[0] > 0.5 > s[1]
    first, bucket = T.subwords(pa.array(["zyxovurp"]))
    assert (m.weights[bucket] == 0).mean() > 0.9  # two documents, many pieces


def test_only_empty_texts_and_repeated_ids(spark):
    docs = spark.createDataFrame([(i, None if i % 2 else " ") for i in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    assert {r.score for r in T.predictions(docs, labels).collect()} == {0.5}
    rows = [(i % 40, f"{'grumblor' if i % 2 else 'taber'} loneno {i}") for i in range(200)]
    scores = []
    for parts in (1, 7):
        many = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        scores.append(sorted(map(tuple, T.predictions(many, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")).collect())))
    assert scores[0] == scores[1] and len(scores[0]) == 200


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "taber " * 300_000), (2, "x" * 2_000_000), (3, "taber"), (3, "taber")], "doc_id long, text string")
    got = [r.score for r in T.score(docs, T.train(["taber loneno", "grumblor misilo"] * 9, [0, 1] * 9)).orderBy("doc_id").collect()]
    assert len(got) == 4 and abs(got[0] - got[2]) < 1e-6 and got[2] == got[3] < 0.5
