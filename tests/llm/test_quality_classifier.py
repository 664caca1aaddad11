import numpy as np

from lexloom.llm import quality_classifier as Q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in Q.predictions(docs, labels).collect()}
    assert len(got) == docs.count()
    for held in (False, True):
        pairs = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out is held]
        assert np.mean([a == b for a, b in pairs]) > 0.93


def test_views_pass_labels_on():
    rng = np.random.default_rng(0)
    rows = [{"doc_id": i, "text": " ".join(rng.choice(["alpha", "beta"] if i % 2 else ["gamma", "delta"], 6)), "lang": "en", "source": "s1" if i % 2 else "s0"} for i in range(40)]
    y = np.array([i % 2 for i in range(10)])
    content, meta = Q.co_train(Q._batch(rows[:10]), y, Q._batch(rows[10:]), passed=5)
    b = Q._batch(rows)
    total = content.log_odds(Q.content_view(b.column("text"))) + meta.log_odds(Q.meta_view(b))
    assert ((total > 0) == np.array([i % 2 == 1 for i in range(40)])).all()


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, None, None, "x"), (2, "", "en", "a", "y"), (None, "b c", "en", "a", "z")], "doc_id long, text string, lang string, source string, score string")
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    assert [r.score for r in Q.predictions(docs, labels).collect()] == [0.5] * 3
    assert Q.predictions(docs.limit(0), labels).collect() == []


def test_all_unlabelled_documents_are_scored_and_passed_on(spark, monkeypatch):
    """Every round looks at all unlabelled documents, and what is passed on grows with them."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta"] if i % 2 else ["gamma", "delta"], 6)), "en", "s1" if i % 2 else "s0") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    monkeypatch.setattr(Q, "PASSED", 5)
    monkeypatch.setattr(Q, "SHARD_ROWS", 40)
    counted, limits = [], Q._limits
    monkeypatch.setattr(Q, "_limits", lambda found, passed: counted.append((sum(n for k, n in found.items() if k[0] == 0), passed)) or limits(found, passed))
    got = Q.predictions(docs, labels).collect()
    free = sum(not r.held_out and r.doc_id >= 40 for r in got)
    assert len(got) == 3000 and all(r.predicted == r.doc_id % 2 for r in got)
    assert counted[0] == (free, -(-free // 100)) and len(counted) == Q.ROUNDS
    assert all(free * 0.01 < a[0] - b[0] < free * 0.06 for a, b in zip(counted, counted[1:]))


def test_packed_features_are_the_same():
    b = Q._batch([{"doc_id": i, "text": t, "lang": None, "source": "s"} for i, t in enumerate(["a b a b a", None, "x", "", "é ü é"])])
    first, bucket, count = Q.content_counts(b.column("text"))
    assert all((x == y).all() for x, y in zip((first, bucket, count), Q._unpack(Q._pack(first, bucket, count))))


def test_each_row_of_a_repeated_id_is_judged(spark):
    rng = np.random.default_rng(3)
    word = lambda good: " ".join(rng.choice(["alpha", "beta"] if good else ["gamma", "delta"], 6))
    rows = [(i, word(i % 2), "en", "s1" if i % 2 else "s0", "x") for i in range(200)]
    rows += [(500, word(1), "en", "s1", "good"), (500, word(0), "en", "s0", "bad"), (None, word(1), "en", "s1", "good"), (None, word(0), "en", "s0", "bad")] + [(502, word(1), "en", "s1", "good")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, predicted string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(str(r.doc_id) for r in got if r.predicted != "x") == ["500", "502", "502", "None"] and {r.predicted for r in got} == {"x", "good"}
    assert all(r.doc_id % 2 for r in got if r.predicted == "x")


def test_the_prior_counts_once():
    assert Q.combined(np.array([1.0]), np.array([0.5]), 0.5).tolist() == [1.0]
    view = Q.View(np.zeros(4))
    Q._calibrate(view, np.zeros(40), np.array([1] * 30 + [0] * 10))
    odds = view.log_odds((np.array([0, 0]), np.zeros(0, int), np.zeros(0)))
    assert abs(Q.combined(odds, odds, view.prior)[0] - np.log(3)) < 0.1


def test_very_long_text_and_ties(spark):
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(["alpha " * 200_000, "x" * 1_000_000, "alpha", "alpha"] + ["beta"] * 8)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.score for r in Q.predictions(docs, spark.createDataFrame([(2, 1), (4, 0), (5, 0), (3, 1)], "doc_id long, quality int")).collect()}
    assert len(got) == 12 and len({got[i] for i in range(4, 12)}) == 1
