"""The pipeline against plain Python, stage by stage, each on its own input."""

import re

import public_tokenizers
import tiktoken

import corpus_pipeline as P
from lexloom.llm import bpe, toxicity
from lexloom.llm.storage import materialize

from .test_ngram_join import brute as groups
from .test_substring_dedup import brute as repeats

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "source_mixing", "byte_bpe"]
    rows = lambda d: {r.doc_id: r.text for r in d.collect()}

    toxic = {r.doc_id for r in toxicity.predictions(docs, labels).where("predicted = 1").collect()}
    one = materialize(P.reject_toxic(spark, docs, SF), "t")
    assert one.columns == docs.columns and rows(one) == {i: t for i, t in rows(docs).items() if i not in toxic}

    two = materialize(P.one_of_each_group(spark, one, SF), "t")
    want = {i for i, _, c in groups(list(rows(one).items()), 5, 80) if i == c}
    assert two.columns == docs.columns and set(rows(two)) == want

    three = materialize(P.without_repeats(spark, two, SF), "t")
    removed = {i: n for i, _, n, _ in repeats(list(rows(two).items()))}
    source, left = rows(two), rows(three)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    assert three.columns == docs.columns and {i: len(words(t)) for i, t in left.items()} == {i: len(words(t)) - removed[i] for i, t in source.items()}

    four = materialize(P.mixed(spark, three, SF), "t")
    assert four.columns == docs.columns and rows(four) == left

    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = P.encoded(spark, four, SF).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {i: enc.encode_ordinary(t or "") for i, t in left.items()} and all(r.n_tokens == len(r.ids) for r in got)


def test_every_prefix_of_the_result_has_the_shares_of_the_mix(spark, tmp_path):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(6)), "en", "src0" if i % 4 == 0 else "src1" if i % 4 == 1 else "src10", 40) for i in range(1200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == list(range(1200)) and len({r.position for r in got}) == 1200
    source, share = {r[0]: r[3] for r in rows}, {"src0": 4 / 7, "src1": 2 / 7, "src10": 1 / 7}
    had = dict.fromkeys(share, 0)
    for n, r in enumerate(sorted(got, key=lambda r: r.position), 1):
        had[source[r.doc_id]] += 1
        assert all(abs(had[s] - w * n) < 2 * 64 for s, w in share.items())
        if had["src0"] == 300:  # the first source to run out
            break
    else:
        raise AssertionError("src0 never ran out")


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(40))
    near = " ".join(f"n{i}" for i in range(60))
    own = [" ".join(f"{x}{i}" for i in range(20)) for x in "ab"]
    rows = [
        (1, near, "en", "src0"), (2, near + " more", "en", "src0"), (3, f"{passage} {own[0]}", None, None), (4, f"{own[1]} {passage}", "fr", "nobody"), (5, None, None, None), (6, "", "en", "src1"),
        (7, "one text", "en", "src1"), (7, "another text", "en", "src1"), (7, "another text", "en", "src1"), (None, "no id", "en", "src2"), (None, None, None, None), (8, "long " * 50_000 + "end", "en", "src10"),
    ]
    names = ["position", "row", "firsts", "ends", "slot", "stream", "k1", "k2", "verdict", "toxicity", "node", "place"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *names) for r in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = docs
    for name, stage in P.STAGES[:-1]:
        at = materialize(stage(spark, at, str(tmp_path)), name)
        assert at.dtypes == docs.dtypes and all(tuple(r[n] for n in names) == tuple(names) for r in at.collect())
    left = sorted(((r.doc_id, r.text) for r in at.collect()), key=str)
    want = [(1, near), (3, own[0]), (4, own[1]), (5, None), (6, ""), (7, "one text"), (7, "another text"), (None, "no id"), (None, None), (8, "")]
    assert [(d, t if d != 8 else "") for d, t in left] == sorted(want, key=str)
    got = P.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in want) and len({r.position for r in got}) == len(want)
    assert all((r.n_tokens == 0) == (not r.ids) for r in got)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = P.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "position", "n_tokens", "ids"] and got.collect() == []
