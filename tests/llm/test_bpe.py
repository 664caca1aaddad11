import hashlib
import random

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken

from lexloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"


def expected(rows):
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    out = []
    for doc, text in rows:
        ids = enc.encode_ordinary(text or "")
        out.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_pretokens_match_the_pattern():
    rng = random.Random(0)
    pat = regex.compile(public_tokenizers.PATTERN)
    letters = "ab'stvemrld  \n\t é9٣!?中\U0001f600　S\x85\x1c"
    for _ in range(1500):
        rows = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 14))) for _ in range(5)]
        tokens, first = bpe.pretokens(pa.array(rows))
        for i, r in enumerate(rows):
            assert tokens[first[i] : first[i + 1]].to_pylist() == pat.findall(r)


def test_digests_equal_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(-1, None), (-2, ""), (-3, "  \n"), (-4, "don't 'stop  it's\n\n 'tis"), (-5, "x" * 30000), (None, "<|endoftext|> é中\U0001f600"), (-6, "same"), (-6, "same")]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in both.collect()]
    got = bpe.digests(both.withColumn("ids", bpe.F.lit("clash")), PATH, block_bytes=100_000).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_round_trip_and_empty_table(spark):
    rows = [(1, "Das ist gut, n'est-ce pas? "), (2, None), (3, "\ttab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    back = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert back == {i: t or "" for i, t in rows}
    assert bpe.digests(docs.limit(0), PATH).collect() == []


def test_words_of_a_missing_block_are_an_error():
    left = pa.table({"first": pa.array([5], pa.int64())})
    right = pa.table({"first": pa.array([0], pa.int64())})
    assert list(bpe._documents(left, right.slice(0, 0))) == []
    try:
        list(bpe._documents(left, right))
    except RuntimeError:
        return
    raise AssertionError("the words were dropped")
