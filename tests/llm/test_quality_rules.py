import random
import re

import duckdb
import pytest

from lexloom.llm import queries as Q
from lexloom.llm import quality_rules as R

SF = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_measures(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "é中\U0001f600 b\x0bc\x0cd\r\ne", "x y\nx y\n\nx y\n \n", "# * $ % & | < > ##"]
    texts += [" ".join(rng.choice("abc") for _ in range(n)) for n in (7, 8, 9, 15, 16, 17, 40, 400)]
    texts += ["p q r s t u v w " * 3, " ".join(map(str, range(3000))) + " " + " ".join(map(str, range(100)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", R.F.lit("clash"))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in R.measured(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    real = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in real.collect()}
    for r in R.measured(real).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text[r.doc_id])


def test_policy_and_ablations(spark):
    rows = [(1, "a b c"), (2, " ".join(f"w{i}" for i in range(30))), (3, " ".join(f"#w{i}" for i in range(30))), (4, "# #")]
    led = R.ledger(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.kept for r in R.apply_policy(led, "v1").collect()} == {1: False, 2: True, 3: False, 4: False}
    found = {r.rule: (r.n_failed, r.n_only, r.kept_without) for r in R.ablations(led, "v1").collect()}
    assert found["few_words"] == (2, 1, 2) and found["symbol_heavy"] == (2, 1, 2) and found["shouting"] == (0, 0, 1)
    assert R.ledger(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("name, by", [("op5_quality_rules", "doc_id"), ("quality_ablations", "rule")])
def test_sql_gives_the_same(spark, name, by):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    sql = con.execute(Q.oracle_sql()[name]).to_arrow_table().to_pylist()
    got = [r.asDict() for r in Q.queries()[name](spark, SF).collect()]
    key = lambda r: r[by]
    assert sorted(got, key=key) == sorted(sql, key=key)


def test_very_long_text(spark):
    text = "x" * 1_000_000 + " " + "one two three four five six seven eight nine " * 20_000
    got = R.ledger(spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")).collect()
    assert {(r.n_words, r.word_chars, r.n_repeat_words) for r in got} == {(180_001, 1_000_000 + 36 * 20_000, 180_000)} and len(got) == 3
