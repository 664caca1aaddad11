"""The similarity join where most terms are rare, and the rows it makes for common captions; quick paths of caption functions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text
from lexloom.operators import similarity
from lexloom.operators.similarity import link_cases

from .plan_rows import most_rows
from .test_similarity import brute, corpus, frame


@pytest.mark.parametrize("common, options", [(3, {}), (0, {"side_threshold": 0.3, "cutoff": 0.3}), (6, {"max_df": 0.2, "min_df": 3}), (2, {"years": 1})])
def test_few_common_terms(spark, monkeypatch, common, options):
    monkeypatch.setattr(similarity, "_COMMON", common)
    rows = corpus(20 + common)
    got = {(r.circuit, r.a): (r.d, round(r.score, 6)) for r in link_cases(frame(spark, rows), **options).collect()}
    if "years" in options:  # dates as they would have to be for the default of seven
        rows = [(*r[:5], r[5] and (r[5].replace(year=r[5].year * 7 - 12000)), r[6]) for r in rows]
        options = {}
    want = brute(rows, **{{"side_threshold": "side"}.get(k, k): v for k, v in options.items()})
    assert want and got == want


def test_a_common_caption_makes_no_row_for_each_date_and_appeal(spark):
    day = lambda i: dt.date(1990, 1, 1) + dt.timedelta(days=9 * i)
    rows = [("c", i, i, "acme bank", None, day(i), 0) for i in range(400)] + [("c", 1000 + i, i, "acme bank", None, day(i), 1) for i in range(400)]
    rows += [("c", 2000 + i, i, f"other{i}", None, day(i), 0) for i in range(200)]  # so that the terms are not in nearly all
    df = link_cases(frame(spark, rows))
    assert most_rows(df) <= 8000
    before = lambda d: d.replace(year=d.year - 7, day=min(d.day, 28) if d.month == 2 else d.day)
    first = {1000 + i: min(j for j in range(i + 1) if day(j) >= before(day(i))) for i in range(400)}
    assert {r.a: r.d for r in df.collect()} == first


def test_quick_normaliser_is_the_general_one(spark):
    rng = random.Random(5)
    bits = ["v", "v.", "vs.", "V.", "Co.", "co", "Inc.", "inc.ltd", "LLC", "h/w", "hw", "his", "wife", "His Wife", "husband", "&", "a&b", "the", "United", "States", "Smith", "O'Neil", "(US)", "#12", "x-co", "co-v-x", "v.-x", "é", "_co", "ltd.,", "No.", "al.", "\t", ""]
    names = [rng.choice(["", " "]) + rng.choice([" ", " ", ", ", "  ", "-"]).join(rng.choice(bits) for _ in range(rng.randrange(1, 7))) for _ in range(3000)]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    norm = text.normalize_caption(F.col("name"))
    whole = F.regexp_extract_all(norm, F.lit(similarity.TERM), F.lit(0))
    assert df.where((norm != text.normalize_any(F.col("name"))) | (similarity.word_terms(norm) != whole)).collect() == []
