"""The similarity join against plain Python."""

import datetime as dt
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexloom.operators.similarity import link_cases


def brute(rows, side=0.7, cutoff=0.65, bonus=0.15, max_df=0.8, min_df=1, terms=lambda s: re.findall(r"\b\w\w+\b", s)):
    """rows: (circuit, doc, ord, left, right, date, is_appellate); right is None for captions without sides."""
    out = {}
    for circuit in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == circuit]
        for sided in (False, True):
            index = [r for r in mine if r[6] == 0 and (r[4] is not None or not sided)]
            whole = lambda r: r[3] if r[4] is None else f"{r[3]} {r[4]}"
            norms = lambda r, sided=sided: [r[3], r[4]] if sided else [whole(r)]
            every = [n for r in index for n in norms(r)]
            df = Counter(t for n in every for t in set(terms(n)))
            idf = {t: math.log((1 + len(every)) / (1 + n)) + 1 for t, n in df.items() if min_df <= n <= max_df * len(every)}

            def vec(n, idf=idf):
                w = {t: k * idf[t] for t, k in Counter(terms(n)).items() if t in idf}
                length = math.sqrt(sum(x * x for x in w.values()))
                return {t: x / length for t, x in w.items()}

            for a in mine:
                if a[6] != 1 or (a[4] is not None) != sided:
                    continue
                best = None
                for d in index:
                    if a[5] is not None and not (d[5] is not None and a[5].replace(year=a[5].year - 7) <= d[5] <= a[5]):
                        continue
                    s = [round(sum(x * vec(y).get(t, 0) for t, x in vec(n).items()), 12) for n, y in zip(norms(a), norms(d), strict=True)]
                    if sided and min(s) < side:
                        continue
                    score = sum(s) / len(s)
                    if score > cutoff and (best is None or (-score, d[2]) < best[:2]):
                        best = (-score, d[2], d[1])
                if best:
                    out[circuit, a[1]] = (best[2], round((0 if sided else bonus) - best[0], 6))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [f"name{i}" for i in range(12)] + ["acme", "acme", "smith", "smith", "jones", "bank"]
    rows = []
    for i in range(260):
        side = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))
        date = None if rng.random() < 0.1 else dt.date(1980 + rng.randrange(12), 3, 1 + rng.randrange(3))
        rows.append((rng.choice(["c1", "c2"]), i, rng.randrange(10**6), side(), side() if rng.random() < 0.6 else None, date, int(rng.random() < 0.3)))
    twins = [(r[0], 1000 + r[1], *r[2:]) for r in rows[:20]]  # equal in everything but the id
    return rows + [(*t[:2], t[2] + 1, *t[3:]) for t in twins]


def frame(spark, rows):
    flat = [(c, doc, ord_, left if right is None else f"{left} v. {right}", date, flag) for c, doc, ord_, left, right, date, flag in rows]
    return spark.createDataFrame(flat, "circuit string, doc long, ord long, name string, decision_date date, is_appellate int")


@pytest.mark.parametrize("options", [{}, {"side_threshold": 0.3, "cutoff": 0.3}, {"max_df": 0.2, "min_df": 3}])
def test_against_brute_force(spark, options):
    rows = corpus(len(options))
    got = {(r.circuit, r.a): (r.d, round(r.score, 6)) for r in link_cases(frame(spark, rows), **options).collect()}
    renamed = {"side_threshold": "side"}
    want = brute(rows, **{renamed.get(k, k): v for k, v in options.items()})
    assert want and got == want


def test_own_normaliser_and_terms(spark):
    rows = corpus(7)
    got = link_cases(frame(spark, rows), normalize=lambda c: F.regexp_replace(F.lower(c), " v. ", " "), analyze=lambda c: F.transform(F.split(c, " "), lambda w: F.right(w, F.lit(2))))
    want = brute(rows, terms=lambda s: [w[-2:] for w in s.split(" ")])
    assert {(r.circuit, r.a): (r.d, round(r.score, 6)) for r in got.collect()} == want


def test_empty(spark):
    assert link_cases(frame(spark, corpus(1)).limit(0)).collect() == []
