"""Names to ids against plain Python, and the rows made on the way."""

import random
import re

from lexloom.operators.resolve import resolve_judges

from .plan_rows import most_rows


def frames(spark, named, judges):
    return spark.createDataFrame(named, "case_id long, judge string, court string"), spark.createDataFrame(judges, "judge_id long, ord long, first_name string, last_name string, court_name string")


def brute(named, judges):
    key = lambda s: re.sub("[^a-z]", "", (s or "").lower())
    of_case = {}
    for case, judge, court in named:
        first, last, court = key(judge.split()[0]), key(judge.split()[-1]), key(court)
        for jid, order, j_first, j_last, j_court in judges:
            if key(j_last) == last:
                c = key(j_court)
                of_case.setdefault(case, []).append(((order, jid), key(j_first.split()[0]) == first, bool(court and c) and (court in c or c in court)))
    out = {case: None for case, _, _ in named}
    for case, hits in of_case.items():
        firsts, courts, both = [h for h in hits if h[1]], [h for h in hits if h[2]], [h for h in hits if h[1] and h[2]]
        pick = hits if len(hits) == 1 else firsts if len(firsts) == 1 else both if len(firsts) > 1 and both else courts if len(courts) == 1 else None
        out[case] = min(pick)[0][1] if pick else None
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    courts = ["D. Maine", "Maine", "N.D. Ohio", "Ohio", "", None, "Guam"]
    judges = [(i, rng.randrange(40), rng.choice(["Ann", "Bob M.", "Cy"]), rng.choice(["Lee", "Orr", "Poe", "Ito"]) + rng.choice("abc"), rng.choice(courts)) for i in range(30)]
    named = [(i % 180, rng.choice(["Ann", "Bob", "Zed"]) + " " + rng.choice(["Lee", "Orr", "Poe", "Ito"]) + rng.choice("abc"), rng.choice(courts)) for i in range(200)]
    got = {r.case_id: r.district_judge_id for r in resolve_judges(*frames(spark, named, judges)).collect()}
    want = brute(named, judges)
    assert got == want and None in want.values() and len(set(want.values())) > 5


def test_a_common_name_makes_no_row_for_each_case_and_judge(spark):
    named = [(i, f"Ann{i % 3} Lee", f"court of {i % 5}") for i in range(1000)]
    judges = [(i, i, f"Ann{i % 2}", "Lee", "court of maine") for i in range(400)]
    assert most_rows(resolve_judges(*frames(spark, named, judges))) <= 2000
