import itertools
import random
from fractions import Fraction
from math import ceil, floor

import pytest

from lexloom.llm import mixing as M

SF = "/root/testdata/sf0.001"

WEIGHTS = [
    {"a": 1}, {"a": 1, "b": 1}, {"a": 5, "b": 2, "c": 1}, {"a": 7, "b": 7, "c": 3, "d": 1, "e": 13},
    {"a": 1, "b": 100000}, {"a": 1, "b": 0.0001}, {"a": 0.1, "b": 0.2, "c": 1 / 3}, {f"s{i}": 1 + i / 997 for i in range(60)},
]


@pytest.mark.parametrize("weights", WEIGHTS)
def test_every_prefix_is_within_one_block(weights):
    whole = M.whole_weights(weights)
    total = sum(whole.values())
    assert {s: Fraction(w, total) for s, w in whole.items()} == {s: Fraction(str(w)) / sum(Fraction(str(x)) for x in weights.values()) for s, w in weights.items()}
    had = dict.fromkeys(whole, 0)
    for slot, s in enumerate(itertools.islice(M.earliest_deadlines(whole), 3000)):
        k = had[s]
        assert k * total // whole[s] <= slot < ceil(Fraction((k + 1) * total, whole[s]))
        had[s] += 1
        assert all(abs(had[x] - Fraction(whole[x] * (slot + 1), total)) < 1 for x in whole)


def slow(weights, blocks):
    """(source, block) of each slot, by looking at all sources at each slot and no period."""
    left = {s: n for s, n in blocks.items() if n and weights.get(s, 0) > 0}
    had, out = dict.fromkeys(left, 0), []
    while left:
        total = sum(Fraction(str(weights[s])) for s in left)
        w = {s: Fraction(str(weights[s])) / total for s in left}
        done = dict.fromkeys(w, 0)
        for t in itertools.count():
            ready = [s for s in w if floor(done[s] / w[s]) <= t]
            best = min(ready, key=lambda s: (ceil((done[s] + 1) / w[s]), -w[s], s))
            out.append((best, had[best]))
            had[best] += 1
            done[best] += 1
            left[best] -= 1
            if not left[best]:
                del left[best]
                break
    return out


@pytest.mark.parametrize("seed", range(6))
def test_places_against_a_plain_simulation(spark, seed, monkeypatch):
    monkeypatch.setattr(M, "PIECE", 7)
    rng = random.Random(seed)
    weights = {s: rng.choice([1, 2, 0.5, 3.7, 0.001, 50]) for s in "abcdef"}
    blocks = {s: rng.randrange(0, 60) for s in "abcdef"}
    got = sorted(M.places(spark, M.phases(M.whole_weights(weights), blocks)).collect(), key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(sum(blocks.values()))) and all(r.release <= r.slot < r.deadline for r in got)
    assert [(r.stream, r.block) for r in got] == slow(weights, blocks)


def test_many_sources_are_quick():
    weights = {f"s{i}": 1 + i / 7 for i in range(300)}
    plan = M.phases(M.whole_weights(weights), {s: 40 for s in weights})
    assert len(plan) <= 300 and sum(sum(p["used"].values()) for p in plan) == 300 * 40


def test_schedule(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 40)
    rng = random.Random(0)
    rows = [(i, rng.choice(["a"] * 5 + ["b", "b", "c", None, "z"])) for i in range(700)] + [(3, "a"), (3, "a"), (None, "b"), (None, None)]
    docs = spark.createDataFrame([(*r, i, "mine") for i, r in enumerate(rows)], "doc_id long, source string, slot int, stream string")
    weights = {"a": 2, "b": 1, "c": 1, "z": 0}
    out = M.schedule(docs, weights, block_size=8)
    assert out.columns == [*docs.columns, "stream_", "block", "phase", "release", "deadline", "slot_", "position"]
    got = out.collect()
    assert sorted(r.slot for r in got) == list(range(len(rows))) and {r.stream for r in got} == {"mine"}
    assert len({r.position for r in got}) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.slot_, set()).add((r.stream_, r.block))
    assert sorted(slots) == list(range(len(slots))) and all(len(v) == 1 for v in slots.values())
    assert all(r.release <= r.slot_ < r.deadline for r in got)
    counts = {}
    for r in got:
        counts[r.stream_] = counts.get(r.stream_, 0) + 1
    whole = {"a": 2, "b": 1, "c": 1, M.OTHER: 1}
    want = slow(whole, {s: -(-n // 8) for s, n in counts.items()})
    assert [next(iter(slots[i])) for i in range(len(want))] == want
    assert {next(iter(slots[i]))[0] for i in range(len(want), len(slots))} == {M.LAST}


def test_whole_table_against_a_plain_simulation(spark):
    from lexloom.llm.queries import SOURCE_WEIGHTS, op7_source_mixing

    got = op7_source_mixing(spark, "/root/testdata/sf0.01").collect()
    n = {}
    for r in got:
        n[r.stream] = n.get(r.stream, 0) + 1
    want = slow(SOURCE_WEIGHTS | {M.OTHER: 1.0}, {s: -(-x // 64) for s, x in n.items()})
    order = sorted({(r.slot, r.stream, r.block) for r in got})
    assert [(s, k) for _, s, k in order] == want and len({r.position for r in got}) == len(got)


def test_order_and_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("position", M.F.lit(777))
    mixed = M.in_mix_order(docs, {"src0": 1, "src1": 3})
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect()) and {r.position for r in rows} == {777}
    assert M.schedule(docs.limit(0), {"src0": 1}).collect() == []
    assert len(M.schedule(docs, {}, other=0).collect()) == len(rows)  # no weight at all: one stream
