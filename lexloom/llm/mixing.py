"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of ``block_size`` documents in a random but fixed order.  With
weight ``w`` (its exact share of all weights) block ``k`` of a source is released at slot
``floor(k / w)`` and due at ``ceil((k + 1) / w)``.  Slots go to the released block with the
earliest deadline, so after any number of slots each source is less than one block away from
its target.

Weights are exact: floats count as the decimal number they print, and all are scaled to whole
numbers.  The schedule repeats after as many slots as their sum.  At most one such period of a
phase is scheduled, and never more slots than there are blocks, with a heap of one entry per
source; a block finds its slot by arithmetic: period number times period length plus its place
there.  Weights with a long period (thousandths of very uneven sizes) cost the driver one number
per block, so larger blocks suit a very large corpus.  Slots become a table with a row per block,
which is joined with the documents.

A source that runs out leaves the schedule.  The others go on with their weights in a new
phase, so every document gets a place and none is dropped or repeated.  The number of phases
is at most the number of weighted sources.

Sources are numbered within hash buckets of bounded size whose counts are added up first, so
one source may hold most rows.  Sources without a weight of their own, and null sources, share
the stream ``OTHER``.  Sources of weight 0 and less are placed after all others, in one stream.
Ties of deadlines go to the larger weight, then to the name; ties of the order of documents are
broken by doc_id and then by the hash of all columns; repeated rows are placed one by one.  Null
ids are ids like others.  Empty tables give an empty result; columns ``doc_id`` and ``source`` are
required, texts are not read, other columns pass by.  A column of the schedule whose name is taken
gets marks at its end.
"""

from __future__ import annotations

import heapq
import itertools
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from math import ceil, gcd, lcm

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .packing import fresh_name
from .storage import materialize

OTHER = "(other)"
LAST = "(last)"
#: Blocks of one source that a task spreads out at once.
PIECE = 65_536
#: Documents that one window task numbers, about.
BUCKET_ROWS = 4_000


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportion of the weights above 0."""
    exact = {s: Fraction(str(w)) if isinstance(w, float) else Fraction(w) for s, w in weights.items()}
    exact = {s: w for s, w in exact.items() if w > 0}
    scale = lcm(*(w.denominator for w in exact.values()))
    out = {s: int(w * scale) for s, w in exact.items()}
    shared = gcd(*out.values()) or 1
    return {s: n // shared for s, n in out.items()}


def earliest_deadlines(weights: dict[str, int]) -> Iterator[str]:
    """The source of each slot: earliest deadline first among released blocks, without end."""
    total = sum(weights.values())
    coming = [(0, s, 0) for s in weights]  # release, source, block
    heapq.heapify(coming)
    ready: list[tuple[int, int, str, int]] = []  # deadline, -weight, source, block
    for slot in itertools.count():
        while coming and coming[0][0] <= slot:
            _, s, k = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(k + 1) * total // weights[s]), -weights[s], s, k))
        _, _, s, k = heapq.heappop(ready)
        yield s
        heapq.heappush(coming, ((k + 1) * total // weights[s], s, k + 1))


def phases(weights: dict[str, int], blocks: dict[str, int]) -> list[dict]:
    """Phases of the schedule: first slot, live sources, and the blocks each has had before.

    A phase ends with the slot of the last block of the source that runs out first.
    """
    left = {s: blocks.get(s, 0) for s in weights if blocks.get(s, 0) > 0}
    had = dict.fromkeys(left, 0)
    out, start = [], 0
    while left:
        live = whole_weights({s: weights[s] for s in left})
        total = sum(live.values())
        places: dict[str, list[int]] = {s: [] for s in live}
        length = None
        for slot, s in enumerate(itertools.islice(earliest_deadlines(live), min(total, sum(left.values())))):
            places[s].append(slot)
            if len(places[s]) == left[s]:
                length = slot + 1
                break
        if length is None:
            length = min((left[s] - 1) // w * total + places[s][(left[s] - 1) % w] + 1 for s, w in live.items())
        full, rest = divmod(length, total)
        used = {s: full * w + bisect_left(places[s], rest) for s, w in live.items()}
        out.append({"start": start, "total": total, "places": places, "weights": live, "before": {s: had[s] for s in live}, "used": used})
        start += length
        for s, n in used.items():
            had[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
    return out


def places(spark: SparkSession, plan: list[dict]) -> DataFrame:
    """``(stream, block, phase, slot, release, deadline)`` of every block of the plan."""
    rows = []
    for i, p in enumerate(plan):
        for s, w in p["weights"].items():
            if p["used"][s]:  # the period counts only where it is over, so that nothing here exceeds the number of blocks
                slots, total = p["places"][s], p["total"]
                due = [(k * total // w, -(-(k + 1) * total // w)) for k in range(len(slots))]
                rows.append((i, s, p["before"][s], p["used"][s], p["start"], total if p["used"][s] > len(slots) else 0, slots, [r for r, _ in due], [d for _, d in due]))
    whole = spark.createDataFrame(rows, "phase int, stream string, before long, used long, start long, total long, slots array<long>, releases array<long>, deadlines array<long>")
    cut = whole.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("used") - 1, F.lit(PIECE)))).repartition("stream", "phase", "piece")
    each = cut.withColumn("nth", F.explode(F.sequence("piece", F.least(F.col("used"), F.col("piece") + PIECE) - 1)))
    at = lambda of: F.expr(f"start + nth div size({of}) * total + get({of}, cast(nth % size({of}) as int))")
    return each.select("stream", (F.col("before") + F.col("nth")).alias("block"), "phase", at("slots").alias("slot"), at("releases").alias("release"), at("deadlines").alias("deadline"))


def _numbered(docs: DataFrame, stream, seed: int, doc_id: str) -> tuple[DataFrame, dict[str, int]]:
    """Rows with their stream and number in it (random order fixed by ``seed``), and rows per stream."""
    keyed = docs.withColumns({"_stream": stream, "_order": F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 1)})
    counts = dict(keyed.groupBy("_stream").count().collect())  # one row per weighted source
    if not counts:
        return keyed.withColumn("_number", F.lit(0).cast("long")), {}
    spark = docs.sparkSession
    sizes = spark.createDataFrame([(s, max(1, ceil(n / BUCKET_ROWS))) for s, n in counts.items()], "_stream string, _buckets long")
    even = F.col("_order").cast("double") / F.lit(float(1 << 63))
    keyed = keyed.join(F.broadcast(sizes), "_stream").withColumn("_bucket", F.least(F.floor(even * F.col("_buckets")), F.col("_buckets") - 1)).drop("_buckets")
    per = keyed.groupBy("_stream", "_bucket").count()
    before = per.select("_stream", "_bucket", (F.sum("count").over(Window.partitionBy("_stream").orderBy("_bucket")) - F.col("count")).alias("_before"))
    whole = F.xxhash64(*(f.name for f in docs.schema if "map<" not in f.dataType.simpleString()))
    inner = Window.partitionBy("_stream", "_bucket").orderBy("_order", doc_id, whole)
    ranked = keyed.withColumn("_rank", F.row_number().over(inner) - 1)
    return ranked.join(before, ["_stream", "_bucket"]).withColumn("_number", F.col("_before") + F.col("_rank")).drop("_before", "_rank", "_bucket", "_order"), counts


def schedule(docs: DataFrame, weights: dict[str, float], block_size: int = 64, seed: int = 7, other: float = 1.0) -> DataFrame:
    """``docs`` with ``stream``, ``block``, ``phase``, ``release``, ``deadline``, ``slot`` and ``position``.

    ``position`` numbers the documents of the mix; release and deadline are slots of the phase in
    which the block was placed.  ``other`` is the weight of all unlisted sources together.
    """
    columns = docs.columns
    rows = docs.toDF(*(f"_c{i}" for i in range(len(columns))))
    doc_id, source = (f"_c{columns.index(c)}" for c in ("doc_id", "source"))
    live = {s: w for s, w in weights.items() if w > 0} | ({OTHER: other} if other > 0 else {})
    named = [s for s in live if s != OTHER]
    zero = [s for s, w in weights.items() if w <= 0]
    stream = F.when(F.col(source).isin(named), F.col(source)) if named else F.when(F.lit(False), F.lit(""))
    stream = (stream.when(F.col(source).isin(zero), F.lit(LAST)) if zero else stream).otherwise(F.lit(OTHER))
    numbered, counts = _numbered(rows, stream, seed, doc_id)
    blocks = {s: ceil(n / block_size) for s, n in counts.items()}
    plan = phases(whole_weights(live), blocks)
    placed = places(docs.sparkSession, plan)
    end = sum(n for s, n in blocks.items() if s in live)
    numbered = numbered.withColumns({"_block": F.floor(F.col("_number") / block_size), "_inner": F.col("_number") % block_size})
    joined = numbered.where(F.col("_stream").isin(list(live))).join(placed, (F.col("_stream") == F.col("stream")) & (F.col("_block") == F.col("block")))
    names = {n: fresh_name(n, columns) for n in ("stream", "block", "phase", "release", "deadline", "slot", "position")}

    def result(df: DataFrame, slot) -> DataFrame:
        given = {"position": slot * block_size + F.col("_inner")}
        return df.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)), *(given.get(n, F.col(n)).alias(to) for n, to in names.items()))

    out = result(joined, F.col("slot"))
    last = len(plan)
    for late in sorted(set(blocks) - set(live)):
        at = F.lit(end) + F.col("_block")
        alone = numbered.where(F.col("_stream") == late).withColumns({"stream": F.col("_stream"), "block": F.col("_block"), "phase": F.lit(last), "release": at, "deadline": at + 1, "slot": at})
        out = out.unionByName(result(alone, F.col("slot")))
        end, last = end + blocks[late], last + 1
    return out


def in_mix_order(docs: DataFrame, weights: dict[str, float], block_size: int = 64, seed: int = 7) -> DataFrame:
    """``docs`` in the order of the mix (range partitions, sorted within); same columns and rows."""
    position = fresh_name("position", docs.columns)
    placed = schedule(docs, weights, block_size, seed)
    placed = materialize(placed.select(*docs.columns, F.col(placed.columns[-1]).alias(position)), "mix")
    return placed.repartitionByRange(F.col(position)).sortWithinPartitions(position).drop(position)
