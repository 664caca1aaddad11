"""N-gram Jaccard self-join: size-aware heavy-light join.

Two sets link when ``100 * |A & B| >= 85 * |A | B|`` (the threshold is a parameter).

*Light sets* (size at most the boundary) enumerate fixed-size subsets.  A linked partner misses
at most ``floor(0.15 s)`` elements of a set of size ``s``, so two linked light sets share one of
the subsets that remain after that many deletions.  The largest shared subset is the
intersection, so sizes alone decide a link: within the list of one subset the smallest set links
with a set if any member does, and comparing each member with it loses no component.

*Heavy sets* scan inverted lists of n-grams.  Every n-gram's document frequency is counted over
all distinct sets; a set orders its n-grams from rare to common and enters the lists of its first
``floor(0.15 s) + 1``.  Linked sets share one of those.  N-grams that occur in one set only have
no list, so a text without near copies sends nothing on, and an n-gram of a common passage comes
last.  A set that shares less than 85 % of its n-grams with the rest of the corpus is dropped.

N-grams that hold more than the ``2 ** -18``-th part of all occurrences are at most ``2 ** 18``.  They
are found from counts that each chunk of texts adds up first, and are broadcast.  They need no
counting, so they go to the buckets of their sets and not to one of their own: an n-gram that a
third of all texts have makes no task larger than others.

The boundary is the one with the fewest bytes to move, from the histogram of small set sizes.
Light sets within reach of the boundary take part both ways.

Two members of a list are compared only if their sizes, the places of the n-gram in their orders
and a lower bound of their symmetric difference (n-grams that no other set has, and the parities
of 256 hash classes of the others) allow a link.  Each set is compared with one head of its lists
at first; then only members of different components are compared, with other heads and at last
with every member outside the largest component of a list, so a group of near copies costs about
as many comparisons as it has members and no link is lost.  Every link is checked on the sets.

64-bit hashes stand for n-grams; the exchange keeps ``TOKEN_BYTES`` low bytes beside the bucket,
which holds the high bits.  Sets are told apart by 128 bits.

Nulls, empty texts and texts without words have the empty set: they link with nothing and are
their own component.  A text with fewer words than an n-gram has its whole word sequence as
single element.  Very long texts are read whole.  Ties of heads go to the smaller node and do not
change components.  Repeated rows of one ``doc_id`` and rows with a null id are documents of
their own; a component without any id has a null one.  Columns other than the id and the text are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .packing import bucket_of, fresh_name, pieces
from .storage import discard, materialize
from .wordtools import Words, chunks, mix64, sequence_hash, window_hashes
from .workers import lean

WIDTH = 4
PERCENT = 85
#: Subsets that a light set enumerates, at most.
MAX_SUBSETS = 200
#: N-grams in a bucket of the frequency count, about.
BUCKET_GRAMS = 3_000_000
#: N-grams that are broadcast with their counts, at most.
MOST_COMMON = 1 << 18
#: Bytes of an n-gram in the exchange; its bucket stands for the highest bits.
TOKEN_BYTES = 5
#: Rounds that compare with one head of each list before the rest is compared.
HEAD_ROUNDS = 3


# ---------------------------------------------------------------- sets


def ngram_sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """For each chunk the sorted distinct n-gram hashes of each row."""
    for part in chunks(batch):
        words = Words(part.column("text"), lower_ascii=True)
        hashed = words.hashes()
        grams = window_hashes(hashed, width)
        out = []
        for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
            if b - a >= width:
                s = np.sort(grams[a : b - width + 1])
                out.append(s[np.append(True, s[1:] != s[:-1])])
            else:
                out.append(np.array([sequence_hash(hashed[a:b])]) if b > a else np.zeros(0, np.uint64))
        yield part, out


def _set_key(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit keys of a set."""
    with np.errstate(over="ignore"):
        one = np.sum(mix64(s + np.uint64(0xA5A5)), dtype=np.uint64)
        two = np.sum(mix64(s ^ np.uint64(0x5DEECE66D)) | np.uint64(1), dtype=np.uint64)
    return int(mix64(np.array([one + np.uint64(len(s))]))[0]), int(two)


def _signed(values, kind=np.uint64) -> pa.Array:
    return pa.array(np.array(values, kind).view(np.int64))


def missing(size: int, percent: int) -> int:
    """Most elements of a set of this size that a linked partner can lack."""
    return size * (100 - percent) // 100


def subset_count(size: int, percent: int) -> int:
    return sum(math.comb(size, i) for i in range(missing(size, percent) + 1))


def largest_light(percent: int) -> int:
    """Largest size up to which no set has more than ``MAX_SUBSETS`` subsets."""
    return next(n for n in itertools.count(1) if subset_count(n + 1, percent) > MAX_SUBSETS)


def subset_keys(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, size) of every subset left after the deletions that a link allows."""
    x = mix64(s ^ np.uint64(0x7F4A7C15))
    with np.errstate(over="ignore"):
        total = np.sum(x, dtype=np.uint64)
    keys, sizes = [np.array([total])], [np.array([len(s)])]
    for k in range(1, missing(len(s), percent) + 1):
        gone = np.array(list(itertools.combinations(range(len(s)), k)), dtype=np.int64)
        keys.append(total - np.sum(x[gone], axis=1, dtype=np.uint64))
        sizes.append(np.full(len(gone), len(s) - k))
    return mix64(np.concatenate(keys) ^ np.uint64(0x11C7)), np.concatenate(sizes)


_MEMBERS = "doc_id long, n_shingles long, k1 long, k2 long, subsets array<struct<key:long,kept:int>>, common array<struct<gram:long,n:int>>"


def _common(sets: list[np.ndarray]) -> list[dict]:
    """N-grams that hold a large part of a chunk's, with the sets that have them; one of the whole corpus does so in some chunk."""
    flat = np.sort(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
    start = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(flat)))
    held = np.flatnonzero(count >= max(3, math.ceil(len(flat) / MOST_COMMON)))
    return [{"gram": g, "n": n} for g, n in zip(flat[start[held]].view(np.int64).tolist(), count[held].tolist(), strict=True)]


@lean
def _members(batches, width, percent, largest):
    kind = pa.list_(pa.struct([("key", pa.int64()), ("kept", pa.int32())]))
    common = pa.list_(pa.struct([("gram", pa.int64()), ("n", pa.int32())]))
    for batch in batches:
        for part, sets in ngram_sets(batch, width):
            keys = [_set_key(s) for s in sets]
            subsets = []
            for s in sets:
                if 0 < len(s) <= largest:
                    key, kept = subset_keys(s, percent)
                    subsets.append([{"key": a, "kept": b} for a, b in zip(key.view(np.int64).tolist(), kept.tolist(), strict=True)])
                else:
                    subsets.append(None)
            cols = [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), _signed([k[0] for k in keys]), _signed([k[1] for k in keys]), pa.array(subsets, kind)]
            cols.append(pa.array([_common(list(dict(zip(keys, sets, strict=True)).values()))] + [None] * (len(sets) - 1), common))  # with the chunk's first row
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "k1", "k2", "subsets", "common"])


@lean
def _keyed_rows(batches, width, columns, names):
    """The columns of every row and the two keys of its set."""
    for batch in batches:
        for part, sets in ngram_sets(batch, width):
            keys = [_set_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), _signed([k[0] for k in keys]), _signed([k[1] for k in keys])], [*columns, *names])


# ---------------------------------------------------------------- document frequencies


_PACKED = "bucket long, nodes binary, sizes binary, counts binary, tokens binary, ranks binary"


def _packed(bucket: np.ndarray, node: np.ndarray, size: np.ndarray, tokens: np.ndarray, ranks: np.ndarray | None = None) -> pa.RecordBatch:
    """One row per bucket of items sorted by bucket and node: nodes, sizes and counts of items once per node."""
    fresh = np.append(True, (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1]))
    run = np.flatnonzero(fresh)
    first = np.flatnonzero(np.append(True, bucket[run[1:]] != bucket[run[:-1]]))
    runs, items = np.append(first, len(run)), np.append(run[first], len(node))
    counts = np.diff(np.append(run, len(node))).astype(np.int32)
    cols = [pa.array(bucket[run[first]]), pieces(node[run], runs), pieces(size[run].astype(np.int32), runs), pieces(counts, runs), pieces(tokens, items), pa.nulls(len(first), pa.binary()) if ranks is None else pieces(ranks, items)]
    return pa.RecordBatch.from_arrays(cols, ["bucket", "nodes", "sizes", "counts", "tokens", "ranks"])


def _ids(low: np.ndarray, bucket) -> np.ndarray:
    """The number of an n-gram: its low bytes, and its bucket above them."""
    return low | (np.asarray(bucket).astype(np.uint64) << np.uint64(8 * TOKEN_BYTES))


@lean
def _token_rows(batches, width, buckets, least, common):
    """The n-grams of the distinct sets of each chunk, by bucket of the n-gram; common ones, with their ranks, by bucket of the set behind those."""
    grams, ranks = common.value
    for batch in batches:
        for _, sets in ngram_sets(batch, width):
            own = {_set_key(s)[0]: s for s in sets if len(s) >= least}
            if not own:
                continue
            sizes = np.array([len(s) for s in own.values()])
            node = np.repeat(np.fromiter(own, np.uint64, len(own)), sizes)
            flat = np.concatenate(list(own.values()))
            sizes = np.repeat(sizes, sizes)
            if len(grams):
                at = np.minimum(np.searchsorted(grams, flat), len(grams) - 1)
                known = grams[at] == flat
                if known.any():
                    own_bucket = buckets + bucket_of(node[known], buckets)
                    order = np.lexsort((node[known], own_bucket))
                    low = flat[known] & np.uint64((1 << 8 * TOKEN_BYTES) - 1)
                    yield _packed(own_bucket[order], node[known][order], sizes[known][order], _ids(low, bucket_of(flat[known], buckets))[order], ranks[at[known]][order])
                    flat, node, sizes = flat[~known], node[~known], sizes[~known]
            if not len(flat):
                continue
            bucket = bucket_of(flat, buckets)
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
            low = flat[order].view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]
            yield _packed(bucket[order], node[order], sizes[order], low)


def _by_bucket(batches) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(bucket, [node and size of each run, run of each item, token bytes, ranks]) of rows sorted by bucket.

    Rows stay where Arrow has them until their bucket is complete, and are let go before it is used.
    """
    held: list[list] = []
    now = None

    def whole():
        nodes, sizes, counts = (np.concatenate([np.frombuffer(r[i], t) for r in held]) for i, t in ((0, np.uint64), (1, np.int32), (2, np.int32)))
        run = np.repeat(np.arange(len(nodes), dtype=np.int32), counts)
        return now, [nodes, sizes, run, np.frombuffer(b"".join(r[3] for r in held), np.uint8), np.frombuffer(b"".join(r[4] for r in held if r[4] is not None), np.int64)]

    for batch in batches:
        buckets = batch.column(0).to_pylist()
        for i, b in enumerate(buckets):
            if b != now and held:
                out, held = whole(), []
                yield out
                del out
            now = b
            held.append([c[i].as_buffer() if c[i].is_valid else None for c in batch.columns[1:]])
    if held:
        out, held = whole(), []
        yield out


@lean
def _recurring_rows(batches, buckets):
    """N-grams that at least two sets have, with their rank (frequency), by bucket of the node."""
    for bucket, (nodes, sizes, run, raw, rank) in _by_bucket(batches):
        if bucket >= buckets:  # common ones; copies of a set came from several chunks
            token, node, size = raw.view(np.uint64), nodes[run], sizes[run]
            order = np.lexsort((token, node))
            node, size, token, rank = node[order], size[order], token[order], rank[order]
            once = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))
            yield _packed(np.full(int(once.sum()), bucket - buckets), node[once], size[once], token[once], rank[once])
            continue
        wide = np.zeros((len(run), 8), np.uint8)
        wide[:, :TOKEN_BYTES] = raw.reshape(-1, TOKEN_BYTES)
        token = wide.reshape(-1).view(np.uint64)
        del wide, raw
        order = np.argsort(token)
        same = token[order[1:]] == token[order[:-1]]
        order = order[np.append(same, False) | np.append(False, same)]
        if not len(order):
            continue
        token, run = token[order], run[order]
        node, size = nodes[run], sizes[run]
        order = np.lexsort((node, token))
        token, node, size = token[order], node[order], size[order]
        once = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))  # copies in other chunks
        token, node, size = token[once], node[once], size[once]
        start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        count = np.diff(np.append(start, len(token)))
        rank = np.repeat(count, count)
        keep = rank > 1
        if not keep.any():
            continue
        token, node, size, rank = _ids(token[keep], bucket), node[keep], size[keep], rank[keep]
        goal = bucket_of(node, buckets)
        order = np.lexsort((node, goal))
        yield _packed(goal[order], node[order], size[order], token[order], rank[order])


_SETS = "node long, size int, own int, b0 long, b1 long, b2 long, b3 long, grams array<long>"


@lean
def _set_rows(batches, percent):
    """Sets that can have a partner: their shared n-grams from rare to common, the number of unshared ones, parities of hash classes."""
    for _, (nodes, sizes, run, raw, rank) in _by_bucket(batches):
        token, node, size = raw.view(np.uint64), nodes[run], sizes[run]
        order = np.lexsort((token, rank, node))
        token, node, size = token[order], node[order], size[order]
        start = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        count = np.diff(np.append(start, len(node)))
        total = size[start].astype(np.int64)
        for a in range(0, len(start), 2048):
            some = np.flatnonzero(100 * count[a : a + 2048] >= percent * total[a : a + 2048]) + a
            if not len(some):
                continue
            at = np.concatenate([np.arange(start[i], start[i] + count[i]) for i in some])
            grams = token[at]
            owner = np.repeat(np.arange(len(some)), count[some])
            odd = np.bincount(owner * 256 + (mix64(grams) >> np.uint64(56)).astype(np.int64), minlength=256 * len(some)) & 1
            bits = np.packbits(odd.astype(np.uint8).reshape(len(some), 256), axis=1).view(np.int64)
            offsets = pa.array(np.append(0, np.cumsum(count[some])).astype(np.int32))
            cols = [pa.array(node[start[some]].view(np.int64)), pa.array(size[start[some]]), pa.array((total - count)[some].astype(np.int32))]
            cols += [pa.array(np.ascontiguousarray(bits[:, i])) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(offsets, pa.array(grams.view(np.int64)))], ["node", "size", "own", "b0", "b1", "b2", "b3", "grams"])


# ---------------------------------------------------------------- join


def choose_boundary(sizes: DataFrame, percent: int) -> int:
    """Boundary with the fewest bytes to move; reads a histogram row for each small size.

    A subset is a row of 20 bytes.  A heavy set sends its n-grams to be counted, its first ones to
    lists (26 bytes each) and, to be compared, the set itself.
    """
    most = largest_light(percent)
    found = dict(sizes.where(F.col("n_shingles").between(1, 2 * most)).groupBy("n_shingles").count().collect())

    def cost(x: int) -> int:
        near = percent * (x + 1) // 100
        heavy = sum(c * (n * (TOKEN_BYTES + 17) + 26 * (missing(n, percent) + 1)) for n, c in found.items() if n >= near)
        return heavy + sum(20 * c * subset_count(n, percent) for n, c in found.items() if n <= x)

    return min(range(1, most + 1), key=lambda x: (cost(x), x))


def _light_links(distinct: DataFrame, boundary: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` between light sets: each set of a list with the smallest set of that list."""
    rows = distinct.where(F.col("size") <= boundary).select("node", "size", F.explode("subsets").alias("s")).select("node", "size", "s.key", "s.kept")
    head = rows.groupBy("key").agg(F.min(F.struct("size", "node")).alias("h"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.col("h.size").alias("hsize"), F.col("h.node").alias("b"))
    fits = f"node <> b and 100 * kept >= {percent} * (size + hsize - kept)"
    return rows.join(head, "key").where(fits).select(F.col("node").alias("a"), "b").distinct()


def _lists(sets: DataFrame, percent: int) -> DataFrame:
    """Entries of the inverted lists: the n-gram, the set, and the n-gram's place in its order."""
    first = f"size - cast(({percent} * size + 99) div 100 as int) + 1 - own"
    some = sets.where(f"{first} > 0").select("node", "size", "own", "b0", "b1", "b2", "b3", F.posexplode(F.expr(f"slice(grams, 1, {first})")).alias("i", "key"))
    return some.withColumn("place", F.col("own") + F.col("i")).drop("i")


def _fits(percent: int) -> str:
    """Whether two entries ``x`` and ``y`` of a list can belong to linked sets."""
    both = f"(({percent} * (x.size + y.size) + {99 + percent}) div {100 + percent})"
    apart = " + ".join(f"bit_count(x.b{i} ^ y.b{i})" for i in range(4))
    return (
        f"100 * least(x.size, y.size) >= {percent} * greatest(x.size, y.size) and x.size - x.place >= {both} and y.size - y.place >= {both}"
        f" and x.own + y.own + {apart} <= x.size + y.size - 2 * {both}"
    )


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of nodes that link."""
    a = sets.select(F.col("node").alias("a"), F.col("size").alias("sa"), F.col("grams").alias("ga"))
    b = sets.select(F.col("node").alias("b"), F.col("size").alias("sb"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    return pairs.join(a, "a").join(b, "b").where(100 * both >= percent * (F.col("sa") + F.col("sb") - both)).select("a", "b")


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


class _Heavy:
    """Distinct sets that can have partners, and their inverted lists."""

    def __init__(self, docs: DataFrame, members: DataFrame, width: int, percent: int, least: int):
        self.percent = percent
        grams = members.agg(F.sum("n_shingles")).first()[0] or 0
        buckets = max(1, math.ceil(grams / BUCKET_GRAMS))
        some = members.where("common is not null").select(F.inline("common")).groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= grams / MOST_COMMON).collect()  # MOST_COMMON rows at most
        found = sorted((r.gram & (1 << 64) - 1, r.n) for r in some)
        common = docs.sparkSession.sparkContext.broadcast((np.array([g for g, _ in found], np.uint64), np.array([n for _, n in found], np.int64)))
        rows = docs.select("text").mapInArrow(functools.partial(_token_rows, width=width, buckets=buckets, least=least, common=common), _PACKED)
        counted = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(functools.partial(_recurring_rows, buckets=buckets), _PACKED)
        self.sets = materialize(counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(functools.partial(_set_rows, percent=percent), _SETS), "sets")
        entries = _lists(self.sets, percent)
        shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
        self.lists = materialize(entries.join(shared, "key"), "lists")

    def heads(self, rows: DataFrame, turn: int) -> DataFrame:
        """Pairs of the members of each list with its head, of another component (``comp``)."""
        rank = F.col("place") / F.col("size") if turn == 0 else F.xxhash64("node", F.lit(turn))
        fields = ["node", "size", "own", "place", "b0", "b1", "b2", "b3", "comp"]
        head = rows.groupBy("key").agg(F.min(F.struct(rank.alias("r"), *fields)).alias("h")).select("key", *(F.col(f"h.{f}").alias(f) for f in fields))
        return rows.alias("x").join(head.alias("y"), F.expr(f"x.key = y.key and x.comp <> y.comp and {_fits(self.percent)}")).select(F.col("x.node").alias("x"), F.col("y.node").alias("y"))

    def rest(self, rows: DataFrame) -> DataFrame:
        """Pairs of the members of each list outside its largest component with all of another component."""
        per = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
        most = per.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m")).select("key", F.col("m.comp").alias("most"))
        few = rows.join(most, "key").where("comp <> most").drop("most")
        return few.alias("x").join(rows.alias("y"), F.expr(f"x.key = y.key and x.comp <> y.comp and {_fits(self.percent)}")).select(F.col("x.node").alias("x"), F.col("y.node").alias("y"))

    def split(self, labels: DataFrame) -> DataFrame:
        """Entries of the lists whose members lie in different components."""
        known = self.lists.join(labels, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        split = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        return known.join(split, "key")

    def labels(self, links: DataFrame) -> DataFrame:
        """Components of all sets that link, by ``links`` of light sets and as many of heavy sets as join them."""
        rows = self.lists.withColumn("comp", F.col("node"))
        for turn in range(HEAD_ROUNDS + 1):
            used = None
            if turn:
                labels = components(links)
                used = rows = materialize(self.split(labels), "split")
                if rows.isEmpty():
                    discard(used, links)
                    return labels
                discard(labels)
            pairs = self.heads(rows, turn) if turn < HEAD_ROUNDS else self.rest(rows)
            if turn == 0:  # the head that a set shares most lists with; later rounds look at the others
                best = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).groupBy("x").agg(F.max(F.struct("n", "y")).alias("h"))
                pairs = best.select("x", F.col("h.y").alias("y"))
            fresh = materialize(_linked(pairs.select(*_pair("x", "y")).distinct(), self.sets, self.percent), "links")
            discard(used)
            old, links = links, materialize(links.unionByName(fresh), "links")
            discard(old, fresh)
        labels = components(links)
        discard(links)
        return labels

    def discard(self) -> None:
        discard(self.sets, self.lists)


def _distinct_sets(members: DataFrame) -> DataFrame:
    some = members.where("n_shingles > 0")
    return some.groupBy(F.col("k1").alias("node")).agg(F.first("n_shingles").cast("int").alias("size"), F.first("subsets").alias("subsets"))


def _started(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, _Heavy]:
    """(members, links of light sets, heavy sets)."""
    members = materialize(docs.mapInArrow(functools.partial(_members, width=width, percent=percent, largest=largest_light(percent)), _MEMBERS), "members")
    boundary = choose_boundary(members, percent)
    light = materialize(_light_links(_distinct_sets(members), boundary, percent), "links")
    return members, light, _Heavy(docs, members, width, percent, percent * (boundary + 1) // 100)


def _labelled(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``(doc_id, n_shingles, k1, k2, comp)`` of every row; sets with the same ``comp`` are one component, empty sets have none."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    members, light, heavy = _started(docs, width, percent)
    labels = heavy.labels(light)
    heavy.discard()
    own = members.select("doc_id", "n_shingles", "k1", "k2")
    return own.join(labels, F.col("k1") == F.col("node"), "left").select(
        "doc_id", "n_shingles", "k1", "k2", F.when(F.col("n_shingles") > 0, F.struct(F.coalesce("component", "k1").alias("c"), F.when(F.col("component").isNull(), F.col("k2")).alias("t"))).alias("comp")
    )


def link_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs(doc_id, text)``."""
    rows = _labelled(docs, width, percent)
    lowest = rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("lowest"))
    return rows.join(lowest, "comp", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("lowest")).otherwise(F.col("doc_id")).alias("component_id"))


def linked_sets(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All links between different sets, as pairs ``(a, b)`` of set keys, and the membership ``(doc_id, node)``.

    Rows with equal sets share a node; they link with each other and have each other's links.
    The light lists are joined member by member here, so their links are all there too.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    members, light, heavy = _started(docs, width, percent)
    rows = heavy.lists.withColumn("comp", F.col("node"))
    pairs = rows.alias("x").join(rows.alias("y"), F.expr(f"x.key = y.key and x.node < y.node and {_fits(percent)}"))
    found = _linked(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), heavy.sets, percent)
    subsets = _distinct_sets(members).select("node", "size", F.explode("subsets").alias("s")).select("node", "size", "s.key", "s.kept")
    close = f"x.key = y.key and x.node < y.node and 100 * x.kept >= {percent} * (x.size + y.size - x.kept)"
    small = subsets.alias("x").join(subsets.alias("y"), F.expr(close)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    discard(light)
    return found.unionByName(small).distinct(), members.where("n_shingles > 0").select("doc_id", F.col("k1").alias("node"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each linked group (a row with the smallest id, null ids last); same columns.

    Rows with the empty set stay.  Rows that share an id are judged one by one, by their texts;
    of rows equal in id and set one stays.
    """
    rows = materialize(_labelled(docs, width, percent), "labelled")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")
    winners = rows.where("comp is not null").groupBy("comp").agg(F.min(order).alias("w")).select(F.col("w.doc_id").alias("doc_id"), F.col("w.k1").alias("k1"), F.col("w.k2").alias("k2"))
    winners = materialize(winners, "winners")
    per_id = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("comp").isNull()).alias("blank"))
    several = per_id.where("n > 1").select("doc_id")
    single = per_id.where("n = 1").join(winners.where("doc_id is not null").select("doc_id", F.lit(True).alias("wins")), "doc_id", "left").where("not blank and wins is null").select("doc_id")
    verdict = single.select("doc_id", F.lit("goes").alias("verdict")).unionByName(several.select("doc_id", F.lit("by text").alias("verdict")))
    verdict = materialize(verdict.withColumnRenamed("doc_id", fresh_name("id", docs.columns)).withColumnRenamed("verdict", fresh_name("verdict", docs.columns)), "verdict")
    ident, said = verdict.columns
    joined = docs.join(verdict, docs["doc_id"].cast("long") == F.col(ident), "left")
    plain = joined.where(F.col("doc_id").isNotNull() & F.col(said).isNull()).select(docs.columns)
    if not rows.where("doc_id is null").isEmpty() or not verdict.where(F.col(said) == "by text").isEmpty():
        odd = joined.where(F.col("doc_id").isNull() | (F.col(said) == "by text")).select(docs.columns)
        names = [fresh_name("k1", docs.columns), fresh_name("k2", docs.columns)]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", " + ", ".join(f"`{n}` long" for n in names)
        keyed = odd.mapInArrow(functools.partial(_keyed_rows, width=width, columns=docs.columns, names=names), schema)
        w = winners.toDF("_id", "_one", "_two")
        wins = keyed.join(w, keyed["doc_id"].cast("long").eqNullSafe(w["_id"]) & (keyed[names[0]] == w["_one"]) & (keyed[names[1]] == w["_two"]), "left_semi").dropDuplicates(["doc_id", *names])
        blank = keyed.where((F.col(names[0]) == _EMPTY[0]) & (F.col(names[1]) == _EMPTY[1]))
        plain = plain.unionByName(wins.select(docs.columns)).unionByName(blank.select(docs.columns))
    return plain


#: Keys of the empty set.
_EMPTY = tuple(int(np.array(k, np.uint64).view(np.int64)) for k in _set_key(np.zeros(0, np.uint64)))
