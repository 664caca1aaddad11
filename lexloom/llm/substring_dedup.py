"""Substring dedup by repeated-phrase automata.

A *window* is ``width`` consecutive words of one document.  Every word covered by a window
whose word sequence also starts anywhere else (same document included) is removed; windows
are judged on the input.

1. *Anchors.*  Each window's anchor is its short word run with the smallest hash, so equal
   windows have equal anchors at equal offsets and about one word in fifteen is an anchor.
   Anchors are counted over all documents; each chunk of texts adds its own up first, and they
   travel packed, a row per chunk and bucket.
2. *Segments.*  Where an anchor occurs at least twice, the stretch of words whose windows have
   that anchor is sent to the anchor's shard.  A stretch that a chunk of documents holds twice
   recurs as a whole: it is sent once, and its other places are cuts already.  An anchor that occurs more than ``CROWD`` times sends its windows one by one, keyed by the
   window, so that no shard depends on one phrase.
3. *Automata.*  A shard takes its segments key by key.  Windows that occur at least twice are
   the confirmed recurring passages; the ends of each confirmed stretch are compiled into an
   Aho-Corasick automaton over word numbers, and the shard's segments stream through it to
   locate every occurrence.  Identical segments arrive together and are read as one, so a
   passage shared by a third of all documents takes no more memory than a rare one.
   Automata are bounded by ``AUTOMATON_WORDS``; a shard builds as many as it needs.
4. *Removal.*  Located stretches go back to their documents.

Words are compared as text; hashes only route them (windows of equal hash are compared word by
word).  Null, empty and short texts have no window and stay as they are; very long texts are read
whole.  Located stretches belong to a text (its 64-bit hash), since equal texts lose the same
words; rows that repeat a ``doc_id`` and rows with a null id are documents of their own.  There
are no ties: every occurrence goes.  An empty table gives an empty result.  Extra columns are kept
by ``remove_repeats``, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import bucket_of, fresh_name, pieces
from .storage import materialize
from .wordtools import Words, chunks, mix64, text_bytes, window_hashes
from .workers import lean

WIDTH = 35
#: Words in an anchor.
ANCHOR = 8
#: Occurrences from which an anchor's windows are routed one by one; in a large corpus its 2 ** 20-th part, so that
#: crowded anchors are a bounded number.  It changes routes and no results.
CROWD = 5000
#: Words of distinct segments compiled and searched at once.
AUTOMATON_WORDS = 400_000
#: Characters of text whose anchors meet in one bucket, about.
BUCKET_CHARS = 40_000_000


def _window_anchors(hashed: np.ndarray, bounds: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, anchor position of each window, hashes of all runs of ``anchor`` words)."""
    grams = window_hashes(hashed, anchor)
    n = len(hashed) - width + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, grams
    inside = np.zeros(n + 1, np.int32)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            inside[a] += 1
            inside[b - width + 1] -= 1
    starts = np.flatnonzero(np.cumsum(inside[:n]) > 0)
    # Position of the smallest hash of each run of ``span`` anchors, by doubling.
    span = width - anchor + 1
    best = np.arange(len(grams))
    size = 1
    while size < span:
        step = min(size, span - size)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(grams[left] <= grams[right], left, right)
        size += step
    return starts, best[starts], grams


def _runs(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Indices where a new stretch of consecutive windows with one anchor begins, and the end."""
    if not len(starts):
        return np.zeros(1, np.int64)
    new = np.append(True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))
    return np.append(np.flatnonzero(new), len(starts))


def _row_keys(text: pa.Array) -> np.ndarray:
    """Number of each row: the hash of its text."""
    raw, offsets = text_bytes(text)
    view = memoryview(np.ascontiguousarray(raw))
    return np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), np.uint64, len(text))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        for part in chunks(batch):
            yield part, Words(part.column("text"))


_PACKED = "bucket long, a binary, b binary, c binary"
#: Bucket of the crowded anchors.
_CROWDED = -1


def _grouped(bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row per bucket with the packed items of up to three columns."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    bounds = np.append(first, len(bucket))
    cols = [pieces(c[order], bounds) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first]), *cols, *[pa.nulls(len(first), pa.binary())] * (3 - len(cols))], ["bucket", "a", "b", "c"])


def _regrouped(batches) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(bucket, its items of the three columns) of rows sorted by bucket."""
    held, now = [], None

    def whole():
        return now, [np.frombuffer(b"".join(r[i] or b"" for r in held), np.uint64) for i in range(3)]

    for batch in batches:
        for b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != now and held:
                yield whole()
                held = []
            now = b
            held.append(row)
    if held:
        yield whole()


@lean
def _anchor_rows(batches, width, anchor, buckets):
    """Every distinct anchor of a chunk, with its occurrences there and one row that has it, by bucket of the anchor.

    An anchor that occurs twice in a chunk recurs whatever the others hold: all its rows are marked
    here, by bucket of the row behind those.  So a bucket gets an anchor once from each chunk at most.
    """
    for part, words in _parts(batches):
        starts, at, grams = _window_anchors(words.hashes(), words.bounds, width, anchor)
        if not len(starts):
            continue
        where = np.flatnonzero(np.bincount(at))
        rows = _row_keys(part.column("text"))[np.searchsorted(words.bounds, where, side="right") - 1]
        found = grams[where]
        order = np.argsort(found, kind="stable")
        found, rows = found[order], rows[order]
        first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        count = np.diff(np.append(first, len(found)))
        yield _grouped(bucket_of(found[first], buckets), found[first], rows[first], count.astype(np.uint64))
        again = np.repeat(count > 1, count)
        if again.any():
            yield _grouped(buckets + bucket_of(rows[again], buckets), rows[again], found[again])


@lean
def _recurring_rows(batches, buckets, crowd):
    """(row, anchor that occurs at least twice) by bucket of the row, and the crowded anchors."""
    for bucket, (one, two, n) in _regrouped(batches):
        if bucket >= buckets:
            yield _grouped(np.full(len(one), bucket - buckets), one, two)
            continue
        order = np.argsort(one, kind="stable")
        anchor, row, n = one[order], two[order], n[order].astype(np.int64)
        start = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        total = np.add.reduceat(n, start)
        keep = np.repeat(total, np.diff(np.append(start, len(anchor)))) > 1
        if keep.any():
            yield _grouped(bucket_of(row[keep], buckets), row[keep], anchor[keep])
        crowded = anchor[start[total > crowd]]
        if len(crowded):
            yield _grouped(np.full(len(crowded), _CROWDED), crowded)


@lean
def _known_rows(batches):
    """(row, recurring anchors)."""
    for _, (row, anchor, _) in _regrouped(batches):
        order = np.lexsort((anchor, row))
        row, anchor = row[order], anchor[order]
        once = np.append(True, (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]))
        row, anchor = row[once], anchor[once]
        start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        yield pa.RecordBatch.from_arrays([pa.array(row[start].view(np.int64)), pieces(anchor, np.append(start, len(row)))], ["row", "anchors"])


_SEGMENTS = "key long, segment binary, n long, rows array<long>, firsts array<int>"


@lean
def _segment_rows(batches, width, anchor, crowds):
    """(key, segment, occurrences, rows, first words) of every stretch whose anchor recurs, equal ones of a chunk together.

    A segment that a chunk holds twice recurs as a whole: one place of it goes on, and the others pass
    through as cuts already (segment null, ``n`` words each), dealt by themselves.
    """
    for part, words in _parts(batches):
        starts, at, grams = _window_anchors(words.hashes(), words.bounds, width, anchor)
        if not len(starts):
            continue
        edges = _runs(starts, at)
        first = edges[:-1]
        own = grams[at[first]]
        known = np.unique(np.frombuffer(b"".join(part.column("anchors").to_pylist()), np.uint64))
        place = np.minimum(np.searchsorted(known, own), len(known) - 1)
        hit = np.flatnonzero(known[place] == own)
        crowded = np.isin(own, crowds.value)
        line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.array), " ")[0].as_buffer().to_pybytes()
        offset = np.frombuffer(words.array.buffers()[1], np.int32, len(words) + 1).astype(np.int64) + np.arange(len(words) + 1)
        row_at = np.searchsorted(words.bounds, starts[first], side="right") - 1
        rows, begin = part.column("row").to_numpy(zero_copy_only=False), words.bounds[row_at]
        found: dict[tuple[int, bytes], list] = {}
        for j in hit.tolist():
            a, b, base, row = int(starts[edges[j]]), int(starts[edges[j + 1] - 1]), int(begin[j]), int(rows[row_at[j]])
            if crowded[j]:
                cuts = ((s, line[offset[s] : offset[s + width] - 1]) for s in range(a, b + 1))
                stretches = [(xxhash.xxh3_64_intdigest(t) >> 1, t, s) for s, t in cuts]
            else:
                stretches = [(int(own[j]) >> 1, line[offset[a] : offset[b + width] - 1], a)]
            for key, text, s in stretches:
                held = found.setdefault((key, text), [0, {}])
                held[0] += 1
                held[1][row, s - base] = None
        out = []
        for (key, text), (n, where) in found.items():
            places = list(where)
            out.append((key, text, n, places[:1]))
            if len(places) > 1:
                out.append((xxhash.xxh3_64_intdigest(text, seed=places[1][0] & 0xFFFFFFFF) >> 1, None, text.count(b" ") + 1, places[1:]))
        if out:
            bounds = pa.array(np.append(0, np.cumsum([len(o[3]) for o in out])).astype(np.int32))
            cols = [pa.array([o[i] for o in out], t) for i, t in ((0, pa.int64()), (1, pa.binary()), (2, pa.int64()))]
            cols += [pa.ListArray.from_arrays(bounds, pa.array([x[i] for o in out for x in o[3]], t)) for i, t in ((0, pa.int64()), (1, pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["key", "segment", "n", "rows", "firsts"])


class _Shard:
    """Segments of some keys: confirms recurring windows, compiles them and locates every occurrence."""

    def __init__(self, width: int):
        self.width = width
        self.texts: list[bytes] = []
        self.places: list[list[tuple[int, int]]] = []
        self.times: list[int] = []
        self.words = 0

    def add(self, text: bytes, times: int, places: list[tuple[int, int]]) -> None:
        self.texts.append(text)
        self.times.append(times)
        self.places.append(places)
        self.words += text.count(b" ") + 1

    def recurring(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Whether the window at each word recurs among all segments."""
        flags = np.zeros(len(codes), bool)
        inside = np.zeros(len(codes) + 1, np.int32)
        np.add.at(inside, bounds[:-1], 1)
        np.add.at(inside, bounds[1:] - self.width + 1, -1)  # a segment has at least one window
        at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        hashed = window_hashes(mix64(codes.astype(np.uint64) + np.uint64(1)), self.width)[at]
        times = np.array(self.times)[np.searchsorted(bounds, at, side="right") - 1]
        order = np.argsort(hashed, kind="stable")
        start = np.flatnonzero(np.append(True, hashed[order[1:]] != hashed[order[:-1]]))
        size = np.diff(np.append(start, len(order)))
        total = np.add.reduceat(times[order], start)
        group = np.repeat(np.arange(len(start)), size)
        near = np.flatnonzero(group[1:] == group[:-1])
        one, other = at[order[near]], at[order[near + 1]]
        differ = np.zeros(len(near), bool)
        for i in range(self.width):
            differ |= codes[one + i] != codes[other + i]
        flags[at[order]] = (total > 1)[group]
        for g in np.unique(group[near[differ]]).tolist():  # one hash, different words
            mine = order[start[g] : start[g] + size[g]]
            seen: Counter = Counter()
            for k in mine.tolist():
                seen[tuple(codes[at[k] : at[k] + self.width].tolist())] += int(times[k])
            for k in mine.tolist():
                flags[at[k]] = seen[tuple(codes[at[k] : at[k] + self.width].tolist())] > 1
        return flags

    def locate(self) -> Iterator[tuple[int, int, int]]:
        """(row, first word, end) of the stretches to remove."""
        if not self.texts:
            return
        width = self.width
        words = Words(pa.array(self.texts, pa.binary()).cast(pa.string()))
        codes, _ = words.codes()
        bounds = words.bounds
        flags = self.recurring(codes, bounds)
        before, after = np.append(False, flags[:-1]), np.append(flags[1:], False)
        before[bounds[:-1]] = False
        edge = flags & ~(before & after)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        plain = codes.tolist()
        for i in np.flatnonzero(edge).tolist():
            automaton.add_word(tuple(plain[i : i + width]), width)
        if not len(automaton):
            return
        automaton.make_automaton()
        for a, b, places in zip(bounds[:-1].tolist(), bounds[1:].tolist(), self.places, strict=True):
            begin = end = -1
            for last, length in automaton.iter(tuple(plain[a:b])):
                x, y = last + 1 - length, last + 1
                if x > end:
                    if end > 0:
                        yield from ((row, first + begin, first + end) for row, first in places)
                    begin = x
                end = y
            if end > 0:
                yield from ((row, first + begin, first + end) for row, first in places)


@lean
def _located_rows(batches, width, limit):
    """Located stretches of segments sorted by key and segment."""
    out: list[tuple[int, int, int]] = []

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["row", "first", "end"])

    shard = _Shard(width)
    key = text = None
    places: list[tuple[int, int]] = []
    times = size = 0

    def close():
        nonlocal places, times
        if places:
            shard.add(text, times, places)
        places, times = [], 0

    for batch in batches:
        for k, segment, n, rows, firsts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if segment is None:
                out += ((r, f, f + n) for r, f in zip(rows, firsts, strict=True))
                if len(out) > 20_000:
                    yield flush(out)
                    out = []
                continue
            if k != key or segment != text:
                close()
                if k != key and shard.words >= limit:
                    out += shard.locate()
                    shard = _Shard(width)
                key, text, size = k, segment, segment.count(b" ") + 1
            places += zip(rows, firsts, strict=True)
            times += n
            if len(places) > 2000:  # a segment seen twice is removed as a whole; two places stand for the rest
                out += ((r, f, f + size) for r, f in places[2:])
                del places[2:]
            if len(out) > 20_000:
                yield flush(out)
                out = []
    close()
    out += shard.locate()
    if out:
        yield flush(out)


def _kept(part: pa.RecordBatch, firsts: str, ends: str) -> tuple[Words, np.ndarray, pa.Array]:
    """(words, how many of each row go, what is left of each text joined by one space)."""
    words = Words(part.column("text"))
    change = np.zeros(len(words) + 1, np.int64)
    base = np.repeat(words.bounds[:-1], pc.fill_null(pc.list_value_length(part.column(firsts)), 0).to_numpy(zero_copy_only=False))
    np.add.at(change, base + part.column(firsts).flatten().to_numpy(zero_copy_only=False), 1)
    np.add.at(change, base + part.column(ends).flatten().to_numpy(zero_copy_only=False), -1)
    stays = np.cumsum(change)[:-1] == 0
    before = np.append(0, np.cumsum(stays))
    bounds = before[words.bounds]
    left = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), words.array.filter(pa.array(stays))), " ")
    return words, np.diff(words.bounds) - np.diff(bounds), left


@lean
def _result_rows(batches, firsts, ends):
    """Word counts and the digest of what is left of every document."""
    for batch in batches:
        for part in chunks(batch):
            words, removed, left = _kept(part, firsts, ends)
            sha = [hashlib.sha256(x).hexdigest() for x in left.cast(pa.binary()).to_pylist()]
            cols = [part.column("doc_id"), pa.array(np.diff(words.bounds).astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256"])


@lean
def _cleaned_texts(batches, columns, firsts, ends):
    """The batch with covered words cut out of its texts; untouched texts stay byte for byte."""
    for batch in batches:
        for part in chunks(batch):
            _, removed, left = _kept(part, firsts, ends)
            text = pc.if_else(pa.array(removed > 0), left.cast(pa.string()), part.column("text").cast(pa.string()))
            yield pa.RecordBatch.from_arrays([text if c == "text" else part.column(c) for c in columns], columns)


@lean
def _with_row_columns(batches, columns, name):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_row_keys(batch.column("text")).view(np.int64)), *(batch.column(c) for c in columns)], [name, *columns])


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the number of each row."""
    schema = f"`{name}` long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(functools.partial(_with_row_columns, columns=docs.columns, name=name), schema)


def located(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """``(row, first, end)``: stretches of words to remove, by row number (see ``_row_keys``)."""
    texts = docs.select("text")
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets, crowd = max(1, math.ceil(size / BUCKET_CHARS)), max(CROWD, size >> 20)
    anchors = texts.mapInArrow(functools.partial(_anchor_rows, width=width, anchor=anchor, buckets=buckets), _PACKED)
    recurring = materialize(anchors.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(functools.partial(_recurring_rows, buckets=buckets, crowd=crowd), _PACKED), "recurring")
    crowded = recurring.where(F.col("bucket") == _CROWDED).select("a").collect()  # fewer than 2 ** 20 anchors
    crowds = docs.sparkSession.sparkContext.broadcast(np.unique(np.frombuffer(b"".join(bytes(r.a) for r in crowded), np.uint64)))
    known = recurring.where(F.col("bucket") != _CROWDED).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_known_rows, "row long, anchors binary")
    marked = _numbered(texts, "row").join(known, "row").select("row", "text", "anchors")
    segments = marked.mapInArrow(functools.partial(_segment_rows, width=width, anchor=anchor, crowds=crowds), _SEGMENTS)
    sharded = segments.repartition("key").sortWithinPartitions("key", "segment")
    return sharded.mapInArrow(functools.partial(_located_rows, width=width, limit=AUTOMATON_WORDS), "row long, first int, end int")


def _with_cuts(docs: DataFrame, width: int, anchor: int) -> tuple[DataFrame, str, str]:
    """``docs`` with the stretches to remove, and the names of the columns of their beginnings and ends."""
    row, firsts, ends = (fresh_name(n, docs.columns) for n in ("row", "firsts", "ends"))
    cuts = materialize(located(docs, width, anchor), "cuts")
    per_row = cuts.groupBy(F.col("row").alias(row)).agg(F.collect_set(F.struct("first", "end")).alias("c")).select(row, F.col("c.first").alias(firsts), F.col("c.end").alias(ends))
    return _numbered(docs, row).join(per_row, row, "left"), firsts, ends


def summary(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` for every row of ``docs(doc_id, text)``."""
    joined, firsts, ends = _with_cuts(docs.select("doc_id", "text"), width, anchor)
    return joined.mapInArrow(functools.partial(_result_rows, firsts=firsts, ends=ends), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with the covered words cut out of ``text`` (kept words joined by one space); same columns."""
    joined, firsts, ends = _with_cuts(docs, width, anchor)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(functools.partial(_cleaned_texts, columns=docs.columns, firsts=firsts, ends=ends), schema)
