"""Quality classifier by co-training on two views.

The *content* view is hashed words and word pairs of the text; the *metadata* view is language,
source and the layout figures of a document (size, lines, share of symbols and capitals,
repeated lines, ...).  Each view has a logistic regression.  In every round either classifier
labels the unlabelled documents it is surest of and passes them on to the other one as
training data.  At last both are calibrated (Platt scaling on labelled rows kept out of
fitting) and their log-odds are added, less the log-odds of the calibration rows, which both hold.

The hashed features of all texts are written once, packed.  In every round both views score
*all* unlabelled documents on the executors and each passes on its surest share ``PASSED_SHARE``
of them for each class (``PASSED`` at least), so the pseudo-labels grow with the input.  A
histogram of the margins gives the limits; which documents were passed on before follows from
the limits and models of the earlier rounds, so no table of labels is kept or joined.  Views are
fitted in executor tasks: pseudo-labelled documents are dealt to shards of ``SHARD_ROWS`` by id
hash, each shard is fitted together with the labelled sample, and the weights are averaged.

Only the labelled side is a bounded sample (``LABELLED_PER_CLASS`` documents of each class, by
id hash), whose ids are broadcast; all other documents count as unlabelled.  Rows with
crc32(doc_id) mod 5 = 0 and rows without an id are never learnt from.

Null and empty texts are scored by their metadata and the bias.  Null language or source is a
value of its own.  Very long texts are read whole.  Repeated rows are scored alike and each is
learnt from, but a labelled id counts once; ties of confidence are broken by a hash of the id.
Columns other than id, text, language and
source are ignored; an empty table gives an empty result.  Without labels of both classes
every score is 0.5.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .toxicity import held_out
from .wordtools import Words, chunks, mix64, text_bytes
from .workers import lean

LABELLED_PER_CLASS = 700
ROUNDS = 4
#: Documents of each class that a view passes on in a round: a share of all unlabelled ones, and at least so many.
PASSED_SHARE = 0.01
PASSED = 60
#: Pseudo-labelled documents that one task fits a view on, about.
SHARD_ROWS = 3000
#: Text whose features lie in one packed row, in bytes.
FEATURE_BYTES = 1 << 20
#: Steps of the margin histogram in one unit, and its ends.
STEPS, END = 200, 40 * 200
#: Roles besides the labels 0 and 1: to be pseudo-labelled, and never learnt from.
FREE, UNUSED = -1, 2
CONTENT_BUCKETS = 1 << 16
META_BUCKETS = 1 << 10
COLUMNS = ["doc_id", "text", "lang", "source"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"()-?"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def content_counts(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first entry of each row, bucket, count) of words, word pairs and word shapes."""
    words = Words(text)
    hashed = words.hashes()
    n = np.diff(words.bounds)
    row = np.repeat(np.arange(len(n)), n)
    pair = mix64(hashed[:-1] * np.uint64(31) + hashed[1:]) if len(hashed) > 1 else np.zeros(0, np.uint64)
    inside = row[1:] == row[:-1]
    codes, distinct = words.codes()
    tail = np.fromiter((xxhash.xxh3_64_intdigest(w[-2:] + b"$") for w in distinct.cast(pa.binary()).to_pylist()), np.uint64, count=len(distinct))
    same = (hashed[1:] == hashed[:-1])[inside] if len(hashed) > 1 else np.zeros(0, bool)
    rows = np.concatenate([row, row[1:][inside], row, row[1:][inside][same]])
    keys = np.concatenate([hashed, pair[inside], tail[codes] if len(codes) else np.zeros(0, np.uint64), np.full(int(same.sum()), 7, np.uint64)])
    flat, count = np.unique(rows * CONTENT_BUCKETS + (mix64(keys) % np.uint64(CONTENT_BUCKETS)).astype(np.int64), return_counts=True)
    at, bucket = flat // CONTENT_BUCKETS, flat % CONTENT_BUCKETS
    return np.searchsorted(at, np.arange(len(n) + 1)), bucket, count


def content_view(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first entry of each row, bucket, value): the counts' logarithms, scaled to unit length."""
    first, bucket, count = content_counts(text)
    return first, bucket, _values(first, count)


def meta_view(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first entry of each row, bucket, 1.0): language, source and layout figures in steps."""
    raw, at = text_bytes(batch.column("text"))
    sums = {name: np.append(0, np.cumsum(flag)) for name, flag in (("symbols", _SYMBOL[raw]), ("capitals", _UPPER[raw]), ("lines", raw == 10), ("blanks", raw == 32))}
    size = np.diff(at)
    share = {k: (v[at[1:]] - v[at[:-1]]) / np.maximum(size, 1) for k, v in sums.items()}
    texts = batch.column("text").to_pylist()
    again = []
    for t in texts:
        lines = [x for x in (t or "").split("\n") if x.strip()]
        again.append(1 - len(set(lines)) / len(lines) if lines else 0.0)
    out = []
    for i, (lang, source) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
        figures = [f"lang={lang}", f"source={source}", f"size={int(np.log2(size[i] + 1))}", f"again={round(again[i] * 10)}"]
        figures += [f"{k}={int(np.log2(v[i] * 1000 + 1))}" for k, v in share.items()]
        out.append(sorted({xxhash.xxh3_64_intdigest(x) % META_BUCKETS for x in figures}))
    lengths = [len(x) for x in out]
    return np.append(0, np.cumsum(lengths)).astype(np.int64), np.array([b for x in out for b in x], np.int64), np.ones(sum(lengths))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each row's values; it does not depend on the rows before."""
    out = np.zeros(len(first) - 1)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, first[:-1][full])
    return out


@dataclass
class View:
    """A logistic regression over hashed features, with its calibration."""

    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    #: Log-odds of the classes among the calibration rows.
    prior: float = 0.0

    def margin(self, features) -> np.ndarray:
        first, bucket, value = features
        return _sums(self.weights[bucket] * value, first) + self.bias

    def log_odds(self, features) -> np.ndarray:
        return self.slope * self.margin(features) + self.shift


def _rows_of(features, rows: np.ndarray):
    first, bucket, value = features
    lengths = (first[1:] - first[:-1])[rows]
    begin = np.append(0, np.cumsum(lengths))
    pick = np.repeat(first[:-1][rows] - begin[:-1], lengths) + np.arange(begin[-1])
    return begin, bucket[pick], value[pick]


def _fit_view(features, y: np.ndarray, buckets: int, steps: int = 120, rate: float = 0.5, decay: float = 1e-4) -> View:
    """Balanced logistic regression (AdaGrad on all rows)."""
    first, bucket, value = features
    view = View(np.zeros(buckets))
    row = np.repeat(np.arange(len(y)), np.diff(first))
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    square, square_bias = np.full(buckets, 1e-8), 1e-8
    for _ in range(steps):
        error = (1 / (1 + np.exp(-np.clip(view.margin(features), -40, 40))) - y) * weight
        g = np.bincount(bucket, weights=value * error[row], minlength=buckets) + decay * view.weights
        square += g * g
        view.weights -= rate * g / np.sqrt(square)
        square_bias += error.sum() ** 2
        view.bias -= rate * error.sum() / np.sqrt(square_bias)
    return view


def _calibrate(view: View, m: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling: logistic regression on the margin, with smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
        g = np.array([((p - target) * m).sum(), (p - target).sum()])
        w = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * m * m).sum() + 1e-6, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    view.slope, view.shift, view.prior = float(max(a, 0.0)), float(b), float(np.log((pos + 1) / (neg + 1)))


def _chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def combined(content: np.ndarray, meta: np.ndarray, prior: float) -> np.ndarray:
    """Log-odds of both views together: each holds the prior, which counts once."""
    return content + meta - prior


# ---------------------------------------------------------------- packed features


@dataclass
class Chunk:
    """Some documents: ids, roles (a label, ``FREE`` or ``UNUSED``) and the features of both views."""

    ids: np.ndarray
    role: np.ndarray
    views: tuple
    counts: tuple = ()


def _values(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Values of the content view from its counts."""
    value = np.log1p(count)
    norm = np.sqrt(_sums(value**2, first))
    return value / np.maximum(np.repeat(norm, np.diff(first)), 1e-9)


def _pack(first: np.ndarray, bucket: np.ndarray, count: np.ndarray) -> bytes:
    """Lengths, bucket steps and counts; buckets ascend in a row."""
    step = np.diff(bucket, prepend=0)
    begins = first[:-1][first[1:] > first[:-1]]
    step[begins] = bucket[begins]
    return zstandard.compress(b"".join([len(first).to_bytes(4, "little"), np.diff(first).astype(np.uint32).tobytes(), step.astype(np.uint16).tobytes(), count.astype(np.uint32).tobytes()]), 1)


def _unpack(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, bucket, count) as packed."""
    raw = zstandard.decompress(body)
    rows = int.from_bytes(raw[:4], "little") - 1
    first = np.append(0, np.cumsum(np.frombuffer(raw, np.uint32, rows, 4).astype(np.int64)))
    run = np.cumsum(np.frombuffer(raw, np.uint16, first[-1], 4 + 4 * rows).astype(np.int64))
    before = np.append(0, run)[first[:-1]]
    return first, run - np.repeat(before, np.diff(first)), np.frombuffer(raw, np.uint32, first[-1], 4 + 4 * rows + 2 * first[-1]).astype(np.int64)


_FEATURES = "ids array<long>, role binary, content binary, meta binary"


def _roles(ids: list[int | None], sample: dict[int, int]) -> np.ndarray:
    """What each document is learnt from as: its label in the sample, ``FREE`` or ``UNUSED``."""
    return np.array([UNUSED if i is None or zlib.crc32(str(i).encode()) % 5 == 0 else sample.get(i, FREE) for i in ids], np.int8)


@lean
def _feature_rows(batches: Iterator[pa.RecordBatch], sample) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, limit=FEATURE_BYTES):
            first, bucket, counts = content_counts(part.column("text"))
            meta_first, meta_bucket, _ = meta_view(part)
            ids = part.column("doc_id").to_pylist()
            row = [ids], [_roles(ids, sample.value).tobytes()], [_pack(first, bucket, counts)], [_pack(meta_first, meta_bucket, np.ones(len(meta_bucket)))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["ids", "role", "content", "meta"])


def _chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Chunk, pa.Array]]:
    """The chunks of packed rows, each with its ids as they were (nulls too)."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch.column("ids")[i].values
            first, bucket, count = _unpack(batch.column("content")[i].as_py())
            meta_first, meta_bucket, ones = _unpack(batch.column("meta")[i].as_py())
            role = np.frombuffer(batch.column("role")[i].as_py(), np.int8)
            yield Chunk(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), role, ((first, bucket, _values(first, count)), (meta_first, meta_bucket, ones.astype(float))), ((first, bucket, count), (meta_first, meta_bucket, ones))), ids


# ---------------------------------------------------------------- co-training


@dataclass
class Rule:
    """The models of a round and, for each view and label, the last histogram step passed on and the share of it."""

    views: list[View]
    limits: list[list[tuple[int, float]]]


def _step(margin: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(margin * STEPS, -END, END)).astype(np.int64)


def _lot(ids: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 for each id, which breaks ties within a histogram step."""
    return mix64(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(11)) / 2.0**64


def given_labels(chunk: Chunk, rules: list[Rule]) -> tuple[np.ndarray, np.ndarray]:
    """(not yet passed on, labels each view has been given or -1) after the rounds of ``rules``."""
    free = chunk.role == FREE
    given = np.full((2, len(chunk.ids)), -1)
    lot = _lot(chunk.ids)
    for rule in rules:
        taken = np.zeros(len(free), bool)
        for own, other in ((0, 1), (1, 0)):
            margin = rule.views[own].margin(chunk.views[own])
            step = _step(margin)
            for label in (1, 0):
                edge, share = rule.limits[own][label]
                hit = free & ((margin > 0) == bool(label)) & ((step > edge if label else step < edge) | (step == edge) & (lot < share))
                given[other][hit] = label
                taken |= hit
        free &= ~taken
    return free, given


def margin_counts(chunk: Chunk, rules: list[Rule], views: list[View]) -> Counter:
    """Documents not yet passed on, by view, label and histogram step."""
    free, _ = given_labels(chunk, rules)
    out: Counter = Counter()
    for i in (0, 1):
        margin = views[i].margin(chunk.views[i])[free]
        for label in (0, 1):
            steps, counts = np.unique(_step(margin[(margin > 0) == bool(label)]), return_counts=True)
            out.update({(i, label, int(s)): int(n) for s, n in zip(steps, counts, strict=True)})
    return out


def _limits(found: Counter, passed: int) -> list[list[tuple[int, float]]]:
    """For each view and label the histogram step where ``passed`` documents are reached."""
    out = []
    for view in (0, 1):
        both = []
        for label in (0, 1):
            edge, held = (-END - 1 if label else END + 1, 1.0), 0
            for (_, _, step), n in sorted(((k, n) for k, n in found.items() if k[:2] == (view, label)), reverse=bool(label)):
                if held + n >= passed:
                    edge = step, (passed - held) / n
                    break
                held += n
            both.append(edge)
        out.append(both)
    return out


def _joined(parts: list):
    """Features of several chunks, one after the other."""
    ends = np.cumsum([0] + [p[0][-1] for p in parts])
    first = np.concatenate([[0]] + [p[0][1:] + e for p, e in zip(parts, ends, strict=False)]).astype(np.int64)
    return first, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])


def _order(ids: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, np.array([xxhash.xxh3_64_intdigest(str(i)) for i in ids.tolist()], np.uint64)))


def _labelled_order(ids: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows to fit on, rows kept for calibration) of the labelled rows ``base``, each id once."""
    rows = base[_order(ids[base])]
    rows = rows[np.sort(np.unique(ids[rows], return_index=True)[1])]
    kept_out = np.arange(len(rows)) % 5 == 4
    return rows[~kept_out], rows[kept_out]


def _fit_rows(features, ids: np.ndarray, y: np.ndarray, labelled: np.ndarray, buckets: int) -> View:
    """A view fitted on the labelled rows that are not kept for calibration and all pseudo-labelled ones."""
    extra = np.flatnonzero(~labelled)
    rows = np.concatenate([_labelled_order(ids, np.flatnonzero(labelled))[0], extra[_order(ids[extra])]])
    return _fit_view(_rows_of(features, rows), y[rows], buckets)


def _rounds(rounds: int, passed: int, fit_views: Callable, count_margins: Callable) -> list[View]:
    """Fit, count the margins of all documents not yet passed on, and pass on the surest ones, ``rounds`` times."""
    rules: list[Rule] = []
    sizes = [0, 0]
    for turn in range(rounds + 1):
        views = fit_views(rules, sizes)
        if turn == rounds:
            break
        found = count_margins(rules, views)
        if not found:
            break
        rules.append(Rule(views, _limits(found, passed)))
        for own in (0, 1):
            sizes[1 - own] += sum(min(passed, sum(n for k, n in found.items() if k[:2] == (own, label))) for label in (0, 1))
    return views


def _calibrated(views: list[View], ids: np.ndarray, y: np.ndarray, margins) -> tuple[View, View]:
    """The views, calibrated on the labelled rows kept for that."""
    test = _labelled_order(ids, np.arange(len(ids)))[1]
    if len(set(y[test].tolist())) == 2:
        for view, margin in zip(views, margins, strict=True):
            _calibrate(view, margin[test], y[test])
    return views[0], views[1]


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(COLUMNS, (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], COLUMNS)


def co_train(labelled: pa.RecordBatch, y: np.ndarray, unlabelled: pa.RecordBatch, rounds: int = ROUNDS, passed: int = PASSED) -> tuple[View, View]:
    """The calibrated content and metadata classifiers of documents in memory."""
    both = pa.Table.from_batches([labelled, unlabelled.cast(labelled.schema)]).combine_chunks().to_batches()[0]
    chunk = Chunk(both.column("doc_id").to_numpy(), np.append(y, np.full(unlabelled.num_rows, FREE)), (content_view(both.column("text")), meta_view(both)))

    def fit_views(rules, sizes):
        _, given = given_labels(chunk, rules)
        learnt = [_training(chunk, given, i) for i in (0, 1)]
        return [_fit_rows(_rows_of(f, rows), *rest, buckets) for f, (rows, *rest), buckets in zip(chunk.views, learnt, (CONTENT_BUCKETS, META_BUCKETS), strict=True)]

    views = _rounds(rounds, passed, fit_views, functools.partial(margin_counts, chunk))
    return _calibrated(views, chunk.ids[: len(y)], y, [v.margin(f)[: len(y)] for v, f in zip(views, chunk.views, strict=True)])


def _training(chunk: Chunk, given: np.ndarray, view: int):
    """(rows, ids, labels, labelled) that a view learns from."""
    labelled = (chunk.role == 0) | (chunk.role == 1)
    rows = np.flatnonzero(labelled | (given[view] >= 0))
    return rows, chunk.ids[rows], np.where(labelled, chunk.role, given[view])[rows].astype(np.int64), labelled[rows]


# ---------------------------------------------------------------- operators


def features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Packed features of all rows of ``docs`` (see ``_FEATURES``), written once, with the role of each document.

    The ids of the bounded labelled sample are broadcast, so neither texts nor features are shuffled.
    """
    usable = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out())
    picked = [usable.where(f"quality = {q}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_PER_CLASS).select("doc_id", "quality") for q in (1, 0)]
    sample = {int(r.doc_id): int(r.quality) for r in picked[1].unionByName(picked[0]).orderBy("quality").collect()}  # 1 where an id has both
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    return materialize(rows.mapInArrow(functools.partial(_feature_rows, sample=docs.sparkSession.sparkContext.broadcast(sample)), _FEATURES), "features")


@lean
def _training_rows(batches, shared, shards):
    """Packed training rows of both views by shard; labelled rows go to every shard."""
    rules = shared.value
    for chunk, _ in _chunks_of(batches):
        _, given = given_labels(chunk, rules)
        for view in (0, 1):
            own, ids, y, labelled = _training(chunk, given, view)
            if not len(ids):
                continue
            shard = (mix64(ids.astype(np.uint64)) % np.uint64(shards[view])).astype(np.int64)
            for k in range(shards[view]) if labelled.any() else np.unique(shard).tolist():
                rows = np.flatnonzero(labelled | (shard == k))
                if len(rows):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([view]), pa.array([k]), pa.array([ids[rows].tolist()], pa.list_(pa.int64())), pa.array([y[rows].astype(np.int8).tobytes()]), pa.array([labelled[rows].tobytes()]), pa.array([_pack(*_rows_of(chunk.counts[view], own[rows]))])],
                        ["view", "shard", "ids", "y", "labelled", "body"],
                    )


def _fit_shard(table: pa.Table) -> pa.Table:
    view = table.column("view")[0].as_py()
    ids = np.concatenate([np.array(x, np.int64) for x in table.column("ids").to_pylist()])
    y = np.concatenate([np.frombuffer(x, np.int8) for x in table.column("y").to_pylist()]).astype(np.int64)
    labelled = np.concatenate([np.frombuffer(x, bool) for x in table.column("labelled").to_pylist()])
    first, bucket, count = _joined([_unpack(x) for x in table.column("body").to_pylist()])
    got = _fit_rows((first, bucket, count.astype(float) if view else _values(first, count)), ids, y, labelled, META_BUCKETS if view else CONTENT_BUCKETS)
    return pa.table({"view": [view], "shard": [table.column("shard")[0].as_py()], "weights": pa.array([got.weights.tobytes()], pa.binary()), "bias": [got.bias]})


@lean
def _mean_rows(batches):
    """The mean of each view's shards, read in the order of the shards."""
    sums: dict[int, list] = {}
    for batch in batches:
        for view, weights, bias in zip(*(batch.column(c).to_pylist() for c in ("view", "weights", "bias")), strict=True):
            s = sums.setdefault(view, [0.0, 0.0, 0])
            s[0], s[1], s[2] = s[0] + np.frombuffer(weights), s[1] + bias, s[2] + 1
    for view, (weights, bias, n) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([view]), pa.array([(weights / n).tobytes()], pa.binary()), pa.array([bias / n])], ["view", "weights", "bias"])


@lean
def _count_rows(batches, shared):
    rules, views = shared.value
    total: Counter = Counter()
    for chunk, _ in _chunks_of(batches):
        total.update(margin_counts(chunk, rules, views))
    rows = [(*k, n) for k, n in total.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["view", "label", "step", "n"])


@lean
def _role_rows(batches):
    for batch in batches:
        roles, n = np.unique(np.frombuffer(b"".join(batch.column("role").to_pylist()), np.int8), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(roles.astype(np.int64)), pa.array(n)], ["role", "n"])


@lean
def _margin_rows(batches, shared):
    """Id, label and margins of the labelled sample."""
    views = shared.value
    for chunk, _ in _chunks_of(batches):
        rows = np.flatnonzero((chunk.role == 0) | (chunk.role == 1))
        a, b = (v.margin(_rows_of(f, rows)) for v, f in zip(views, chunk.views, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(chunk.ids[rows]), pa.array(chunk.role[rows].astype(np.int64)), pa.array(a), pa.array(b)], ["doc_id", "label", "a", "b"])


def fit(packed: DataFrame) -> tuple[View, View]:
    """Both views' classifiers from all packed features (see the module text)."""
    context = packed.sparkSession.sparkContext
    roles = dict(packed.select("role").mapInArrow(_role_rows, "role long, n long").groupBy("role").agg(F.sum("n")).collect())
    if not (roles.get(0) and roles.get(1)):
        return View(np.zeros(CONTENT_BUCKETS), slope=0.0), View(np.zeros(META_BUCKETS), slope=0.0)

    def fit_views(rules, sizes):
        shards = [max(1, ceil(n / SHARD_ROWS)) for n in sizes]
        rows = packed.mapInArrow(functools.partial(_training_rows, shared=context.broadcast(rules), shards=shards), "view long, shard long, ids array<long>, y binary, labelled binary, body binary")
        models = rows.groupBy("view", "shard").applyInArrow(_fit_shard, "view long, shard long, weights binary, bias double")
        mean = models.repartition(1).sortWithinPartitions("view", "shard").mapInArrow(_mean_rows, "view long, weights binary, bias double").collect()
        return [View(np.frombuffer(r.weights).copy(), r.bias) for r in sorted(mean, key=lambda r: r.view)]

    def count_margins(rules, views):
        rows = packed.mapInArrow(functools.partial(_count_rows, shared=context.broadcast((rules, views))), "view long, label long, step long, n long")
        return Counter({(r.view, r.label, r.step): r.n for r in rows.groupBy("view", "label", "step").agg(F.sum("n").alias("n")).collect()})

    views = _rounds(ROUNDS, max(PASSED, ceil(PASSED_SHARE * roles.get(FREE, 0))), fit_views, count_margins)
    known = packed.mapInArrow(functools.partial(_margin_rows, shared=context.broadcast(views)), "doc_id long, label long, a double, b double").collect()  # at most the labelled sample
    ids, y = np.array([r.doc_id for r in known], np.int64), np.array([r.label for r in known], np.int64)
    return _calibrated(views, ids, y, [np.array([r.a for r in known]), np.array([r.b for r in known])])


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, content_score, meta_score, score, predicted)`` for every row of ``docs``."""
    packed = features(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(fit(packed))

    @lean
    def run(batches):
        content, meta = shared.value
        for chunk, ids in _chunks_of(batches):
            a, b = content.log_odds(chunk.views[0]), meta.log_odds(chunk.views[1])
            scores = [_chance(x) for x in (a, b, combined(a, b, content.prior))]
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, scores)], ["doc_id", "content_score", "meta_score", "score"])

    scored = packed.mapInArrow(run, "doc_id long, content_score double, meta_score double, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "content_score", "meta_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents predicted to be of low quality; same columns.  Every row is judged on its own."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(features(docs, labels)))
    columns = docs.columns

    @lean
    def run(batches):
        content, meta = shared.value
        for batch in batches:
            for part in chunks(batch):
                odds = combined(content.log_odds(content_view(part.column("text"))), meta.log_odds(meta_view(part)), content.prior)
                yield part.filter(pa.array(_chance(odds) >= 0.5)).select(columns)

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
