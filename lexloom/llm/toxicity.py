"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the average of the vectors of its character n-grams (with boundary marks), a
document the average of its words, and a softmax over two classes sits on top.  Vectors and
softmax are trained together in numpy, in one task, from a bounded sample of labelled
documents.  A misspelling shares most n-grams with the word it hides.

Scores are linear in the document vector, so the trained model folds into one number per
n-gram bucket; that table (``BUCKETS`` floats) goes to the executors and every whole text is
scored in one pass without a shuffle.

Null and empty texts and texts without words have the score of the bias alone.  Repeated
rows are scored alike; an empty table gives an empty result; other columns pass by unread.
Labels are learnt only from rows with a 0 or 1 label and a document; an unlabelled or
one-class corpus gives the constant score 0, and labelled documents that share no n-gram
(all of them empty, say) the constant score 0.5.  Where rows repeat a labelled ``doc_id`` the text
with the smallest hash is learnt from.  Very long texts are read whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import fresh_name
from .wordtools import Words, chunks, mix64
from .workers import lean

#: Most labelled documents of each class that a model is fitted on.
SAMPLE_PER_CLASS = 1200
BUCKETS = 1 << 18
SIZES = (3, 4, 5)
DIMENSIONS = 2
EPOCHS = 90
#: An n-gram has a vector if so many whole documents of the sample have it, whatever the size of the sample.
LEAST_DOCUMENTS = 3
#: Share that a vector loses in each epoch, divided by the documents that have its n-gram: rare ones weigh less.
RARE_DECAY = 0.3
#: Pieces of each clean document that join the sample, so that ordinary words are seen in short texts.
PIECES = 24
#: Adam: learning rates of vectors, softmax and bias, weight decay of the vectors, and the floor of the step size.
RATES = (6.0, 0.05, 0.2)
DECAY = 0.0
EPSILON = 1e-6


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(first n-gram of each word, bucket of every n-gram); every word has at least one."""
    joined = pc.binary_join_element_wise("<", pc.utf8_lower(words), ">", "")
    lengths = pc.utf8_length(joined).to_numpy(zero_copy_only=False).astype(np.int64)
    text = "".join(joined.to_pylist())
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    edges = np.append(0, np.cumsum(lengths))
    owner = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(edges[1:], lengths) - np.arange(len(points))  # code points from here to the end of the word
    at, bucket = [], []
    rolled = np.zeros(len(points), np.uint64)
    for n in range(1, max(SIZES) + 1):
        shifted = np.zeros(len(points), np.uint64)
        shifted[: max(0, len(points) - n + 1)] = points[n - 1 :]
        rolled = rolled * np.uint64(1099511628211) + shifted + np.uint64(17)
        if n in SIZES:
            ok = np.flatnonzero(left >= n)
            at.append(owner[ok])
            bucket.append(mix64(rolled[ok] + np.uint64(n * 0x51ED2701)) % np.uint64(BUCKETS))
    short = np.flatnonzero(lengths < min(SIZES))  # only the empty word
    at.append(short)
    bucket.append(np.zeros(len(short), np.uint64))
    at, bucket = np.concatenate(at), np.concatenate(bucket).astype(np.int64)
    order = np.argsort(at, kind="stable")
    return np.searchsorted(at[order], np.arange(len(lengths) + 1)), bucket[order]


def _segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows; ``first`` has the start of each segment and the end, segments may be empty."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, first[:-1][full], axis=0)
    return out


class _Sparse:
    """A sparse matrix that multiplies dense ones from the left, and its transpose; ``rows`` must be sorted."""

    def __init__(self, rows, cols, values, shape):
        order = np.argsort(cols, kind="stable").astype(np.int32)
        self.parts = [
            (np.searchsorted(rows, np.arange(shape[0] + 1)), cols, values[:, None]),
            (np.searchsorted(cols[order], np.arange(shape[1] + 1)), rows[order], values[order][:, None]),
        ]

    def dot(self, x, transpose=False):
        first, cols, values = self.parts[transpose]
        rows = len(first) - 1
        out = np.zeros((rows, x.shape[1]), np.float32)
        start = 0
        while start < rows:  # a million entries at once
            stop = min(rows, max(start + 1, int(np.searchsorted(first, first[start] + (1 << 20), side="right")) - 1))
            a, b = first[start], first[stop]
            out[start:stop] = _segment_sums(np.take(x, cols[a:b], axis=0) * values[a:b], first[start : stop + 1] - a)
            start = stop
        return out


@dataclass
class Model:
    """The folded model: a weight per n-gram bucket and a bias."""

    weights: np.ndarray
    bias: float

    def word_scores(self, words: pa.Array) -> np.ndarray:
        first, bucket = subwords(words)
        return _segment_sums(self.weights[bucket], first) / np.maximum(np.diff(first), 1)

    def scores(self, text: pa.Array) -> np.ndarray:
        words = Words(text)
        codes, distinct = words.codes()
        each = self.word_scores(distinct)[codes] if len(codes) else np.zeros(0)
        n = np.diff(words.bounds)
        logit = _segment_sums(each, words.bounds) / np.maximum(n, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def _pieces(text: str | None, rng: np.random.Generator) -> list[str]:
    """Short random pieces of a clean document; each of them is clean as well."""
    words = Words(pa.array([text], pa.string())).array
    out = []
    for _ in range(min(PIECES, len(words) // 4)):
        n = int(rng.integers(3, 40))
        a = int(rng.integers(0, max(1, len(words) - n)))
        out.append(" ".join(words.slice(a, n).to_pylist()))
    return out


def _bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of a text, share of each), the average of its words' averages."""
    words = Words(pa.array([text], pa.string()))
    codes, distinct = words.codes()
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    first, bucket = subwords(distinct)
    size = np.diff(first)
    part = np.bincount(codes, minlength=len(distinct)) / len(codes) / size
    own, where = np.unique(bucket, return_inverse=True)
    return own.astype(np.int32), np.bincount(where, weights=np.repeat(part, size)).astype(np.float32)


def train(texts: Iterable[str | None], labels: Iterable[int], epochs: int = EPOCHS, seed: int = 0) -> Model:
    """Fit n-gram vectors and softmax together (Adam on the whole sample).

    Averaging words that average their n-grams is one sparse product, documents by n-grams.
    N-grams of fewer than ``LEAST_DOCUMENTS`` whole documents get no vector; pieces don't count.
    Vectors of rare n-grams decay (``RARE_DECAY``).  Texts are read one by one and not held: a document
    is its bag from then on, and a clean one ``PIECES`` short pieces.
    """
    rng = np.random.default_rng(seed)
    bags: list[tuple[np.ndarray, np.ndarray]] = []
    held = np.zeros(BUCKETS, np.int32)
    seen: list[int] = []
    pieces: list[str] = []
    for text, label in zip(texts, labels, strict=True):
        bags.append(_bag(text))
        held[bags[-1][0]] += 1
        seen.append(label)
        if not label:
            pieces += _pieces(text, rng)
    if len(set(seen)) < 2:
        return Model(np.zeros(BUCKETS), -60.0)
    whole = len(seen)
    y = np.array(seen + [0] * len(pieces), dtype=np.int64)
    often = held >= LEAST_DOCUMENTS
    for text in pieces:
        bag = _bag(text)
        bags.append(tuple(x[often[bag[0]]] for x in bag))
    used = np.flatnonzero(often)
    if not len(used):
        return Model(np.zeros(BUCKETS), 0.0)
    number = (np.cumsum(often) - 1).astype(np.int32)
    bags = [(number[g[often[g]]], s[often[g]]) for g, s in bags]
    doc_at = np.repeat(np.arange(len(bags), dtype=np.int32), [len(g) for g, _ in bags])
    gram_at = np.concatenate([g for g, _ in bags])
    share = np.concatenate([s for _, s in bags])
    del bags
    x = _Sparse(doc_at, gram_at, share, (len(y), len(used)))
    del doc_at, gram_at, share

    params = [rng.normal(0, 0.01, (len(used), DIMENSIONS)).astype(np.float32), rng.normal(0, 1, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    stays = (1 - np.minimum(1, RARE_DECAY / held[used])).astype(np.float32)[:, None]
    weight = np.where(y == 1, 1 / y.sum(), 1 / max(1, whole - y.sum())).astype(np.float32)[:, None]
    weight[whole:] = 2 / max(1, len(y) - whole)
    weight /= weight.sum()
    target = np.eye(2, dtype=np.float32)[y]
    for t in range(1, epochs + 1):
        vectors, top, bias = params
        hidden = x.dot(vectors)
        logits = hidden @ top + bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        error = (p - target) * weight
        back = x.dot(error @ top.T, transpose=True) + DECAY * vectors
        for i, g in enumerate((back, hidden.T @ error, error.sum(axis=0))):
            m, v = moments[i]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            params[i] = params[i] - RATES[i] * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + EPSILON)
        params[0] *= stays
    vectors, top, bias = params
    weights = np.zeros(BUCKETS)
    weights[used] = vectors @ (top[:, 1] - top[:, 0])
    return Model(weights, float(bias[1] - bias[0]))


# ---------------------------------------------------------------- operators


def held_out(doc_id: str = "doc_id"):
    """Rows never learnt from: crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Model of ``labels.toxic``, from at most ``per_class`` documents of each class.

    The sample is the labelled rows with the smallest id hashes, so it does not depend on
    partitioning; its ids are bounded by ``2 * per_class`` and are broadcast to read the texts.
    """
    usable = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out())
    picked = [usable.where(f"toxic = {t}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id", F.lit(t).alias("toxic")) for t in (0, 1)]
    ids = picked[0].unionByName(picked[1]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("doc_id", "t.text", "toxic")
    found = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(_train_rows, "weights binary, bias double").collect()
    return Model(np.frombuffer(found[0].weights, np.float32).astype(np.float64), found[0].bias) if found else train([], [])


@lean
def _train_rows(batches):
    """The model of all rows of the bounded sample, trained in one task."""
    batches = (b.slice(i, 1) for b in batches for i in range(b.num_rows))
    first = next(batches, None)
    if first is not None:
        texts, labels = itertools.tee(itertools.chain([first], batches))  # read in step
        m = train((b.column("text")[0].as_py() for b in texts), (b.column("toxic")[0].as_py() for b in labels))
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.astype(np.float32).tobytes()], pa.binary()), pa.array([m.bias], pa.float64())], ["weights", "bias"])


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every whole text (a column of that name is replaced)."""
    base = docs.drop(column)
    columns = base.columns
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    @lean
    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(own.scores(part.column("text")))], [*columns, column])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + f", `{column}` double"
    return base.mapInArrow(run, schema)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``."""
    model = fit(docs, labels)
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents predicted toxic; same columns."""
    model = fit(docs, labels)
    name = fresh_name("toxicity", docs.columns)
    return score(docs, model, name).where(F.col(name) < 0.5).drop(name)
