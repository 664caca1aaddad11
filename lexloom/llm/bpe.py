"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

1. *Explode with positions.*  Each task cuts its texts into pre-tokens, block by block
   (``BLOCK_BYTES`` of text).  A block keeps the word number at each position of each of its
   documents; its distinct words go out in one packed row for each bucket of word hashes.
2. *Encode each distinct word once.*  All occurrences of a word in any block meet in its
   bucket, where the word passes through the BPE merges once; a task holds the words of one
   bucket at a time.
3. *Join ids back.*  The ids return to the blocks, again in packed rows.  A word travels once
   for each block and not for each occurrence, so even the most frequent one stays small.
4. *Reassemble by position.*  Block by block, ids and positions give each document's ids.

The blocks are shuffled once; that exchange serves both the encoding and the reassembly.
Blocks are named by their content.  A task that is run again after a lost executor reads the same
file splits in the same order and makes the same blocks; an input whose order changes from read to
read must be written to a table first.  Where that was not done the names no longer match, and the
job fails: words never go to another document and no document is lost.

Decoding looks every id up in the token-byte table, whose size is that of the vocabulary,
and concatenates the bytes.

Null texts count as empty: no ids, no bytes.  Very long texts are read whole; they make blocks of
their own size.  There are no ties: equal words have equal ids.  Repeated rows and repeated ids are kept as
they are; columns other than the id and the text are ignored; an empty table gives an
empty result.  Each pre-token is encoded separately and special tokens are never made.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordtools import chunks, text_bytes
from .workers import lean

#: Text gathered in one block; bounds the memory of a task that builds or reassembles it.
BLOCK_BYTES = 8 << 20
#: Least number of word buckets; twice the shuffle partitions if that is more.
LEAST_BUCKETS = 128

_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


@functools.cache
def _classes() -> np.ndarray:
    table = np.full(0x110000, _OTHER, np.uint8)
    everything = "".join(map(chr, range(0x110000)))
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER)):
        for m in regex.finditer(pattern, everything):
            table[m.start() : m.end()] = kind
    table[_WHITE] = _SPACE
    return table


def pretokens(text: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """All pre-tokens of a column and the first one of each row.

    Same cuts as the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
    applied to each row, found on whole columns of code points.
    """
    raw, offsets = text_bytes(text)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    n = len(points)
    if not n:
        return pa.array([], pa.string()), np.zeros(len(offsets), np.int64)
    at_byte = np.zeros(n + 1, np.int64)
    np.cumsum(1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF), out=at_byte[1:])
    rows = np.searchsorted(at_byte, offsets)
    kind = _classes()[points]
    fresh = np.zeros(n + 1, bool)  # first code point of a row, and the end
    fresh[rows] = True
    fresh[n] = True

    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= fresh[:n]
    start = change.copy()
    blank = points == 0x20
    # A run of white space gives its last character to what follows, unless the row ends there.
    last_space = (kind == _SPACE) & np.append(change[1:], True) & ~fresh[1:]
    start[last_space] = True
    lead = last_space & blank
    taken = np.flatnonzero(lead) + 1
    start[taken] = False
    # Contractions: an apostrophe that starts a pre-token.
    quote = np.flatnonzero((points == 0x27) & start)
    if len(quote):
        padded = np.append(points, [0, 0, 0])
        ends = np.append(fresh, [True, True])
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"]) & ~ends[quote + 1]
        two = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v"))) | (a == ord("l")) & (b == ord("l"))) & ~ends[quote + 1] & ~ends[quote + 2]
        short, long = quote[one], quote[two]
        start[short + 1] = False
        start[long + 1] = False
        for after in (short + 2, long + 3):
            after = after[after < n]
            start[after[(kind[after] == _LETTER)]] = True
    cuts = np.flatnonzero(start)
    where = np.append(at_byte[cuts], at_byte[n]).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(where), pa.py_buffer(np.ascontiguousarray(raw)))
    return tokens, np.searchsorted(cuts, rows)


# ---------------------------------------------------------------- vocabulary


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


@functools.cache
def _coder(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("lexloom", pat_str=r"[\s\S]+", mergeable_ranks=load_ranks(path), special_tokens={})


@functools.cache
def token_bytes(path: str) -> pa.BinaryArray:
    """The token-byte table: bytes by id (bounded by the vocabulary)."""
    ranks = load_ranks(path)
    out: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return pa.array(out, pa.binary())


def decode_ids(ids: pa.Array, path: str) -> pa.BinaryArray:
    """Bytes of every id, by lookup in the token-byte table."""
    return token_bytes(path).take(ids)


# ---------------------------------------------------------------- steps

_SHUFFLED = "key long, block long, first long, docs array<long>, places array<long>, counts array<long>, packed binary"
_NAMES = ["key", "block", "first", "docs", "places", "counts", "packed"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]


def _pack(numbers: np.ndarray) -> bytes:
    """Compressed unsigned 32-bit numbers, byte plane by byte plane."""
    planes = np.ascontiguousarray(numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), 3)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()


def _block_rows(ids: list[pa.Array], places: list[pa.Array], tokens: list[pa.Array], counts: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """One row with the documents and positions of a block (packed: word numbers), then its words by bucket.

    Words are numbered by bucket and then by their bytes, so a bucket's words have consecutive numbers.
    """
    encoded = pa.concat_arrays(tokens).dictionary_encode()
    words = encoded.dictionary.cast(pa.binary()).to_pylist()
    bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, count=len(words))
    order = sorted(range(len(words)), key=lambda i: (bucket[i], words[i]))
    number = np.empty(len(words), np.int64)
    number[order] = np.arange(len(words))
    positions = _pack(number[encoded.indices.to_numpy(zero_copy_only=False)]) if words else _pack(np.zeros(0, np.uint32))
    docs, at = ([d for part in parts for d in part.to_pylist()] for parts in (ids, places))
    lengths = np.concatenate(counts).tolist()
    name = xxhash.xxh3_64_intdigest(positions + repr((docs, at, lengths)).encode() + b"\0".join(words)) >> 2 | 1 << 62
    rows = [(name, name, -1, docs, at, lengths, positions)]
    sizes = np.bincount(bucket, minlength=buckets)
    first = 0
    for b in np.flatnonzero(sizes).tolist():
        own = [words[i] for i in order[first : first + int(sizes[b])]]
        lens = np.array([len(w) for w in own], np.uint32)
        body = zstandard.compress(len(own).to_bytes(4, "little") + lens.tobytes() + b"".join(own), 3)
        rows.append((b, name, first, None, None, None, body))
        first += int(sizes[b])
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _NAMES)


@lean
def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int, buckets: int) -> Iterator[pa.RecordBatch]:
    ids, places, tokens, counts, held = [], [], [], [], 0
    for batch in batches:
        for part in chunks(batch):
            words, bounds = pretokens(part.column("text"))
            ids.append(part.column("doc_id"))
            places.append(part.column("place"))
            tokens.append(words)
            counts.append(np.diff(bounds))
            held += part.column("text").nbytes
            if held >= block_bytes:
                yield _block_rows(ids, places, tokens, counts, buckets)
                ids, places, tokens, counts, held = [], [], [], [], 0
    if ids:
        yield _block_rows(ids, places, tokens, counts, buckets)


@lean
def _encode_words(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The ids of each packed list of words, sorted by bucket: how many each word has, then all of them."""
    coder, ranks = _coder(path), load_ranks(path)
    known: dict[bytes, list[int]] = {}  # the words of one bucket
    bucket = None
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], ["block", "first", "words", "packed"])
        held.clear()
        return out

    for batch in batches:
        for row in range(batch.num_rows):
            first, key = batch.column("first")[row].as_py(), batch.column("key")[row].as_py()
            if first < 0:
                continue
            if key != bucket:
                known, bucket = {}, key
            body = zstandard.decompress(batch.column("packed")[row].as_py())
            n = int.from_bytes(body[:4], "little")
            edges = np.append(0, np.cumsum(np.frombuffer(body, np.uint32, count=n, offset=4), dtype=np.int64)).tolist()
            text, lens, flat = body[4 + 4 * n :], [], []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                w = text[a:b]
                ids = known.get(w)
                if ids is None:
                    whole = ranks.get(w)
                    ids = known[w] = [whole] if whole is not None else coder._encode_single_piece(w)
                lens.append(len(ids))
                flat += ids
            held.append((batch.column("block")[row].as_py(), first, n, _pack(np.array(lens + flat, np.uint32))))
            size += len(held[-1][3])
            if size > 4 << 20:
                yield flush()
                size = 0
    if held:
        yield flush()


def _documents(left: pa.Table, right: pa.Table) -> Iterator[tuple[int | None, int | None, pa.Array]]:
    """(doc_id, place, ids) of every document of a block."""
    left = left.filter(pc.less(left.column("first"), 0))
    if not left.num_rows:
        if right.num_rows:
            raise RuntimeError("words came back to a block that is not there: its input was read in another order")
        return
    lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for first, words, packed in zip(*(right.column(c).to_pylist() for c in ("first", "words", "packed")), strict=True):
        numbers = _unpack(packed)
        lists[first] = numbers[:words], numbers[words:]
    lens = np.concatenate([lists[f][0] for f in sorted(lists)]) if lists else np.zeros(0, np.uint32)
    flat = np.concatenate([lists[f][1] for f in sorted(lists)]) if lists else np.zeros(0, np.uint32)
    table = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lens, dtype=np.int64)).astype(np.int32)), pa.array(flat.astype(np.int32)))
    for docs, places, counts, packed in zip(*(left.column(c).to_pylist() for c in ("docs", "places", "counts", "packed")), strict=True):
        codes, edges = _unpack(packed), np.append(0, np.cumsum(counts))
        if len(codes) and codes.max() >= len(table):
            raise RuntimeError("a block came back without all of its words: its input was read in another order")
        start = 0
        while start < len(docs):  # a million positions at once
            stop = max(start + 1, int(np.searchsorted(edges, edges[start] + (1 << 20), side="right")) - 1)
            got = table.take(pa.array(codes[edges[start] : edges[stop]]))
            ids, at = got.flatten(), np.append(0, np.cumsum(pc.list_value_length(got).to_numpy(zero_copy_only=False)))
            for d in range(start, stop):
                a, b = int(at[edges[d] - edges[start]]), int(at[edges[d + 1] - edges[start]])
                yield docs[d], places[d], ids.slice(a, b - a)
            start = stop


def _id_rows(left: pa.Table, right: pa.Table) -> pa.Table:
    docs, places, lists = [], [], []
    for doc, place, ids in _documents(left, right):
        docs.append(doc)
        places.append(place)
        lists.append(ids)
    at = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int32)
    flat = pa.concat_arrays(lists) if lists else pa.array([], pa.int32())
    return pa.table({"doc_id": pa.array(docs, pa.int64()), "place": pa.array(places, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(at), flat)})


def _digest_rows(left: pa.Table, right: pa.Table, path: str) -> pa.Table:
    """Digest columns of a block's documents; decoding goes through the token-byte table."""
    names = _decimal_names(path)
    docs, lengths, ids_sha, text_sha = [], [], [], []
    for doc, _, ids in _documents(left, right):
        docs.append(doc)
        lengths.append(len(ids))
        line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), names.take(ids)), ",")
        ids_sha.append(hashlib.sha256(line[0].as_buffer()).hexdigest())
        text_sha.append(hashlib.sha256(_joined(decode_ids(ids, path))).hexdigest())
    return pa.table({"doc_id": pa.array(docs, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())})


@functools.cache
def _decimal_names(path: str) -> pa.StringArray:
    return pa.array([str(i) for i in range(len(token_bytes(path)))], pa.string())


def _joined(pieces: pa.BinaryArray) -> bytes | memoryview:
    """All bytes of a column that lies in one piece of memory."""
    if not len(pieces):
        return b""
    at = np.frombuffer(pieces.buffers()[1], np.int32, count=pieces.offset + len(pieces) + 1)
    return memoryview(pieces.buffers()[2])[at[pieces.offset] : at[-1]]


# ---------------------------------------------------------------- operators


def _by_block(docs: DataFrame, path: str, block_bytes: int, finish, schema: str, place: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    buckets = max(LEAST_BUCKETS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(place).cast("long").alias("place") if place else F.lit(None).cast("long").alias("place"))
    dealt = rows.mapInArrow(functools.partial(_blocks, block_bytes=block_bytes, buckets=buckets), _SHUFFLED).repartition("key").sortWithinPartitions("key")
    coded = dealt.mapInArrow(functools.partial(_encode_words, path=path), "block long, first long, words long, packed binary")
    return dealt.groupBy("key").cogroup(coded.groupBy("block")).applyInArrow(finish, schema)


def encode(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES, place: str | None = None) -> DataFrame:
    """``(doc_id, ids array<int>)`` for every row of ``docs(doc_id, text)`` by the ranks at ``path``.

    ``path`` is the vocabulary file as installed on every node.  ``place`` names a whole-number
    column that each row keeps, between the id and the token ids.
    """
    coded = _by_block(docs, path, block_bytes, _id_rows, "doc_id long, place long, ids array<int>", place)
    return coded.withColumnRenamed("place", place) if place else coded.drop("place")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, decoded binary)`` for every row of ``encoded(doc_id, ids)``; null ids give null."""

    @lean
    def run(batches):
        for batch in batches:
            out = [bytes(_joined(decode_ids(x.values, path))) if x.is_valid else None for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digests(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: every text encoded, then its ids decoded."""

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        return _digest_rows(left, right, path)

    return _by_block(docs, path, block_bytes, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
