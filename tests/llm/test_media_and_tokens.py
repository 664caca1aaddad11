import hashlib
import json
import random
import re
import zlib

import public_tokenizers
import pytest

from lexloom.llm import media as M
from lexloom.llm import token_counts as T

SF = "/root/testdata/sf0.001"
VOCAB = public_tokenizers.path("word_bpe_49k.json")


def greedy(word, initial, inner):
    """Token count of greedy longest match, piece by piece."""
    at, n = 0, 0
    while at < len(word):
        pool = inner if at else initial
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pool), None)
        if end is None:
            return None
        at, n = end, n + 1
    return n


def test_automaton_equals_greedy_matching():
    rng = random.Random(4)
    for _ in range(300):
        pieces = lambda: {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 9))}
        a, b = pieces(), pieces()
        m = T.LongestMatch(sorted(a), sorted(b))
        for _ in range(30):
            word = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12)))
            assert m.count(word) == greedy(word, a, b), (word, a, b)


def test_counts_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n"), (-4, "Hello WORLD é中"), (-5, "x" * 20000)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(odd)
    rows = both.collect()
    m = T.from_byte_pieces(VOCAB)
    pool = {T._plain(p) for p in json.load(open(VOCAB))["model"]["vocab"]} - {None}
    got = {r.doc_id: r for r in T.token_counts(both, VOCAB).collect()}
    looked_at = set()
    assert len(got) == len(rows)
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        counts = [m.count(w.lower().encode().decode("latin-1") + T.END) for w in words]
        assert got[r.doc_id].n_words == len(words) and got[r.doc_id].n_tokens == sum(1 if c is None else c for c in counts)
        for w, c in zip(words, counts):
            if w not in looked_at and len(w) < 2000:
                looked_at.add(w)
                assert c == greedy(w.lower().encode().decode("latin-1") + T.END, pool, pool)


def decoded(image):
    """Samples of a PNG by its specification: 8-bit grey, lines without a filter."""
    assert image[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    parts, at = [], 8
    while at < len(image):
        n = int.from_bytes(image[at : at + 4], "big")
        kind, body, crc = image[at + 4 : at + 8], image[at + 8 : at + 8 + n], image[at + 8 + n : at + 12 + n]
        assert zlib.crc32(kind + body) == int.from_bytes(crc, "big")
        parts.append((kind, body))
        at += 12 + n
    assert [k for k, _ in parts] == [b"IHDR", b"IDAT", b"IEND"]
    width, height = (int.from_bytes(parts[0][1][i : i + 4], "big") for i in (0, 4))
    assert width == 576 and parts[0][1][8:] == bytes([8, 0, 0, 0, 0])
    flat = zlib.decompress(parts[1][1])
    lines = [flat[i * 577 : (i + 1) * 577] for i in range(height)]
    assert len(flat) == 577 * height and all(line[0] == 0 for line in lines)
    return b"".join(line[1:] for line in lines)


def described(p):
    """The feature text, computed with plain numbers."""
    n = len(p)
    mean = sum(p) / n
    std = (sum((x - mean) ** 2 for x in p) / n) ** 0.5
    levels = [0] * 16
    for x in p:
        levels[x // 16] += 1
    edges = [i * n // 64 for i in range(65)]
    cells = [sum(p[a:b]) // (b - a) for a, b in zip(edges, edges[1:])]
    bits = "".join("1" if c * 64 > sum(cells) else "0" for c in cells)
    return f"mean={mean:.3f};std={std:.3f};hist={','.join(str(c * 1000 // n) for c in levels)};hash={int(bits, 2):016x}"


def test_media_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "x" * 576), (-4, "é" * 288 + "y"), (-4, "é" * 288 + "y"), (-7, "long " * 60_000)], "doc_id long, text string")
    both = docs.unionByName(odd)
    rows = both.collect()
    members = M.read_archives(M.write_archives(both), part_bytes=50_000)
    got = M.describe(members).collect()
    stored = {}
    for r in members.collect():
        stored.setdefault(decoded(bytes(r.image)), set()).add(bytes(r.image))
    want = []
    for r in rows:
        raw = (r.text or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576) if raw else b"\xff" * 576
        (image,) = stored[p]  # equal texts have one form
        want.append((r.doc_id, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(image), hashlib.sha256(image).hexdigest(), described(p)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    texts = sorted((str(r.doc_id), bytes(r.payload).decode()) for r in M.payloads(members).collect())
    assert texts == sorted((str(r.doc_id), r.text or "") for r in rows)
    assert M.describe(M.read_archives(M.write_archives(both.limit(0)))).collect() == []


def test_members_are_tried_again_by_offset(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").coalesce(1)
    path = M.write_archives(docs).first().path
    archive = M._Archive(path)
    first, second = archive.directory()
    fails = [OSError("gone"), OSError("gone")]
    real = archive.system

    class Flaky:
        def open_input_file(self, p):
            if fails:
                raise fails.pop()
            return real.open_input_file(p)

    archive.system, archive.file = Flaky(), None
    assert M.samples(archive.member(second)) == M.payload_of("b") and not fails
    broken = M.png(M.payload_of("a"))
    with pytest.raises(ValueError):
        M.samples(broken[:60] + b"\0" + broken[61:])


def test_names_of_file_systems_and_failed_attempts(tmp_path):
    assert [M.arrow_uri(u) for u in ("s3a://bucket/a/b", "s3://b/c", "file:///a")] == ["s3://bucket/a/b", "s3://b/c", "file:///a"]

    def batches():
        yield M.pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a"]})
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        list(M._archives(batches(), f"file://{tmp_path}/m"))
    assert list((tmp_path / "m").iterdir()) == []
