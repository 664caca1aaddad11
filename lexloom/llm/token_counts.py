"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie over word starts and one over continuations (pieces that go on
inside a word).  Every trie node has a failure link and a precomputed number of tokens popped
on the way: following the link from a node means that the longest pieces of what has been read
are complete.  A word is read once, character by character; no piece is ever built and no
character is read twice, so the time is linear in the word's length.

Greedy longest match: a word that cannot be matched to its end is one unknown token.  Words
are ``[^\\x20\\x09-\\x0D]+``, lower-cased.  Each task counts every distinct word of a chunk
once and multiplies out, so there is no shuffle and no state grows with the input.

Null and empty texts have no words and no tokens; repeated rows are counted alike; extra
columns are ignored; an empty table gives an empty result.  Very long texts and words of any length are read
whole.  There are no ties: the longest piece is one piece.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .wordtools import Words, chunks

_DEAD = -1


class LongestMatch:
    """Automaton over initial pieces and continuation pieces."""

    def __init__(self, initial: list[str], inner: list[str]):
        self.next: list[dict[str, int]] = [{}, {}]  # 0: word start, 1: inside a word
        whole: list[bool] = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                node = root
                for ch in piece:
                    child = self.next[node].get(ch)
                    if child is None:
                        child = self.next[node][ch] = len(self.next)
                        self.next.append({})
                        whole.append(False)
                    node = child
                if piece:
                    whole[node] = True
        n = len(self.next)
        self.fail = [_DEAD] * n
        self.popped = [0] * n
        level = [0, 1]
        while level:
            below = []
            for node in level:
                for ch, child in self.next[node].items():
                    below.append(child)
                    if whole[child]:
                        self.fail[child], self.popped[child] = 1, 1
                        continue
                    state, pops = self.fail[node], self.popped[node]
                    while state != _DEAD and ch not in self.next[state]:
                        pops += self.popped[state]
                        state = self.fail[state]
                    if state != _DEAD:
                        self.fail[child], self.popped[child] = self.next[state][ch], pops
            level = below

    def count(self, word: str) -> int | None:
        """Tokens of a word, or None if it cannot be matched."""
        nxt, fail, popped = self.next, self.fail, self.popped
        state, tokens = 0, 0
        for ch in word:
            while (child := nxt[state].get(ch)) is None:
                tokens += popped[state]
                state = fail[state]
                if state == _DEAD:
                    return None
            state = child
        while state != 1:
            tokens += popped[state]
            state = fail[state]
            if state == _DEAD:
                return None
        return tokens


@functools.cache
def from_byte_pieces(path: str) -> LongestMatch:
    """Pieces of a word-end vocabulary file: a piece with the end mark continues to the end of a word.

    Here a word is read with the end mark as its last character; every piece may start a word or go on.
    """
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    pieces = [_plain(p) for p in vocab]
    pieces = [p for p in pieces if p]
    return LongestMatch(pieces, pieces)


@functools.cache
def _letters() -> dict[str, int]:
    """Byte of each printable stand-in of byte-level vocabularies."""
    direct = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in direct}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(direct))}


END = "\0"


def _plain(piece: str) -> str | None:
    """A vocabulary entry as one character per byte, with ``END`` for the word-end mark."""
    table = _letters()
    end = piece.endswith("</w>") and piece != "</w>"
    body = piece.removesuffix("</w>") if end else piece
    if not all(c in table for c in body):
        return None
    return "".join(chr(table[c]) for c in body) + (END if end else "")


def _rows(batches, path):
    automaton = from_byte_pieces(path)
    for batch in batches:
        for part in chunks(batch):
            words = Words(part.column("text"))
            codes, distinct = words.codes()
            counts = [automaton.count(w.decode("latin-1") + END) for w in pc.utf8_lower(distinct).cast(pa.binary()).to_pylist()]
            tokens = np.array([1 if c is None else c for c in counts], np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
            unknown = np.array([c is None for c in counts], np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
            at = words.bounds
            total, lost = np.append(0, np.cumsum(tokens)), np.append(0, np.cumsum(unknown))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(total[at[1:]] - total[at[:-1]]), pa.array(lost[at[1:]] - lost[at[:-1]])],
                ["doc_id", "n_words", "n_tokens", "n_unknown"],
            )


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_words, n_tokens, n_unknown)`` for every row of ``docs(doc_id, text)``.

    ``path`` is a vocabulary file with word-end marks, as installed on every node.
    """
    return docs.select("doc_id", "text").mapInArrow(functools.partial(_rows, path=path), "doc_id long, n_words long, n_tokens long, n_unknown long")
