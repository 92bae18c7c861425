"""Operator 9, byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that its encoding can end with. The
encoder stores that token for each prefix: of the tokens that end there, it is the one that may
follow the last token of the prefix before it, where two tokens may be neighbours if merging their
common bytes by rank would leave the border between them. Walking the stored tokens back gives the
encoding. Appending bytes only adds prefixes, and an edit leaves all prefixes before it as they are.

A text is cut into pieces by the vocabulary's pattern, and each piece is encoded on its own.

Defined results: null and empty texts give no ids; special tokens' strings are ordinary text; texts
of any length are encoded whole, in time that grows with their length; repeated ids stay repeated
rows, null ids stay null; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encoded words that a Python worker keeps, and neighbours it has tested; beyond it a store starts anew.
CACHED_WORDS = 300_000
CACHED_PAIRS = 1_000_000
#: Longer words are encoded each time they occur.
LONGEST_CACHED = 64
#: Where this is found, white space meets across a single space, so that words depend on each other.
MEETING_SPACE = re.compile(r"\s \s")


class Vocabulary:
    """Tokens by rank, with each token's last merge and the test of neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.sizes = list(map(len, self.tokens))
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.allowed: dict[int, bool] = {}
        for rank, token in enumerate(self.tokens):
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None and left < rank and right < rank and self._stay_apart(left, right):
                    self.parts[rank] = (left, right)
                    self.merged[left, right] = rank
                    break
        self.ending = ahocorasick.Automaton()  # finds all tokens that end at a byte; bytes are Latin-1 characters here
        for rank, token in enumerate(self.tokens):
            if token:
                self.ending.add_word(token.decode("latin-1"), (rank, len(token)))
        self.ending.make_automaton()

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        return cls({base64.b64decode(token): int(rank) for token, rank in pairs})

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before the merges that made the two tokens.
        The later made of the two is undone step by step, towards the border."""
        before = len(self.tokens)
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < before:
                return False
            inner_left, inner_right = self.parts.get(left), self.parts.get(right)
            undo_left = inner_left is not None and (inner_right is None or left > right)
            if undo_left:
                before, left = left, inner_left[1]
            elif inner_right is not None:
                before, right = right + 1, inner_right[0]
            else:
                return True

    def test(self, left: int, right: int) -> bool:
        if len(self.allowed) >= CACHED_PAIRS:
            self.allowed.clear()
        known = self.allowed[left << 32 | right] = self._stay_apart(left, right)
        return known


class PrefixEncoding:
    """The last token of every prefix of a piece of bytes."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece = vocabulary, bytearray()
        self.last: list[int] = []
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Exact: earlier prefixes keep their tokens."""
        first = len(self.piece)
        self.piece += more
        last, v = self.last, self.vocabulary
        allowed, test, push = v.allowed.get, v.test, last.append
        base = max(0, first + 1 - v.longest)
        need = first - base  # the first byte whose prefix has no token yet
        for end, (token, size) in v.ending.iter(bytes(self.piece[base:]).decode("latin-1")):
            if end == need:
                before = base + end - size
                if before < 0:
                    push(token)
                    need += 1
                else:
                    pair = last[before] << 32 | token
                    ok = allowed(pair)
                    if ok or (ok is None and test(last[before], token)):
                        push(token)
                        need += 1
        if len(last) < len(self.piece):
            raise ValueError("the vocabulary lacks a byte")

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace bytes ``start`` to ``end``; prefixes up to ``start`` are not computed again."""
        tail = bytes(self.piece[end:])
        del self.piece[start:], self.last[start:]
        self.append(new + tail)

    def ids(self) -> tuple[int, ...]:
        found, end, last, sizes = [], len(self.piece), self.last, self.vocabulary.sizes
        while end:
            token = last[end - 1]
            found.append(token)
            end -= sizes[token]
        found.reverse()
        return tuple(found)


class Encoder:
    """Encodes texts and edits of them."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.split = regex.compile(pattern).findall
        self.match = regex.compile(pattern).finditer
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        found = self.pieces.get(piece)
        if found is None:
            found = PrefixEncoding(self.vocabulary, piece.encode()).ids()
            if len(piece) <= LONGEST_CACHED:
                if len(self.pieces) >= CACHED_WORDS:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def _span_ids(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.piece_ids, self.split(text))))

    def encode(self, text: str) -> list[int]:
        """Words between single spaces take the space before them and are looked up as a whole:
        no piece crosses from a word into the space after it. Where white space meets across
        such a space, the pattern runs over the whole text instead."""
        if MEETING_SPACE.search(text):
            return list(self._span_ids(text))
        first, *rest = text.split(" ")
        words = self.words
        missing = set(rest).difference(words)
        if missing:
            if len(words) > CACHED_WORDS:
                missing = set(rest)
            self._learn(missing)
            words = self.words
        ids = list(self._span_ids(first))
        try:
            ids.extend(chain.from_iterable(map(words.__getitem__, rest)))
        except KeyError:  # a very long word
            ids = list(self._span_ids(text))
        return ids

    def _learn(self, missing: set[str]) -> None:
        """Two generations: when the young one is full it becomes the old one, and words that
        are met again come back from there."""
        if len(self.words) > CACHED_WORDS:
            self.old, self.words = self.words, {}
        old, words = self.old.get, self.words
        for word in missing:
            if len(word) <= LONGEST_CACHED:
                words[word] = old(word) or self._span_ids(f" {word}")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))

    def re_encode(self, text: str, spans: list[tuple[int, int, tuple[int, ...]]], start: int, end: int, new: str):
        """The new text and its pieces ``(start, end, ids)`` after ``text[start:end]`` became
        ``new``. A match looks at most two characters past its end, so pieces that end over two
        before the edit stay; matching goes on until a border meets an old one past the edit."""
        changed = text[:start] + new + text[end:]
        shift = len(new) - (end - start)
        kept = next((k for k, s in enumerate(spans) if s[1] >= start - 2), len(spans))
        found = spans[:kept]
        borders = {s[0] + shift: k for k, s in enumerate(spans) if s[0] >= end}
        for m in self.match(changed, found[-1][1] if found else 0):
            if m.start() in borders and m.start() >= start + len(new):
                rest = spans[borders[m.start()] :]
                return changed, found + [(a + shift, b + shift, ids) for a, b, ids in rest]
            found.append((m.start(), m.end(), self.piece_ids(m[0])))
        return changed, found

    def spans(self, text: str) -> list[tuple[int, int, tuple[int, ...]]]:
        return [(m.start(), m.end(), self.piece_ids(m[0])) for m in self.match(text)]


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(Vocabulary.load(path), pattern)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id, the token ids and the bytes they decode to. No shuffle."""
    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [enc.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([enc.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return chosen.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digest_documents(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Counts and digests of what ``encode_documents`` gives, made where the ids are."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern)
        decimal = enc.vocabulary.decimal.__getitem__
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = enc.encode(text or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return chosen.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
