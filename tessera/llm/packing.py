"""Operator 8, packing: sum-of-squares online placement.

Documents become token ids plus an end id. Whole windows are cut off first; what remains of a
document goes into an open window (or a new one) at the fill level for which the sum of the squared
counts of partially filled windows, over all levels, is least afterwards. The counts are one array
with an entry for each level, so a placement is one vectorised pass over it. Of equal levels the
fullest wins.

Each task packs its own input partition, with its own level array; nothing is shuffled. Small
partitions are read together, so that a task has some ``LEAST_DOCUMENTS``. When its input ends, the
windows still open are finished by the same rule: the emptiest is dissolved and its pieces are placed
in the others, cut where they fit in none, until one is left; that one is cut at powers of two,
lengths that need no padding. Sequence ids hold the partition's number above 33 bits, and so a task
that runs again after a lost executor gives the same rows. Open windows keep their ids in memory:
few windows of ``window`` ids.

Tokens are exact: words between white space do not depend on each other under the vocabulary's
pattern, so that encoded words are kept and looked up. Texts with unusual white space or control
characters go to the library as a whole.

Defined results: a null or empty text is the end id alone; texts of any length are cut, never
truncated; repeated rows and ids are packed as rows of their own; a null id stays null; other
columns are ignored; an empty input gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
END_ID = 1
#: Documents that a task should have at least, where there are so many.
LEAST_DOCUMENTS = 2500
#: Encoded words that a Python worker keeps, in two generations.
CACHED_WORDS = 700_000
LONGEST_CACHED = 64
#: White space beyond the plain four, or what only some libraries take for it.
ODD_SPACE = re.compile("[\x00\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")


class WordEncoder:
    """Whole texts to little-endian 32-bit ids, by way of the words between white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def lowered(text: str) -> str:
        """The vocabulary's own lower case, where it is sure to be Python's: one word less to know
        for every capital. Other texts are left to the library."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [None if ODD_SPACE.search(t) else self.lowered(t).split() for t in texts]
        self._learn(split)
        known = self.words
        found = []
        for text, words in zip(texts, split, strict=True):
            try:
                found.append(self.whole(text) if words is None else b"".join(map(known.__getitem__, words)))
            except KeyError:  # a very long word
                found.append(self.whole(text))
        return found

    def _learn(self, split: list[list[str] | None]) -> None:
        if len(self.words) > CACHED_WORDS:
            self.old, self.words = self.words, {}
        words, old = self.words, self.old
        missing: set[str] = set()
        for some in split:
            if some:
                missing.update(some)
        missing.difference_update(words)
        fresh = []
        for word in missing:
            if word in old:
                words[word] = old[word]
            elif len(word) <= LONGEST_CACHED:
                fresh.append(word)
        for encoding, word in zip(self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False), fresh, strict=True):
            words[word] = np.array(encoding.ids, "<u4").tobytes()


@cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class Packer:
    """Places one run of documents. ``rows`` gathers finished pieces."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        #: Counts of open windows by fill level; a full window counts as -0.5, which makes the
        #: change of the sum, halved and less 1, one subtraction for every level.
        self.count = np.zeros(window + 1)
        self.count[window] = -0.5
        self.open: list[list[list]] = [[] for _ in range(window)]  # by level, windows as lists of pieces
        self.rows: list[tuple] = []
        #: Ids placed on arrival (without whole windows), and those placed again at the end.
        self.placed = self.drained = 0

    def _close(self, pieces: list, length: int) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.sequence, offset, ids))
            offset += n
        assert offset == length
        self.sequence += 1

    def _level_for(self, size: int) -> tuple[int, float]:
        """The level of an open window, with room for ``size``, whose use leaves the least sum of
        squares, and that change, halved and less 1; level 0 if there is none."""
        here = self.count[1 : self.window - size + 1]
        change = np.where(here > 0, self.count[size + 1 :] - here, np.inf)
        if not len(change):
            return 0, np.inf
        at = len(change) - 1 - int(change[::-1].argmin())
        return (at + 1, float(change[at])) if change[at] < np.inf else (0, np.inf)

    def _put(self, level: int, piece: tuple) -> None:
        """Add a piece to a window of ``level`` (0: a new one)."""
        pieces, filled = [piece], level + len(piece[2]) // 4
        if level:
            pieces = self.open[level].pop()
            pieces.append(piece)
            self.count[level] -= 1
        if filled == self.window:
            self._close(pieces, filled)
        else:
            self.open[filled].append(pieces)
            self.count[filled] += 1

    def add(self, doc, ids: bytes) -> None:
        window, total, start = self.window, len(ids) // 4, 0
        while total - start >= window:
            self._close([(doc, start, ids[4 * start : 4 * (start + window)], total)], window)
            start += window
        size = total - start
        if size:
            level, change = self._level_for(size)
            self._put(level if change <= self.count[size] - 0.5 else 0, (doc, start, ids[4 * start :], total))
            self.placed += size

    def drain(self) -> None:
        """Windows still open are finished by the same rule: the emptiest is dissolved, and its
        pieces are placed in the others; one that fits in none is cut to fill the fullest. The last
        window is cut at powers of two."""
        while True:
            levels = np.flatnonzero(self.count[: self.window])
            if not len(levels):
                return
            least = int(levels[0])
            pieces = self.open[least].pop()
            self.count[least] -= 1
            self.drained += least
            if len(levels) == 1 and not self.count[least]:
                break
            for k, (doc, start, ids, total) in enumerate(pieces):
                while ids:
                    level, _ = self._level_for(len(ids) // 4)
                    room = len(ids) // 4
                    if not level:
                        fullest = np.flatnonzero(self.count[: self.window])
                        if not len(fullest):
                            break
                        level = int(fullest[-1])
                        room = self.window - level
                    self._put(level, (doc, start, ids[: 4 * room], total))
                    start, ids = start + room, ids[4 * room :]
                if ids:  # no window is left: the rest begins one
                    for rest in [(doc, start, ids, total), *pieces[k + 1 :]]:
                        level, _ = self._level_for(len(rest[2]) // 4)
                        self._put(level, rest)
                    break
        left = list(reversed(pieces))
        for length in [1 << b for b in reversed(range(self.window.bit_length())) if least >> b & 1]:
            taken, need = [], length
            while need:
                doc, start, ids, doc_tokens = left.pop()
                n = len(ids) // 4
                if n > need:
                    left.append((doc, start + need, ids[4 * need :], doc_tokens))
                    ids, n = ids[: 4 * need], need
                taken.append((doc, start, ids, doc_tokens))
                need -= n
            self._close(taken, length)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True) -> DataFrame:
    """A row for each piece: where it starts in its document, its length, checksum and place;
    with ``with_ids`` also its ids."""
    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    chosen = chosen.coalesce(max(1, docs.count() // LEAST_DOCUMENTS))  # joins input splits, without a shuffle
    end = np.array([end_id], "<u4").tobytes()

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 8
        arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in columns[7]], pa.list_(pa.int32())))
            names.append("ids")
        return pa.record_batch(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        packer = Packer(window, TaskContext.get().partitionId() << 33)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                encoded = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                for doc, ids in zip(part.column(0).to_pylist(), encoded, strict=True):
                    packer.add(doc, ids + end)
                yield table(packer.rows)
                packer.rows = []
        packer.drain()
        yield table(packer.rows)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return chosen.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
