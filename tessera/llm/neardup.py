"""Operator 7, n-gram Jaccard join by a MinHash LSH forest.

Documents are sets of shingles of five words (white-space words in lower case; shorter texts are one
shingle). Pairs whose sets have a Jaccard similarity of at least 0.8 are linked.

1. One pass gives each document a digest of its set, a parity sketch and a signature: the smallest
   shingle hash in each of ``TREES`` x ``DEPTH`` ranges of the hash space (an empty range takes the
   next one's). Documents with equal sets form a copy class, represented by the smallest id; all
   that follows is about representatives, and copies come back as members of their class.
2. Each tree of the forest is the sorted list of its labels, ``DEPTH`` parts of the signature. Only
   nodes of two or more at the least depth are kept; their members arrive sorted by label and pass
   in a stream that remembers the first member of the current node at every depth. A document is
   compared with the first of the longest prefix it matches, then of shorter and shorter prefixes,
   until one is similar by the signatures, or down to the depth at which a pair at the threshold meets
   in some tree with probability ``TARGET_RECALL``. So every document has one partner a tree at most,
   however large a node is. Nodes with more than one in ``HOT`` of all rows are dealt to several
   streams, otherwise in each tree.
3. The partners' connected components are groups. Whatever the forest has missed is found between
   groups: two linked sets share one of their first ``n - ceil(0.8 n) + 1`` shingles in any common order (a
   prefix filter): here by count in a sample of documents, then by hash, which only says how few
   candidates there are. A pair whose sketches differ in more bits than its sets could is dropped, and
   one of large sets whose signatures are far under the threshold (see ``near_enough``); for every
   other one its two groups become one.
4. Within a group all pairs are verified exactly, once, by products of incidence matrices: sets are made
   again for members of groups alone and sent once, unless a group is large; that is cut into tiles, every
   pair of tiles a task of its own. A tile gives each member its count of links and the smallest member
   it is connected with, never the pairs themselves.
5. Connected components: every node points to its smallest neighbour and edges are drawn between
   the parents until none is left; each round is a written table, deleted when the next is there.

Defined results: null and empty texts have the empty set, and are copies of each other; rows that
share an id are one document with the smallest text (null: empty); rows with a null id come back with
null class and 0 links and never meet others; texts of any length are read whole; an empty input
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, materialise, release

WORDS = 5
THRESHOLD = Fraction(4, 5)
TREES, DEPTH, TARGET_RECALL = 10, 6, 0.99
TILE_ROWS, TILE_SHINGLES = 512, 2_000_000
BITMAP_BITS = 1 << 26
SKETCH_BITS = 1024
#: Of sets from this size on, that many of the signature's 60 parts at least must be equal in a pair
#: that is verified between groups: 48 are expected at the threshold.
LARGE, FEWEST = 400, 27
#: Partners in the forest have at least this share of equal parts in their signatures, well under the
#: threshold; a node is hot with more than one in so many of all rows.
PARTNER, HOT = 0.6, 1024
#: Documents sampled for the order of shingles (and at most one of so many), and how many frequent
#: shingles are broadcast.
SAMPLE, SPARSE, FREQUENT, LEAST_COUNT = 16_000, 16, 500_000, 2
#: Members of the largest components that are broadcast, parts of the prefix filter, entries a task
#: holds before it hands them on, and pairs made at a time.
KNOWN_ROOTS, PARTS, HELD_ENTRIES, HELD_PAIRS = 1_000_000, 1024, 400_000, 1_000_000


def matched_depth(trees: int = TREES, depth: int = DEPTH, threshold: Fraction = THRESHOLD, target: float = TARGET_RECALL) -> int:
    """Prefixes are shortened until a pair at the threshold is found often enough."""
    for x in range(depth, 0, -1):
        if 1 - (1 - float(threshold) ** x) ** trees >= target:
            return x
    raise ValueError("too few trees for this recall")


_WORD_HASHES: dict[str, int] = {}


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = _WORD_HASHES
    if len(known) > 300_000:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = (total ^ hashes[k : len(words) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return np.unique(total)


@cache
def borders(parts: int) -> np.ndarray:
    """Where each of so many equal ranges of 64-bit hashes begins."""
    return np.array([(k << 64) // parts for k in range(parts)], np.uint64)


def signature(found: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> np.ndarray:
    """For every range the low half of its smallest hash, or of the next range's that has any; two
    sets have the same in about the share of their similarity."""
    at = np.searchsorted(found, borders(trees * depth))
    return found[at % len(found)].astype(np.uint32)


def digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def sketch(found: np.ndarray) -> bytes:
    """The parity of the shingles on each of SKETCH_BITS bits: two sketches differ in no more bits
    than their sets have shingles apart."""
    at = (found & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=SKETCH_BITS) & 1).tobytes()


def describe(docs: DataFrame, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """``doc_id``, ``key`` (digest of the set), ``size``, ``trees`` (the signature as bytes),
    ``sketch`` (with the low byte of each part of the signature after it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                keys, sizes, found, sketches = [], [], [], []
                for text in part.column(1).to_pylist():
                    own = shingles(text)
                    parts = signature(own, trees, depth) if len(own) else np.zeros(0, np.uint32)
                    keys.append(digest(own))
                    sizes.append(len(own))
                    sketches.append(sketch(own) + parts.astype(np.uint8).tobytes())
                    found.append(parts.tobytes() if len(own) else None)
                yield pa.record_batch([part.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "key", "size", "trees", "sketch"])

    return docs.mapInArrow(run, "doc_id long, key binary, size long, trees binary, sketch binary")


def with_sets(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """``rep``, ``shingles`` (bytes) of documents whose id may be wanted."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)
    bit = id_bit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            chosen = batch.take(pa.array(np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)))
            for first in range(0, chosen.num_rows, 512):
                part = chosen.slice(first, 512)
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "shingles"])

    return docs.select("doc_id", "text", bit.alias("bit")).mapInArrow(run, "rep long, shingles binary")


def id_bitmap(ids: DataFrame) -> np.ndarray:
    """Bits of hashed ids, BITMAP_BITS in all: made with the engine's own bitmap aggregate."""
    bit = id_bit("rep") + 1
    found = np.zeros(BITMAP_BITS // 8, np.uint8)
    size = 4096  # bytes of one bucket
    for row in ids.groupBy(F.bitmap_bucket_number(bit).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).toLocalIterator():
        found[(row["at"] - 1) * size : row["at"] * size] = np.frombuffer(row["bits"], np.uint8)
    return found


def frequent_shingles(docs: DataFrame, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles met often in a sample of documents (sorted) and their counts."""
    each = max(SPARSE if documents > SAMPLE else 1, documents // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                sets = [shingles(t) for t in batch.column(0).slice(first, 1024).to_pylist()]
                found, times = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(times, pa.int64())], ["shingle", "c"])

    counted = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(each)) == 0).select("text").mapInArrow(run, "shingle long, c long")
    often = materialise(counted.groupBy("shingle").agg(F.sum("c").alias("c")).where(F.col("c") >= LEAST_COUNT), "frequent")
    step = F.floor(F.log2("c") * 8)
    taken, least = 0, 1 << 30
    for at, n in sorted(((r["step"], r["n"]) for r in often.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True):
        taken += n
        if taken > FREQUENT:
            break
        least = at
    rows = often.where(step >= least).toArrow()  # FREQUENT rows at most
    release(often)
    found, times = rows.column("shingle").to_numpy().view(np.uint64), rows.column("c").to_numpy()
    order = np.argsort(found)
    return found[order], times[order]


def prefix(own: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set by (count in the sample, hash), so many that two sets at
    the threshold share one."""
    up, down = THRESHOLD.numerator, THRESHOLD.denominator
    n = len(own) + (-up * len(own)) // down + 1 if len(own) else 0
    if not len(frequent):
        return own[:n]
    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
    times = np.where(frequent[at] == own, counts[at], 0)
    rare = own[times == 0]
    if len(rare) >= n:
        return rare[:n]
    return own[np.lexsort((own, times))[:n]]


def prefix_entries(docs: DataFrame, reps: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Prefixes of documents that may be representatives, packed by ``part`` of the hash: columns
    ``low`` (32 bits of the hash), ``ids`` and ``sizes`` as bytes."""
    held = docs.sparkSession.sparkContext.broadcast((reps, *frequent))
    bit = id_bit()

    def packed(found: list[np.ndarray], ids: list[int], sizes: list[int]) -> pa.RecordBatch:
        flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
        times = [len(f) for f in found]
        part = (flat & np.uint64(PARTS - 1)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        low = (flat >> np.uint64(10)).astype(np.uint32)[order]
        owner = np.repeat(np.array(ids, np.int64), times)[order]
        size = np.repeat(np.array(sizes, np.uint32), times)[order]
        parts, first = np.unique(part[order], return_index=True)
        ends = [*first[1:], len(flat)]
        columns = [pa.array([values[a:b].tobytes() for a, b in zip(first, ends, strict=True)] if len(parts) else [], pa.binary()) for values in (low, owner, size)]
        return pa.record_batch([pa.array(parts, pa.int32()), *columns], ["part", "low", "ids", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known, counts = held.value
        found, ids, sizes, entries = [], [], [], 0
        for batch in batches:
            at = batch.column(2).to_numpy()
            chosen = batch.take(pa.array(np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)))
            for first in range(0, chosen.num_rows, 512):
                part = chosen.slice(first, 512)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own = shingles(text)
                    found.append(prefix(own, known, counts))
                    ids.append(doc_id)
                    sizes.append(len(own))
                    entries += len(found[-1])
                if entries > HELD_ENTRIES:
                    yield packed(found, ids, sizes)
                    found, ids, sizes, entries = [], [], [], 0
        yield packed(found, ids, sizes)

    return docs.select("doc_id", "text", bit.alias("bit")).mapInArrow(run, "part int, low binary, ids binary, sizes binary")


def candidate_pairs(low: np.ndarray, ids: np.ndarray, sizes: np.ndarray, roots: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs (smaller id first) of one part that share a shingle, are of near enough sizes and of
    different roots, as far as these are known."""
    up, down = THRESHOLD.numerator, THRESHOLD.denominator
    order = np.lexsort((roots, low))
    low, ids, sizes, roots = low[order], ids[order], sizes[order].astype(np.int64), roots[order]
    begin = np.flatnonzero(np.r_[True, low[1:] != low[:-1]]) if len(low) else np.zeros(0, np.int64)
    end = np.r_[begin[1:], len(low)] if len(low) else begin
    keep = np.repeat(roots[begin] != roots[end - 1], end - begin)  # else of one component alone
    low, ids, sizes, roots = low[keep], ids[keep], sizes[keep], roots[keep]
    # The entries that follow those of the same root: pairs within a component aren't made.
    border = np.flatnonzero(np.r_[(low[1:] != low[:-1]) | (roots[1:] != roots[:-1]), True]) if len(low) else np.zeros(0, np.int64)
    after = border[np.searchsorted(border, np.arange(len(low)))] + 1
    until = np.searchsorted(low, low, side="right")
    times = until - after
    total = np.cumsum(times)
    at = 0
    while at < len(low):
        last = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + HELD_PAIRS, side="right")))
        own = times[at:last]
        a = np.repeat(np.arange(at, last), own)
        b = np.arange(len(a)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(after[at:last], own)
        near = (down * np.minimum(sizes[a], sizes[b]) >= up * np.maximum(sizes[a], sizes[b])) & (ids[a] != ids[b])
        a, b = ids[a[near]], ids[b[near]]
        if len(a):
            yield np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        at = last


def pairs_of(entries: DataFrame, members: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``a``, ``b``: candidates of all parts."""
    held = entries.sparkSession.sparkContext.broadcast(members)
    ready = entries.repartition("part").sortWithinPartitions("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, root = held.value
        rows: list[dict] = []

        def flush() -> Iterator[pa.RecordBatch]:
            low, ids, sizes = (np.frombuffer(b"".join(r[c] for r in rows), t) for c, t in (("low", np.uint32), ("ids", np.int64), ("sizes", np.uint32)))
            roots = ids
            if len(known):
                at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
                roots = np.where(known[at] == ids, root[at], ids)
            for found in candidate_pairs(low, ids, sizes, roots):
                yield pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])
            rows.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if rows and rows[0]["part"] != row["part"]:
                    yield from flush()
                rows.append(row)
        yield from flush()

    return ready.mapInArrow(run, "a long, b long").distinct()


def near_enough(pairs: DataFrame) -> DataFrame:
    """``a``, ``b``: the groups of the pairs, without those that cannot be linked: whose sketches differ
    in more bits than linked sets of their sizes could, |A ^ B| = (1 - J) / (1 + J) (|A| + |B|), and, of
    large sets, for which the sketch is too short, those with fewer than ``FEWEST`` equal parts in their
    signatures (a linked pair has so few with a probability under 1e-8)."""
    up, down = THRESHOLD.numerator, THRESHOLD.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy()
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch_b"))
            bits = SKETCH_BITS // 8
            apart = np.bitwise_count(x[:, :bits] ^ y[:, :bits]).sum(1, dtype=np.int64)
            equal = (x[:, bits:] == y[:, bits:]).sum(1)
            near = (apart * (down + up) <= (down - up) * (a + b)) & ((np.minimum(a, b) < LARGE) | (equal >= FEWEST))
            yield batch.select(["root_a", "root_b"]).filter(pa.array(near)).rename_columns(["a", "b"])

    chosen = pairs.select(F.least("root_a", "root_b").alias("root_a"), F.greatest("root_a", "root_b").alias("root_b"), "size_a", "size_b", "sketch_a", "sketch_b")
    return chosen.mapInArrow(run, "a long, b long")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of a tile's sets, by products of incidence matrices over
    those shingles that two sets or more share."""
    n = len(sets)
    if n == 2:
        return np.array([[0, (m := len(np.intersect1d(*sets, assume_unique=True)))], [m, 0]])
    flat = np.concatenate(sets)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    columns = np.cumsum(shared) - 1
    keep = shared[at]
    rows, columns = rows[keep], columns[at[keep]]
    by_column = np.argsort(columns, kind="stable")
    rows, columns = rows[by_column], columns[by_column]
    total = np.zeros((n, n), np.float32)
    step = max(64, (1 << 22) // n)
    edges = np.searchsorted(columns, np.arange(0, (columns[-1] if len(columns) else 0) + step, step))
    for k, (a, b) in enumerate(zip(edges, [*edges[1:], len(columns)], strict=True)):
        if b > a:
            part = np.zeros((n, step), np.float32)
            part[rows[a:b], columns[a:b] - k * step] = 1
            total += part @ part.T
    return np.rint(total).astype(np.int64)


def linked(members: list[dict], same_tile: bool, threshold: Fraction = THRESHOLD) -> list[tuple[int, int, int]]:
    """For members with links in this tile: representative, linked documents, smallest connected
    member. ``side`` 0 and 1 are the two tiles; pairs within one belong to its own tile."""
    sets = [np.frombuffer(m["shingles"], np.uint64) for m in members]
    sizes = np.array([len(s) for s in sets])
    common = common_counts(sets)
    up, down = threshold.numerator, threshold.denominator
    # common / (a + b - common) >= up / down
    near = (down + up) * common >= up * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(near, False)
    if not same_tile:
        side = np.array([m["side"] for m in members])
        near &= side[:, None] != side[None, :]
    if not near.any():
        return []
    weights = np.array([m["copies"] for m in members])
    ids = np.array([m["rep"] for m in members])
    links = near @ weights
    root = ids.copy()
    while True:
        least = np.where(near, root[None, :], np.iinfo(np.int64).max).min(1)
        new = np.minimum(root, least)
        if (new == root).all():
            break
        root = new
    return [(int(i), int(w), int(r)) for i, w, r in zip(ids, links, root, strict=True) if w]


class Descent:
    """The sorted labels of one stream, row by row."""

    def __init__(self, least: int, depth: int = DEPTH):
        self.least, self.depth = least, depth
        self.at: tuple | None = None
        self.label = np.zeros(depth, np.uint32)
        self.first: list[tuple[int, np.ndarray]] = [(0, np.zeros(0, np.uint32))] * (depth + 1)

    def partner(self, at: tuple, rep: int, label: np.ndarray, parts: np.ndarray) -> int | None:
        """``at``: the tree and node; ``parts``: the whole signature."""
        apart = np.flatnonzero(label != self.label)
        common = int(apart[0]) if len(apart) else self.depth
        if at != self.at or common < self.least:
            common = self.least - 1
        found = None
        for depth in range(common, self.least - 1, -1):
            other, theirs = self.first[depth]
            if other != rep and np.count_nonzero(theirs == parts) >= PARTNER * len(parts):
                found = other
                break
        for depth in range(common + 1, self.depth + 1):
            self.first[depth] = rep, parts
        self.at, self.label = at, label
        return found


def partners(members: DataFrame, least: int) -> DataFrame:
    """``a``, ``b``: of ``tree``, ``node``, ``stream``, ``label``, ``rep``, ``trees`` those who meet."""
    group = ["tree", "node", "stream"]
    ready = members.repartition(*group).sortWithinPartitions(*group, "label", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Descent(least)
        for batch in batches:
            a, b = [], []
            for tree, node, stream, label, rep, parts in zip(*(batch.column(c).to_pylist() for c in (*group, "label", "rep", "trees")), strict=True):
                found = walk.partner((tree, node, stream), rep, np.frombuffer(label, np.uint32), np.frombuffer(parts, np.uint32))
                if found is not None:
                    a.append(min(found, rep))
                    b.append(max(found, rep))
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return ready.mapInArrow(run, "a long, b long").distinct()


def forest(classes: DataFrame, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """``a``, ``b``: representatives that are similar by their signatures and meet in some tree."""
    least, width = matched_depth(trees, depth), 4 * depth
    label = lambda k: F.substring("trees", k * width + 1, F.lit(width))
    node = lambda k: F.xxhash64(F.substring("trees", k * width + 1, F.lit(4 * least)))
    nodes = classes.where("size > 0").select("rep", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), node)).alias("tree", "node"))
    crowded = materialise(nodes.groupBy("tree", "node").agg(F.count("*").alias("n")).where("n > 1"), "nodes")
    rows = crowded.agg(F.sum("n")).first()[0] or 0
    # Nodes with more than one in HOT of these rows are fewer than HOT.
    share = rows // HOT + 1
    streams = F.ceil(F.col("n") / share).cast("int")
    hot = crowded.where(F.col("n") > share).select("tree", "node", streams.alias("streams"))
    members = nodes.join(crowded.select("tree", "node"), ["tree", "node"], "left_semi").join(F.broadcast(hot), ["tree", "node"], "left")
    dealt = F.coalesce(F.pmod(F.xxhash64("rep", "tree"), F.col("streams")), F.lit(0)).cast("int")
    members = members.select("tree", "node", "rep", dealt.alias("stream")).join(classes.select("rep", "trees"), "rep")
    return partners(members.withColumn("label", label(F.col("tree"))), least)


def verify(tiles: DataFrame) -> DataFrame:
    """``rep``, ``links``, ``root`` for the rows of each pair of tiles."""
    group = ["node", "low", "high"]
    ready = tiles.repartition(*group).sortWithinPartitions(*group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        at = None

        def flush(rows: list[tuple[int, int, int]]) -> None:
            if len(held) > 1:
                rows.extend(linked(held, at[1] == at[2]))
            held.clear()

        def table(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["rep", "links", "root"])

        for batch in batches:
            rows: list[tuple[int, int, int]] = []
            for first in range(0, batch.num_rows, 256):
                for row in batch.slice(first, 256).to_pylist():
                    key = (row["node"], row["low"], row["high"])
                    if key != at:
                        flush(rows)
                        at = key
                    held.append(row)
            yield table(rows)
        rows = []
        flush(rows)
        yield table(rows)

    return ready.mapInArrow(run, "rep long, links long, root long")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node connected) for all nodes of ``edges`` (``a``, ``b``)."""
    edges = materialise(edges.where("a <> b").select("a", "b").distinct(), "edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root"))
        parent = materialise(parent, "parents")
        steps.append(parent)
        up = edges.join(parent, edges["a"] == parent["node"]).select(F.col("root").alias("a"), "b")
        up = up.join(parent, up["b"] == parent["node"]).select("a", F.col("root").alias("b")).where("a <> b").distinct()
        up = materialise(up, "edges")
        release(edges)
        edges = up
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = steps[0]
    for parent in steps[1:]:
        next_ = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
        found = found.join(next_, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    found = materialise(found, "roots")
    release(edges, *steps)
    return found


def tiles_of(n: str, shingles: str) -> Column:
    return F.greatest(F.ceil(F.col(n) / TILE_ROWS), F.ceil(F.col(shingles) / TILE_SHINGLES)).cast("int").alias("tiles")


def verify_groups(known: DataFrame, reps: DataFrame) -> DataFrame:
    """Links within the groups (``root``) of ``reps``: ``rep``, ``links``, ``root``."""
    # Written, so that a large group's rows are not bound to the task that counted them.
    groups = reps.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).where("n > 1")
    groups = materialise(groups.select("root", tiles_of("n", "shingles")), "groups")
    members = materialise(reps.join(groups, "root").select(F.col("root").alias("node"), "rep", "copies", "tiles"), "members")
    sets = with_sets(known, id_bitmap(members.select("rep")))
    own = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("node", "rep", "copies", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    found = materialise(verify(dealt.join(sets, "rep")), "links")
    release(members)
    return found


def edges_of(verified: DataFrame) -> DataFrame:
    return verified.select(F.col("rep").alias("a"), F.col("root").alias("b"))


def pairs_between(known: DataFrame, documents: int, reps: DataFrame) -> DataFrame:
    """``a``, ``b``: the groups (``root``) that may have links between them, every one that has."""
    groups = materialise(reps.groupBy("root").agg(F.count("*").alias("n")).where("n > 1"), "groups")
    large = reps.select("rep", "root").join(groups, "root")
    sizes = {r["step"]: r["m"] for r in large.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("m")).collect()}
    taken, least = 0, 1 << 30
    for step in sorted(sizes, reverse=True):
        taken += sizes[step]
        if taken > KNOWN_ROOTS:
            break
        least = step
    large = large.where(F.floor(F.log2("n") * 8) >= least).select("rep", "root").toArrow()  # KNOWN_ROOTS rows at most
    ids, root = large.column("rep").to_numpy(), large.column("root").to_numpy()
    order = np.argsort(ids)
    entries = prefix_entries(known, id_bitmap(reps.select("rep")), frequent_shingles(known, documents))
    pairs = materialise(pairs_of(entries, (ids[order], root[order])), "candidates")
    for side in "ab":
        pairs = pairs.join(reps.select(F.col("rep").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("root", "size", "sketch"))), side)
    return near_enough(pairs.where("root_a <> root_b")).distinct()


def id_bit(column: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BITMAP_BITS))


def one_per_id(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` (no null ids) as the rows whose id may be repeated and all others; none where no id
    is. Only ids are shuffled to see that."""
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("rep"))
    bits = id_bitmap(repeated)
    if not bits.any():
        return docs, None
    held = docs.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def marked(at: pd.Series) -> pd.Series:
        places = at.to_numpy()
        return pd.Series((held.value[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool))

    is_marked = marked(id_bit())
    return docs.where(~is_marked), docs.where(is_marked)


def join_documents(docs: DataFrame) -> DataFrame:
    """One row a document: ``doc_id``, ``copy_id`` (smallest id with an equal set), ``class_id``
    (smallest id of its connected component), ``n_links`` (other documents it is linked with)."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known, repeated = one_per_id(chosen.where("doc_id IS NOT NULL"))
    if repeated is not None:
        known = known.union(materialise(repeated.groupBy("doc_id").agg(F.min("text").alias("text")), "repeated"))
    described = materialise(describe(known), "sets")
    documents = described.count()
    classes = described.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *(F.min(c).alias(c) for c in ("size", "trees", "sketch")))
    classes = materialise(classes, "classes")

    groups = components(forest(classes)).withColumnRenamed("node", "rep")
    reps = classes.where("size > 0").join(groups, "rep", "left").select("rep", F.coalesce("root", "rep").alias("root"), "copies", "size", "sketch")
    reps = materialise(reps, "representatives")
    wider = components(pairs_between(known, documents, reps)).select(F.col("node").alias("root"), F.col("root").alias("wide"))
    verified = verify_groups(known, reps.join(wider, "root", "left").withColumn("root", F.coalesce("wide", "root")))
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(edges_of(verified))
    per_class = classes.select("key", "rep", "copies").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = materialise(per_class.select("key", "rep", F.coalesce("root", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "class-links")
    found = described.select("doc_id", "key").join(per_class, "key").select("doc_id", F.col("rep").alias("copy_id"), "class_id", "n_links")
    nulls = chosen.where("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("copy_id"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return found.union(nulls)


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component the document with the smallest id, with all columns; of rows that share an
    id the one with the smallest text; rows with null ids stay."""
    (gone,) = fresh(docs, "gone")
    away = join_documents(docs).where("class_id <> doc_id").select(F.col("doc_id").alias(gone))
    single, repeated = one_per_id(docs.where("doc_id IS NOT NULL"))
    rows = docs.where("doc_id IS NULL").union(single)
    if repeated is not None:
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        one = repeated.groupBy("doc_id").agg(F.min_by(row, F.coalesce("text", F.lit(""))).alias("row"))
        rows = rows.union(one.select(*(F.col("row").getField(c).alias(c) for c in docs.columns)))
    return rows.join(away, F.col("doc_id").cast("long") == F.col(gone), "left_anti")
