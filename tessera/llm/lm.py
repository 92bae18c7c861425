"""Operator 10, LM scoring with a gated recurrent model (see ``gru``) over the whole corpus.

Tokens are the words of a text, split at ASCII white space with A-Z in lower case, and one end.

1. Words of all documents are counted, in training documents and in all of them (combined in the
   tasks, then by one shuffle), into a written table, which grows with the corpus. One aggregation
   by steps of the count says from which count on there are at most ``HEAD`` words; these alone are
   read by the driver and broadcast.
2. The model's symbols are the end, the ``WORDS`` most frequent words of the training documents and
   ``TAIL`` classes of all other words, by the hash of their last two bytes. A tail word's
   probability is that of its class times ``(c + 0.5) / (N + 0.5 (V + 1))`` over the class's own
   counts, so that the model gives every text a probability, unseen words included.
3. Training goes over all training documents once, at every size alike, in rounds that take
   ``SHARES`` parts of them by a hash: each task trains on its part from common weights, and the
   results are averaged by their tokens, piece by piece in a shuffle. So the weights depend on how
   the input is partitioned; nothing of the texts goes to the driver.
4. One pass scores all documents. Words beyond the broadcast ones leave the tasks with their row and
   meet the written counts in a join; such a word has few tokens in all documents together, fewer
   than any broadcast one, and so is never a hot key.

Defined results: null and empty texts are one end; long texts are read whole, the state carried
through; rows are scored one by one, equal or not; a null id counts as the empty text when folds are
dealt; without training documents all counts are 0 and the model's symbols equally likely by class;
words of equal count come to the broadcast together or not at all; an empty input gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import gru
from tessera.llm.common import held_out, materialise

WORDS, TAIL, HEAD = 4096, 64, 200_000
#: Parts of the training documents, by round, and the learning rate of each round.
SHARES, RATES = (1, 3, 4), (gru.RATE, gru.RATE, gru.RATE / 2)
FOLD = 1
#: Distinct words a counting task holds before it hands them on; symbols that lie in lanes at once;
#: rows whose words are taken apart at a time; rows of an output batch.
HELD_WORDS, HELD_SYMBOLS, ROWS, MANY = 600_000, 1_500_000, 768, 100_000
PIECE, SPREAD = 8192, 16
#: Steps of the count in an octave; counts up to 64 have steps of their own.
STEPS = 64


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def all_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``words_of`` for a column: the words of all texts, and how many each has."""
    # A copy of its own: these functions get slices of other arrays wrong.
    own = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()).fill_null("")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(own))
    words, lengths = lists.flatten(), pc.list_value_length(lists).to_numpy()
    there = pc.binary_length(words).to_numpy() > 0  # white space at an end leaves an empty piece
    if not there.all():
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[there], minlength=len(lengths))
        words = words.filter(pa.array(there))
    return words, lengths.astype(np.int64)


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL


@cache
def tail_table() -> np.ndarray:
    """Classes by the last two bytes, then by the only byte."""
    pairs = [tail_class(bytes([a, b])) for a in range(256) for b in range(256)]
    return np.array(pairs + [tail_class(bytes([a])) for a in range(256)], np.int32)


def tail_classes(words: pa.Array) -> np.ndarray:
    """``tail_class`` of each word of a large string array."""
    if not len(words):
        return np.zeros(0, np.int32)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64, len(words) + 1, 8 * words.offset)
    data = np.frombuffer(data, np.uint8)
    last, before = data[ends[1:] - 1].astype(np.int64), data[np.maximum(ends[1:] - 2, 0)].astype(np.int64)
    return tail_table()[np.where(np.diff(ends) > 1, before * 256 + last, 65_536 + last)]


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def summed(counts: list[pa.Table]) -> pa.Table:
    """``word``, ``c``, ``t``: one row a word. Words are coded and their counts added by code, which
    costs a fraction of grouping by strings; sums stay far under what doubles hold exactly."""
    both = pa.concat_tables(counts).combine_chunks()
    coded = pa.concat_arrays(both["word"].chunks).dictionary_encode()
    at, n = coded.indices.to_numpy(), len(coded.dictionary)
    sums = [pa.array(np.bincount(at, both[k].to_numpy(), n).astype(np.int64)) for k in ("c", "t")]
    return pa.table([coded.dictionary, *sums], ["word", "c", "t"])


def count_words(docs: DataFrame) -> DataFrame:
    """``word`` (bytes), ``c`` (in training documents), ``t`` (in all) of ``text``, ``held_out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["word", "c", "t"]
        held: list[pa.Table] = []
        rows = merged = 0

        for batch in sliced(batches):
            words, lengths = all_words(batch.column(0))
            out = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), lengths)
            for training in (True, False):
                found = pc.value_counts(words.filter(pa.array(out != training)))
                n = found.field("counts")
                held.append(pa.table([found.field("values").cast(pa.large_binary()), n if training else pa.array(np.zeros(len(n), np.int64)), n], names))
                rows += len(n)
            if rows > 2 * merged + HELD_WORDS // 4:
                held[:] = [summed(held)]
                rows = merged = held[0].num_rows
                if merged > HELD_WORDS:
                    yield from held.pop().cast(schema).to_batches(max_chunksize=MANY)
                    rows = merged = 0
        if held:
            yield from summed(held).cast(schema).to_batches(max_chunksize=MANY)

    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("t", pa.int64())])
    counted = docs.select("text", "held_out").mapInArrow(run, "word binary, c long, t long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))


def step_of() -> Column:
    return F.floor(F.log2("t") * STEPS).cast("int")


class Symbols:
    """The model's symbols and what is known of the corpus; all of bounded size."""

    def __init__(self, head: list[tuple[bytes, int]], documents: int, tails: dict[int, tuple[int, int]]):
        """``head``: frequent words with their counts in training documents, at most ``HEAD``;
        ``tails``: of each tail class the training tokens and distinct words, symbols included."""
        head = sorted(head, key=lambda x: (-x[1], x[0]))
        tails = {k: list(tails.get(k, (0, 0))) for k in range(TAIL)}
        self.documents = documents
        self.tokens = sum(n for n, _ in tails.values()) + documents
        self.distinct = sum(v for _, v in tails.values()) + (documents > 0)
        chosen = [(w, c) for w, c in head[:WORDS] if c > 0]
        for word, c in chosen:
            own = tails[tail_class(word)]
            own[0] -= c
            own[1] -= 1
        items: list[tuple[int, object]] = [(documents, None)] + [(c, w) for w, c in chosen] + [(tails[k][0], k) for k in range(TAIL)]
        order = sorted(range(len(items)), key=lambda k: (-items[k][0], k))
        self.frequencies = np.array([items[k][0] for k in order], float)
        place = {items[k][1]: at for at, k in enumerate(order)}
        self.end = place[None]
        self.tail_ids = np.array([place[k] for k in range(TAIL)], np.int32)
        self.base_log = math.log10(self.tokens + 0.5 * (self.distinct + 1))
        #: By symbol: what a word of this tail class divides by; 0 for words that are symbols.
        self.symbol_logs = np.zeros(len(items))
        self.symbol_logs[self.tail_ids] = [math.log10(n + 0.5 * (v + 1)) for n, v in tails.values()]
        # By place in the head, and one more entry for all other words.
        self.words = [w.decode() for w, _ in head]
        counts = np.array([c for _, c in head] + [0], np.float64)
        self.logs = np.log10(counts + 0.5)
        self.logs[-1] = 0  # those are looked up in the whole table
        self.met = (counts > 0).astype(np.float64)
        self.symbol = np.array([place.get(w, -1) for w, _ in head] + [-1], np.int32)
        self.in_tail = self.symbol < 0
        self.tail_logs = np.where(self.in_tail, self.logs, 0.0)
        self.symbol[:-1][self.in_tail[:-1]] = [self.tail_ids[tail_class(w)] for (w, _), s in zip(head, self.symbol, strict=False) if s < 0]

    def take_apart(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """How many words each text has, every word's place in the head (the one past it if it has
        none) and its symbol; which words have no place, and these words."""
        words, lengths = all_words(texts)
        found = pc.index_in(words, value_set=pa.array(self.words, pa.large_string()))
        at = found.fill_null(len(self.words)).to_numpy()
        symbols = self.symbol[at]
        rare = np.flatnonzero(at == len(self.words))
        without = words.take(pa.array(rare))
        symbols[rare] = self.tail_ids[tail_classes(without)]
        return lengths, at, symbols, rare, without

    def with_ends(self, lengths: np.ndarray, symbols: np.ndarray) -> list[np.ndarray]:
        """Every text's symbols and the end."""
        ends = np.cumsum(lengths + 1) - 1
        found = np.full(len(symbols) + len(lengths), self.end, np.int32)
        there = np.ones(len(found), bool)
        there[ends] = False
        found[there] = symbols
        return np.split(found, ends[:-1] + 1) if len(lengths) else []

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        lengths, _, symbols, _, _ = self.take_apart(texts)
        return self.with_ends(lengths, symbols)


def gather_symbols(counts: DataFrame, documents: int) -> tuple[Symbols, int]:
    """Also the least step of the count that is in the head."""
    by = counts.groupBy(step_of().alias("step"), F.pmod(F.crc32(F.substring("word", -2, 2)), F.lit(TAIL)).cast("int").alias("tail"))
    # Some thousand rows at most: steps of a 64-bit count, by tail class.
    rows = by.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v"), F.count("*").alias("words")).collect()
    tails: dict[int, list[int]] = {}
    words: Counter = Counter()
    for r in rows:
        own = tails.setdefault(r["tail"], [0, 0])
        own[0] += r["n"]
        own[1] += r["v"]
        words[r["step"]] += r["words"]
    least, taken = 1 << 30, 0
    for step in sorted(words, reverse=True):
        taken += words[step]
        if taken > HEAD:
            break
        least = step
    head = counts.where(step_of() >= least).select("word", "c").toArrow()  # HEAD rows at most
    return Symbols(list(zip(head["word"].to_pylist(), head["c"].to_pylist(), strict=True)), documents, {k: (n, v) for k, (n, v) in tails.items()}), least


def train_round(docs: DataFrame, symbols, weights: dict[str, np.ndarray], edges: np.ndarray, rate: float) -> dict[str, np.ndarray]:
    """Weights after every task has trained on its part of ``docs``, averaged by tokens."""
    held = docs.sparkSession.sparkContext.broadcast((weights, edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, borders = held.value
        model = gru.Model(p, borders)
        seen = 0
        for texts in grouped(batches):
            seen += sum(map(len, texts))
            model.train(texts, rate)
        if seen:
            pieces = [model.values[a : a + PIECE] for a in range(0, len(model.values), PIECE)]
            salt = TaskContext.get().partitionId() % SPREAD
            yield table([(k, salt, seen, v) for k, v in enumerate(pieces)])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        texts: list[np.ndarray] = []
        size = 0
        for batch in sliced(batches):
            found = symbols.value.encode(batch.column(0))
            texts += found
            size += sum(map(len, found))
            if size > HELD_SYMBOLS:
                yield texts
                texts, size = [], 0
        if texts:
            yield texts

    def table(rows: list[tuple]) -> pa.RecordBatch:
        piece, salt, seen, values = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.record_batch([pa.array(piece, pa.int32()), pa.array(salt, pa.int32()), pa.array(seen, pa.int64()), pa.array([v.astype(np.float32).tobytes() for v in values], pa.binary())], ["piece", "salt", "seen", "mean"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                values = np.frombuffer(row["mean"], np.float32)
                known = sums.setdefault(row["piece"], [0, np.zeros(len(values))])
                known[0] += row["seen"]
                known[1] += values * float(row["seen"])
        yield table([(k, 0, seen, total / seen) for k, (seen, total) in sums.items()])

    schema = "piece int, salt int, seen long, mean binary"
    parts = docs.select("text").mapInArrow(run, schema).repartition("piece", "salt").mapInArrow(add, schema)
    pieces = {r["piece"]: np.frombuffer(r["mean"], np.float32) for r in parts.repartition("piece").mapInArrow(add, schema).collect()}  # one set of weights
    if not pieces:
        return weights
    return gru.shaped(np.concatenate([pieces[k] for k in sorted(pieces)]), weights)


def learn(docs: DataFrame, symbols: Symbols) -> gru.Model:
    edges = gru.class_edges(symbols.frequencies)
    weights = gru.initial(symbols.frequencies, edges)
    if symbols.documents:
        shared = docs.sparkSession.sparkContext.broadcast(symbols)
        dealt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(sum(SHARES)))
        at = 0
        for share, rate in zip(SHARES, RATES, strict=True):
            weights = train_round(docs.where((dealt >= at) & (dealt < at + share)), shared, weights, edges, rate)
            at += share
    return gru.Model(weights, edges)


def score_documents(docs: DataFrame, fold: int = FOLD) -> DataFrame:
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out("doc_id", fold).alias("held_out"))
    training = chosen.where(~F.col("held_out"))
    counts = materialise(count_words(chosen), "word-counts")
    symbols, least = gather_symbols(counts, training.count())
    model = learn(training, symbols)
    held = docs.sparkSession.sparkContext.broadcast((symbols, model.p, model.edges))
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, words array<binary>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, p, edges = held.value
        scorer = gru.Model(p, edges)
        row = TaskContext.get().partitionId() << 33
        parts: list[pa.RecordBatch] = []
        texts: list[np.ndarray] = []
        size = 0

        def table() -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks()
            score = whole["score"].to_numpy() + scorer.scores(texts) / math.log(10)
            done = whole.set_column(whole.schema.get_field_index("score"), "score", pa.array(score)).to_batches()[0]
            parts.clear()
            texts.clear()
            return done

        for batch in sliced(batches):
            found, own = take_apart(known, batch, row)
            parts.append(found)
            texts += own
            row += batch.num_rows
            size += sum(map(len, own))
            if size > HELD_SYMBOLS:
                yield table()
                size = 0
        if parts:
            yield table()

    def take_apart(known: Symbols, batch: pa.RecordBatch, row: int) -> tuple[pa.RecordBatch, list[np.ndarray]]:
        """The rows without the model's part of their score, and the symbols of their texts."""
        n = batch.num_rows
        lengths, at, symbols, rare, without = known.take_apart(batch.column(1))
        owner = np.repeat(np.arange(n), lengths)
        sums = lambda values: np.bincount(owner, values, n)
        base = sums(known.logs[at]) + math.log10(known.documents + 0.5) - (lengths + 1) * known.base_log
        score = sums(known.tail_logs[at] - known.symbol_logs[symbols])
        n_known = sums(known.met[at]).astype(np.int64) + (known.documents > 0)
        coded = without.dictionary_encode()
        pairs, times = np.unique(owner[rare] * (len(coded.dictionary) + 1) + coded.indices.to_numpy(), return_counts=True)
        whose, which = np.divmod(pairs, len(coded.dictionary) + 1)
        offsets = np.searchsorted(whose, np.arange(n + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), values) for values in (coded.dictionary.take(pa.array(which)).cast(pa.binary()), pa.array(times.astype(np.int32)))]
        columns = [pa.array(np.arange(row, row + n)), batch.column(0), batch.column(2), pa.array(lengths + 1), pa.array(n_known), pa.array(base), pa.array(score), *lists]
        return pa.record_batch(columns, [c.split()[0] for c in schema.split(", ")]), known.with_ends(lengths, symbols)

    scored = materialise(chosen.select("doc_id", "text", "held_out").mapInArrow(run, schema), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("n"))
    # What a tail word divides by, and every token's share of the base, is in the scores already.
    met = rare.join(counts.where(step_of() < least).select("word", "c").hint("shuffle_hash"), "word", "left")
    value = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    rest = met.groupBy("row").agg(F.sum(value).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0).cast("long")).alias("met"))
    total = scored.drop("words", "times").join(rest, "row", "left").withColumn("more", F.coalesce("more", F.lit(0.0)))
    n_known = F.col("n_known") + F.coalesce("met", F.lit(0))
    return total.select("doc_id", "held_out", "n_tokens", n_known.cast("long").alias("n_known"), F.lit(symbols.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.col("more")).alias("base_score"), (F.col("score") + F.col("more")).alias("score"))
