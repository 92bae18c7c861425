"""Operator 3, toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a seed lexicon and of a lexicon of words and stems learned
from labelled texts, closeness of their hits to second-person words, capitals, punctuation, and
rates of obfuscated spellings (with the spellings undone and looked up again). Trees of depth
``DEPTH`` are boosted on the logistic loss over histogram bins, in numpy; a part of the rows that the
trees never see fits the isotonic calibration.

Training uses at most about ``LABELLED_ROWS`` labelled rows, chosen by a hash of their id; that bound
is a parameter. Near copies among them count once. A third of them (by another hash) gives the
lexicon, a half the trees and the rest the calibration, so that neither trusts what the step before
has memorised. Labelled rows are joined by a broadcast of their ids, at most that bound; the scoring
pass over all documents is one map without a shuffle.

The learned lexicon is a part of the model and has parameters of its own: at most ``ENTRIES`` entries,
chosen among the ``CANDIDATES`` words and stems that most toxic training documents hold; words of more
than ``LONGEST_WORD`` characters enter it by their stems alone. They bound the model, and no document
or word is left out of a score.

Defined results: null and empty texts get a score like any other; a document with several labels
has the largest; null labels and labels without a document are ignored; without both classes among
the training rows every score is the share of toxic ones (0 without rows); repeated rows get equal
scores; null ids stay null; other columns stay as they are. Texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import held_out, materialise

LABELLED_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST_ROWS = 80, 3, 32, 0.2, 8
#: Stems are prefixes of these lengths; bounds of the learned lexicon.
STEM_LENGTHS = (3, 4, 5, 6, 7, 8, 9)
CANDIDATES, ENTRIES, LONGEST_WORD = 20_000, 600, 40
LEAST_DOCUMENTS, LEAST_PRECISION, LEAST_GAIN = 4, 0.4, 12.0

# Common insults, second-person words of four languages, and letters that other
# characters stand for.
SEED_LEXICON = frozenset("asshole bastard bitch clown coward cretin crap damn disgusting dumb filth fool garbage hate idiot imbecile jerk kill liar loser moron pathetic pig scum shit stupid trash ugly vermin worthless".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
STANDS_FOR = str.maketrans("013457@$!|+€", "oieastasiite")

WORD = re.compile(r"\w+")
#: A word that holds letters and, inside or before them, something that stands for one.
ODD_WORD = re.compile(r"[\w@$!|+*€]*(?:[A-Za-z][0-9@$!|+*€]+[A-Za-z]|\b[013457@$!]+[A-Za-z])[\w@$!|+*€]*")
SPACED = re.compile(r"\b(?:[A-Za-z][ .\-_*]){3,}[A-Za-z]\b")
#: Classes of characters, as bits of one table; letters past its end count as plain letters.
LETTER, UPPER, STAND_IN, GAP, MARK, ASCII_SYMBOL = 1, 2, 4, 8, 16, 32
TABLE_END = 0x24F


def _classes() -> np.ndarray:
    table = np.zeros(TABLE_END + 1, np.uint8)
    for code in range(TABLE_END + 1):
        c = chr(code)
        table[code] = LETTER * c.isalpha() + UPPER * c.isupper() + STAND_IN * (c in "0123456789@$!|+*€") + GAP * (c in " .-_*") + MARK * (c in "#$%&*@^~") + ASCII_SYMBOL * (code < 128 and not c.isalnum() and not c.isspace() and c.isprintable())
    table[TABLE_END] = LETTER
    return table


CLASSES = _classes()
NAMES = ("seed_density", "seed_hits", "learned_density", "learned_hits", "learned_kinds", "learned_weight", "near_second_person", "second_person_density", "capitals", "shouted", "exclamations", "questions", "symbols", "obfuscated", "obfuscated_hits", "spaced_hits", "marked_tails", "word_length", "repeated_words", "log_words")


class Lexicon:
    """Weights of whole words and of stems."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.lengths = sorted({len(s) for s in stems})
        self.plain = SEED_LEXICON | set(words)

    def weight(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for n in self.lengths:
            if len(word) >= n:
                found = max(found, self.stems.get(word[:n], 0.0))
        return found

    def meets(self, words: set[str]) -> bool:
        if not self.plain.isdisjoint(words):
            return True
        return any(not self.stems.keys().isdisjoint({w[:n] for w in words}) for n in self.lengths)


def entries(words: set[str]) -> set[tuple[str, bool]]:
    """What of a document may enter the lexicon: (text, whether it is a stem)."""
    found = {(w, False) for w in words if len(w) <= LONGEST_WORD}
    for n in STEM_LENGTHS:
        found.update((w[:n], True) for w in words if len(w) >= n)
    return found


def choose_lexicon(counts: dict[tuple[str, bool], tuple[int, int]], toxic: int, clean: int) -> Lexicon:
    """The entries that tell toxic documents from others best, by the likelihood ratio, none of
    them a stem of another; of equal ones the longest."""
    least = max(LEAST_DOCUMENTS, toxic // 40, round(toxic**0.5 / 2))
    merit = {}
    for (text, stem), (pos, neg) in counts.items():
        if pos >= least and pos / (pos + neg) >= LEAST_PRECISION and pos / max(1, toxic) > 4 * (neg + 0.5) / max(1, clean):
            observed = np.array([[pos, neg], [toxic - pos, clean - neg]], float)
            expected = observed.sum(0) * observed.sum(1, keepdims=True) / observed.sum()
            gain = 2 * float((observed * np.log(np.maximum(observed, 1e-9) / np.maximum(expected, 1e-9))).sum())
            if gain >= LEAST_GAIN:
                merit[text, stem] = gain
    words, stems, taken = {}, {}, set()
    for text, stem in sorted(merit, key=lambda e: (-merit[e], -len(e[0]), e[1], e[0])):
        above = any(text[:k] in stems for k in range(1, len(text) + (not stem)))
        if above or (stem and text in taken) or len(words) + len(stems) >= ENTRIES:
            continue
        pos, neg = counts[text, stem]
        (stems if stem else words)[text] = float(np.log(pos / toxic / ((neg + 0.5) / max(1, clean))))
        taken.update(text[:k] for k in range(1, len(text) + 1))
    return Lexicon(words, stems)


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    text = text or ""
    lower = text.lower()
    words = WORD.findall(lower)
    kinds = set(words)
    n, size = max(1, len(words)), max(1, len(text))
    kind = np.zeros(len(text) + 4, np.uint8)  # the end is free of all classes
    kind[: len(text)] = CLASSES[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4"), TABLE_END)]
    letter, upper, mark = kind & LETTER > 0, kind & UPPER > 0, kind & MARK > 0
    stand_in, gap = kind & STAND_IN > 0, kind & GAP > 0
    count = np.count_nonzero
    shouted = count(upper[2:] & upper[1:-1] & upper[:-2]) - count(upper[3:] & upper[2:-1] & upper[1:-2] & upper[:-3])
    # The two expressions run only where characters make a match possible.
    odd = ODD_WORD.findall(text) if (stand_in[:-1] & letter[1:]).any() else []
    undone = [re.sub(r"[^\w]", "", w.lower().translate(STANDS_FOR)) for w in odd]
    spaced = [re.sub(r"[^A-Za-z]", "", w).lower() for w in SPACED.findall(text)] if (letter[:-4] & gap[1:-3] & letter[2:-2] & gap[3:-1] & letter[4:]).any() else []
    seed = learned = 0
    hit_kinds, weight, near = set(), 0.0, 0.0
    persons = [] if kinds.isdisjoint(SECOND_PERSON) else [k for k, w in enumerate(words) if w in SECOND_PERSON]
    if lexicon.meets(kinds):
        known = {w: lexicon.weight(w) for w in kinds}
        hits = []
        for k, w in enumerate(words):
            is_seed = w in SEED_LEXICON
            seed += is_seed
            if known[w]:
                learned += 1
                weight += known[w]
                hit_kinds.add(w)
            if is_seed or known[w]:
                hits.append(k)
        if persons and hits:
            at = np.searchsorted(persons, hits)
            places = np.array([-(1 << 60), *persons, 1 << 60])
            gaps = np.minimum(np.array(hits) - places[at], places[at + 1] - np.array(hits))
            near = float((1 / (1 + gaps)).sum()) / n * 1000
    bad = lambda w: w in SEED_LEXICON or lexicon.weight(w) > 0
    return [
        seed / n * 1000, seed, learned / n * 1000, learned, len(hit_kinds), weight, near, len(persons) / n * 1000,
        count(upper) / size, shouted / n, text.count("!") / size * 1000, text.count("?") / size * 1000, count(kind & ASCII_SYMBOL) / size,
        len(odd) / n, sum(map(bad, undone)), sum(map(bad, spaced)), count(letter[:-2] & mark[1:-1] & mark[2:]) / n, sum(map(len, words)) / n, (len(words) - len(kinds)) / n, float(np.log1p(len(words))),
    ]


class Trees:
    """Boosted regression trees of one depth, as arrays: node k has the children 2k+1 and 2k+2."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (2**DEPTH - 1)]
        return total


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    cuts = [np.unique(np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1])) for col in x.T]
    # Mostly constant features still get a cut above their common value.
    cuts = [np.unique(np.append(c, np.quantile(col[col > c[0]], [0.0, 0.25, 0.5]) * (1 - 1e-9))) if (col > c[0]).any() else c for c, col in zip(cuts, x.T, strict=True)]
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    width = max(map(len, cuts)) + 1
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    raw = np.full(len(y), base)
    inner = 2**DEPTH - 1
    least = min(LEAST_ROWS, max(2, int(min(y.sum(), len(y) - y.sum())) // 4))  # fewer, where one class is rare
    features_, cuts_, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            best = np.full(many, 1e-9)
            for f, c in enumerate(cuts):
                key = (node - first) * width + binned[:, f]
                sums = [np.bincount(key, w, many * width).reshape(many, width).cumsum(1) for w in (g, h, None)]
                gl, hl, nl = (s[:, : len(c)] for s in sums)
                ga, ha, na = (s[:, -1:] for s in sums)
                gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                gain[(nl < least) | (na - nl < least)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(many), at]
                for k in np.flatnonzero(top > best):
                    best[k], feature[first + k], cut[first + k] = top[k], f, c[at[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf_of = node - inner
        leaf = RATE * np.bincount(leaf_of, g, inner + 1) / (np.bincount(leaf_of, h, inner + 1) + 1)
        raw += leaf[leaf_of]
        features_.append(feature)
        cuts_.append(cut)
        leaves.append(leaf)
    return Trees(base, np.array(features_), np.array(cuts_), np.array(leaves))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and heights of the blocks of the best rising step curve."""
    blocks: list[list[float]] = []  # sum of y, rows, sum of x
    for a, b in sorted(zip(x.tolist(), y.tolist(), strict=True)):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Model:
    def __init__(self, lexicon: Lexicon, trees: Trees | None, curve: tuple[np.ndarray, np.ndarray] | None, share: float):
        self.lexicon, self.trees, self.curve, self.share = lexicon, trees, curve, share

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        raw = self.trees.raw(x)
        plain = 1 / (1 + np.exp(-raw))
        if self.curve is None:
            return plain
        # A little of the plain score keeps the order within the curve's flat parts.
        return np.clip(0.98 * np.interp(raw, *self.curve) + 0.02 * plain, 0, 1)


def _signature(words: set[str]) -> int:
    """Equal for most near copies: made of the words with the four smallest hashes."""
    return xxhash.xxh3_64_intdigest(repr(sorted(map(xxhash.xxh3_64_intdigest, words))[:4]))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``text``, ``toxic`` (double), ``part`` (0 lexicon, 1 trees, 2 calibration), ``one``."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out("doc_id", 0)).groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("__toxic"))
    n = marked.count()
    if n > rows:  # by hash, so that a hundredth over the bound is already unlikely
        marked = marked.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int(rows / n * (1 << 30)))
    chosen = docs.select(F.col("doc_id").alias("__id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(marked), "__id")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = [_signature(set(WORD.findall(t.lower()))) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array([s - (1 << 63) for s in signs], pa.int64())], ["text", "toxic", "id", "one"])

    signed = chosen.select("text", (F.col("__toxic") > 0).cast("double").alias("toxic"), F.col("__id").cast("long").alias("id")).mapInArrow(sign, "text string, toxic double, id long, one long")
    part = F.pmod(F.col("one"), F.lit(6))
    return signed.withColumn("part", F.when(part < 2, 0).when(part < 5, 1).otherwise(2))


def learn(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Model:
    sample = materialise(training_rows(docs, labels, rows), "toxicity-sample")
    totals = {r["toxic"]: r["n"] for r in sample.where("part = 0").groupBy("toxic").agg(F.countDistinct("one").alias("n")).collect()}
    toxic, clean = totals.get(1.0, 0), totals.get(0.0, 0)

    def count(known: set | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: Counter = Counter()
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    found = entries(set(WORD.findall(text.lower())))
                    counts.update(found if known is None else found & known)
            rows = list(counts.items())
            yield pa.record_batch([pa.array([e[0] for e, _ in rows], pa.string()), pa.array([e[1] for e, _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64())], ["entry", "stem", "n"])

        return run

    once = sample.where("part = 0").groupBy("one", "toxic").agg(F.min("text").alias("text"))
    schema = "entry string, stem boolean, n long"
    gathered = lambda side, known: side.select("text").mapInArrow(count(known), schema).groupBy("entry", "stem").agg(F.sum("n").alias("n"))
    pos = {(r["entry"], r["stem"]): r["n"] for r in gathered(once.where("toxic = 1"), None).where(F.col("n") >= LEAST_DOCUMENTS).orderBy(F.desc("n"), "entry", "stem").limit(CANDIDATES).collect()}
    neg = {(r["entry"], r["stem"]): r["n"] for r in gathered(once.where("toxic = 0"), set(pos)).collect()}
    lexicon = choose_lexicon({e: (n, neg.get(e, 0)) for e, n in pos.items()}, toxic, clean)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t, lexicon) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(1), batch.column(2), batch.column(3), pa.array(x, pa.list_(pa.float64()))], ["toxic", "part", "one", "x"])

    measured = sample.select("text", "toxic", "part", "one").where("part > 0").mapInArrow(measure, "toxic double, part int, one long, x array<double>")
    table = measured.groupBy("one", "toxic").agg(F.min("part").alias("part"), F.min("x").alias("x")).orderBy("one", "toxic").toPandas()  # at most the bound
    y = table["toxic"].to_numpy(float)
    share = float(y.mean()) if len(y) else 0.0
    fit = (table["part"] == 1).to_numpy()
    if len(np.unique(y[fit])) < 2:
        return Model(lexicon, None, None, share)
    x = np.stack(table["x"].to_numpy())
    trees = boost(x[fit], y[fit])
    curve = isotonic(trees.raw(x[~fit]), y[~fit]) if len(np.unique(y[~fit])) == 2 else None
    return Model(lexicon, trees, curve, share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, which replace columns of those names."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    at = keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t, held.value.lexicon) for t in batch.column(at).to_pylist()]).reshape(-1, len(NAMES))
            scores = held.value.scores(x)
            yield pa.record_batch([*batch.columns, pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())], [*keep, "score", "predicted"])

    return docs.select(*keep).mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 0).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their columns."""
    scored = score(docs.select(F.struct(*docs.columns).alias("row"), "text"), learn(docs, labels))
    return scored.where("predicted = 0").select("row.*")
