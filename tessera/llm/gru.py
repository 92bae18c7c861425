"""A gated recurrent language model in numpy, with a class-factored softmax.

Symbols are ordered by frequency and cut into classes of contiguous ranges with about equal sums of
the square roots of their counts; a symbol's probability is its class's times its own within the
class. Training is truncated backpropagation: windows of ``STEPS`` symbols, through which the state
is carried but not the gradient. The state starts anew with each text, so that a text's
log-likelihood never depends on its neighbours.

For training, texts lie end to end in one stream that is cut into lanes of one length; the state is
carried through whole texts, and only a text that crosses the end of its lane goes on in the next
one from the zero state (with the symbol before it as input), at most one text a lane. For scoring
every text stays whole in one lane. Scoring multiplies embeddings by the input weights once a model,
so that a token's input is a row looked up.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

HIDDEN, EMBEDDING, CLASSES = 32, 24, 64
#: Lanes are fewer where there is little text, so that weights are updated often enough.
LANES, LEAST_LANES, STEPS, LANE_SYMBOLS = 512, 16, 24, 2048
#: Windows of a scoring pass hold about so many symbols, and at most so many steps.
SCORED_SYMBOLS, SCORED_STEPS = 16_384, 512
RATE, CLIP = 8e-3, 1.0
#: Rows of class logits that are worked on at a time, few enough for the processor's cache.
CHUNK = 2048
#: Weights that are updated at a time.
UPDATED = 16_384
#: Larger logits would leave single precision's exponential.
LARGEST_LOGIT = 80.0
NAMES = ("embedding", "input", "bias", "recurrent", "class_w", "class_b", "word_w", "word_b")


def class_edges(counts: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Where each class begins among symbols ordered by falling count, and their number."""
    mass = np.sqrt(np.maximum(counts, 1.0)).cumsum()
    cuts = np.searchsorted(mass, mass[-1] * np.arange(1, classes) / classes) + 1
    return np.unique(np.concatenate([[0], np.minimum(cuts, len(counts)), [len(counts)]]))


def initial(counts: np.ndarray, edges: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """The output begins at the symbols' own frequencies. The input side has one symbol more, the
    start of a text."""
    symbols, classes = len(counts), len(edges) - 1
    mass = np.maximum(counts, 0.5)
    by_class = np.add.reduceat(mass, edges[:-1])
    rng = np.random.default_rng(seed)
    draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    zero = lambda *shape: np.zeros(shape, np.float32)
    return {
        "embedding": draw(symbols + 1, EMBEDDING, by=0.3), "input": draw(EMBEDDING, 3 * HIDDEN, by=EMBEDDING**-0.5), "bias": zero(3 * HIDDEN), "recurrent": draw(HIDDEN, 3 * HIDDEN, by=HIDDEN**-0.5),
        "class_w": draw(HIDDEN, classes, by=0.05), "class_b": np.log(by_class / mass.sum()).astype(np.float32), "word_w": draw(symbols, HIDDEN, by=0.05), "word_b": np.log(mass / np.repeat(by_class, np.diff(edges))).astype(np.float32),
    }


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[n].ravel() for n in NAMES])


def views(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The parts of one flat array, without a copy."""
    found, at = {}, 0
    for n in NAMES:
        size = like[n].size
        found[n] = values[at : at + size].reshape(like[n].shape)
        at += size
    return found


def shaped(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return views(values.astype(np.float32), like)


class Stream:
    """Texts end to end: targets, the symbols before them, where texts start, whose symbol it is."""

    def __init__(self, texts: list[np.ndarray], start: int):
        lengths = np.array([len(t) for t in texts], np.int64)
        self.targets = np.concatenate(texts) if texts else np.zeros(0, np.int32)
        begins = np.cumsum(lengths) - lengths
        self.inputs = np.empty_like(self.targets)
        self.inputs[1:] = self.targets[:-1]
        self.inputs[begins] = start
        self.first = np.zeros(len(self.targets), bool)
        self.first[begins] = True
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)

    def windows(self, offsets: np.ndarray, lengths: np.ndarray, steps: int | None) -> Iterator[tuple[np.ndarray, ...]]:
        """(inputs, targets, first, owner) of the lanes that still go on, for lanes of falling
        length; owner -1 where a lane has ended. Without ``steps`` the windows are longer where
        lanes are few."""
        at, longest = 0, int(lengths[0]) if len(lengths) else 0
        while at < longest:
            wide = int((lengths > at).sum())
            end = min(longest, at + (steps or min(SCORED_STEPS, max(STEPS, SCORED_SYMBOLS // wide))))
            where = offsets[None, :wide] + np.arange(at, end)[:, None]
            over = np.arange(at, end)[:, None] >= lengths[None, :wide]
            some = bool(over.any())
            if some:
                where = np.where(over, 0, where)
            first, owner = self.first[where], self.owner[where]
            if some:
                first[over], owner[over] = False, -1
            yield self.inputs[where], self.targets[where], first, owner
            at = end


def training_windows(texts: list[np.ndarray], start: int, steps: int = STEPS) -> Iterator[tuple[np.ndarray, ...]]:
    """The stream cut into lanes of one length; the last one may end earlier."""
    stream = Stream(texts, start)
    total = len(stream.targets)
    if not total:
        return iter(())
    lanes = min(LANES, max(LEAST_LANES, total // LANE_SYMBOLS))
    each = -(-total // lanes)
    offsets = np.arange(0, total, each)
    return stream.windows(offsets, np.minimum(total - offsets, each), steps)


def scoring_windows(texts: list[np.ndarray], start: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Whole texts one after another in lanes of nearly equal length, long ones first."""
    total = sum(map(len, texts))
    lanes = min(LANES, max(LEAST_LANES, total // LANE_SYMBOLS), max(1, len(texts)))
    heap = [(0, lane) for lane in range(lanes)]
    content: list[list[int]] = [[] for _ in heap]
    for k in sorted(range(len(texts)), key=lambda k: (-len(texts[k]), k)):
        length, lane = heapq.heappop(heap)
        content[lane].append(k)
        heapq.heappush(heap, (length + len(texts[k]), lane))
    lengths = np.array([sum(len(texts[k]) for k in lane) for lane in content])
    order = [int(lane) for lane in np.argsort(-lengths, kind="stable")]
    lengths = lengths[order]
    placed = [k for lane in order for k in content[lane]]
    stream = Stream([texts[k] for k in placed], start)
    stream.owner = np.array(placed, np.int32)[stream.owner]
    return stream.windows(np.cumsum(lengths) - lengths, lengths, None)


class Model:
    """``p``: the weights; they become views of one flat array, which ``train`` changes."""

    def __init__(self, p: dict[str, np.ndarray], edges: np.ndarray):
        self.values = flat(p)
        self.p, self.edges = views(self.values, p), edges
        self.class_of = np.repeat(np.arange(len(edges) - 1, dtype=np.int16), np.diff(edges))
        self.moments: tuple[np.ndarray, np.ndarray] | None = None
        self.updates = 0
        self.kept_table: np.ndarray | None = None
        self.memory = np.zeros(0, self.values.dtype)
        self.ones = np.ones(max(CHUNK, int(np.diff(edges).max(initial=1)), len(edges)), self.values.dtype)

    @property
    def start(self) -> int:
        return int(self.edges[-1])

    def _gates(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs by symbol and recurrent weights, gate by gate. Those of the update and reset gates
        have the other sign, as their sigmoid is 1 / (1 + exp(-x))."""
        p = self.p
        h = p["recurrent"].shape[0]
        if self.kept_table is None:
            sign = np.array([-1, -1, 1], self.values.dtype)[:, None, None]
            table = np.matmul(p["embedding"], p["input"].reshape(-1, 3, h).transpose(1, 0, 2) * sign)
            table += p["bias"].reshape(3, 1, h) * sign
            self.kept_table = table
        u = p["recurrent"].reshape(h, 3, h).transpose(1, 0, 2)
        return self.kept_table, -u[:2], u[2].copy()

    def forward(self, inputs: np.ndarray, first: np.ndarray, h: np.ndarray, keep: bool = False):
        """The states after each step; with ``keep`` also what ``backward`` needs: the states before,
        both gates, candidates and their recurrent part."""
        table, u_gates, u_n = self._gates()
        steps, wide = inputs.shape
        size, kind = h.shape[1], table.dtype
        x = np.take(table, inputs, axis=1)
        hidden = np.empty((steps, wide, size), kind)
        kept = [np.empty((steps, *shape, wide, size), kind) for shape in ((), (2,), (), ())] if keep else None
        gates, n, un = np.empty((2, wide, size), kind), np.empty((wide, size), kind), np.empty((wide, size), kind)
        anew = first.any(1)
        h = np.ascontiguousarray(h, kind)
        with np.errstate(over="ignore"):  # the gate is 0 there
            for t in range(steps):
                if anew[t]:
                    h = h.copy()
                    h[first[t]] = 0
                if kept:
                    gates, n, un = kept[1][t], kept[2][t], kept[3][t]
                    kept[0][t] = h
                np.matmul(h, u_gates, out=gates)
                gates += x[:2, t]
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                np.matmul(h, u_n, out=un)
                np.multiply(gates[1], un, out=n)
                n += x[2, t]
                np.tanh(n, out=n)
                out = hidden[t]
                np.subtract(h, n, out=out)
                out *= gates[0]
                out += n
                h = out
        return hidden, kept

    def _buffer(self, rows: int, columns: int) -> np.ndarray:
        """One piece of memory for the logits of all chunks and classes."""
        if len(self.memory) < rows * columns:
            self.memory = np.empty(rows * columns, self.values.dtype)
        return self.memory[: rows * columns].reshape(rows, columns)

    def _softmax(self, hidden: np.ndarray, w: np.ndarray, b: np.ndarray, bound: float, at: tuple[np.ndarray, np.ndarray], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adds the log probabilities of the targets ``at``; gives the exponentials and their sums.
        Biases begin as log shares, so that logits lie near 0; they are held down only where the
        weights could make them large."""
        logits = np.matmul(hidden, w, out=self._buffer(len(hidden), w.shape[1]))
        logits += b
        if bound > LARGEST_LOGIT:
            np.clip(logits, -LARGEST_LOGIT, LARGEST_LOGIT, out=logits)
        logp += logits[at]
        e = np.exp(logits, out=logits)
        total = e @ self.ones[: e.shape[1]]
        logp -= np.log(total)
        return e, total

    def output(self, hidden: np.ndarray, targets: np.ndarray, weight: np.ndarray | float | None = None, grads: dict[str, np.ndarray] | None = None):
        """Natural log probabilities of the targets; with ``weight`` (a number, or one a row) also
        the gradient of their negative weighted sum, for the weights in ``grads`` and for
        ``hidden``. Rows are taken in the order of their classes, some thousand at a time."""
        p = self.p
        classes = self.class_of[targets]
        order = np.argsort(classes, kind="stable")
        hidden, classes, targets = hidden[order], classes[order], targets[order]
        # States lie between -1 and 1.
        bound = float(np.abs(p["class_w"]).sum(0).max() + np.abs(p["class_b"]).max())
        word_bound = float(np.abs(p["word_w"]).sum(1).max() + np.abs(p["word_b"]).max())
        rows = np.arange(len(targets))
        logp = np.zeros(len(targets), hidden.dtype)
        d_hidden = None
        if weight is not None:
            by = np.broadcast_to(np.asarray(weight, hidden.dtype), len(order))[order]
            d_hidden = np.empty_like(hidden)
            up = p["class_w"].T.copy()
            for n in ("class_w", "class_b", "word_w", "word_b"):
                grads[n][:] = 0
        for first in range(0, len(targets), CHUNK):
            own = slice(first, first + CHUNK)
            h = hidden[own]
            at = rows[: len(h)], classes[own]
            e, total = self._softmax(h, p["class_w"], p["class_b"], bound, at, logp[own])
            if weight is not None:
                e *= (by[own] / total)[:, None]
                e[at] -= by[own]
                grads["class_w"] += h.T @ e
                grads["class_b"] += self.ones_of(len(h)) @ e
                np.matmul(e, up, out=d_hidden[own])
        borders = np.searchsorted(classes, np.arange(len(self.edges)))
        for c in np.flatnonzero(np.diff(borders)):
            own = slice(borders[c], borders[c + 1])
            a, b = self.edges[c], self.edges[c + 1]
            if b - a == 1:
                continue
            h = hidden[own]
            at = rows[: len(h)], targets[own] - a
            words = p["word_w"][a:b]
            e, total = self._softmax(h, words.T, p["word_b"][a:b], word_bound, at, logp[own])
            if weight is not None:
                e *= (by[own] / total)[:, None]
                e[at] -= by[own]
                np.matmul(e.T, h, out=grads["word_w"][a:b])
                np.matmul(self.ones_of(len(h)), e, out=grads["word_b"][a:b])
                d_hidden[own] += e @ words
        back = np.empty_like(logp)
        back[order] = logp
        if d_hidden is not None:
            d_sorted, d_hidden = d_hidden, np.empty_like(d_hidden)
            d_hidden[order] = d_sorted
        return back, d_hidden

    def ones_of(self, n: int) -> np.ndarray:
        if len(self.ones) < n:
            self.ones = np.ones(n, self.values.dtype)
        return self.ones[:n]

    def backward(self, inputs: np.ndarray, first: np.ndarray, kept: list, d_hidden: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        p = self.p
        before, gates, n, un = kept
        z, r = gates[:, 0], gates[:, 1]
        steps, wide, size = n.shape
        # What a state's gradient is multiplied by, for the whole window at once.
        to_n = 1 - n * n
        to_n *= 1 - z
        to_z = before - n
        to_z *= z * (1 - z)
        to_r = un * r
        to_r *= 1 - r
        part, dn = np.empty((wide, 3 * size), n.dtype), np.empty((wide, size), n.dtype)
        d_embedded = np.empty((steps, wide, p["embedding"].shape[1]), n.dtype)
        d_next = np.zeros((wide, size), n.dtype)
        up, down = p["recurrent"].T.copy(), p["input"].T.copy()
        d_recurrent, d_input = np.zeros_like(up), np.zeros_like(down)
        ones = self.ones_of(wide)
        grads["bias"][:] = 0
        anew = first.any(1)
        for t in reversed(range(steps)):
            dh = d_hidden[t]
            dh += d_next
            np.multiply(dh, to_n[t], out=dn)
            np.multiply(dh, to_z[t], out=part[:, :size])
            np.multiply(dn, to_r[t], out=part[:, size : 2 * size])
            np.multiply(dn, r[t], out=part[:, 2 * size :])
            np.matmul(part, up, out=d_next)
            dh *= z[t]
            d_next += dh
            if anew[t]:
                d_next[first[t]] = 0
            # The weights' gradients are added while the step's are in the processor's cache.
            d_recurrent += part.T @ before[t]
            part[:, 2 * size :] = dn
            np.matmul(part, down, out=d_embedded[t])
            d_input += part.T @ p["embedding"][inputs[t]]
            grads["bias"] += ones @ part
        grads["recurrent"][:], grads["input"][:] = d_recurrent.T, d_input.T
        symbols = inputs.ravel()
        order = np.argsort(symbols.astype(np.int16) if self.start < 32_768 else symbols, kind="stable")
        ordered = symbols[order]
        at = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        grads["embedding"][:] = 0
        grads["embedding"][ordered[at]] = np.add.reduceat(np.take(d_embedded.reshape(len(symbols), -1), order, axis=0), at, axis=0)

    def update(self, g: np.ndarray, rate: float) -> None:
        """One step of Adam, the gradient's norm held down."""
        if self.moments is None:
            self.moments = np.zeros_like(self.values), np.zeros_like(self.values)
        m, v = self.moments
        norm = float(np.sqrt(np.dot(g, g)))
        g *= g.dtype.type(min(1.0, CLIP / max(norm, 1e-9)))
        self.updates += 1
        rate *= (1 - 0.999**self.updates) ** 0.5 / (1 - 0.9**self.updates)
        # Bit by bit, so that a bit stays in the processor's cache through all steps.
        kind = self.values.dtype.type
        for at in range(0, len(g), UPDATED):
            own = slice(at, at + UPDATED)
            gb, mb, vb = g[own], m[own], v[own]
            mb *= kind(0.9)
            vb *= kind(0.999)
            step = gb * kind(0.1)
            mb += step
            gb *= gb
            gb *= kind(0.001)
            vb += gb
            np.sqrt(vb, out=step)
            step += kind(1e-8)
            np.divide(mb, step, out=step)
            step *= kind(rate)
            self.values[own] -= step
        self.kept_table = None

    def train(self, texts: list[np.ndarray], rate: float = RATE) -> None:
        size = self.p["recurrent"].shape[0]
        h = np.zeros((0, size), self.values.dtype)
        g = np.zeros_like(self.values)
        grads = views(g, self.p)
        for inputs, targets, first, owner in training_windows(texts, self.start):
            wide = inputs.shape[1]
            h = np.concatenate([h[:wide], np.zeros((max(0, wide - len(h)), size), h.dtype)])
            hidden, kept = self.forward(inputs, first, h, keep=True)
            there = owner.ravel() >= 0
            n = int(there.sum())
            weight = 1 / n if n == len(there) else there / n
            h = hidden[-1].copy()
            _, d_hidden = self.output(hidden.reshape(-1, size), targets.ravel(), weight, grads)
            self.backward(inputs, first, kept, d_hidden.reshape(hidden.shape), grads)
            self.update(g, rate)

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """The natural log-likelihood of each whole text."""
        size = self.p["recurrent"].shape[0]
        total = np.zeros(len(texts))
        h = np.zeros((0, size), self.values.dtype)
        for inputs, targets, first, owner in scoring_windows(texts, self.start):
            wide = inputs.shape[1]
            h = np.concatenate([h[:wide], np.zeros((max(0, wide - len(h)), size), h.dtype)])
            hidden, _ = self.forward(inputs, first, h)
            logp, _ = self.output(hidden.reshape(-1, size), targets.ravel())
            owner = owner.ravel()
            there = owner >= 0
            total += np.bincount(owner[there], logp[there].astype(np.float64), len(texts))
            h = hidden[-1]
        return total
