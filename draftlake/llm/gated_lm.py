"""Gated recurrent language model: log-likelihood of complete documents.

Words are counted over all learning documents.  The most frequent ones are the model's
vocabulary and the next most frequent ones are known to every task; any other word meets
its count by a join, so the vocabulary may grow without bound.  A gated recurrent network
predicts the next token through a softmax factored into a word's class and the word inside
its class.  It is trained in numpy by backpropagation truncated at the windows' edges, while
the state is carried on; scoring carries the state across all windows of a document.

All learning documents train it.  Their tokens are dealt to slices of about SLICE_TOKENS: the
first slice starts the network, the others go on from its weights in parallel, a task per
slice, and after each of ROUNDS rounds the weights are averaged by tokens.

A word outside the model's vocabulary has the probability of the token "another word" times
its smoothed share of all such words, so probabilities of a position add up to one.

Arrays are (units, lanes): a lane reads documents one after the other, and one step moves
all lanes by a token.
"""

from __future__ import annotations

import base64
import heapq
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import Scratch, by_batch, partitions, utf8

# ---------------------------------------------------------------- fixed values
MODEL_WORDS = 4_096  # most frequent tokens the network tells apart
HEAD_WORDS = 131_072  # most frequent tokens whose counts go to every task; others are joined
UNITS = 32
CLASSES = 64
SLICE_TOKENS = 1 << 19  # tokens of learning documents trained on together
PIECE_TOKENS = 512  # a longer document is trained on in pieces, each from a cleared state, side by side
ROUNDS = 4  # averages of the weights after the first slice
PARTS = 16  # pieces of the weights that are averaged on their own
EPOCHS = 3  # over the first slice; the others are read once
LANES = 64  # in training
WINDOW = 32  # tokens between truncations
RATE = 0.03
LATER_RATE = 0.01  # behind the first slice
SEED = 37
WIDE = 256  # lanes in scoring
STEPS = 32  # tokens of a scoring window
CHUNK = 1_500_000  # tokens scored together
PIECE = 1 << 22  # bytes of a text split into words at a time
FLUSH = 400_000  # distinct words a task holds while counting
END = b""
# ---------------------------------------------------------- end of fixed values


@dataclass
class Model:
    """Classes of the vocabulary and the network's parameters.

    Token 0 is the end (also what stands ahead of a document), token 1 another word.
    ``order`` lists tokens class by class and ``starts`` bounds the classes in it.
    """

    order: np.ndarray
    starts: np.ndarray
    weights: dict[str, np.ndarray]

    def __post_init__(self) -> None:
        sizes = np.diff(self.starts)
        self.rank = np.empty_like(self.order)
        self.rank[self.order] = np.arange(len(self.order))
        self.owner = np.repeat(np.arange(len(sizes)), sizes)[self.rank]

    def packed(self) -> str:
        return base64.b64encode(pickle.dumps((self.order, self.starts, self.weights))).decode()

    @staticmethod
    def unpacked(data: str) -> Model:
        return Model(*pickle.loads(base64.b64decode(data)))


def fresh(counts: np.ndarray, units: int = UNITS, classes: int = CLASSES, seed: int = SEED) -> Model:
    """Untrained model; classes hold about equal shares of the square roots of the counts."""
    order = np.argsort(-counts, kind="stable")
    share = np.cumsum(np.sqrt(counts[order] + 1.0))
    found = np.minimum((share / share[-1] * classes).astype(np.int64), classes - 1)
    starts = np.r_[np.flatnonzero(np.r_[True, found[1:] != found[:-1]]), len(order)]
    rng, n, c = np.random.default_rng(seed), len(counts), len(starts) - 1
    single = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    zero = lambda *shape: np.zeros(shape, np.float32)
    weights = {
        "x": single(3 * units, n, scale=0.2),
        "u": single(3 * units, units, scale=1 / np.sqrt(units)),
        "b": zero(units, 1),
        "c": single(units, c, scale=0.1),
        "cb": zero(c),
        "w": single(units, n, scale=0.1),  # columns in the order of ``order``
        "wb": np.log(counts[order] + 1.0).astype(np.float32),
    }
    totals = np.add.reduceat(counts[order].astype(np.float64) + 1, starts[:-1])
    weights["cb"] = np.log(totals).astype(np.float32)
    weights["cb"] -= weights["cb"].mean()
    weights["wb"] -= np.repeat(np.log(totals), np.diff(starts)).astype(np.float32)
    return Model(order, starts, weights)


def states(m: Model, inputs: np.ndarray, first: np.ndarray, h: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Hidden states (T, H, A) over tokens (T, A) from the state ``h``; ``first`` clears it ahead of a step.

    ``keep`` takes what the way back needs, by name, as arrays over all steps.
    """
    w, units = m.weights, m.weights["u"].shape[1]
    steps, wide = inputs.shape
    out = np.empty((steps, units, wide), h.dtype)
    # All steps' columns at once; a row of the transposed table is one piece of memory.
    asked = np.ascontiguousarray(w["x"].T.take(inputs, axis=0).transpose(0, 2, 1))
    before, inner = (np.empty_like(out) for _ in range(2))
    begins = first.any(axis=1)
    for t in range(steps):
        if begins[t]:
            h = h * ~first[t]
        a, g = asked[t], w["u"] @ h
        before[t] = h
        rz, n = a[: 2 * units], a[2 * units :]
        rz += g[: 2 * units]
        rz *= 0.5
        np.tanh(rz, out=rz)
        rz *= 0.5
        rz += 0.5
        np.add(g[2 * units :], w["b"], out=inner[t])
        n += rz[:units] * inner[t]
        np.tanh(n, out=n)
        h = np.subtract(h, n, out=out[t])
        h *= rz[units:]
        h += n
    if keep is not None:
        keep.update(before=before, inner=inner, r=asked[:, :units], z=asked[:, units : 2 * units], n=asked[:, 2 * units :])
    return out


class Stepper:
    """``states`` for scoring: the same up to rounding, in buffers that are used again."""

    def __init__(self, m: Model, wide: int, steps: int) -> None:
        units = self.units = m.weights["u"].shape[1]
        # Gates are 1 / (1 + exp(-x)) and tanh(x) is 1 - 2 / (1 + exp(2x)): their rows are scaled once, here.
        scale = np.r_[np.full(2 * units, -1), np.full(units, 2)].astype(np.float32)[:, None]
        self.x = np.ascontiguousarray((m.weights["x"] * scale).T)  # a token's row is one piece of memory
        self.u, self.b = np.ascontiguousarray(m.weights["u"] * scale), m.weights["b"] * np.float32(2)
        self.a, self.g, self.rows = (np.empty(3 * units * wide, np.float32) for _ in range(3))
        self.t, self.out = np.empty(units * wide, np.float32), np.empty(steps * units * wide, np.float32)

    @np.errstate(over="ignore")  # infinite powers give gates of 0 and states of 1
    def run(self, inputs: np.ndarray, first: np.ndarray, h: np.ndarray) -> np.ndarray:
        units, (steps, wide) = self.units, inputs.shape
        a, g = (v[: 3 * units * wide].reshape(3 * units, wide) for v in (self.a, self.g))
        rows = self.rows[: 3 * units * wide].reshape(wide, 3 * units)
        tmp, out = self.t[: units * wide].reshape(units, wide), self.out[: steps * units * wide].reshape(steps, units, wide)
        r, z, n, rz, inner = a[:units], a[units : 2 * units], a[2 * units :], a[: 2 * units], g[2 * units :]
        begins = first.any(axis=1)
        for t in range(steps):
            if begins[t]:
                h = h * ~first[t]
            np.take(self.x, inputs[t], axis=0, out=rows, mode="clip")
            a[:] = rows.T
            np.matmul(self.u, h, out=g)
            rz += g[: 2 * units]
            np.exp(rz, out=rz)
            rz += 1
            np.divide(1, rz, out=rz)
            inner += self.b
            inner *= r
            n += inner
            np.exp(n, out=n)
            n += 1
            np.divide(-2, n, out=n)
            n += 1
            # h = n + z * (h - n)
            np.subtract(h, n, out=tmp)
            tmp *= z
            h = np.add(n, tmp, out=out[t])
        return out


def is_far(m: Model, far: float = 80.0) -> bool:
    """Whether a score may leave the range in which exponentials are taken as they are."""
    return max(float(np.abs(m.weights[k]).sum(axis=0).max() + np.abs(m.weights[b]).max()) for k, b in (("c", "cb"), ("w", "wb"))) > far


def log_likelihood(m: Model, hidden: np.ndarray, targets: np.ndarray, shift: bool | None = None) -> np.ndarray:
    """Natural log of the probability of targets (T, A) from states (T, H, A): the class, then the word in it.

    States lie between -1 and 1, so scores are bounded by the weights; those are shifted
    only if exponentials could leave the range of floats.
    """
    w, classes = m.weights, m.owner[targets]
    shift = is_far(m) if shift is None else shift
    scores = np.matmul(w["c"].T, hidden)
    scores += w["cb"][:, None]
    out = np.take_along_axis(scores, classes[:, None, :], axis=1)[:, 0]
    if shift:
        top = scores.max(axis=1)
        scores -= top[:, None]
        out -= top
    out -= np.log(np.exp(scores, out=scores).sum(axis=1))
    out, flat, word = out.ravel(), classes.ravel(), m.rank[targets].ravel()
    s = hidden.transpose(0, 2, 1).reshape(len(flat), -1)
    by_class = np.argsort(flat.astype(np.int16), kind="stable")
    bounds = np.searchsorted(flat[by_class], np.arange(len(m.starts)))
    for k in np.flatnonzero(np.diff(bounds)):
        low, high = m.starts[k], m.starts[k + 1]
        if high - low > 1:
            own = by_class[bounds[k] : bounds[k + 1]]
            inside = s[own] @ w["w"][:, low:high]
            inside += w["wb"][low:high]
            if shift:
                inside -= inside.max(axis=1, keepdims=True)
            found = inside[np.arange(len(own)), word[own] - low]
            out[own] += found - np.log(np.exp(inside, out=inside) @ np.ones(high - low, inside.dtype))
    return out.reshape(targets.shape)


def _softmax(scores: np.ndarray, at: np.ndarray, share: float) -> tuple[float, np.ndarray]:
    """Sum of the log probabilities of places ``at`` of the flat ``scores``, one a row, and the gradient of minus ``share`` times it, in ``scores``."""
    flat = scores.reshape(-1)
    scores -= np.maximum.reduce(scores, axis=1, keepdims=True)
    found = flat.take(at)
    np.exp(scores, out=scores)
    sums = scores @ np.ones(scores.shape[1], scores.dtype)
    scores *= (share / sums)[:, None]
    flat[at] -= share
    return float(np.add.reduce(found - np.log(sums))), scores


def gradients(
    m: Model, inputs: np.ndarray, targets: np.ndarray, first: np.ndarray, live: np.ndarray, h: np.ndarray, grad: dict | None = None
) -> tuple[float, dict, np.ndarray]:
    """Mean negative log-likelihood of a window, its gradient inside the window, and the last state.

    ``grad`` may bring zeroed arrays for the gradient.
    """
    w, units, kept = m.weights, m.weights["u"].shape[1], {}
    grad = {k: np.zeros_like(v) for k, v in w.items()} if grad is None else grad
    hidden = states(m, inputs, first, h, kept)
    on = np.flatnonzero(live.ravel())
    classes = m.owner[targets.ravel()[on]]
    # Positions class by class, so a class is one stretch of every array below.
    by_class = np.argsort(classes.astype(np.int16), kind="stable")
    on, classes = on[by_class], classes[by_class]
    word, share = m.rank[targets.ravel()[on]], hidden.dtype.type(1 / max(len(on), 1))
    s = hidden.transpose(0, 2, 1).reshape(-1, units).take(on, axis=0)
    p = s @ w["c"]
    p += w["cb"]
    total, p = _softmax(p, np.arange(len(on)) * p.shape[1] + classes, share)
    grad["c"][:], grad["cb"][:] = s.T @ p, p.sum(axis=0)
    ds = p @ w["c"].T
    bounds = np.searchsorted(classes, np.arange(len(m.starts)))
    # Where a position's word lies in the flat scores of its class.
    at = (np.arange(len(on)) - bounds[classes]) * np.diff(m.starts)[classes] + word - m.starts[classes]
    starts, ends = m.starts.tolist(), bounds.tolist()
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        low, high = starts[k], starts[k + 1]
        if high - low > 1:
            own = slice(ends[k], ends[k + 1])
            here, columns = s[own], w["w"][:, low:high]
            q = here @ columns
            q += w["wb"][low:high]
            more, q = _softmax(q, at[own], share)
            total += more
            np.matmul(here.T, q, out=grad["w"][:, low:high])
            np.add.reduce(q, axis=0, out=grad["wb"][low:high])
            ds[own] += q @ columns.T
    back = np.zeros((inputs.size, units), hidden.dtype)
    back[on] = ds
    back = np.ascontiguousarray(back.reshape(*inputs.shape, units).transpose(0, 2, 1))
    before, inner, r, z, n = (kept[k] for k in ("before", "inner", "r", "z", "n"))
    # What the gates' gradients are of the state's, for all steps.
    of_n = (1 - z) * (1 - n * n)
    of_z = (before - n) * z * (1 - z)
    of_r = inner * r * (1 - r)
    gates, begins = np.empty((len(inputs), 3 * units, inputs.shape[1]), hidden.dtype), first.any(axis=1)
    dn, dh, back_u = np.empty_like(back), np.zeros_like(h), np.ascontiguousarray(w["u"].T)
    for t in range(len(inputs) - 1, -1, -1):
        dh += back[t]
        np.multiply(dh, of_n[t], out=dn[t])
        np.multiply(dh, of_z[t], out=gates[t, units : 2 * units])
        np.multiply(dn[t], of_r[t], out=gates[t, :units])
        np.multiply(dn[t], r[t], out=gates[t, 2 * units :])
        dh *= z[t]
        dh += back_u @ gates[t]
        if begins[t]:
            dh *= ~first[t]
    flat = lambda v: v.transpose(1, 0, 2).reshape(v.shape[1], -1)
    grad["u"][:] = flat(gates) @ flat(before).T
    grad["b"][:] = gates[:, 2 * units :].sum(axis=(0, 2))[:, None]
    gates[:, 2 * units :] = dn
    order = np.argsort(inputs.ravel(), kind="stable")
    tokens = inputs.ravel()[order]
    runs = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    grad["x"].T[tokens[runs]] = np.add.reduceat(gates.transpose(0, 2, 1).reshape(-1, 3 * units).take(order, axis=0), runs)
    return -total / max(len(on), 1), grad, hidden[-1]


@dataclass
class Lanes:
    """Documents laid end to end into lanes of about equal length, the longest lane first."""

    starts: np.ndarray  # of the lanes in ``stream``
    sizes: np.ndarray
    stream: np.ndarray  # tokens
    ahead: np.ndarray  # the token ahead of each
    first: np.ndarray  # whether a document begins
    docs: np.ndarray  # numbers of the documents in stream order
    at: np.ndarray  # and where they begin

    @staticmethod
    def of(docs: list[np.ndarray], wide: int) -> Lanes:
        """``docs`` hold at least one token each."""
        lanes: list[list[int]] = [[] for _ in range(min(wide, len(docs)))]
        room = [(0, k) for k in range(len(lanes))]
        for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
            load, k = room[0]
            lanes[k].append(d)
            heapq.heapreplace(room, (load + len(docs[d]), k))
        lanes.sort(key=lambda own: -sum(len(docs[d]) for d in own))
        order = [d for own in lanes for d in own]
        lengths = np.array([len(docs[d]) for d in order], np.int64)
        at = np.cumsum(lengths) - lengths
        sizes = np.array([sum(len(docs[d]) for d in own) for own in lanes], np.int64)
        stream = np.concatenate([docs[d] for d in order])
        ahead = np.r_[0, stream[:-1]].astype(stream.dtype)
        ahead[at] = 0
        first = np.zeros(len(stream), bool)
        first[at] = True
        return Lanes(np.cumsum(sizes) - sizes, sizes, stream, ahead, first, np.array(order, np.int64), at)

    def windows(self, steps: int, stretch: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(lanes still running, places (T, A) in the stream, which of them are real).

        With ``stretch`` few lanes take longer windows, up to the next lane's end, of no more places than all lanes' window.
        """
        t = 0
        while t < self.sizes[0]:
            running = int(np.searchsorted(-self.sizes, -t, "left"))
            long = min(steps * len(self.sizes) // running, int(self.sizes[running - 1]) - t) if stretch else 0
            step = np.arange(t, min(t + max(steps, long), int(self.sizes[0])))[:, None]
            live = step < self.sizes[:running]
            yield running, self.starts[:running] + np.where(live, step, 0), live
            t += len(step)


def train(
    docs: list[np.ndarray],
    counts: np.ndarray,
    epochs: int = EPOCHS,
    units: int = UNITS,
    classes: int = CLASSES,
    seed: int = SEED,
    start: Model | None = None,
    top_rate: float = RATE,
) -> Model:
    """Fit by Adam on windows of WINDOW tokens, from ``start`` if given; the same documents always give the same model."""
    m, rng = fresh(counts, units, classes, seed), np.random.default_rng(seed)
    if start is not None:
        m = Model(start.order, start.starts, {k: v.copy() for k, v in start.weights.items()})
        units = m.weights["u"].shape[1]
    # One vector of all weights and one of their gradients; the arrays are views of them.
    shapes = {k: v.shape for k, v in m.weights.items()}
    flat = np.concatenate([m.weights[k].T.ravel() if k == "x" else m.weights[k].ravel() for k in shapes])
    slope, mean, square = (np.zeros_like(flat) for _ in range(3))
    m.weights, grad = _views(flat, shapes), _views(slope, shapes)
    total, step = max(1, epochs * -(-sum(map(len, docs)) // (LANES * WINDOW))), 0
    for _ in range(epochs if docs else 0):
        laid = Lanes.of([docs[k] for k in rng.permutation(len(docs))], LANES)
        h = np.zeros((units, len(laid.sizes)), np.float32)
        for running, at, live in laid.windows(WINDOW):
            first = laid.first[at] & live
            slope.fill(0)
            _, _, h = gradients(m, laid.ahead[at], laid.stream[at], first, live, h[:, :running], grad)
            step += 1
            _adam(flat, slope, mean, square, step, top_rate * max(0.05, 1 - step / total))
    m.weights = {k: np.ascontiguousarray(v) for k, v in m.weights.items()}
    return m


def _views(flat: np.ndarray, shapes: dict[str, tuple]) -> dict[str, np.ndarray]:
    """Arrays of these shapes inside a vector; ``x`` lies there token by token."""
    out, at = {}, 0
    for name, shape in shapes.items():
        own = flat[at : at + int(np.prod(shape))]
        out[name], at = own.reshape(shape[::-1]).T if name == "x" else own.reshape(shape), at + own.size
    return out


def _adam(weights: np.ndarray, slope: np.ndarray, mean: np.ndarray, square: np.ndarray, step: int, rate: float, block: int = 1 << 15) -> None:
    """One step, by blocks that stay in the processor's cache."""
    norm = float(np.sqrt(np.dot(slope, slope)))
    cut, held = min(1.0, 1.0 / max(norm, 1e-9)), np.empty(block, weights.dtype)
    rate, wide = rate / (1 - 0.9**step), 1 / np.sqrt(1 - 0.99**step)
    for at in range(0, len(weights), block):
        g, a, b, w = (v[at : at + block] for v in (slope, mean, square, weights))
        t = held[: len(g)]
        a *= 0.9
        a += np.multiply(g, 0.1 * cut, out=t)
        np.multiply(g, g, out=t)
        t *= 0.01 * cut * cut
        b *= 0.99
        b += t
        np.sqrt(b, out=t)
        t *= wide
        t += 1e-6
        np.divide(a, t, out=t)
        t *= rate
        w -= t


def document_scores(m: Model, docs: list[np.ndarray], wide: int = WIDE, steps: int = STEPS) -> np.ndarray:
    """Natural log-likelihood of every document; the state is carried over all its windows."""
    if not docs:
        return np.zeros(0)
    laid, units = Lanes.of(docs, wide), m.weights["u"].shape[1]
    found, h = np.zeros(len(laid.stream)), np.zeros((units, len(laid.sizes)), np.float32)
    stepper, shift = Stepper(m, len(laid.sizes), steps), is_far(m)
    for running, at, live in laid.windows(steps, stretch=True):
        hidden = stepper.run(laid.ahead[at], laid.first[at], np.ascontiguousarray(h[:, :running]))
        h = hidden[-1].copy()
        found[at[live]] = log_likelihood(m, hidden, laid.stream[at], shift)[live]
    out = np.zeros(len(docs))
    out[laid.docs] = np.add.reduceat(found, laid.at)
    return out


def words_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text without case (A-Z), by pieces of bounded size that end between words."""
    text, at = (text or b"").lower(), 0
    while len(text) - at > PIECE:
        stop = at + PIECE
        while stop < len(text) and text[stop] not in b" \t\n\v\f\r":
            stop += 1
        yield text[at:stop].split()
        at = stop
    yield text[at:].split()


def is_held_out(id: str = "doc_id") -> Column:
    """A seventh of the ids is never learned from."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 7 == 2, F.lit(False))


def token_counts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, c): how often each token occurs in the learning documents; the end is the empty word."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held: Counter[bytes] = Counter()
        for b in batches:
            for t in b["text"]:
                for words in words_of(t):
                    held.update(words)
            held[END] += len(b["text"])
            if len(held) > FLUSH:
                yield {"word": list(held), "c": list(held.values())}
                held.clear()
        if held:
            yield {"word": list(held), "c": list(held.values())}

    learned = docs.where(~is_held_out(id)).select(utf8(text).alias("text"))
    return by_batch(learned, run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Known:
    """What every task knows of the counts: the most frequent tokens, the end first, and totals."""

    words: list[bytes]
    counts: np.ndarray
    total: int  # tokens
    distinct: int
    model: int  # how many of ``words`` the network tells apart

    def token(self, k: np.ndarray) -> np.ndarray:
        """Model token of word number ``k``; 1 stands for another word, also for k = -1."""
        return np.where(k == 0, 0, np.where((k < 0) | (k >= self.model), 1, k + 1))

    @property
    def rest(self) -> tuple[int, int]:
        """Tokens and distinct tokens outside the network's vocabulary."""
        return self.total - int(self.counts[: self.model].sum()), self.distinct - min(self.model, len(self.words))

    def token_counts(self) -> np.ndarray:
        own = self.counts[: self.model]
        return np.r_[own[:1], self.rest[0], own[1:]] if len(own) else np.zeros(2, np.int64)

    def logs(self) -> tuple[np.ndarray, np.ndarray]:
        """Per word number: log10 of the base probability, and of the share among other words."""
        base = np.log10((self.counts + 1) / (self.total + self.distinct + 1))
        share = np.log10((self.counts + 1) / (sum(self.rest) + 1))
        share[: self.model] = 0
        return base, share


def known(counts: DataFrame, head: int = HEAD_WORDS, model: int = MODEL_WORDS) -> Known:
    """The end and at most ``head`` of the most frequent words come to the driver.

    Words are taken by ranges of their counts, 16 to a power of two, so a bounded table of
    ranges says how far they may reach and no task sends words that are not taken.
    """
    reach = F.floor(F.log2("c") * 16).cast("int")
    whole = counts.agg(F.sum("c"), F.count("*")).first()
    room, least = head, None
    for r in sorted(counts.where(F.length("word") > 0).groupBy(reach.alias("reach")).count().collect(), reverse=True):
        if r["count"] > room:
            break
        room, least = room - r["count"], r["reach"]
    taken = (F.length("word") == 0) | (F.lit(False) if least is None else reach >= least)
    got = sorted(((bytes(r[0]), r[1]) for r in counts.where(taken).collect()), key=lambda r: (len(r[0]) > 0, -r[1], r[0]))
    return Known([w for w, _ in got], np.array([c for _, c in got], np.int64), whole[0] or 0, whole[1], min(model, len(got)))


def lessons(docs: DataFrame, k: Known, slices: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(slice, hash, piece, ids): model tokens of every learning document, dealt to slices."""
    hashed = F.xxhash64(F.col(id).cast("long"), utf8(text), F.lit(SEED))
    learned = docs.where(~is_held_out(id)).select(hashed.alias("hash"), utf8(text).alias("text"))
    words = k.words[: k.model]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        number = dict(zip(words, k.token(np.arange(len(words))).tolist(), strict=True))
        for b in batches:
            out = []
            for h, t in zip(b["hash"].tolist(), b["text"], strict=True):
                parts = [np.fromiter(map(number.get, part, repeat(1)), "<i4", len(part)) for part in words_of(t)]
                ids = np.concatenate([*parts, np.zeros(1, "<i4")])
                out += [(h, p, ids[at : at + PIECE_TOKENS].tobytes()) for p, at in enumerate(range(0, len(ids), PIECE_TOKENS))]
            yield dict(zip(("hash", "piece", "ids"), map(list, zip(*out, strict=True)), strict=True))

    cut = by_batch(learned, run, "hash long, piece int, ids binary")
    return cut.withColumn("slice", F.pmod(F.xxhash64("hash", "piece"), F.lit(slices)).cast("int"))


def taught(m: Model, dealt: DataFrame, counts: np.ndarray, epochs: int, rate: float) -> Model:
    """The average, by tokens, of the models that the slices of ``dealt`` make of ``m``.

    A task holds one slice, and of a crowded one two slices' tokens at a time.
    """
    packed = m.packed()
    sizes = {name: w.shape for name, w in m.weights.items()}

    def trained(batches: Iterator[dict]) -> Iterator[dict]:
        name, net, docs, load, total = None, None, [], 0, 0

        def learn() -> None:
            nonlocal net, docs, load, total
            net, total = train(docs, counts, epochs, start=net, top_rate=rate), total + load
            docs, load = [], 0

        def weights() -> dict:
            parts = np.array_split(np.concatenate([w.ravel() for w in net.weights.values()]), PARTS)
            return {"part": list(range(PARTS)), "slice": [name] * PARTS, "tokens": [total] * PARTS, "weights": [p.astype("<f4").tobytes() for p in parts]}

        for b in batches:
            for own, ids in zip(b["slice"].tolist(), b["ids"], strict=True):
                if own != name or load >= 2 * SLICE_TOKENS:
                    if docs:
                        learn()
                    if own != name:
                        if name is not None:
                            yield weights()
                        name, net, total = own, Model.unpacked(packed), 0
                docs.append(np.frombuffer(ids, "<i4").astype(np.int64))
                load += len(docs[-1])
        if docs:
            learn()
        if name is not None:
            yield weights()

    def averaged(batches: Iterator[dict]) -> Iterator[dict]:
        part, total, tokens = None, None, 0
        for b in batches:
            for p, n, w in zip(b["part"].tolist(), b["tokens"].tolist(), b["weights"], strict=True):
                if p != part:
                    if part is not None:
                        yield {"part": [part], "weights": [(total / tokens).astype("<f4").tobytes()]}
                    part, total, tokens = p, 0.0, 0
                total, tokens = total + n * np.frombuffer(w, "<f4").astype(np.float64), tokens + n
        if part is not None:
            yield {"part": [part], "weights": [(total / tokens).astype("<f4").tobytes()]}

    count = partitions(dealt.sparkSession)
    rows = dealt.repartition(count, "slice").sortWithinPartitions("slice", "hash", "piece", "ids").select("slice", "ids")
    models = by_batch(rows, trained, "part int, slice int, tokens long, weights binary")
    whole = by_batch(models.repartition(PARTS, "part").sortWithinPartitions("part", "slice"), averaged, "part int, weights binary")
    got = sorted(whole.collect())
    if not got:
        return m
    flat, at, weights = np.concatenate([np.frombuffer(r["weights"], "<f4") for r in got]), 0, {}
    for name, shape in sizes.items():
        size = int(np.prod(shape))
        weights[name], at = flat[at : at + size].reshape(shape).copy(), at + size
    return Model(m.order, m.starts, weights)


def fit(docs: DataFrame, counts: DataFrame, id: str = "doc_id", text: str = "text", head: int = HEAD_WORDS, model: int = MODEL_WORDS) -> tuple[Known, Model]:
    """Counts and the network, both of all learning documents."""
    k = known(counts, head, model)
    own = k.token_counts()
    m = fresh(own)
    if not k.total:
        return k, m
    slices = -(-k.total // SLICE_TOKENS)
    read = Scratch(docs.sparkSession).keep("lessons", lessons(docs, k, slices, id, text))
    m = taught(m, read.where(F.col("slice") == 0), own, EPOCHS, RATE)
    rounds = min(ROUNDS, slices - 1)
    for r in range(rounds):
        now = (F.col("slice") > 0) & (F.pmod(F.col("slice") - 1, F.lit(rounds)) == r)
        m = taught(m, read.where(now), own, 1, LATER_RATE * (1 - r / rounds))
    return k, m


def _scored(docs: DataFrame, k: Known, m: Model) -> DataFrame:
    """A row per row of (doc_id, text): scores of the words every task knows, and the other words with their counts."""
    packed, words = m.packed(), k
    schema = "key long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<binary>, times array<long>"

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        net, number = Model.unpacked(packed), {w: n for n, w in enumerate(words.words)}
        base, share = words.logs()
        # Number -1 (a word that is joined later) reads the last entry.
        base, share = np.r_[base, 0.0], np.r_[share, 0.0]
        token = np.r_[words.token(np.arange(len(words.words))), 1].astype(np.int32)
        key = TaskContext.get().partitionId() << 40
        held: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
        docs, load = [], 0

        def closed() -> dict:
            held["score"] = (np.array(held["score"]) + document_scores(net, docs) / np.log(10)).tolist()
            return held

        for b in batches:
            ids = b["doc_id"].tolist() if isinstance(b["doc_id"], np.ndarray) else b["doc_id"]
            for d, t in zip(ids, b["text"], strict=True):
                parts, rare = [], Counter()
                for own in words_of(t):
                    n = np.fromiter(map(number.get, own, repeat(-1)), np.int64, len(own))
                    if (n < 0).any():
                        rare.update(own[i] for i in np.flatnonzero(n < 0))
                    parts.append(n)
                n = np.concatenate([*parts, np.zeros(1, np.int64)])
                row = (key, d, len(n), int((n >= 0).sum()), float(base[n].sum()), float(share[n].sum()), list(rare), list(rare.values()))
                for c, v in zip(held, row, strict=True):
                    held[c].append(v)
                docs.append(token[n])
                key, load = key + 1, load + len(n)
            if load >= CHUNK:
                yield closed()
                held, docs, load = {c: [] for c in held}, [], 0
        if docs:
            yield closed()

    return by_batch(docs, run, schema)


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", head: int = HEAD_WORDS, model: int = MODEL_WORDS) -> DataFrame:
    """Log10 probability of every whole text, by counts and by the network.

    One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.  Tokens are the words without case (A-Z) and one end.  A null or empty
    text is its end alone; a null id is not held out; repeated rows are scored alike, and
    counted as often as they stand there.  If there is nothing to learn from, ``score`` is the
    base score, with every token as probable as an unknown one.  Extra columns are ignored;
    an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    counts = scratch.keep("counts", token_counts(docs, id, text))
    k, m = fit(docs, counts, id, text, head, model)
    total = k.total
    source = docs.select(F.col(id).cast("long").alias("doc_id"), utf8(text).alias("text"))
    if not total:
        words = by_batch(source, lambda bs: ({"doc_id": b["doc_id"], "n_tokens": [sum(map(len, words_of(t))) + 1 for t in b["text"]]} for b in bs), "doc_id long, n_tokens long")
        zero = F.lit(0.0)
        return words.select("doc_id", is_held_out().alias("held_out"), "n_tokens", F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), zero.alias("base_score"), zero.alias("score"))
    scored = scratch.keep("scored", _scored(source, k, m))
    rare = scored.where(F.size("rare") > 0).select("key", F.explode(F.arrays_zip("rare", "times")).alias("r"))
    rare = rare.select("key", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    # Both sides grow with the table, so this join is a merge join at every size.
    met = rare.join(counts.hint("merge"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    log = lambda whole: F.log10((F.col("c") + 1) / F.lit(float(whole + 1))) * F.col("times")
    late = met.groupBy(F.col("key").alias("_key")).agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("_known"),
        F.sum(log(total + k.distinct)).alias("_base"),
        F.sum(log(sum(k.rest))).alias("_share"),
    )
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0)))
    return scored.join(late.hint("merge"), F.col("key") == F.col("_key"), "left").select(
        "doc_id",
        is_held_out().alias("held_out"),
        "n_tokens",
        plus("n_known", "_known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        plus("base", "_base").alias("base_score"),
        plus("score", "_share").alias("score"),
    )
