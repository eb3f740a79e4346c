"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of bytes in both directions, labels every position with a
distribution over the languages, and a document's probabilities are the mean over all its
positions.  It is trained in numpy by backpropagation through time on a bounded sample of
labelled rows; prediction covers every byte of every text.

Gates follow the form with the reset gate behind the recurrent product, so one matrix
product serves the three gates of a step.  Arrays are (units, windows): one step updates
all windows of a block at once.
"""

from __future__ import annotations

import base64
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlake.llm.common import by_batch

# ---------------------------------------------------------------- fixed values
UNITS = 8  # per direction
SPAN = 64  # bytes of a window
BLOCK = 1536  # windows that one step updates
SAMPLE_DOCS = 300  # labelled rows per language that training may use
SAMPLE_WINDOWS = 6  # windows drawn from each of them
EPOCHS = 5
BATCH = 256
RATE = 0.03
SEED = 17
UNKNOWN = "und"
# ---------------------------------------------------------- end of fixed values

LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    """Parameters: per direction an input table (3H x 256), recurrent weights and bias; output."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    def packed(self) -> str:
        return base64.b64encode(pickle.dumps((self.languages, self.weights))).decode()

    @staticmethod
    def unpacked(data: str) -> Network:
        return Network(*pickle.loads(base64.b64decode(data)))


def fresh(languages: list[str], units: int = UNITS, seed: int = SEED) -> Network:
    rng = np.random.default_rng(seed)
    w = {}
    for d in ("f", "b"):
        w[f"x{d}"] = rng.normal(0, 0.3, (3 * units, 257)).astype(np.float32)  # 256: behind the end
        w[f"u{d}"] = rng.normal(0, 1 / np.sqrt(units), (3 * units, units)).astype(np.float32)
        w[f"n{d}"] = np.zeros((units, 1), np.float32)
    w["o"] = rng.normal(0, 0.3, (len(languages), 2 * units)).astype(np.float32)
    w["c"] = np.zeros((len(languages), 1), np.float32)
    return Network(languages, w)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _states(net: Network, codes: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
    """Hidden states (T, H, B) of one direction over codes (T, B)."""
    x, u, bias = net.weights[f"x{d}"], net.weights[f"u{d}"], net.weights[f"n{d}"]
    units, (steps, width) = u.shape[1], codes.shape
    out = np.zeros((steps, units, width), np.float32)
    h = np.zeros((units, width), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        a = x[:, codes[t]]
        g = u @ h
        rz = _sigmoid(a[: 2 * units] + g[: 2 * units])
        r, z = rz[:units], rz[units:]
        inner = g[2 * units :] + bias
        n = np.tanh(a[2 * units :] + r * inner)
        if keep is not None:
            keep.append((t, h, r, z, n, inner))
        h = n + z * (h - n)
        out[t] = h
    return out


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-2, keepdims=True))
    return e / e.sum(axis=-2, keepdims=True)


def gradients(net: Network, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over positions and its gradient by backpropagation through time.

    ``codes`` is (T, B) with 256 behind a window's end; ``labels`` is (B,).
    """
    w, live = net.weights, (codes < 256).astype(np.float32)
    kept: dict[str, list] = {"f": [], "b": []}
    states = {d: _states(net, codes, d, kept[d]) for d in "fb"}
    both = np.concatenate([states["f"], states["b"]], axis=1)
    p = _softmax(w["o"] @ both + w["c"])
    total = live.sum()
    right = p[:, labels, np.arange(len(labels))]
    loss = float(-(np.log(np.maximum(right, 1e-9)) * live).sum() / total)
    p[:, labels, np.arange(len(labels))] -= 1
    ds = p * (live / total)[:, None, :]
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    grad["o"] = np.einsum("tlb,thb->lh", ds, both)
    grad["c"] = ds.sum(axis=(0, 2))[:, None]
    dboth = w["o"].T @ ds
    units = both.shape[1] // 2
    for k, d in enumerate("fb"):
        u, dx = w[f"u{d}"], np.zeros((257, 3 * units), np.float32)
        dh = np.zeros((units, codes.shape[1]), np.float32)
        for t, before, r, z, n, inner in reversed(kept[d]):
            dh = dh + dboth[t, k * units : (k + 1) * units]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (before - n) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            da = np.concatenate([dr, dz, dn])
            dg = np.concatenate([dr, dz, dn * r])
            grad[f"u{d}"] += dg @ before.T
            grad[f"n{d}"] += (dn * r).sum(axis=1, keepdims=True)
            np.add.at(dx, codes[t], da.T)
            dh = dh * z + u.T @ dg
        grad[f"x{d}"] = dx.T
    return loss, grad


def train(windows: list[bytes], labels: list[str], epochs: int = EPOCHS, units: int = UNITS, seed: int = SEED) -> Network:
    """Fit by Adam over shuffled batches; the same rows always give the same network."""
    languages = sorted(set(labels))
    net, rng = fresh(languages, units, seed), np.random.default_rng(seed)
    number = {x: k for k, x in enumerate(languages)}
    y = np.array([number[x] for x in labels], np.int64)
    codes = encode(windows)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    step, steps = 0, epochs * max(1, len(y) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at : at + BATCH]
            _, grad = gradients(net, codes[:, pick], y[pick])
            step += 1
            rate = RATE * (1 - 0.9 * step / max(steps, step))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                fixed = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                net.weights[k] = (net.weights[k] - rate * fixed).astype(np.float32)
    return net


def encode(windows: list[bytes], span: int = SPAN) -> np.ndarray:
    """Windows as columns of codes, 256 behind their end."""
    out = np.full((span, len(windows)), 256, np.int64)
    for k, text in enumerate(windows):
        part = np.frombuffer(text[:span], np.uint8)
        out[: len(part), k] = part
    return out


class Reader:
    """Prediction with buffers that are used again for every block."""

    def __init__(self, net: Network, block: int = BLOCK, span: int = SPAN) -> None:
        self.net, self.block, self.span = net, block, span
        self.half = {}
        units = self.units = net.weights["uf"].shape[1]
        for d in "fb":
            # Gates r and z are 1/2 + tanh(x/2)/2: halve their rows once, here.
            scale = np.r_[np.full(2 * units, 0.5), np.ones(units)].astype(np.float32)[:, None]
            x, u = net.weights[f"x{d}"] * scale, net.weights[f"u{d}"] * scale
            # r * inner = inner / 2 + tanh * inner / 2, so inner is halved as well.
            u[2 * units :] *= 0.5
            self.half[d] = (np.ascontiguousarray(x), np.ascontiguousarray(u), net.weights[f"n{d}"] * 0.5)
        self.states = np.empty((2, span, units, block), np.float32)
        self.a, self.g = np.empty((3 * units, block), np.float32), np.empty((3 * units, block), np.float32)
        self.t, self.h = np.empty((units, block), np.float32), np.empty((units, block), np.float32)

    def _run(self, codes: np.ndarray, d: str) -> np.ndarray:
        (x, u, bias), units, width = self.half[d], self.units, codes.shape[1]
        a, g, tmp, h = self.a[:, :width], self.g[:, :width], self.t[:, :width], self.h[:, :width]
        if width < self.block:
            a, g, tmp, h = (np.empty_like(v) for v in (a, g, tmp, h))
        out = self.states[0 if d == "f" else 1][:, :, :width]
        h[:] = 0
        steps = len(codes)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(x, codes[t], axis=1, out=a, mode="clip")
            np.matmul(u, h, out=g)
            rz, n, inner = a[: 2 * units], a[2 * units :], g[2 * units :]
            rz += g[: 2 * units]
            np.tanh(rz, out=rz)
            inner += bias
            n += inner
            inner *= rz[:units]
            n += inner
            np.tanh(n, out=n)
            # h = n + (1 + tanh)/2 * (h - n)
            np.subtract(h, n, out=tmp)
            tmp *= 0.5
            h *= 0.5
            n *= 0.5
            h += n
            tmp *= rz[units:]
            h += tmp
            out[t] = h
        return out

    def position_sums(self, codes: np.ndarray) -> np.ndarray:
        """Sum of the position probabilities of each window: (B, L)."""
        o, c = self.net.weights["o"], self.net.weights["c"]
        forward, backward = self._run(codes, "f"), self._run(codes, "b")
        left, right = o[:, : self.units], o[:, self.units :]
        total = np.zeros((len(c), codes.shape[1]), np.float32)
        for t in range(len(codes)):
            s = left @ forward[t]
            s += right @ backward[t]
            s += c
            np.exp(s, out=s)  # bounded: |states| <= 1
            s *= (codes[t] < 256) / s.sum(axis=0)
            total += s
        return total.T

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean position probabilities of each text, (N, L); zeros for empty texts."""
        sizes = np.array([len(t) for t in texts], np.int64)
        counts = -(-sizes // self.span)
        owner = np.repeat(np.arange(len(texts)), counts)
        flat = np.full((int(counts.sum()), self.span), 256, np.int16)
        row = 0
        for text, n in zip(texts, counts.tolist(), strict=True):
            flat[row : row + n].reshape(-1)[: len(text)] = np.frombuffer(text, np.uint8)
            row += n
        total = np.zeros((len(texts), len(self.net.languages)))
        for at in range(0, len(flat), self.block):
            part = flat[at : at + self.block]
            live = int((part < 256).sum(axis=1).max())
            codes = np.ascontiguousarray(part[:, :live].T).astype(np.intp)
            np.add.at(total, owner[at : at + self.block], self.position_sums(codes))
        return total / np.maximum(sizes, 1)[:, None]


def is_held_out(id: str = "doc_id") -> Column:
    """A quarter of the ids is never learned from."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 4 == 2, F.lit(False))


def training_sample(
    docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_DOCS, windows: int = SAMPLE_WINDOWS
) -> tuple[list[bytes], list[str]]:
    """Windows and labels of at most ``per_language`` labelled rows of each language.

    The rows with the smallest hashes of their id are taken; windows start at places that
    are spread over the whole text.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~is_held_out("doc_id"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id")
    places = F.sequence(F.lit(0), F.lit(windows - 1))
    room = F.greatest(F.lit(0), F.octet_length("text") - SPAN)
    raw = F.col("text").cast("binary")
    starts = F.array_distinct(F.transform(places, lambda k: (room * k / max(1, windows - 1)).cast("int")))
    cut = F.transform(starts, lambda s: F.substring(raw, s + 1, F.lit(SPAN)))
    picked = rows.select("doc_id", "lang", cut.alias("cut")).withColumn("place", F.row_number().over(order))
    got = picked.where(F.col("place") <= per_language).select("lang", "place", "cut").collect()
    got.sort(key=lambda r: (r["lang"], r["place"]))
    pairs = [(bytes(w), r["lang"]) for r in got for w in r["cut"]]
    return [w for w, _ in pairs], [x for _, x in pairs]


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", epochs: int = EPOCHS) -> Network:
    windows, labels = training_sample(docs, id, text, lang)
    return train(windows, labels, epochs)


def predict(docs: DataFrame, net: Network, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and the probability of every language (same order).

    Null texts, texts without any letter and, where nothing could be learned, all texts get
    ``und`` with score 0.  Every byte of a text counts, also the last one of a very long text.
    Other columns pass through; columns of the result's names must not exist.
    """
    packed, languages = net.packed(), net.languages

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        own = Network.unpacked(packed)
        reader = Reader(own) if languages else None
        for b in batches:
            texts = [t if t and LETTER.search(t) else "" for t in b["text"]]
            if reader is None:
                yield {"doc_id": b["doc_id"], "lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts)}
                continue
            p = reader.documents([t.encode() for t in texts])
            best = p.argmax(axis=1)
            score = np.clip(p[np.arange(len(p)), best], 0.0, 1.0)
            known = np.array([bool(t) for t in texts], bool)
            yield {
                "doc_id": b["doc_id"],
                "lang_pred": [languages[k] if on else UNKNOWN for k, on in zip(best.tolist(), known.tolist(), strict=True)],
                "score": np.where(known, score, 0.0),
            }

    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return by_batch(source, run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Fit on the rows that are not held out, then predict every row.

    One row per row of ``docs``: doc_id, held_out, lang_pred, score.  Rows without id are
    not held out.  An empty table gives an empty result.
    """
    out = predict(docs, fit(docs, id, text, lang), id, text)
    return out.select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score")
