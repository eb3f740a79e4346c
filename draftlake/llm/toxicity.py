"""Toxicity by cumulative-link ordinal regression over sparse word features.

P(grade >= k) = sigmoid(w . x - t_k) with ordered thresholds t_1 < t_2 < ... and one weight
vector shared by all of them.  The result is the expected grade, the sum of those
probabilities.  The model is fitted on a bounded sample of labelled rows; every document is
scored by its whole text.
"""

from __future__ import annotations

import base64
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlake.llm.common import by_batch, utf8

# ---------------------------------------------------------------- fixed values
DIMENSIONS = 1 << 20
SAMPLE_PER_GRADE = 3000  # labelled rows of each grade that fitting may use
MIN_DOCUMENTS = 4  # of the sample that must hold a word for it to be a feature
STEPS = 250
RATE = 0.15
SPARSE = 5e-5  # pull of each weight towards zero
EDGE = b".,;:!?\"'()[]*&%$#-_"
SEED = 29
SLICES = 64  # of a grade's labelled rows, ranked apart
CACHE = 500_000
# ---------------------------------------------------------- end of fixed values


def grade(toxic: str = "toxic", quality: str = "quality") -> Column:
    """Severity from the labels: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    return F.when(F.col(toxic) == 0, 0).when((F.col(toxic) == 1) & (F.col(quality) == 0), 2).when(F.col(toxic) == 1, 1)


def feature(word: bytes) -> int:
    """Bucket of a word without case (A-Z) and outer punctuation."""
    return xxhash.xxh64_intdigest(word.lower().strip(EDGE) or word) & (DIMENSIONS - 1)


class Features(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = feature(word)
        return value

    def of(self, text: bytes | None) -> np.ndarray:
        """Distinct buckets of a text."""
        return np.unique(np.fromiter(map(self.__getitem__, set((text or b"").split())), np.int64))


@dataclass
class Ordinal:
    """Weights by bucket (only those that are not zero) and ordered thresholds."""

    weights: dict[int, float]
    thresholds: list[float]

    def packed(self) -> str:
        return base64.b64encode(pickle.dumps((self.weights, self.thresholds))).decode()

    @staticmethod
    def unpacked(data: str) -> Ordinal:
        return Ordinal(*pickle.loads(base64.b64decode(data)))

    def at_least(self, score: float) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        return 1 / (1 + np.exp(-(score - np.array(self.thresholds))))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, weight: np.ndarray, levels: int, steps: int = STEPS) -> Ordinal:
    """Maximum likelihood with a pull of the weights towards zero, by proximal Adam.

    ``rows`` are the buckets of each text, ``weight`` how many rows of the table it stands
    for.  Thresholds are a first value and positive gaps, so they stay ordered.
    """
    if not len(grades):
        return Ordinal({}, [30.0] * levels)
    flat = np.concatenate([*rows, np.zeros(0, np.int64)])
    buckets, column, held = np.unique(flat, return_inverse=True, return_counts=True)
    often = held >= MIN_DOCUMENTS
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    use = often[column]
    owner, column, buckets = owner[use], (np.cumsum(often) - 1)[column[use]], buckets[often]
    n, share = len(grades), weight / weight.sum()
    above = [np.clip(np.sum(share[grades >= k]), 1e-6, 1 - 1e-6) for k in range(1, levels + 1)]
    start = np.array([np.log((1 - a) / a) for a in above])
    w, first = np.zeros(len(buckets)), start[0]
    gaps = np.log(np.expm1(np.maximum(np.diff(start), 1e-3)))
    params, m, v = [w, np.array([first]), gaps], None, None
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        w, first, gaps = params
        cuts = first[0] + np.concatenate([[0.0], np.cumsum(np.log1p(np.exp(gaps)))])
        score = np.bincount(owner, w[column], n)
        # Likelihood of grade g is S(score - t_g) - S(score - t_(g+1)).
        s = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -40, 40)))
        full = np.concatenate([np.ones((n, 1)), s, np.zeros((n, 1))], axis=1)
        slope = full * (1 - full)
        row = np.arange(n)
        p = np.maximum(full[row, grades] - full[row, grades + 1], 1e-9)
        low, high = slope[row, grades] / p * share, slope[row, grades + 1] / p * share
        dscore = -(low - high)
        dcut = np.zeros(levels + 2)
        np.add.at(dcut, grades, low)
        np.add.at(dcut, grades + 1, -high)
        dcut = dcut[1 : levels + 1]
        dgap = np.cumsum(dcut[::-1])[::-1][1:] / (1 + np.exp(-gaps))
        grads = [np.bincount(column, dscore[owner], len(w)), np.array([dcut.sum()]), dgap]
        for k, g in enumerate(grads):
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            rate = RATE / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
            moved = params[k] - rate * m[k] / (1 - 0.9**step)
            params[k] = np.sign(moved) * np.maximum(np.abs(moved) - rate * SPARSE, 0) if k == 0 else moved
    w, first, gaps = params
    cuts = first[0] + np.concatenate([[0.0], np.cumsum(np.log1p(np.exp(gaps)))])
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return Ordinal(dict(zip(buckets[kept].tolist(), w[kept].tolist(), strict=True)), cuts.tolist())


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", per_grade: int = SAMPLE_PER_GRADE) -> Ordinal:
    """Fit on at most ``per_grade`` labelled rows of each grade, chosen by a hash of the id.

    Only distinct word buckets of one text of each of those ids come to the driver.  Rows are weighted so that
    the sample stands for all labelled rows.
    """
    known = labels.select(F.col(id).cast("long").alias("doc_id"), grade().alias("grade")).where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("grade").alias("grade"))
    total = {r[0]: r[1] for r in known.groupBy("grade").count().collect()}
    # First per slice of a grade, so that no task ranks all labelled rows of one.
    spot = F.xxhash64("doc_id", F.lit(SEED))
    ranked = known.withColumns({"spot": spot, "slice": F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(SLICES))})
    for keys in (["grade", "slice"], ["grade"]):
        order = Window.partitionBy(*keys).orderBy("spot", "doc_id")
        ranked = ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_grade)
    sample = ranked
    texts = docs.select(F.col(id).cast("long").alias("doc_id"), utf8(text).alias("text"))
    # The sample has at most per_grade rows of each of three grades.
    joined = texts.join(F.broadcast(sample.select("doc_id", "grade")), "doc_id")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        own = Features()
        for b in batches:
            yield {"doc_id": b["doc_id"], "grade": b["grade"], "buckets": [own.of(t).astype("<i4").tobytes() for t in b["text"]]}

    # One text of each id, the smallest by hash, so that repeated ids do not exceed the sample.
    chosen = F.min(F.struct(F.xxhash64("buckets").alias("hash"), "buckets", "grade")).alias("row")
    held = by_batch(joined, run, "doc_id long, grade int, buckets binary").groupBy("doc_id").agg(chosen)
    got = held.select("doc_id", "row.grade", "row.buckets").collect()
    got.sort(key=lambda r: r["doc_id"])
    grades = np.array([r["grade"] for r in got], np.int64)
    counts = np.bincount(grades, minlength=3)
    weight = np.array([total[g] / counts[g] for g in grades.tolist()])
    return fit_ordinal([np.frombuffer(r["buckets"], "<i4").astype(np.int64) for r in got], grades, weight, 2)


def score(docs: DataFrame, model: Ordinal, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, severity (0 to 2), p_toxic, grade, toxic.

    ``severity`` is the expected grade, ``grade`` the most probable one and ``toxic`` says
    that P(grade >= 1) is above one half.  A text counts each of its words once.  Null and
    empty texts are scored by the thresholds alone; repeated rows are scored alike; null ids
    pass through; extra columns are ignored; an empty table gives an empty result.
    """
    packed = model.packed()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        own = Ordinal.unpacked(packed)
        buckets = Features()
        for b in batches:
            scores = []
            for t in b["text"]:
                found = buckets.of(t).tolist()
                scores.append(sum(own.weights[k] for k in found if k in own.weights))
            p = 1 / (1 + np.exp(-np.clip(np.array(scores)[:, None] - np.array(own.thresholds), -40, 40)))
            full = np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1)
            yield {
                "doc_id": b["doc_id"],
                "severity": p.sum(axis=1),
                "p_toxic": p[:, 0],
                "grade": (full[:, :-1] - full[:, 1:]).argmax(axis=1).astype(np.int32),
                "toxic": p[:, 0] > 0.5,
            }

    source = docs.select(F.col(id).cast("long").alias("doc_id"), utf8(text).alias("text"))
    return by_batch(source, run, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def grade_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
