"""Ordinal regression against plain Python: score, gradient at the optimum, the sample by slices."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from draftlake.llm import toxicity

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"


def corpus(seed=4):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(400):
        toxic, bad = k % 3 == 0, k % 6 == 0
        words = [f"w{rng.randrange(60)}" for _ in range(40)] + ["vile"] * toxic + ["awful", "vile,"] * bad
        rng.shuffle(words)
        docs.append((k, " ".join(words)))
        labels.append((k, 0 if bad else 1, int(toxic)))
    return docs + [(900, None), (901, "VILE vile awful!")], labels


def test_scores_like_plain_python(spark):
    docs, labels = corpus()
    table = spark.createDataFrame(docs, DOCS)
    model = toxicity.fit(table, spark.createDataFrame(labels, LABELS))
    assert model.thresholds == sorted(model.thresholds)
    text = dict(docs)
    for r in toxicity.score(table, model).collect():
        own = {toxicity.feature(w) for w in (text[r.doc_id] or "").encode().split()}
        s = sum(model.weights.get(b, 0.0) for b in own)
        p = [1 / (1 + math.exp(-(s - t))) for t in model.thresholds]
        grades = [1 - p[0], p[0] - p[1], p[1]]
        assert r.severity == pytest.approx(sum(p)) and r.p_toxic == pytest.approx(p[0])
        assert r.grade == int(np.argmax(grades)) and r.toxic == (p[0] > 0.5)


def loss(rows, grades, model):
    total = 0.0
    for own, g in zip(rows, grades, strict=True):
        s = sum(model.weights.get(int(b), 0.0) for b in own)
        edges = [1.0, *(1 / (1 + math.exp(-(s - t))) for t in model.thresholds), 0.0]
        total -= math.log(max(edges[g] - edges[g + 1], 1e-9))
    return total / len(rows) + toxicity.SPARSE * sum(map(abs, model.weights.values()))


def test_the_fit_is_close_to_a_minimum():
    docs, labels = corpus(7)
    reader = toxicity.Features()
    rows = [reader.of(t.encode()) for _, t in docs[:400]]
    grades = np.array([2 if x and not q else x for _, q, x in labels])
    model = toxicity.fit_ordinal(rows, grades, np.ones(len(rows)), 2)
    blank = toxicity.Ordinal(dict.fromkeys(model.weights, 0.0), model.thresholds)
    assert loss(rows, grades, model) < loss(rows, grades, blank) - 0.1

    def steepest(of):
        at, step = loss(rows, grades, of), 1e-4
        moved = [toxicity.Ordinal(of.weights | {name: of.weights[name] + sign * step}, of.thresholds) for name in list(of.weights)[:12] for sign in (1, -1)]
        return max((at - loss(rows, grades, m)) / step for m in moved)

    # Hardly any direction leads down any more, measured by the slopes at the start.
    assert steepest(model) < 0.1 * steepest(blank)


@pytest.mark.parametrize("per_grade", [5, 50])
def test_the_sample_is_the_first_of_each_grade(spark, per_grade, monkeypatch):
    docs, labels = corpus(9)
    seen = {}
    monkeypatch.setattr(toxicity, "fit_ordinal", lambda rows, grades, weight, levels: seen.update(grades=grades, weight=weight))
    toxicity.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), per_grade=per_grade)
    have = {g: sum(1 for _, q, x in labels if (2 if x and not q else x) == g) for g in range(3)}
    assert [int((seen["grades"] == g).sum()) for g in range(3)] == [min(per_grade, have[g]) for g in range(3)]
    assert seen["weight"].sum() == pytest.approx(len(labels))
