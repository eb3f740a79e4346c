"""The pipeline's near-duplicate stage against all pairs."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 5) for i, t in rows], SCHEMA)


def similarity(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_every_pair_of_080_is_one_group(spark):
    rng, rows = random.Random(4), []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(90, 200))]
        for edits in (0, 1, 2, 3, 9):
            own = list(base)
            for k in rng.sample(range(len(own)), edits):
                own[k] = f"e{rng.randrange(99)}"
            rows.append((len(rows), " ".join(own)))
    group = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows:
            if i < j and similarity(a, b) >= 0.8:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    got = corpus_pipeline.one_of_each_group(spark, frame(spark, rows), "").collect()
    assert sorted(r.doc_id for r in got) == sorted(set(group.values()))
    assert 12 < len(got) < 36


def test_other_texts_under_one_id_stay(spark):
    rng = random.Random(7)
    a, b, c = ([f"w{rng.randrange(5000)}" for _ in range(100)] for _ in range(3))
    near = " ".join([*b[:-1], "edit"])
    a, b, c = map(" ".join, (a, b, c))
    rows = [(1, b), (5, a), (5, near), (5, c), (5, a), (None, a), (8, a.upper())]
    got = corpus_pipeline.one_of_each_group(spark, frame(spark, rows), "")
    assert got.columns == frame(spark, []).columns
    assert sorted(((r.doc_id or 0, r.text) for r in got.collect())) == sorted([(0, a), (1, b), (5, a), (5, c)])
