"""The language model is trained on every learning document."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from draftlake.llm import gated_lm as lm


def corpus(spark):
    rng, rows = random.Random(8), []
    for k in range(300):
        rows.append((k, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 90)))))
    rows += [(7, rows[7][1]), (None, "no id"), (800, None), (801, "w1 " * 900)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_every_learning_token_is_in_one_slice(spark, monkeypatch):
    monkeypatch.setattr(lm, "PIECE_TOKENS", 200)
    docs = corpus(spark)
    counts = lm.token_counts(docs).cache()
    k = lm.known(counts, model=20)
    read = lm.lessons(docs, k, 5).collect()
    got = Counter(t for r in read for t in np.frombuffer(r.ids, "<i4").tolist())
    assert {r.slice for r in read} == set(range(5)) and max(len(r.ids) for r in read) == 800
    assert [got[t] for t in range(21)] == k.token_counts().tolist()


def test_weights_are_averaged_over_all_slices(spark, monkeypatch):
    monkeypatch.setattr(lm, "SLICE_TOKENS", 2_500)
    docs = corpus(spark)
    counts = lm.token_counts(docs).cache()
    k, m = lm.fit(docs, counts, model=20)
    slices = -(-k.total // 2_500)
    read = sorted(lm.lessons(docs, k, slices).collect(), key=lambda r: (r["hash"], r.piece, r.ids))
    of = lambda s: [np.frombuffer(r.ids, "<i4").astype(np.int64) for r in read if r.slice == s]
    assert slices > 4
    want = lm.train(of(0), k.token_counts())
    rounds = min(lm.ROUNDS, slices - 1)
    for n in range(rounds):
        own = [of(s) for s in range(1, slices) if (s - 1) % rounds == n]
        made = [lm.train(d, k.token_counts(), 1, start=want, top_rate=lm.LATER_RATE * (1 - n / rounds)) for d in own]
        size = [sum(map(len, d)) for d in own]
        want.weights.update({name: sum(t * x.weights[name] for t, x in zip(size, made, strict=True)) / sum(size) for name in want.weights})
    for name, w in want.weights.items():
        np.testing.assert_allclose(m.weights[name], w, atol=2e-3)
