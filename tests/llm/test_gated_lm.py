"""Language model: gradients, whole-document scores and counts against plain Python."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from draftlake.llm import gated_lm

DOCS = "doc_id long, text string, word string, c int, key int, rare int, score int"


def small_model(seed=3, tokens=11):
    counts = np.random.default_rng(seed).integers(1, 60, tokens)
    return gated_lm.fresh(counts, units=4, classes=3, seed=seed)


def test_gradients_like_differences():
    m, rng = small_model(), np.random.default_rng(1)
    m.weights = {k: v.astype(np.float64) for k, v in m.weights.items()}
    inputs, targets = rng.integers(0, 11, (6, 3)), rng.integers(0, 11, (6, 3))
    first, live = rng.random((6, 3)) < 0.2, rng.random((6, 3)) < 0.8
    h = rng.normal(0, 0.5, (4, 3))
    _, grad, _ = gated_lm.gradients(m, inputs, targets, first, live, h)
    for name, w in m.weights.items():
        for _ in range(6):
            at, step = tuple(rng.integers(0, n) for n in w.shape), 1e-3
            held = w[at]
            w[at] = held + step
            up = gated_lm.gradients(m, inputs, targets, first, live, h)[0]
            w[at] = held - step
            down = gated_lm.gradients(m, inputs, targets, first, live, h)[0]
            w[at] = held
            assert grad[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-3)


def test_probabilities_of_a_position_add_up():
    m = small_model()
    s = np.random.default_rng(2).normal(0, 1, (5, 4)).astype(np.float32)
    whole = sum(np.exp(gated_lm.log_likelihood(m, s.T[None], np.full((1, 5), t))) for t in range(11))
    assert whole[0] == pytest.approx(np.ones(5), abs=1e-5)


def slow_score(m, tokens):
    h, ahead, total = np.zeros((4, 1), np.float32), 0, 0.0
    for t in tokens:
        h = gated_lm.states(m, np.array([[ahead]]), np.zeros((1, 1), bool), h)[-1]
        total += float(gated_lm.log_likelihood(m, h[None], np.array([[t]]))[0, 0])
        ahead = t
    return total


@pytest.mark.parametrize("wide, steps", [(1, 5), (3, 4), (64, 1000)])
def test_the_state_is_carried_over_windows(wide, steps):
    m, rng = small_model(), np.random.default_rng(4)
    docs = [rng.integers(0, 11, n) for n in [1, 40, 3, 7, 1, 25, 2]]
    assert gated_lm.document_scores(m, docs, wide, steps) == pytest.approx([slow_score(m, d) for d in docs], abs=1e-3)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(5)
    docs = [np.r_[np.tile([2, 3, 4, 5], rng.integers(5, 20)), 0] for _ in range(60)]
    counts = np.bincount(np.concatenate(docs), minlength=6)
    before, after = gated_lm.fresh(counts, 8, 3), gated_lm.train(docs, counts, 60, 8, 3)
    again = gated_lm.train(docs, counts, 60, 8, 3)
    assert all((after.weights[k] == again.weights[k]).all() for k in after.weights)
    assert gated_lm.document_scores(after, docs).mean() > 0.4 * gated_lm.document_scores(before, docs).mean()


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(gated_lm, "PIECE", 10)
    text = ("Ab cdefghijklmnop q\n" * 9).encode() + b"x" * 50
    assert [w for p in gated_lm.words_of(text) for w in p] == text.lower().split()


def tokens_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]


def is_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def corpus():
    rng, rows = random.Random(6), []
    for k in range(160):
        base = [f"a{j}" for j in range(40)] if k % 2 else [f"B{j}É" for j in range(40)]
        words = [rng.choice(base[: rng.randrange(1, 41)]) for _ in range(rng.randrange(1, 120))] + [f"r{rng.randrange(60)}" for _ in range(3)]
        rows.append((k, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(300, None), (301, ""), (302, None), (None, "a1 a2"), (None, None), (5, rows[5][1]), (5, "a1 other"), (303, "a3 " * 20_000 + "new")]
    return rows + [(next(i for i in range(400, 500) if is_out(i)), "never met words never A1")]


@pytest.mark.parametrize("head, model", [(131_072, 4_096), (30, 12), (12, 12), (1, 1)])
def test_scores_like_plain_counts(spark, head, model):
    rows = corpus()
    got = gated_lm.score(spark.createDataFrame([(*r, "w", 1, 2, 3, 4) for r in rows], DOCS), head=head, model=model).collect()
    counts = Counter(t for i, x in rows if not is_out(i) for t in tokens_of(x))
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for i, x in rows:
        own = tokens_of(x)
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own)
        want.append((i, is_out(i), len(own), sum(counts[t] > 0 for t in own), total, round(base, 5)))
    key = lambda r: (r[0] is None, str(r))
    assert sorted([(*r[:5], round(r.base_score, 5)) for r in got], key=key) == sorted(want, key=key)
    assert all(r.score < 0 for r in got)
    same = [r.score for r in got if r.doc_id in (300, 301, 302)]
    assert max(same) - min(same) < 1e-4


def test_the_model_beats_the_counts(spark):
    got = gated_lm.score(spark.createDataFrame([(*r, "w", 1, 2, 3, 4) for r in corpus()], DOCS)).collect()
    out = [r for r in got if r.held_out and r.n_tokens > 20]
    assert len(out) > 8 and sum(r.score for r in out) > sum(r.base_score for r in out)


def test_nothing_to_score_or_to_learn(spark):
    assert gated_lm.score(spark.createDataFrame([], DOCS)).collect() == []
    out = next(i for i in range(100) if is_out(i))
    row = gated_lm.score(spark.createDataFrame([(out, "a b", "w", 1, 2, 3, 4)], DOCS)).collect()
    assert [tuple(r) for r in row] == [(out, True, 3, 0, 0, 0.0, 0.0)]


def test_training_takes_one_softmax_a_window(monkeypatch):
    rng = np.random.default_rng(6)
    docs = [np.r_[rng.integers(1, 40, n), 0] for n in (70, 3, 150, 1, 33)]
    counts = np.bincount(np.concatenate(docs), minlength=40)
    own, calls = gated_lm.gradients, []
    monkeypatch.setattr(gated_lm, "log_likelihood", lambda *a: pytest.fail("scores are taken a second time"))
    monkeypatch.setattr(gated_lm, "gradients", lambda *a: calls.append(own(*a)[0]) or own(*a))
    after = gated_lm.train(docs, counts, 2, 8, 3)
    assert len(calls) > 2 and np.isfinite(calls).all()
    assert all(w.flags.c_contiguous for w in after.weights.values())


def test_a_long_document_is_scored_in_few_windows(monkeypatch):
    m, rng, own, places = small_model(), np.random.default_rng(8), gated_lm.log_likelihood, []
    monkeypatch.setattr(gated_lm, "log_likelihood", lambda m, h, at, *a: places.append(at.size) or own(m, h, at, *a))
    docs = [rng.integers(0, 11, n) for n in [4_000, 900, *[50] * 62]]
    got = gated_lm.document_scores(m, docs, 64, 32)
    assert max(places) <= 64 * 32 and len(places) < 20
    assert got == pytest.approx([slow_score(m, d) for d in docs], rel=1e-5)


def test_gates_far_from_zero():
    m = small_model()
    m.weights["x"] *= 1e4
    docs = [np.array([1, 5, 9, 3, 0])]
    assert gated_lm.document_scores(m, docs) == pytest.approx([slow_score(m, docs[0])], rel=1e-4)
