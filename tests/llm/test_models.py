"""Trained operators: gradients, held-out accuracy, defined results for odd rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from draftlake.llm import langid, toxicity

FOLDER = "/root/testdata/sf0.01"


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = langid.fresh(["a", "b", "c"], units=3)
    net.weights = {k: v.astype(np.float64) + 0.1 for k, v in net.weights.items()}
    codes = rng.integers(0, 256, (7, 4))
    codes[5:, 1] = 256
    labels = np.array([0, 1, 2, 1])
    loss, grad = langid.gradients(net, codes, labels)
    for name, w in net.weights.items():
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in w.shape)
            if name[0] == "x":
                at = (at[0], int(codes[rng.integers(0, 5), 0]))
            old, step = w[at], 1e-3
            w[at] = old + step
            up, _ = langid.gradients(net, codes, labels)
            w[at] = old - step
            down, _ = langid.gradients(net, codes, labels)
            w[at] = old
            assert abs((up - down) / (2 * step) - grad[name][at]) < 2e-4


def test_reader_equals_the_plain_network():
    net = langid.fresh(["a", "b"], units=5)
    texts = [b"short", b"", b"x" * 500, bytes(range(256)) * 3]
    got = langid.Reader(net, block=6).documents(texts)
    for text, p in zip(texts, got, strict=True):
        want = np.zeros(2)
        for at in range(0, len(text), langid.SPAN):
            codes = langid.encode([text[at : at + langid.SPAN]])
            both = np.concatenate([langid._states(net, codes, d) for d in "fb"], axis=1)
            q = langid._softmax(net.weights["o"] @ both + net.weights["c"])
            want += (q[:, :, 0] * (codes < 256)).sum(axis=0)
        assert np.allclose(p, want / max(1, len(text)), atol=1e-4)


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, score double"
    assert langid.identify(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, None, "en", 0.0), (3, "", "en", 0.0), (4, "12 $$ \n", "en", 0.0), (None, "das Haus", None, 0.0)]
    rows += [(k, "the house and the road", "en", 0.0) for k in range(5, 25)] + [(k, "x " * 40_000, "de", 0.0) for k in range(25, 35)]
    got = langid.identify(spark.createDataFrame(rows, schema)).collect()
    by_id = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by_id[1] == by_id[3] == by_id[4] == ("und", 0.0)
    assert {by_id[5][0], by_id[30][0], by_id[None][0]} <= {"en", "de"}
    nothing = langid.identify(spark.createDataFrame([(5, "the house", None, 0.0)], schema)).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]


def test_thresholds_stay_ordered_and_find_the_signal():
    rng = np.random.default_rng(2)
    rows, grades = [], []
    for _ in range(900):
        g = int(rng.choice(3, p=[0.7, 0.2, 0.1]))
        signs = [1] * (g >= 1) + [2] * (g == 2)
        rows.append(np.unique(np.concatenate([rng.integers(10, 400, 30), np.array(signs, np.int64)])))
        grades.append(g)
    grades = np.array(grades)
    model = toxicity.fit_ordinal(rows, grades, np.ones(900), 2)
    assert model.thresholds[0] < model.thresholds[1]
    expected = [model.at_least(sum(model.weights.get(k, 0.0) for k in r.tolist())).sum() for r in rows]
    assert np.mean(np.round(expected) == grades) > 0.97
    assert np.mean([e for e, g in zip(expected, grades, strict=True) if g == 2]) > np.mean([e for e, g in zip(expected, grades, strict=True) if g == 1])


@pytest.mark.parametrize("folder", [FOLDER])
def test_toxicity_on_the_table(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.grade_toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    known = [(r.toxic, got[r.doc_id]) for r in labels.collect() if r.doc_id in got]
    assert np.mean([r.toxic for t, r in known if t]) > 0.9
    assert np.mean([r.toxic for t, r in known if not t]) < 0.02
    assert all(0 <= r.severity <= 2 and r.p_toxic >= r.severity - r.p_toxic - 1e-9 for r in got.values())


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(None, None, 1.0), (1, "", 1.0), (2, "w " * 90_000, 1.0), (2, "w", 1.0)], "doc_id long, text string, severity double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert len(toxicity.grade_toxicity(docs, none).collect()) == 4
    odd = spark.createDataFrame([(2, None, 1), (1, None, 0), (None, 1, 1), (9, 1, None)], "doc_id long, quality int, toxic int")
    assert len(toxicity.grade_toxicity(docs, odd).collect()) == 4
    assert toxicity.grade_toxicity(docs.limit(0), odd).collect() == []
