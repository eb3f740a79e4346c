"""The sample that comes to the driver is bounded by ids, not by rows of documents."""

from __future__ import annotations

from draftlake.llm import toxicity


def test_a_repeated_id_brings_one_text(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit_ordinal", lambda rows, grades, weight, levels: seen.append((len(rows), grades.tolist(), weight.tolist())))
    texts = [(1, f"text {k}") for k in range(40)] + [(2, "other"), (3, "bad")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    toxicity.fit(docs, labels)
    assert seen == [(3, [0, 0, 2], [1.0, 1.0, 1.0])]
