"""The pipeline's near-duplicate stage takes candidates from op6's ball search."""

from __future__ import annotations

import random

import corpus_pipeline
from draftlake.llm import paragraphs, simhash
from draftlake.llm.common import Scratch


def test_links_of_the_ball_search_are_candidates(spark):
    rows = [(1, 0b1111 << 40, 0), (2, 0b0011 << 40, 0), (3, 0b1111 << 40, 0), (4, -1, 0)]
    distinct = spark.createDataFrame(rows, "pid long, fp long, more int")
    got = {tuple(r) for r in paragraphs.alike(Scratch(spark), distinct.select("pid", "fp")).collect()}
    assert got == {(1, 3), (1, 2)}


def test_the_stage_runs_the_ball_search(spark, monkeypatch):
    rng, asked, links = random.Random(3), [], simhash.links
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(6)]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)] + [(9, texts[2].upper().replace(" ", "\n"), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(simhash, "links", lambda scratch, prints, *more: asked.append(prints.count()) or links(scratch, prints, *more))
    got = corpus_pipeline.one_of_each_group(spark, docs, "").collect()
    assert asked == [6] and sorted(r.doc_id for r in got) == [0, 1, 2, 3, 4, 5]
