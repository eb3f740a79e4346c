"""The pipeline's stages on a small corpus against plain Python."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from draftlake.llm import mixing
from draftlake.llm.registry import vocabulary

WORDS = {"en": "the and with house from that road is not of", "de": "der und mit haus von daß straße ist nicht über"}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, rows = random.Random(9), []

    def text(lang, n):
        return " ".join(rng.choice(WORDS[lang].split()) + str(rng.randrange(30)) * (rng.random() < 0.3) for _ in range(n))

    item = " ".join(f"b{k}" for k in range(30))
    for k in range(90):
        lang = "en" if k % 3 else "de"
        rows.append((k, text(lang, rng.randrange(60, 200)), lang, f"s{k % 4}"))
    for k in range(90, 120):
        words = rows[k - 90][1].split()
        if k % 2:
            words[rng.randrange(len(words))] = "edit"
        rows.append((k, " ".join(words), "en", "s1"))
    for k in range(120, 130):
        words = text("en", 80).split()
        words[40:40] = item.split()
        rows.append((k, " ".join(words), "en", "s2"))
    rows += [(130, None, "en", "s0"), (131, "12 34 --", "en", "s0"), (132, text("de", 30_000), "de", None), (None, text("en", 90), "en", "s3")]
    folder = tmp_path_factory.mktemp("corpus")
    table = [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows


def slow_groups(texts):
    """The smallest id of each group of texts whose five-word shingles are 0.8 alike."""
    sets = {}
    for i, t in texts:
        words = (t or "").lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {i: low if x == high else x for i, x in label.items()}
    return set(label.values())


def test_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        seen[name] = docs.collect()
    ids = {name: [r.doc_id for r in out] for name, out in seen.items()}
    assert sorted(ids["language"], key=str) == sorted((i for i, *_ in rows if i not in (130, 131)), key=str)
    groups = slow_groups([(r.doc_id, r.text) for r in seen["language"] if r.doc_id is not None])
    assert sorted(ids["near_duplicates"], key=str) == sorted([*groups, None], key=str)
    assert set(ids["near_duplicates"]) - set(ids["decontamination"]) == {i for i in ids["near_duplicates"] if i in range(120, 130)}
    sizes = {r.doc_id: len((r.text or "").split()) for r in seen["decontamination"]}
    source = {r.doc_id: r.source for r in seen["decontamination"]}
    targets = mixing.source_targets(mixing.sizes(spark.createDataFrame(seen["decontamination"], docs.schema))).collect()
    for t in targets:
        own = [i for i in sizes if source[i] == t.source]
        taken = sum(sizes[i] for i in ids["mixture"] if source[i] == t.source)
        assert abs(taken - t.target) <= max(sizes[i] for i in own)
    assert max(ids["mixture"].count(i) for i in ids["mixture"]) <= 2


def test_run_gives_the_tokens_of_the_mixture(spark, corpus):
    from tokenizers import Tokenizer

    folder, rows = corpus
    got = corpus_pipeline.run(spark, folder).orderBy("start").collect()
    text, vocab, start = {i: t for i, t, *_ in rows}, Tokenizer.from_file(vocabulary()), 0
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys) and len(got) > 60
    for r in got:
        ids = np.array([*vocab.encode(text[r.doc_id], add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += r.n_tokens


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_other_texts_and_sources_under_one_id(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(f"a{rng.randrange(90)}" for _ in range(200)), "en", "a", 1) for k in range(300)]
    rows += [(k, f"three words {k}", "en", "b", 1) for k in range(300)] + [(7, "copy of a row", "en", "c", 1)] * 30
    rows += [(None, f"no id {k}", "en", "d", 1) for k in range(40)] + [(None, None, None, None, None), (900, "", "en", "a", 1)]
    names = ["copies", "copy", "number", "_id", "_digest", "key", "rows", "times", "row", "id", "digest"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(*r, *(f"{n}{r[0]}" for n in names)) for r in rows], schema)
    got = corpus_pipeline.mixture(spark, docs, "")
    assert got.columns == docs.columns
    got, given = [tuple(r) for r in got.collect()], {tuple(r) for r in docs.collect()}
    assert set(got) <= given
    taken, most = {}, {}
    for r in got:
        taken[r[3]] = taken.get(r[3], 0) + len((r[1] or "").split())
    for r in given:
        most[r[3]] = max(most.get(r[3], 0), len((r[1] or "").split()))
    for t in mixing.source_targets(mixing.sizes(docs)).collect():
        assert abs(taken.get(t.source, 0) - t.target) <= most[t.source]
    once = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert once.columns == docs.columns
    assert {tuple(r) for r in once.collect()} <= given


def test_a_language_is_rejected_by_its_score(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(WORDS[x].split()) for _ in range(80)), x, "s", 1) for k in range(120) for x in (("en", "de")[k % 2],)]
    short = [(500, "the house", "en", "s", 1), (501, "der und", "de", "s", 1)]
    odd = [(600, "\u4e2d\u6587" * 40, None, "s", 1), (601, "123", None, "s", 1), (602, "", None, "s", 1), (603, None, None, "s", 1)]
    docs = spark.createDataFrame(rows + short + odd, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, docs, "").collect()}
    assert kept >= {r[0] for r in rows + short} and not kept & {601, 602, 603}
