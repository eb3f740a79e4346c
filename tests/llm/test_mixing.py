"""Mixing against a plain water-filling and the rules of pivotal rounding."""

from __future__ import annotations

import random
import re

import pytest

from draftlake.llm import common, mixing

SCHEMA = "doc_id long, text string, source string, target double"


def rows_of(seed, n, sources):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        s = sources[0] if rng.random() < 0.4 else rng.choice(sources)
        text = rng.choice([None, "", " \n"]) if rng.random() < 0.05 else "w " * rng.randrange(1, 60)
        out.append((k, text, s, 1.0))
    return out


def slow_targets(rows):
    total = {}
    for _, t, s, _ in rows:
        total[s] = total.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_names, target = 1.5 * sum(total.values()), set(names), {}
    while open_names:
        unit = left / sum(weight[s] for s in open_names)
        over = {s for s in open_names if unit * weight[s] >= 2 * total[s]}
        if not over:
            target |= {s: unit * weight[s] for s in open_names}
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_names -= over
    return total, target


@pytest.mark.parametrize("sources", [["b", "a", "é", None, "a2"], ["only"], [f"s{k}" for k in range(25)]])
def test_targets_and_rounding(spark, sources):
    rows = rows_of(len(sources), 900, sources)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs, leaf_rows=20, fan=4).collect()
    total, target = slow_targets(rows)
    assert sorted(r.doc_id for r in got) == list(range(900))
    taken, largest = {}, {}
    source_of = {k: s for k, _, s, _ in rows}
    for r in got:
        s = source_of[r.doc_id]
        assert r.source == s and r.source_size == total[s] and abs(r.target - target[s]) < 1e-6
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[s] = taken.get(s, 0) + r.taken
        largest[s] = max(largest.get(s, 0), r.size)
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6
    again = mixing.mix(docs.repartition(7), leaf_rows=20, fan=4).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in got}


def test_transfer_is_unbiased_and_keeps_the_total():
    rng = random.Random(4)
    for _ in range(200):
        p, q, w, v = rng.random(), rng.random(), rng.randrange(1, 50), rng.randrange(1, 50)
        up, down = min(w * (1 - p), v * q), min(w * p, v * (1 - q))
        first, second = mixing.transfer(p, w, q, v, 0.0), mixing.transfer(p, w, q, v, 0.999999999)
        share = down / (up + down)
        for x, y in (first, second):
            assert abs(w * x + v * y - w * p - v * q) < 1e-9
            assert min(abs(x), abs(x - 1), abs(y), abs(y - 1)) < 1e-12
        assert abs(share * first[0] + (1 - share) * second[0] - p) < 1e-9
        assert abs(share * first[1] + (1 - share) * second[1] - q) < 1e-9


def test_edges(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    got = mixing.mix(spark.createDataFrame([(None, None, None, 0.0), (1, "", "a", 0.0)], SCHEMA)).collect()
    assert [r.taken for r in got] == [0, 0]
    same = [(1, "a b c", "s", 0.0)] * 40
    got = mixing.mix(spark.createDataFrame(same, SCHEMA), leaf_rows=5, fan=2).collect()
    assert sum(r.taken for r in got) == 180


def test_few_rows_are_written_by_few_tasks(spark, monkeypatch):
    """Each file written starts processes beside the JVM, so a level's files go with its rows, not with the exchange's partitions."""
    files, keep = {}, mixing.Scratch.keep

    def counted(self, name, df):
        out = keep(self, name, df)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(mixing.Scratch, "keep", counted)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = mixing.mix(spark.createDataFrame(rows_of(3, 900, ["a", "b", None]), SCHEMA), leaf_rows=20, fan=4).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    levels = {name: n for name, n in files.items() if name.startswith("level-")}
    assert got == 900 and len(levels) > 2 and max(levels.values()) <= 4


def test_words_are_counted_without_lists_of_them(spark, monkeypatch):
    monkeypatch.setattr(common, "SCAN", 7)
    rng = random.Random(8)
    texts = ["".join(rng.choice("a\u00e9\u4e2d\u00a0\u2003\x1c\x85 \t\n\v\f\r") for _ in range(rng.randrange(60))) for _ in range(300)] + ["", " ", "x" * 50, None]
    want = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert [common.word_count(None if t is None else t.encode()) for t in texts] == want
    sized = mixing.sizes(spark.createDataFrame([(k, t, "s", 0.0) for k, t in enumerate(texts)], SCHEMA))
    assert [r.size for r in sized.orderBy("doc_id").collect()] == want
    assert "regexp" not in sized._jdf.queryExecution().optimizedPlan().toString()
