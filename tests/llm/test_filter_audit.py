"""Filter audit against a loop over documents."""

from __future__ import annotations

import itertools
import random
import re

import pytest

from draftlake.llm import filter_audit

DOCS = "doc_id long, text string, source string, part string, digest int, bits int, good int, n int"
LABELS = "doc_id long, quality int, toxic int, text string"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def slow_audit(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    failed = []
    for i, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }
        failed.append((source or "", {f for f, x in own.items() if x}, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in failed}:
        rows = [r for r in failed if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                fails = sum(f in r[1] for r in rows)
                shapley[f] += len(gone)
                alone = sum(r[1] == {f} for r in rows)
                out[part, order, k + 1] = [len(left), len(gone), fails - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def run(spark, docs, labels):
    table = spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in docs], DOCS)
    got = filter_audit.audit(table, spark.createDataFrame([(*r, "y") for r in labels], LABELS)).collect()
    found = {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in got}
    assert len(found) == len(got)
    return found


def corpus(seed):
    rng, docs = random.Random(seed), []
    for k in range(120):
        n = rng.choice([0, 3, 49, 50, 51, 120])
        base = rng.choice([5, 30, 60, 400])
        words = [f"w{rng.randrange(base)}é" for _ in range(n)]
        if rng.random() < 0.3:
            words = [w.upper() if rng.random() < 0.2 else w for w in words]
        if words and rng.random() < 0.3:
            words[rng.randrange(n)] = rng.choice(["a#b", "|", "50%", "$5", "r&d", "*"])
        docs.append((k, rng.choice([" ", "\n", "\t", " "]).join(words), rng.choice(["a", "b", "", None])))
    docs += [(200 + k, docs[k % 7][1], rng.choice("ab")) for k in range(60)]
    docs += [(300, None, "a"), (301, "", "c"), (302, None, None), (None, docs[3][1], "a"), (None, None, None), (5, docs[5][1], docs[5][2]), (5, "other", "a")]
    docs += [(-1, docs[9][1], "b"), (400, "W " * 30_000, "c")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9_999, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_like_a_loop(spark, seed):
    docs, labels = corpus(seed)
    assert run(spark, docs, labels) == slow_audit(docs, labels)


def test_one_text_in_most_rows(spark):
    docs = [(k, "same text", f"s{k % 3}") for k in range(3_000)] + [(k, f"t{k}", "s0") for k in range(3_000, 3_020)]
    got = run(spark, docs, [])
    assert got["s0", "EABCD", 1][:2] == [21, 999]
    assert got["s1", "EABCD", 1][:2] == [0, 1000]


def test_edges(spark):
    assert run(spark, [], [(1, 1, 1)]) == {}
    got = run(spark, [(1, None, None)], [])
    assert len(got) == 600 and {p for p, *_ in got} == {""}
    assert got["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]
