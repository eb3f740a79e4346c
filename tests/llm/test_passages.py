"""Repeated passages anywhere in a text against plain Python."""

from __future__ import annotations

import random

from test_text_ops import frame, sentence

from draftlake.llm import paragraphs, passages


def wrapped(words, n):
    return "\n".join(" ".join(words[k : k + n]) for k in range(0, len(words), n))


def test_a_passage_inside_lines_and_across_breaks(spark):
    rng = random.Random(3)
    passage = sentence(rng, 60, 10**6)

    def around(a, b):
        return sentence(rng, a, 10**6) + passage + sentence(rng, b, 10**6)

    rows = [(1, " ".join(around(70, 70))), (2, wrapped(around(33, 51), 10)), (3, " ".join(around(120, 20))), (4, wrapped(passage, 10)), (5, " ".join(passage))]
    found = passages.repeated_passages(frame(spark, rows))
    got = sorted((r.doc_id, r.first_word, r.n_words, r.cluster_doc, r.removed) for r in found.collect())
    # 5 is the hard-wrapped 4 on one line, so the paragraphs link them; the rest are runs.
    assert got == [
        (1, 70, 60, 1, False),
        (2, 33, 60, 1, True),
        (3, 120, 60, 1, True),
        (4, 0, 60, 1, True),
        (4, 0, 60, 4, False),
        (5, 0, 60, 4, True),
    ]
    left = {r.doc_id: r.text.split() for r in paragraphs.without_repeats(frame(spark, rows), found).collect()}
    for i, t in rows:
        words = t.split()
        k = words.index(passage[0])
        assert left[i] == (words if i == 1 else words[:k] + words[k + 60 :])


def test_runs_like_all_windows(spark):
    rng = random.Random(6)
    pool = [sentence(rng, n, 10**6) for n in (49, 50, 51, 75, 130)]
    rows = []
    for k in range(60):
        words = sentence(rng, rng.randrange(0, 120), 10**6)
        for _ in range(rng.randrange(3)):
            own, at = rng.choice(pool), rng.randrange(len(words) + 1)
            cut = rng.randrange(len(own) // 2)
            words[at:at] = own[cut:] if rng.random() < 0.5 else own
        rows.append((k, wrapped(words, rng.choice([7, 30, 1000]))))
    rows += [(100, "x " * 400), (101, None), (102, "")]
    found = passages.repeated_runs(frame(spark, rows), passages.repeated_paragraphs(frame(spark, rows)).where("false")).collect()
    texts, first = {i: (t or "").split() for i, t in rows}, {}
    gone, stay = set(), set()
    for i, words in texts.items():
        for k in range(len(words) - 49):
            key = tuple(words[k : k + 50])
            (gone if first.setdefault(key, (i, k)) != (i, k) else stay).update((i, p) for p in range(k, k + 50))
    counted = {}
    for i, words in texts.items():
        for k in range(len(words) - 49):
            counted.setdefault(tuple(words[k : k + 50]), []).append((i, k))
    stay = {(i, p) for places in counted.values() if len(places) > 1 for i, k in places[:1] for p in range(k, k + 50)}
    removed = {(r.doc_id, p) for r in found if r.removed for p in range(r.first_word, r.first_word + r.n_words)}
    assert removed == gone - stay
    assert {(r.doc_id, p) for r in found if not r.removed for p in range(r.first_word, r.first_word + r.n_words)} == stay
    assert passages.repeated_passages(frame(spark, [])).collect() == []
