"""Decontamination, token files, paragraphs and chats against plain Python."""

from __future__ import annotations

import itertools
import random
import re
import zlib

import numpy as np
import pytest

from draftlake.llm import chat, decontaminate, paragraphs, token_planes
from draftlake.llm.registry import vocabulary

DOCS = "doc_id long, text string, item_id long, n_words long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 5, 6) for i, t in rows], DOCS)


def sentence(rng, n, base=400):
    return [f"w{rng.randrange(base)}" for _ in range(n)]


# ---------------------------------------------------------------- decontamination
def slow_overlap(doc, item):
    """Most equal words over all ways to lay the item over the document."""
    clean = lambda t: [w.lower().strip(".,;:!?\"'()[]") or w for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    d, m, best = clean(doc), clean(item), 0
    for shift in range(-len(m) + 1, len(d)):
        low, high = max(0, -shift), min(len(m), len(d) - shift)
        equal = [m[k] == d[k + shift] for k in range(low, high)]
        for i in range(len(equal)):
            for j in range(i + 1, len(equal) + 1):
                if 5 * sum(equal[i:j]) >= 4 * (j - i):
                    best = max(best, sum(equal[i:j]))
    return best, min(10, -(-8 * len(m) // 10)) if m else 1


@pytest.mark.parametrize("block", [256, 16])
def test_leaks_like_all_alignments(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    rng = random.Random(11)
    items = [(k, " ".join(sentence(rng, n))) for k, n in enumerate([14, 20, 30, 59, 5, 3])] + [(90, None), (91, ""), (92, items_twice := "same item words " * 5), (93, items_twice)]
    docs = []
    for k in range(60):
        words = sentence(rng, rng.randrange(0, 120))
        if k % 3 == 0:
            own = (items[rng.randrange(6)][1]).split()
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = "changed"
            if rng.random() < 0.3:
                own = [w.upper() + "," for w in own]
            cut = rng.randrange(len(own) // 3 + 1)
            at = rng.randrange(len(words) + 1)
            words[at:at] = own[cut:]
        docs.append((k, " ".join(words)))
    docs += [(100, None), (101, ""), (102, items_twice), (103, " ".join(sentence(rng, 20_000)) + " " + items[2][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_equal for r in decontaminate.leaks(frame(spark, docs), bench).collect()}
    for (i, d), (k, m) in itertools.product(docs[:63], items):
        best, least = slow_overlap(d, m)
        assert ((i, k) in got) == (best >= least), (i, k)
        assert best == got.get((i, k), best)
    assert (103, 2) in got and (102, 92) in got and (102, 93) in got
    kept = decontaminate.without_leaks(frame(spark, docs), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in got}
    assert kept.columns == ["doc_id", "text", "item_id", "n_words"]


def test_leak_edges(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(frame(spark, [(1, "a b c")]), bench).collect() == []
    full = spark.createDataFrame([(None, "one two three four five six seven eight nine ten eleven"), (2, "x")], "item_id long, text string")
    assert decontaminate.leaks(frame(spark, []), full).collect() == []
    rows = [(None, "ONE two three four 5 six seven eight nine ten eleven twelve")] * 2
    got = decontaminate.leaks(frame(spark, rows), full).collect()
    assert [(r.doc_id, r.item_id, r.n_overlaps, r.n_equal) for r in got] == [(None, None, 2, 10)]


# ---------------------------------------------------------------- token files
TEXTS = [
    None,
    "",
    "Plain words, 12 of them; don't we'll it's!",
    "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>",
    "É été Straße ΑΣ ΣΑΣ İstanbul Kelvin Å ẞ ª º",
    "é café ́x a b c d​e",
    "日本語 текст العربية 😀😀 _x_ a_b 3.14 №5 ½ ²",
    "tab\tnl\nvt\x0bff\x0ccr\r \x1c\x1d \x85 end",
    "ering&&& a''s 's 'S x're \"q\" `~{|}",
    "long " * 30_000,
]


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


@pytest.mark.parametrize("bits,block,segment", [(False, 1 << 14, 1 << 18), (True, 1000, 40), (False, 7, 1)])
def test_token_round_trip(spark, tmp_path, bits, block, segment):
    rows = [(k * 3, t) for k, t in enumerate(TEXTS)] + [(6, "again"), (6, "again"), (None, "no id")]
    random.Random(0).shuffle(rows)
    path = f"{tmp_path}/tokens"
    token_planes.write_tokens(frame(spark, rows), path, vocabulary(), bits=bits, block=block, segment=segment)
    got = token_planes.read_tokens(spark, path).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert [r.doc_id for r in got] == [i for i, _ in order]
    start = 0
    for r, ids in zip(got, whole([t for _, t in order]), strict=True):
        raw = np.array(ids, "<u4").tobytes()
        assert (r.start, r.n_tokens, bytes(r.ids), r.ids_crc32) == (start, len(ids), raw, zlib.crc32(raw))
        start += len(ids)


def test_one_block_alone():
    ids = np.random.default_rng(1).integers(0, 1 << 32, 10_000, dtype=np.uint64).astype("<u4")
    for bits in (False, True):
        s = token_planes.Segment(token_planes.pack_segment([4, None], [9_000, 1_000], ids.tobytes(), bits, 512))
        assert (s.block(3) == ids[3 * 512 : 4 * 512]).all() and (s.block(19) == ids[19 * 512 :]).all()
        assert (s.ids() == ids).all() and s.missing.tolist() == [False, True]


def test_tokens_of_an_empty_table(spark, tmp_path):
    token_planes.write_tokens(frame(spark, []), f"{tmp_path}/t", vocabulary())
    assert token_planes.read_tokens(spark, f"{tmp_path}/t").collect() == []


# ---------------------------------------------------------------- paragraphs
def slow_clusters(rows, least=20):
    sets = {}
    for i, t in rows:
        for n, line in enumerate((t or "").lower().split("\n")):
            words = line.split()
            if i is not None and len(words) >= least:
                sets[i, n] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    members = {}
    for k in sets:
        members.setdefault(find(k), []).append(k)
    return {k: (r, len(m)) for r, m in members.items() if len(m) > 1 for k in m}


@pytest.mark.parametrize("block", [256, 4])
def test_paragraphs_like_all_pairs(spark, block):
    rng = random.Random(8)
    bases = [sentence(rng, n, 5000) for n in (25, 40, 60, 90, 200)]
    rows = []
    for k in range(70):
        lines = [" ".join(sentence(rng, rng.randrange(5, 50), 5000)) for _ in range(rng.randrange(3))]
        own = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            own[rng.randrange(len(own))] = f"e{rng.randrange(3)}"
        line = " ".join(own)
        lines.insert(rng.randrange(len(lines) + 1), line.upper() if rng.random() < 0.2 else line)
        rows.append((k, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "x " * 30_000), (203, "y " * 30 + "\n" + "y " * 30)]
    want = slow_clusters(rows)
    got = paragraphs.repeated_paragraphs(frame(spark, rows), block=block).collect()
    assert {(r.doc_id, r.paragraph): ((r.cluster_doc, r.cluster_paragraph), r.n_members) for r in got} == want
    assert all(r.removed == ((r.doc_id, r.paragraph) != (r.cluster_doc, r.cluster_paragraph)) for r in got)


def test_paragraph_edges(spark):
    assert paragraphs.repeated_paragraphs(frame(spark, [])).collect() == []
    line = " ".join(f"q{k}" for k in range(25))
    rows = [(None, line), (3, line), (3, line), (4, "short\n" + line), (5, "alone " + " ".join(f"z{k}" for k in range(30)))]
    found = paragraphs.repeated_paragraphs(frame(spark, rows))
    assert sorted((r.doc_id, r.paragraph, r.cluster_doc, r.n_members, r.removed) for r in found.collect()) == [
        (3, 0, 3, 3, False),
        (3, 0, 3, 3, False),
        (4, 1, 3, 3, True),
    ]
    left = paragraphs.without_repeats(frame(spark, rows[3:]), found).collect()
    assert {r.doc_id: r.text for r in left}[4] == "short"


def test_bands_reach_the_recall():
    n = paragraphs.bands()
    assert (1 - 0.8**paragraphs.ROWS) ** n <= paragraphs.MISS < (1 - 0.8**paragraphs.ROWS) ** (n - 1)


# ---------------------------------------------------------------- chats
def slow_chats(rows):
    talks = {}
    for c, t, r, x in set(rows):
        if c is not None:
            talks.setdefault(c, []).append(((t is not None, t or 0, r or "", x or "", r is not None, x is not None), (r, x)))
    whole = {c: tuple(v for _, v in sorted(p, key=lambda p: (p[0]))) for c, p in talks.items()}
    out = {}
    for c, talk in whole.items():
        longer = any(len(o) > len(talk) and o[: len(talk)] == talk for o in whole.values())
        same = sorted(o for o, t in whole.items() if t == talk)
        if not longer and same[0] == c:
            out[c] = (len(talk), len(same), "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in talk))
    return out


def test_chats_like_prefix_search(spark):
    rng = random.Random(6)
    rows, texts = [], ["hi", "ok", "", None, "x" * 50_000]
    for c in range(60):
        if c % 2 and c > 2:
            talk = [r for r in rows if r[0] == c - 1]
            cut = rng.randrange(len(talk) + 1)
            talk = [(c, *r[1:]) for r in talk[:cut]]
        else:
            talk = []
        n = len(talk)
        talk += [(c, n + k, rng.choice(["user", "assistant", None]), rng.choice(texts[:4])) for k in range(rng.randrange(0, 3))]
        rows += talk
    rows += [(None, 0, "user", "lost"), (70, None, "user", "a"), (70, 1, "user", "b"), (71, 0, "user", texts[4]), (72, 3, "u", "t"), (72, 3, "u", "t"), (72, 3, "u", "s")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place long")
    got = {}
    for r in chat.format_chats(turns).orderBy("conv_id", "place").collect():
        n, m, text = got.get(r.conv_id, (r.n_turns, r.n_copies, ""))
        got[r.conv_id] = (n, m, text + r.rendered)
    assert got == slow_chats(rows)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(empty).collect() == []
