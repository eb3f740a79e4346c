"""SimHash, exact and line deduplication against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from draftlake.llm import exact_dedup, line_dedup, simhash
from draftlake.llm.common import Scratch
from draftlake.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, fp string, size long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "x", 7) for i, t in rows], SCHEMA)


def slow_fingerprint(text, width=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, distance=4):
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in prints:
        for j, b in prints:
            if i < j and bin(a ^ b).count("1") <= distance:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in prints}


def words(rng, n):
    return " ".join(rng.choice("the And of ab cd ef gh ij Kl mn op qr st uv été".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(5)
    rows = []
    for base in range(14):
        text = words(rng, 150).split()
        for _ in range(6):
            copy = list(text)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = "edit"
            rows.append(" ".join(copy))
    rows += [None, "", " \n\t", "one", "One", "a b c d", "a  b\nc\td e", words(rng, 30_000)]
    rng.shuffle(rows)
    return [(3 * k + 1, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("hot,block", [(50_000, 2_000_000), (1, 3_000)])
def test_simhash_like_all_pairs(spark, near_rows, hot, block):
    got = simhash.near_duplicates(frame(spark, near_rows), hot_prefix=hot, block=block).collect()
    prints = [(i, slow_fingerprint(t)) for i, t in near_rows]
    want = slow_components(prints)
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints}
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(want)


def test_ball_links_at_every_distance():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [base]
    for d in range(1, 6):
        masks = [sum(1 << int(b) for b in rng.choice(64, d, replace=False)) for _ in base]
        near.append(base ^ np.array(masks, np.uint64))
    fps = np.unique(np.concatenate(near))
    for block in (10_000_000, 500):
        links = list(simhash.collide(fps, fps, np.full(len(fps), 2), 64, 4, block))
        edges = [(int(a), int(b)) for x, y in links for a, b in zip(x, y, strict=True)]
        got = slow_components([(int(f), int(f)) for f in fps])
        root = {int(f): int(f) for f in fps}

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in edges:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        assert {f: find(f) for f in root} == got


def test_simhash_edges(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
    got = simhash.near_duplicates(frame(spark, [(None, "x"), (4, "x"), (4, "x"), (None, "only here and nowhere else")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 4), (4, 4), (4, 4)]


def test_components_of_a_long_path_and_a_star(spark):
    rng = random.Random(1)
    path = [(k, k + 1) for k in range(300)]
    star = [(1000, 1000 + k) for k in range(1, 200)]
    pairs = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in path + star + [(5, 5), (7, 8)]]
    got = components(Scratch(spark), spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == {k: 0 for k in range(1, 301)} | {1000 + k: 1000 for k in range(1, 200)}
    assert components(Scratch(spark), spark.createDataFrame([], "a long, b long")).collect() == []


def slow_exact(rows):
    norm = {}
    for k, (_, t) in enumerate(rows):
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(k)
    out = []
    for text, ks in norm.items():
        keep = min(rows[k][0] for k in ks)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(rows[k][0], keep, len(ks), rows[k][0] == keep, digest) for k in ks]
    return sorted(out)


@pytest.mark.parametrize("bits,huge", [(31, 1 << 20), (31, 100), (5, 100)])
def test_exact_duplicates(spark, bits, huge):
    rng = random.Random(bits)
    rows = [None, "", " ", "\n\t ", " a", "a", "a ", "a b", "a b", "a \n b", "x" * 70_000, "x" * 70_000, "x" * 69_999 + "y"]
    big = words(rng, 40_000)
    rows += [big, big.replace(" ", "\t\n"), big[:-1] + "#", "é" * 65_536, "é" * 65_536]
    rows += [f"w{rng.randrange(12)}" for _ in range(60)]
    rng.shuffle(rows)
    rows = [(k * 2, t) for k, t in enumerate(rows)]
    got = exact_dedup.exact_duplicates(frame(spark, rows), bits=bits, huge=huge).collect()
    assert sorted(tuple(r) for r in got) == slow_exact(rows)


def test_exact_edges(spark):
    assert exact_dedup.exact_duplicates(frame(spark, [])).collect() == []
    rows = [(5, "a b"), (5, "a b"), (5, "other"), (None, "a  b"), (None, "lone")]
    got = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size) for r in got) == [(-1, -1, 1), (-1, 5, 3), (5, 5, 1), (5, 5, 3), (5, 5, 3)]


def test_polynomial_composes():
    poly, data = exact_dedup.Polynomial(), np.random.default_rng(0).integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    plain = [0, 0]
    for byte in data[:5000]:
        plain = [(v * b + byte) % p for v, b, p in zip(plain, exact_dedup.BASES, poly.primes, strict=True)]
    assert poly.whole(data[:5000]) == plain
    left, right = poly.whole(data[:123_457]), poly.whole(data[123_457:])
    joined = [(x + y) % p for x, y, p in zip(poly.shift(left, len(data) - 123_457), right, poly.primes, strict=True)]
    assert poly.whole(data) == joined


def slow_lines(rows, min_chars=10):
    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)

    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        stay = [x for x in parts if len(holders.get(key(x), ())) < 2 or i == min(holders[key(x)])]
        out.append((i, len(parts), len(parts) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out)


def test_lines(spark):
    rng = random.Random(2)
    pool = ["A shared Line of text", "  a shared line OF text\t", "short", "éééééééééé", "ééééééééé", "kept é line É", "KEPT é LINE É", "KEPT é LINE é", ""]
    rows = [(k, "\n".join(rng.choice(pool + [f"unique line {k} {n}"]) for n in range(rng.randrange(7)))) for k in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "line\r\nline\r"), (104, "a line only here\na line only here"), (105, "x" * 300_000 + "\nA shared line of text")]
    got = line_dedup.digest(line_dedup.drop_repeated_lines(frame(spark, rows))).collect()
    assert sorted(tuple(r) for r in got) == slow_lines(rows)


def test_line_edges(spark):
    assert line_dedup.drop_repeated_lines(frame(spark, [])).collect() == []
    rows = [(None, "the same line here"), (1, "the same line here"), (1, "the same line here"), (2, "the same line here")]
    got = line_dedup.drop_repeated_lines(frame(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.n_dropped) for r in got) == [(-1, 0), (1, 0), (1, 0), (2, 1)]
