"""Conversation repair against plain dynamic programming over whole conversations."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict

import pytest

from draftlake.llm import conversation_repair as repair

TABLE = "conv_id long, turn long, role string, text string, times int, first int, slice int, said int"
sys.setrecursionlimit(20_000)  # suffixes of a long conversation
WHITE = " \t\n\v\f\r"


def slow_best(rows):
    """(cost, audit) by suffixes; an insert more than twice in a row never pays."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @functools.cache
    def best(i, state, room):
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        fresh = "a" if state == "u" else "u"

        def go(cost, letter, j, to, left=2):
            tail = best(j, to, left)
            if tail is not None:
                found.append((cost + tail[0], letter + tail[1]))

        if room:
            go(3, "I", i, fresh, room - 1)
        if i < len(rows):
            initial, wrong = rows[i]
            go(4, "D", i + 1, state)
            if wrong not in "BD" or not wrong:
                go(3 + 3 * (wrong == "T"), "R", i + 1, fresh)
                if (state, initial) in after:
                    go(3 * (wrong == "T"), "K", i + 1, after[state, initial])
        return min(found) if found else None

    return best(0, "", 2)


def slow_repair(table):
    held = defaultdict(list)
    for conv, turn, role, text in table:
        rows, role, text = held[conv], " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 4:
            role = "user"
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        rows += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    out = {}
    for conv, rows in held.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in rows:
            left = text.rstrip(WHITE)
            faults.append("B" if not left else "D" if (role, text) in seen else "" if left[-1] in ".!?" else "T")
            seen.add((role, text))
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = slow_best(tuple(zip(initials, faults, strict=True)))
        lines, at, state = [], 0, ""
        for letter in audit:
            fresh = "a" if state == "u" else "u"
            if letter == "I":
                lines.append({"u": "user", "a": "assistant"}[fresh] + ":")
                state = fresh
                continue
            if letter == "K":
                lines.append(f"{rows[at][1]}:{rows[at][2]}")
                state = initials[at]
            elif letter == "R":
                lines.append({"u": "user", "a": "assistant"}[fresh] + ":" + rows[at][2])
                state = fresh
            at += 1
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        counts = [faults.count(f) for f in "BDT"]
        out[conv] = (gaps, *counts, illegal, cost, audit, sha)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_the_heaps_find_the_least_audit(seed):
    rng = random.Random(seed)
    for _ in range(250):
        rows = [(rng.choice([b"s", b"u", b"u", b"a", b"a", b" ", b""]), rng.choice(["", "", "", "B", "D", "T"])) for _ in range(rng.randrange(0, 10))]
        want = slow_best(tuple((a.decode() or "?", w) for a, w in rows))
        assert repair.cheapest(rows, (0,), repair.ACCEPTED) == want
        for size in (1, 3):
            table = {(0, 0): (0, "")}
            for at in range(0, len(rows), size):
                table = repair.combined(table, repair.table_of(rows[at : at + size]))
            if rows:
                assert min(v for (_, t), v in table.items() if t in repair.ACCEPTED) == want


def conversations(seed):
    rng, rows = random.Random(seed), []
    says = ["Yes.", "No!", "why?", "cut", " ", "", "long answer.\n", "ends \t", "ok. ", None, "ü."]
    for conv in range(120):
        for turn in range(rng.choice([1, 2, 5, 8])):
            role = "system" if turn == 0 and rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            if rng.random() < 0.1:
                role = rng.choice([None, "tool", "system", "user", "assistant"])
            text = rng.choice(says) if rng.random() < 0.4 else f"t{rng.randrange(10 ** 6)}."
            rows.append((conv, turn * (1 + (conv % 7 == 0)), role, text))
    for turn in range(300):
        rows.append((500, turn, ("user", "assistant")[rng.random() < 0.5], rng.choice(says + [f"t{turn}."] * 8)))
    rows += [(501, None, "user", "a."), (501, None, "assistant", "b."), (501, 3, "user", "a."), (502, None, None, None)]
    rows += [(None, 1, "user", "q."), (None, 2, "assistant", "r."), (None, None, "user", "s")]
    rows += [(503, 7, "user", "same.")] * 40 + [(503, 8, "assistant", "w " * 50_000 + ".")]
    gone = next(k for k in range(600, 900) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    return rows + [(gone, 1, "user", "never seen.")]


def run(spark, rows, slices=4, **options):
    spark.conf.set("spark.sql.shuffle.partitions", str(slices))
    try:
        got = repair.repair_damaged(spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], TABLE).repartition(3), **options).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    out = {r.conv_id: tuple(r)[1:] for r in got}
    assert len(out) == len(got)
    return out


@pytest.mark.parametrize("slices, options", [(4, {}), (23, {"segment": 16}), (2, {"segment": 5, "hold": 6})])
def test_repairs_like_plain_python(spark, slices, options):
    rows = conversations(slices)
    got, want = run(spark, rows, slices, **options), slow_repair(rows)
    assert set(got) == set(want)
    for conv in want:
        assert got[conv] == want[conv], conv


def test_edges(spark):
    assert run(spark, []) == {}
    nothing = hashlib.sha256(b"").hexdigest()
    gone = conversations(1)[-1]
    assert run(spark, [gone]) == {gone[0]: (0, 0, 0, 0, 0, 0, "", nothing)}
