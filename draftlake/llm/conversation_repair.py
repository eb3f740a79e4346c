"""Repair of conversation structure by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows read, state of the role pattern); edits keep, rerole or
delete the next row or insert one.  A forward and a reverse heap meet in the middle, go on
until no crossing of the same cost can be missing, and the least concatenated audit of all
crossings is taken.

Rows are dealt in order to slices of bounded size, whatever conversation they belong to.  A
conversation inside one slice is repaired there.  Of one that spans slices each part gives a
table: the cheapest audit from every state to every state; tables of consecutive parts
combine, since for fixed ends the least audit consists of least parts.  Long parts are cut
into segments that combine in the same way, so no lattice is large.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import Scratch, by_batch, partitions, utf8

# ---------------------------------------------------------------- fixed values
REROLE = INSERT = TRUNCATED = 3
DELETE = 4
ENDS = b".!?"
NAMES = {"u": b"user", "a": b"assistant"}
# States: 0 nothing yet, 1 after the system row, 2 after a user, 3 after an assistant.
LEGAL = ({b"s": 1, b"u": 2}, {b"u": 2}, {b"a": 3}, {b"u": 2})
NEEDED = ("u", "u", "a", "u")  # what may be inserted or reroled to in a state
NEXT = (2, 2, 3, 2)  # and the state behind it
ACCEPTED = (0, 3)
PAIRS = (b"su", b"ua", b"au")  # neighbours of a sound conversation
SEGMENT = 256  # rows of one lattice
HOLD = 20_000  # rows of a conversation whose texts a task holds
# ---------------------------------------------------------- end of fixed values

WHITE = b" \t\n\v\f\r"
BLANK, DUPLICATE, CUT, SOUND = "B", "D", "T", ""
Row = tuple[bytes, str]  # initial of the role, first fault
Best = tuple[int, str]  # cost, audit


def damaged(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, times): rows with planted faults, set by a CRC of id and turn.

    Null roles and texts are one space, as are nulls in what the CRC reads.  Dropped rows
    stay as places without a text, read no times, so no conversation disappears.
    """
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    rows = convs.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), space(F.col(role)).alias("role"), space(F.col(text)).alias("text"))
    code = F.crc32(F.concat_ws(":", space(F.col("conv_id")), space(F.col("turn"))).cast("binary")) % 20
    rows = rows.withColumn("code", code)
    at = lambda k: F.col("code") == k
    return rows.select(
        "conv_id",
        "turn",
        F.when(at(0), F.lit("")).when(at(4), F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(at(0) | at(1), F.lit("")).when(at(2), F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(at(0), 0).when(at(3), 2).otherwise(1).cast("long").alias("times"),
    )


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times, first): equal rows of a turn together.

    ``first`` says that role and text stand in no earlier turn of the conversation.
    """
    whole = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    whole = whole.withColumn("said", said)
    met = whole.where(F.col("times") > 0).groupBy(F.col("conv_id").alias("_conv"), F.col("said").alias("_said"))
    met = met.agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("least"))
    joined = whole.join(met, same(F.col("conv_id"), F.col("_conv")) & (F.col("said") == F.col("_said")), "left")
    return joined.select("conv_id", "turn", "role", "text", "times", same(F.col("turn"), F.col("least.turn")).alias("first"))


def fault(text: bytes, first: bool) -> str:
    left = text.rstrip(WHITE)
    if not left:
        return BLANK
    if not first:
        return DUPLICATE
    return SOUND if left[-1] in ENDS else CUT


def edits(rows: list[Row], node: tuple[int, int]) -> Iterator[tuple[int, str, tuple[int, int]]]:
    """(cost, letter, node behind it) of every edit at a node."""
    i, state = node
    yield INSERT, "I", (i, NEXT[state])
    if i < len(rows):
        initial, wrong = rows[i]
        yield DELETE, "D", (i + 1, state)
        if wrong not in (BLANK, DUPLICATE):
            more = TRUNCATED if wrong == CUT else 0
            yield REROLE + more, "R", (i + 1, NEXT[state])
            if initial in LEGAL[state]:
                yield more, "K", (i + 1, LEGAL[state][initial])


def edits_back(rows: list[Row], node: tuple[int, int]) -> Iterator[tuple[int, str, tuple[int, int]]]:
    """(cost, letter, node ahead of it) of every edit that ends at a node."""
    i, state = node
    for before in range(len(NEXT)):
        for ahead in ((i, before), (i - 1, before)):
            if ahead[0] >= 0:
                yield from ((cost, letter, ahead) for cost, letter, to in edits(rows, ahead) if to == node)


def cheapest(rows: list[Row], sources: Iterable[int], targets: Iterable[int]) -> Best | None:
    """Cost and least audit of the cheapest way from one of the states to one of the others."""
    n = len(rows)
    labels = ({(0, s): (0, "") for s in sources}, {(n, t): (0, "") for t in targets})
    ends = tuple(set(own) for own in labels)  # final from the start: every cycle costs something
    # Edits that cost nothing go on by a row, so the order of rows settles equal costs.
    order = (lambda v: v[0], lambda v: n - v[0])
    heaps = tuple([(0, order[side](v), v) for v in labels[side]] for side in (0, 1))
    done: tuple[set, set] = (set(), set())
    best = None
    for v in labels[0]:
        if v in labels[1]:
            best = 0
    while heaps[0] and heaps[1]:
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best:
            break
        side = 0 if (heaps[0][0][0], len(done[0])) <= (heaps[1][0][0], len(done[1])) else 1
        cost, _, v = heapq.heappop(heaps[side])
        own, other = labels[side], labels[1 - side]
        if v in done[side] or cost > own[v][0]:
            continue
        done[side].add(v)
        audit = own[v][1]
        for more, letter, w in edits(rows, v) if side == 0 else edits_back(rows, v):
            new = (cost + more, audit + letter if side == 0 else letter + audit)
            old = own.get(w)
            if old is None or new < old:
                own[w] = new
                if old is None or new[0] < old[0]:
                    heapq.heappush(heaps[side], (new[0], order[side](w), w))
            if w in other and (best is None or new[0] + other[w][0] < best):
                best = new[0] + other[w][0]
    if best is None:
        return None
    forward, reverse = done[0] | ends[0], done[1] | ends[1]
    found = [labels[0][v][1] + labels[1][v][1] for v in forward & reverse if labels[0][v][0] + labels[1][v][0] == best]
    for v in forward:
        cost, audit = labels[0][v]
        for more, letter, w in edits(rows, v):
            if w in reverse and cost + more + labels[1][w][0] == best:
                found.append(audit + letter + labels[1][w][1])
    return best, min(found)


def only_deleted(count: int) -> dict[tuple[int, int], Best]:
    """The table of rows that all have to go."""
    out = {}
    for s in range(len(NEXT)):
        state, inserted = s, 0
        while (s, state) not in out:
            out[s, state] = (DELETE * count + INSERT * inserted, "D" * count + "I" * inserted)
            state, inserted = NEXT[state], inserted + 1
    return out


def table_of(rows: list[Row]) -> dict[tuple[int, int], Best]:
    """The cheapest audit from every state to every state."""
    if all(wrong in (BLANK, DUPLICATE) for _, wrong in rows):
        return only_deleted(len(rows))
    states = range(len(NEXT))
    found = {(s, t): cheapest(rows, (s,), (t,)) for s in states for t in states}
    return {k: v for k, v in found.items() if v is not None}


def combined(left: dict[tuple[int, int], Best], right: dict[tuple[int, int], Best]) -> dict[tuple[int, int], Best]:
    out: dict[tuple[int, int], Best] = {}
    for (s, m), (cost, audit) in left.items():
        for (k, t), (more, tail) in right.items():
            if m == k:
                new = (cost + more, audit + tail)
                if (s, t) not in out or new < out[s, t]:
                    out[s, t] = new
    return out


def repaired(audit: str, rows: Iterable[tuple[bytes, bytes]]) -> Iterator[bytes]:
    """``role:text`` of the rows that an audit leaves or makes."""
    state, rows = 0, iter(rows)
    for letter in audit:
        if letter == "I":
            yield NAMES[NEEDED[state]] + b":"
            state = NEXT[state]
            continue
        role, text = next(rows)
        if letter == "K":
            yield role + b":" + text
            state = LEGAL[state][role[:1]]
        elif letter == "R":
            yield NAMES[NEEDED[state]] + b":" + text
            state = NEXT[state]


class Hash:
    """SHA-256 of lines joined by a newline."""

    def __init__(self) -> None:
        self.sha, self.empty = hashlib.sha256(), True

    def add(self, line: bytes) -> None:
        self.sha.update(line if self.empty else b"\n" + line)
        self.empty = False


class Counts:
    """Faults and turns of consecutive rows; ``then`` adds those of the rows behind them."""

    FIELDS = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "last_turn", "head", "tail")

    def __init__(self, values: Iterable | None = None) -> None:
        start = (0, 0, 0, 0, 0, None, None, None, None, None) if values is None else values
        for name, v in zip(self.FIELDS, start, strict=True):
            setattr(self, name, v)

    def add(self, initial: bytes, wrong: str, turn: int | None, times: int) -> None:
        self.blank += times * (wrong == BLANK)
        self.duplicate += times * (wrong == DUPLICATE)
        self.truncated += times * (wrong == CUT)
        if self.tail is not None:
            self.illegal += self.tail + initial not in PAIRS
        self.illegal += times - 1  # no two equal initials may follow each other
        if self.head is None:
            self.head = initial
        self.tail = initial
        if turn is not None:
            self.turns += turn != self.last_turn
            self.low, self.high, self.last_turn = turn if self.low is None else self.low, turn, turn

    def then(self, more: Counts) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + getattr(more, name))
        if self.tail is not None and more.head is not None:
            self.illegal += self.tail + more.head not in PAIRS
        self.turns -= more.low is not None and more.low == self.high
        self.head = more.head if self.head is None else self.head
        self.tail = self.tail if more.tail is None else more.tail
        self.low = more.low if self.low is None else self.low
        self.high = self.high if more.high is None else more.high

    def result(self) -> dict[str, int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PART = f"{RESULT}, slice int, counts array<long>, ends array<binary>, places array<int>, costs array<long>, audits array<string>"


class Part:
    """One conversation's rows inside a slice."""

    def __init__(self, conv: int | None, segment: int, hold: int) -> None:
        self.conv, self.segment, self.hold = conv, segment, hold
        self.counts, self.rows, self.texts, self.table = Counts(), [], [], None

    def add(self, turn: int | None, role: bytes, text: bytes, times: int, first: bool) -> None:
        if not times:
            return
        wrong, initial = fault(text, first), role[:1]
        again = wrong if wrong == BLANK else DUPLICATE
        self.counts.add(initial, wrong, turn, 1)
        if times > 1:
            self.counts.add(initial, again, turn, times - 1)
        self.rows.append((initial, wrong))
        if self.texts is not None:
            self.texts.append((role, text))
        if times - 1 > self.segment:
            self.close()
            self.table = combined(self.table, only_deleted(times - 1))
        else:
            self.rows += [(initial, again)] * (times - 1)
            if self.texts is not None:
                self.texts += [(role, text)] * (times - 1)
        if len(self.rows) > self.hold:
            self.close()

    def close(self) -> None:
        """From now on only the table is carried; the texts are read again later."""
        self.texts = None
        for at in range(0, max(1, len(self.rows)), self.segment):
            own = table_of(self.rows[at : at + self.segment])
            self.table = own if self.table is None else combined(self.table, own)
        self.rows = []

    def whole(self) -> dict | None:
        """The result, if this is all of the conversation and its texts are at hand."""
        if self.texts is None:
            return None
        if len(self.rows) <= self.segment:
            best = cheapest(self.rows, (0,), ACCEPTED)
        else:
            table = {(0, 0): (0, "")}
            for at in range(0, len(self.rows), self.segment):
                table = combined(table, table_of(self.rows[at : at + self.segment]))
            best = min(v for (s, t), v in table.items() if s == 0 and t in ACCEPTED)
        sha = Hash()
        for line in repaired(best[1], self.texts):
            sha.add(line)
        return {"conv_id": self.conv} | self.counts.result() | {"cost": best[0], "audit": best[1], "repaired_sha256": sha.sha.hexdigest()}

    def part(self, slice: int) -> dict:
        self.close()
        places = sorted(self.table)
        values = [getattr(self.counts, f) for f in Counts.FIELDS]
        return {
            "conv_id": self.conv,
            "slice": slice,
            "counts": values[:8],
            "ends": values[8:],
            "places": [len(NEXT) * s + t for s, t in places],
            "costs": [self.table[p][0] for p in places],
            "audits": [self.table[p][1] for p in places],
        }


def _columns(rows: list[dict], schema: str) -> dict[str, list]:
    return {n: [r.get(n) for r in rows] for n in (f.split()[0] for f in schema.split(", "))}


def _listed(b: dict, *names: str) -> Iterator[tuple]:
    return zip(*(b[n].tolist() if isinstance(b[n], np.ndarray) else b[n] for n in names), strict=True)


ORDER = ("conv_id", "turn", "role", "text")


def _parts(rows: DataFrame, segment: int, hold: int) -> DataFrame:
    """Results of conversations inside a slice, and parts of those that may span slices."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        slice, part, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            out = []
            for conv, turn, role, text, times, first in _listed(b, *ORDER, "times", "first"):
                if part is None or conv != part.conv:
                    if part is not None:
                        # The first and the last one may go on in a neighbouring slice.
                        out.append((part.whole() if seen > 1 else None) or part.part(slice))
                    part, seen = Part(conv, segment, hold), seen + 1
                part.add(turn, role, text, times, bool(first))
            if out:
                yield _columns(out, PART)
        if part is not None:
            yield _columns([part.part(slice)], PART)

    key = [F.col(c) for c in ORDER]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *key).sortWithinPartitions(*key)
    dealt = dealt.select("conv_id", "turn", utf8("role").alias("role"), utf8("text").alias("text"), "times", "first")
    return by_batch(dealt, run, PART)


def _folded(parts: DataFrame) -> DataFrame:
    """Parts of a conversation, in the order of their slices, to its result; the hash is still missing."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        start = {(0, 0): (0, "")}

        def closed() -> dict:
            cost, audit = min(v for (_, t), v in table.items() if t in ACCEPTED)
            return {"conv_id": owner} | counts.result() | {"cost": cost, "audit": audit}

        owner, counts, table, on = None, None, start, False
        for b in batches:
            out = []
            for conv, values, ends, places, costs, audits in _listed(b, "conv_id", "counts", "ends", "places", "costs", "audits"):
                if not on or conv != owner:
                    if on:
                        out.append(closed())
                    owner, counts, table, on = conv, Counts(), start, True
                counts.then(Counts([*values, *ends]))
                table = combined(table, {divmod(p, len(NEXT)): (c, a) for p, c, a in zip(places, costs, audits, strict=True)})
            if out:
                yield _columns(out, RESULT)
        if on:
            yield _columns([closed()], RESULT)

    dealt = parts.repartition(partitions(parts.sparkSession), "conv_id").sortWithinPartitions("conv_id", "slice")
    return by_batch(dealt.select("conv_id", "counts", "ends", "places", "costs", "audits"), run, RESULT)


def _hashed(folded: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of conversations whose audit is known; their rows pass by in order."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        owner, sha, stream, on = None, None, None, False

        def lines(audit: str) -> Iterator[bytes | None]:
            """Takes (role, text) one by one: a line to hash, or None when a row is wanted."""
            state = 0
            for letter in audit:
                if letter == "I":
                    yield NAMES[NEEDED[state]] + b":"
                    state = NEXT[state]
                    continue
                role, text = yield None
                if letter == "K":
                    yield role + b":" + text
                    state = LEGAL[state][role[:1]]
                elif letter == "R":
                    yield NAMES[NEEDED[state]] + b":" + text
                    state = NEXT[state]

        def drained(line: bytes | None) -> None:
            while line is not None:
                sha.add(line)
                line = next(stream, None)

        for b in batches:
            out = []
            for conv, kind, role, text, times in _listed(b, "conv_id", "kind", "role", "text", "times"):
                if kind == 0:
                    if on:
                        out.append({"conv_id": owner, "repaired_sha256": sha.sha.hexdigest()})
                    owner, sha, stream, on = conv, Hash(), lines(text.decode()), True
                    drained(next(stream, None))
                    continue
                for _ in range(times):
                    try:
                        line = stream.send((role, text))
                    except StopIteration:
                        break
                    drained(line)
            if out:
                yield _columns(out, "conv_id long, repaired_sha256 string")
        if on:
            yield _columns([{"conv_id": owner, "repaired_sha256": sha.sha.hexdigest()}], "conv_id long, repaired_sha256 string")

    empty = F.lit("").cast("binary")
    audits = folded.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), empty.alias("role"), utf8("audit").alias("text"), F.lit(0).cast("long").alias("times"))
    known = folded.select(F.col("conv_id").alias("_conv"))
    spoken = rows.where(F.col("times") > 0).join(known, same(F.col("conv_id"), F.col("_conv")), "left_semi")
    spoken = spoken.select("conv_id", F.lit(1).alias("kind"), "turn", utf8("role").alias("role"), utf8("text").alias("text"), "times")
    dealt = audits.unionByName(spoken).repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")
    return by_batch(dealt.select("conv_id", "kind", "role", "text", "times"), run, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame, segment: int = SEGMENT, hold: int = HOLD) -> DataFrame:
    """Faults and cheapest repair of every conversation of ``rows`` (conv_id, turn, role, text, times).

    ``times`` says how often a row stands there; a conversation whose rows all stand there
    no times has zeros, an empty audit and the hash of the empty string.  Rows follow each
    other by turn (null first), then role and text.  A row whose role has no initial cannot
    be kept.  Rows without conv_id form one conversation.  SHA-256 reads a repaired
    conversation from its beginning, so a conversation that spans slices passes through one
    task once more for its hash, row by row.
    """
    scratch = Scratch(rows.sparkSession)
    kept = scratch.keep("rows", marked(rows))
    parts = scratch.keep("parts", _parts(kept, segment, hold))
    names = [f.split()[0] for f in RESULT.split(", ")]
    folded = scratch.keep("folded", _folded(parts.where(F.col("slice").isNotNull())).drop("repaired_sha256"))
    hashes = _hashed(folded, kept).withColumnRenamed("conv_id", "_conv")
    late = folded.join(hashes, same(F.col("conv_id"), F.col("_conv"))).select(*names)
    return parts.where(F.col("slice").isNull()).select(*names).unionByName(late)


def repair_damaged(convs: DataFrame, **options) -> DataFrame:
    """Plant faults in conversations, count them and repair every conversation.

    One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.  Null roles and texts are one space; null turns come first and count in
    no gap; equal rows of a turn stand next to each other; texts of any length are read to
    their end.  Extra columns are ignored; an empty table gives an empty result.
    """
    return repair(damaged(convs), **options)
