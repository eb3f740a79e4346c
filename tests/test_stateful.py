"""State of pages and requests in a stream against plain Python, whatever the micro-batches."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from draftlake.streaming import events as ev
from draftlake.streaming import runs, stateful

START = datetime(2024, 1, 1)
SCHEMA = "event_id string, event_type string, batch_id string, page_id string, attempt int, created_at timestamp, payload string"
TYPES = [*ev.STATUS_BY_EVENT, *(t for pair in ev.STAGES.values() for t in pair), "other"]


def log(seed, n=400):
    rng, rows = random.Random(seed), []
    for k in range(n):
        page = None if rng.random() < 0.05 else "" if rng.random() < 0.05 else f"p{rng.choice([0, 0, 0, 1, 2, 3])}"
        rows.append((f"e{k}", rng.choice(TYPES), "b", page, 1, START + timedelta(seconds=rng.choice([60 * k, 60 * (k // 4)]) + rng.choice([0, 0.25])), "{}"))
    return rows


def slow_moves(rows):
    pages, out = defaultdict(list), set()
    for name, kind, _, page, _, at, _ in rows:
        if page and kind in ev.STATUS_BY_EVENT:
            pages[page].append((at, name, ev.STATUS_BY_EVENT[kind]))
    for page, own in pages.items():
        before = None
        for at, name, status in sorted(own):
            out.add((page, name, at, before, status, status in ev.NEXT_STATUS[before or ""]))
            before = status
    return out


def slow_completions(rows, within):
    out = set()
    for name, kind, _, page, _, at, _ in rows:
        for stage, (asked, done) in ev.STAGES.items():
            if page and kind == asked:
                found = [r[5] for r in rows if r[3] == page and r[1] == done and at <= r[5] <= at + within]
                out.add((page, stage, name, at, min(found, default=None)))
    return out


def stream(spark, rows, folder, files, late=()):
    closing = [("close", "page.qa.done", "b", "close", 1, START + timedelta(days=k), "{}") for k in (40, 41)]
    order = sorted(rows, key=lambda r: r[5])
    size = -(-len(order) // files)
    parts = [order[k * size : (k + 1) * size] for k in range(files)]
    random.Random(1).shuffle(parts[0])
    for part in [*parts, closing[:1], closing[1:], list(late)]:
        if part:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return runs.read_table_stream(spark, f"{folder}/in", spark.createDataFrame([], SCHEMA).schema, 1)


@pytest.mark.parametrize("files", [1, 5])
def test_moves(spark, tmp_path, files):
    rows = log(files)
    late = [("late", "page.failed", "b", "p0", 1, START + timedelta(minutes=3), "{}")]
    moves = stateful.page_moves_stream(stream(spark, rows, tmp_path, files, late), "10 minutes")
    runs.split_moves(moves, f"{tmp_path}/legal", f"{tmp_path}/illegal", f"{tmp_path}/ckpt").awaitTermination()
    got = set()
    for side in ("legal", "illegal"):
        table = spark.read.parquet(f"{tmp_path}/{side}").where("page_id <> 'close'")
        got |= {(r.page_id, r.event_id, r.moved_at, r.from_status, r.to_status, side == "legal") for r in table.collect()}
    want = slow_moves(rows)
    assert got == want and {w[-1] for w in want} == {True, False}
    batch = stateful.page_moves(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in batch.collect()} == want


@pytest.mark.parametrize("files", [1, 5])
def test_first_completions(spark, tmp_path, files):
    rows, within = log(10 + files), timedelta(minutes=50)
    late = [("late", "page.ocr.requested", "b", "p0", 1, START + timedelta(minutes=3), "{}")]
    out = stateful.first_completions_stream(stream(spark, rows, tmp_path, files, late), "50 minutes", "10 minutes")
    with stateful.rocks_state(spark):
        got = [tuple(r) for r in runs.drain(out, f"{tmp_path}/out", f"{tmp_path}/ckpt").collect()]
    want = slow_completions(rows, within)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(w[4] is None for w in want) and any(w[4] is not None for w in want)
    batch = stateful.first_completions(spark.createDataFrame(rows, SCHEMA), "50 minutes")
    assert {tuple(r) for r in batch.collect()} == want


def test_one_page_with_most_events(spark):
    rows = [(f"e{k}", "page.failed" if k % 2 else "page.extracted", "b", "p", 1, START + timedelta(seconds=k), "{}") for k in range(3_000)]
    got = stateful.page_moves(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == 3_000 and got.where("legal").count() == 3_000
    assert got.where(F.col("from_status").isNull()).count() == 1


def test_no_events(spark):
    assert stateful.page_moves(spark.createDataFrame([], SCHEMA)).collect() == []


def test_events_without_time_are_left_out(spark, tmp_path):
    rows = log(3, 60)
    timeless = [("none", kind, "b", "p0", 1, None, "{}") for kind in ("page.failed", "page.ocr.requested")]
    moves = stateful.page_moves_stream(stream(spark, rows, f"{tmp_path}/a", 1, timeless), "10 minutes")
    with stateful.rocks_state(spark):
        got = [tuple(r) for r in runs.drain(moves, f"{tmp_path}/a/out", f"{tmp_path}/a/ckpt").collect()]
    assert {r for r in got if r[0] != "close"} == slow_moves(rows)


class State:
    """List or value state that counts how often it is asked."""

    calls = 0

    def __init__(self):
        self.rows = []

    def get(self):
        State.calls += 1
        return iter(self.rows) if self.listed else (self.rows[0] if self.rows else None)

    def put(self, rows):
        State.calls += 1
        self.rows = list(rows)

    def appendList(self, rows):
        State.calls += 1
        self.rows = [*self.rows, *rows]

    def update(self, row):
        self.put([row])

    def clear(self):
        self.put([])


class Handle:
    def __init__(self):
        self.timers = set()

    def getListState(self, name, schema):
        return self._state(True)

    def getValueState(self, name, schema):
        return self._state(False)

    def _state(self, listed):
        found = State()
        found.listed = listed
        return found

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Moment:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


@pytest.mark.parametrize("processor", [stateful.Moves, lambda: stateful.FirstCompletion(5_000_000)])
def test_state_is_not_asked_page_by_page(processor):
    own, handle, pages = processor(), Handle(), 500
    own.init(handle)
    rows = pd.DataFrame([(f"p{k}", "ocr", (k + j) * 1000, j % 2, f"e{k}-{j}", f"s{j}") for k in range(pages) for j in range(4)], columns=["page_id", "stage", "micros", "kind", "event_id", "mark"])
    State.calls, out = 0, []
    for part in (rows.iloc[::2], rows.iloc[1::2]):
        out += own.handleInputRows((0,), iter([part]), Moment(0))
    for at in (200, 20_000):  # in milliseconds
        handle.timers = {t for t in handle.timers if t > at}
        out += own.handleExpiredTimer((0,), Moment(at), None)
    got = pd.concat(out)
    assert State.calls < 40 and handle.timers == set()
    if isinstance(own, stateful.Moves):
        assert len(got) == 4 * pages
        assert {(r.page_id, r.from_status) for r in got.itertuples() if r.to_status == "s0"} == {(f"p{k}", None) for k in range(pages)}
        assert all(r.from_status == f"s{int(r.to_status[1]) - 1}" for r in got.itertuples() if r.to_status != "s0")
    else:
        assert len(got) == 2 * pages and (got["done"] - got["asked"] == 1000).all()
