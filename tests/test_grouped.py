"""Groups cut from batches: the same as a group at a time, whatever the size of batches."""

from __future__ import annotations

import numpy as np
import pytest

from draftlake.operators import grouped, raster, vector


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_groups_are_whole_over_batches(spark, monkeypatch, batch):
    monkeypatch.setattr(grouped, "FLUSH_ROWS", 20)
    rng = np.random.default_rng(batch)
    rows = [(None if k % 9 == 0 else f"p{k % 4}", None if k % 11 == 0 else int(rng.integers(0, 3)), k) for k in range(200)]
    df = spark.createDataFrame(rows, "page_id string, cell int, v int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        seen = lambda own: {"page_id": own["page_id"][0], "n": np.array([len(own["v"])]), "v": np.array([own["v"].sum()])} if own["cell"][0] != 2 else {}
        got = sorted(map(str, grouped.grouped(df, ["page_id", "cell"], seen, "page_id string, n long, v long").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for page, cell, v in rows:
        want.setdefault((page, cell), []).append(v)
    assert got == sorted(f"Row(page_id={page!r}, n={len(v)}, v={sum(v)})" for (page, cell), v in want.items() if cell != 2)


@pytest.mark.parametrize("batch", [5, 10_000])
def test_skew_sums_travel_as_arrays(spark, batch):
    rng = np.random.default_rng(batch)
    ink = [(p, int(x), int(y)) for p, n, side in (("a", 90, 30), ("b", 40, 700)) for x, y in rng.integers(0, side, (n, 2))]
    sizes = {"a": (30, 30), "b": (700, 700), "c": (10, 10)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        profile = raster.skew_profile(spark.createDataFrame(ink, "page_id string, x int, y int"), spark.createDataFrame([(p, *s) for p, s in sizes.items()], "page_id string, width int, height int"))
        # No table of rows of the page is aggregated.
        assert "sum(" not in profile._jdf.queryExecution().executedPlan().toString()
        got = {(r["page_id"], r["i"]): r["score"] for r in profile.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for page, (w, h) in sizes.items():
        own = np.array(sorted({r[1:] for r in ink if r[0] == page})).reshape(-1, 2)
        for i in range(101):
            turn = np.radians(-10.0 + i * 0.2)
            dx, dy = own[:, 0] - w / 2, own[:, 1] - h / 2
            rx, ry = np.floor(np.cos(turn) * dx + np.sin(turn) * dy + w / 2 + 0.5), np.floor(np.cos(turn) * dy - np.sin(turn) * dx + h / 2 + 0.5)
            c = np.unique(ry[(rx >= 0) & (rx < w) & (ry >= 0) & (ry < h)], return_counts=True)[1]
            if len(c):
                want[page, i] = int((c * c).sum() * h - c.sum() ** 2)
    assert got == want


def test_neighbours_are_counted_in_tiles(spark):
    rng = np.random.default_rng(3)
    rows = [("p", int(x), int(y)) for x, y in rng.integers(245, 262, (150, 2))] + [("q", 255, 255), ("q", 256, 256), ("q", 256, 256), (None, 0, 0), (None, 1, 0), ("p", None, 3), ("p", None, 3), ("p", None, None)]
    ink = spark.createDataFrame(rows, "page_id string, x int, y int")
    frame = raster.neighbours(ink)
    # No pixel is multiplied by its neighbours on the way.
    assert "HashAggregate" not in frame._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(str, frame.collect()))
    votes, owns = {}, {}
    for page, x, y in rows:
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                key = (page, None if x is None else x + dx, None if y is None else y + dy)
                votes[key] = votes.get(key, 0) + 1
                owns[key] = owns.get(key, 0) + (dx == dy == 0)
    want = [(*k, votes[k] - n) for k, n in owns.items() if n]
    role = lambda n: "end" if n == 1 else "junction" if n >= 3 else None
    assert got == sorted(f"Row(page_id={p!r}, x={x}, y={y}, neighbours={n}, role={role(n)!r})" for p, x, y, n in want)


def test_chains_are_cut_alike_in_a_task_and_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = []
    for chain in range(40):
        n = int(rng.integers(1, 60))
        x, y = np.round(np.cumsum(rng.normal(0, 2, (2, n)), axis=1), 1)
        if chain % 3 == 0:
            x[-1], y[-1] = x[0], y[0]
        ords = rng.integers(0, n, n) if chain % 5 == 0 else np.arange(n)
        rows += [("p" if chain % 7 else None, chain, int(o), float(a), float(b)) for o, a, b in zip(ords, x, y, strict=True)]
    rows += [("q", 1, None, 1.0, 2.0), ("q", 1, 1, None, 2.0), ("q", 1, 2, 5.0, 2.0), ("q", 1, 3, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "page_id string, chain_id long, ord long, x double, y double")
    shown = lambda got: sorted(str((*r[:8], round(r[8], 9), r[9])) for r in got.collect())
    seen, own = [], vector._split_in_rounds
    monkeypatch.setattr(vector, "_split_in_rounds", lambda points, *more: seen.append(points.count()) or own(points, *more))
    soon = shown(vector.split_polylines(df))
    assert seen == [4]  # no chain but the one with missing numbers takes rounds
    monkeypatch.setattr(vector, "CHAIN_POINTS", 0)
    assert shown(vector.split_polylines(df)) == soon and len(soon) > 200
