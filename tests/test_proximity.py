"""Neighbours of positions against all pairs, with crowds in one cell."""

from __future__ import annotations

import numpy as np
import pytest

from draftlake.operators import proximity


def slow(points, tol):
    out = {}
    spots = {}
    for page, x, y in points:
        spots.setdefault(page, {}).setdefault((x, y), 0)
        spots[page][x, y] += 1
    for page, own in spots.items():
        xy = np.array(sorted(own))
        d2 = (xy[:, 0, None] - xy[:, 0]) ** 2 + (xy[:, 1, None] - xy[:, 1]) ** 2
        np.fill_diagonal(d2, np.inf)
        for k, (x, y) in enumerate(map(tuple, xy)):
            near = d2[k] <= tol * tol
            at = int(np.argmin(d2[k])) if near.any() else None
            out[page, x, y] = (own[x, y], int(near.sum()), *((None, None, None) if at is None else (*xy[at], float(np.sqrt(d2[k, at])))))
    return out


def run(spark, points, **options):
    got = proximity.near_spots(spark.createDataFrame(points, "page_id string, x double, y double"), **options).collect()
    out = {(r.page_id, r.x, r.y): (r.n, r.neighbours, r.near_x, r.near_y, r.dist) for r in got}
    assert len(out) == len(got)
    return out


@pytest.mark.parametrize("limit, levels", [(512, 24), (8, 24), (8, 2)])
def test_like_all_pairs(spark, limit, levels):
    rng = np.random.default_rng(limit + levels)
    points = [("p", *map(float, xy)) for xy in rng.integers(-30, 60, (150, 2))]
    points += [("p", *map(float, xy)) for xy in rng.random((120, 2)) * 3] + [("q", 0.5, 0.5)] * 9
    points += [("r", float(k) * 1e-9, 0.0) for k in range(40)] + points[:20]
    got, want = run(spark, points, limit=limit, levels=levels), slow(points, 4.0)
    assert set(got) == set(want)
    for spot in want:
        assert got[spot][:4] == want[spot][:4], spot
        assert got[spot][4] == pytest.approx(want[spot][4])


def test_a_crowd_in_one_cell(spark):
    rng = np.random.default_rng(1)
    xy = rng.random((6_000, 2)) * 4
    got = run(spark, [("p", float(x), float(y)) for x, y in xy])
    for k in rng.integers(0, len(xy), 40):
        d2 = ((xy - xy[k]) ** 2).sum(axis=1)
        d2[k] = np.inf
        n, near, bx, by, dist = got["p", float(xy[k, 0]), float(xy[k, 1])]
        assert (n, near, (bx, by)) == (1, int((d2 <= 16).sum()), tuple(xy[d2.argmin()])) and dist == pytest.approx(np.sqrt(d2.min()))


def test_cells_are_bounded(spark):
    rng = np.random.default_rng(2)
    spots = spark.createDataFrame([("p", float(x), float(y)) for x, y in rng.random((3_000, 2)) * 4], "page_id string, x double, y double")
    held = proximity.leaves(spots, 4.0, 100).groupBy(*proximity.CELL).count().collect()
    assert max(r["count"] for r in held) <= 100 and sum(r["count"] for r in held) == 3_000


def test_no_points(spark):
    assert run(spark, []) == {}


def test_calm_places_meet_without_a_join(spark):
    points = [("p", float(x), float(y)) for x in range(-300, 300, 3) for y in (-129, -128, -125, 0, 2)]
    got = proximity.near_spots(spark.createDataFrame(points, "page_id string, x double, y double"))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.page_id, r.x, r.y): (r.n, r.neighbours, r.near_x, r.near_y) for r in got.collect()} == {k: v[:4] for k, v in slow(points, 4.0).items()}


def test_blocks_cut_by_batches(spark):
    rng = np.random.default_rng(3)
    points = [(f"p{k % 3}", *map(float, xy)) for k, xy in enumerate(rng.uniform(-140, 140, (900, 2)))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got, want = run(spark, points), slow(points, 4.0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k: v[:4] for k, v in got.items()} == {k: v[:4] for k, v in want.items()}


def test_candidates_are_measured_in_bounded_numbers(monkeypatch):
    xy = np.random.default_rng(4).uniform(0, 60, (400, 2))
    zero, side = np.zeros(400, np.int64), proximity.SQUARE * 4.0
    block = {"page_id": np.array(["p"] * 400, object), "hx": zero, "hy": zero, "x": xy[:, 0], "y": xy[:, 1], "n": zero + 1, "mine": zero == 0}
    block |= {"fx": np.floor(xy[:, 0] / side).astype(np.int64), "fy": np.floor(xy[:, 1] / side).astype(np.int64)}
    whole = proximity._met(block, 4.0)
    monkeypatch.setattr(proximity, "MEETINGS", 50)
    assert proximity._met(block, 4.0).equals(whole) and whole["neighbours"].sum() > 400
