"""Segments of ordinary pages meet inside a task; crowded pages give the same rows in rounds."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftlake.operators import segments as arrays
from draftlake.operators import vector as vec

SEGMENTS = "page_id string, seg_id long, x1 double, y1 double, x2 double, y2 double, rms_px double, inliers long"


@pytest.fixture
def drawn(spark):
    """Dashes, copies, short pieces, and rows without a page, id, place, rms or inliers."""
    rng, rows = random.Random(3), []
    for k in range(70):
        x, y, a = rng.randrange(90), rng.choice([10, 11, 60, 60.5]), rng.choice([0, 0, 1, 30, 90])
        rows.append((f"p{k % 2}", k, float(x), float(y), x + rng.choice([0.4, 12.0, 30.0]), float(y + a), 0.5 + k % 3, 10 + k % 4))
    rows += [("p0", 1000 + k, *rows[k][2:6], None if k % 2 else 0.5, None if k % 3 else 7) for k in range(0, 20, 2)]
    rows += [(None, 1, 0.0, 0.0, 9.0, 0.0, 0.5, 1), ("p1", None, 0.0, 0.0, 9.0, 0.0, 0.5, 1), ("p1", 2000, None, 0.0, 9.0, 0.0, 0.5, 1), ("p1", 2001, 9.0, 9.0, None, None, 0.5, 1)]
    return spark.createDataFrame(rows, SEGMENTS)


def _rows(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("of,rounds", [(vec.merge_collinear, "_merge_in_rounds"), (vec.collinear_pairs, "_collinear_in_cells"), (vec.snap_endpoints, "_snap_in_rounds")])
def test_pages_alike_in_a_task_and_in_rounds(drawn, monkeypatch, of, rounds):
    """Before, every page went through rounds of joins over all tasks."""
    own, late = getattr(vec, rounds), []
    monkeypatch.setattr(vec, rounds, lambda df, *more: late.append(df.where("page_id is not null and seg_id < 2000").count()) or own(df, *more))
    got = _rows(of(drawn))
    assert sum(late) == 0  # only what has no page, id or place
    monkeypatch.setattr(vec, "PAGE_SEGMENTS", 0)
    assert got == _rows(of(drawn)) and sum(late) > 70


def test_hash_of_a_choice_is_that_of_spark(spark):
    rng = random.Random(5)
    ids = [(rng.randrange(-(1 << 62), 1 << 62), rng.randrange(-9, 9)) for _ in range(50)]
    want = [r.h for r in spark.createDataFrame(ids, "a long, b long").select(F.xxhash64("a", "b").alias("h")).collect()]
    assert arrays._hashed(*(np.array(v) for v in zip(*ids, strict=True))).tolist() == want


def test_alike_directions_come_once_and_in_bounded_numbers(monkeypatch):
    monkeypatch.setattr(arrays, "PAIRS", 40)
    ang = np.array([random.Random(k).choice([0.2, 1.0, 45.0, 46.2, 179.5]) for k in range(60)])
    met = [(i, j) for a, b in arrays._alike(ang, np.arange(60), 1.5) if len(a) <= 40 + 60 for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    gap = np.abs(ang[:, None] - ang[None, :])
    want = {(i, j) for i, j in zip(*np.nonzero(np.minimum(gap, 180 - gap) <= 1.5), strict=True) if i < j}
    assert len(met) == len(want) and {tuple(sorted(p)) for p in met} == want
