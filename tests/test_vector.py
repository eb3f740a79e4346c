from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftlake.operators import vector as vec


def _segments(spark, rows):
    data = [(f"p{p}", i, float(a), float(b), float(c), float(d), 0.5, 10) for i, (p, a, b, c, d) in enumerate(rows)]
    return spark.createDataFrame(
        data, "page_id string, seg_id long, x1 double, y1 double, x2 double, y2 double, rms_px double, inliers long"
    )


def test_circle_fit_and_arc(spark):
    pts = []
    for i in range(60):
        a = math.radians(30 + 2 * i)
        pts.append(("p", 1, i, 200 + 100 * math.cos(a), 150 + 100 * math.sin(a)))
    for i in range(360):
        a = math.radians(i)
        pts.append(("p", 2, i, 50 + 20 * math.cos(a), 60 + 20 * math.sin(a)))
    pts += [("p", 3, i, float(i), 2.0 * i) for i in range(40)]
    df = spark.createDataFrame(pts, "page_id string, chain_id long, ord long, x double, y double")
    fits = {r["chain_id"]: r for r in vec.fit_rms(df, vec.fit_circles(df)).collect()}
    assert abs(fits[1]["cx"] - 200) < 1e-6 and abs(fits[1]["r"] - 100) < 1e-6 and fits[1]["accepted"]
    assert fits[3]["r"] is None and not fits[3]["accepted"]
    ext = {r["chain_id"]: r for r in vec.arc_extent(df, vec.fit_circles(df)).collect()}
    assert ext[1]["type"] == "ARC" and abs(ext[1]["start_deg"] - 30) < 1e-6 and abs(ext[1]["end_deg"] - 148) < 1e-6
    assert ext[2]["type"] == "CIRCLE" and ext[2]["start_deg"] is None


def test_arc_over_zero(spark):
    pts = [("p", 1, i, 10 * math.cos(math.radians(a)), 10 * math.sin(math.radians(a))) for i, a in enumerate([*range(300, 360, 3), *range(0, 60, 3)])]
    df = spark.createDataFrame(pts, "page_id string, chain_id long, ord long, x double, y double")
    r = vec.arc_extent(df, vec.fit_circles(df)).first()
    assert abs(r["start_deg"] - 300) < 1e-6 and abs(r["end_deg"] - 57) < 1e-6


def _split(pts: list[tuple[float, float]], tol: float) -> list[tuple]:
    """Plain recursion to compare with."""
    p, q = np.array(pts[0]), np.array(pts[-1])
    if len(pts) < 2 or np.allclose(p, q):
        return []
    d = (q - p) / np.linalg.norm(q - p)
    rel = np.array(pts) - p
    off = np.abs(rel[:, 0] * d[1] - rel[:, 1] * d[0])
    k = int(np.argmax(off))
    if off[k] <= tol or k in (0, len(pts) - 1):
        return [(*map(float, pts[0]), *map(float, pts[-1]), len(pts))]
    return _split(pts[: k + 1], tol) + _split(pts[k:], tol)


def test_split_equals_recursion(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for chain in range(6):
        x = y = 0.0
        pts = []
        for _ in range(80):
            x, y = x + rng.uniform(0, 3), y + rng.uniform(-2, 2)
            pts.append((x, y))
        if chain == 5:
            pts = [(50 + 40 * math.cos(t / 10), 50 + 40 * math.sin(t / 10)) for t in range(63)]
            pts.append(pts[0])
            far = int(np.argmax([math.dist(p, pts[0]) for p in pts]))
            want[chain] = _split(pts[: far + 1], 1.5) + _split(pts[far:], 1.5)
        else:
            want[chain] = _split(pts, 1.5)
        rows += [("p", chain, i, *p) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "page_id string, chain_id long, ord long, x double, y double")
    got = vec.split_polylines(df).toPandas()
    for chain, pieces in want.items():
        mine = got[got["chain_id"] == chain].sort_values("from_ord")
        assert len(mine) == len(pieces)
        assert np.allclose(mine[["x1", "y1", "x2", "y2", "inliers"]].to_numpy(float), np.array(pieces))


def _snap(points: np.ndarray, tol: float) -> np.ndarray:
    seen, owner = [False] * len(points), list(range(len(points)))
    for i in range(len(points)):
        if not seen[i]:
            for j in np.flatnonzero(np.linalg.norm(points - points[i], axis=1) <= tol):
                owner[j], seen[j] = i, True
    owner = np.array(owner)
    return np.array([points[owner == owner[i]].mean(axis=0) for i in range(len(points))])


def test_snap_equals_sequential(spark):
    rng = random.Random(4)
    rows = [(0, *(rng.uniform(0, 40) for _ in range(4))) for _ in range(60)]
    got = vec.snap_endpoints(_segments(spark, rows)).toPandas().sort_values("seg_id")
    flat = np.array([p for r in rows for p in ((r[1], r[2]), (r[3], r[4]))])
    want = _snap(flat, 4.0).reshape(-1, 4)
    assert np.allclose(got[["x1", "y1", "x2", "y2"]].to_numpy(), want)


def test_near_points_brute(spark):
    rng = random.Random(5)
    rows = [(k % 2, *(rng.uniform(-30, 30) for _ in range(4))) for k in range(50)]
    pts = vec.endpoints(_segments(spark, rows))
    got = {(r["page_id"], r["ax"], r["bx"]) for r in vec.near_points(pts).collect()}
    by_page = {p: [(r[1 + 2 * s], r[2 + 2 * s]) for r in rows if r[0] == p for s in (0, 1)] for p in (0, 1)}
    want = {
        (f"p{p}", *sorted((a, b))[0][:1], *sorted((a, b))[1][:1])
        for p, ps in by_page.items()
        for i, a in enumerate(ps)
        for b in ps[i + 1 :]
        if math.dist(a, b) <= 4
    }
    assert got == want


def _try(a, b):
    la, lb = math.dist(a[:2], a[2:]), math.dist(b[:2], b[2:])
    if min(la, lb) < 1:
        return None
    ang = [math.degrees(math.atan2(s[3] - s[1], s[2] - s[0])) % 180 for s in (a, b)]
    gap = abs(ang[0] - ang[1])
    if min(gap, 180 - gap) > 1.5:
        return None
    off = max(abs((b[i] - a[0]) * (a[3] - a[1]) - (b[i + 1] - a[1]) * (a[2] - a[0])) / la for i in (0, 2))
    if off > 2:
        return None
    pts = np.array([a[:2], a[2:], b[:2], b[2:]])
    mid = pts.mean(axis=0)
    _, vecs = np.linalg.eigh(np.cov((pts - mid).T))
    proj = (pts - mid) @ vecs[:, 1]
    return None if proj.max() - proj.min() > la + lb + 12 else float(proj.max() - proj.min())


def test_collinear_pairs_brute(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(160):
        a, t = rng.choice([0, 0.4, 30, 31, 89.5, 90, 179.6]), rng.uniform(0, 400)
        size = rng.choice([2, 5, 30, 200])
        x, y = rng.choice([100.0, 101.5, 103.0]) + t * math.cos(math.radians(a)), 200 + t * math.sin(math.radians(a))
        rows.append((0, x, y, x + size * math.cos(math.radians(a)), y + size * math.sin(math.radians(a))))
    got = {(r["a_id"], r["b_id"]) for r in vec.collinear_pairs(_segments(spark, rows)).collect()}
    want = {(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and _try(rows[i][1:], rows[j][1:]) is not None}
    assert len(want) > 50
    assert got == want


def test_merge_dashes_and_rectangle(spark):
    dashes = [(0, 20 * i, 50, 20 * i + 12, 50) for i in range(9)]
    sides = [(1, 100, 80, 500, 80), (1, 500, 80, 500, 320), (1, 500, 320, 100, 320), (1, 100, 320, 100, 80)]
    copies = [(2, 0, 0, 50, 0)] * 3
    got = vec.merge_collinear(_segments(spark, dashes + sides + copies)).toPandas()
    dash = got[got["page_id"] == "p0"]
    assert len(dash) == 1 and dash["inliers"].iloc[0] == 90
    assert sorted([dash["x1"].iloc[0], dash["x2"].iloc[0]]) == pytest.approx([0, 172])
    assert len(got[got["page_id"] == "p1"]) == 4
    assert got[got["page_id"] == "p2"]["inliers"].tolist() == [30]


def test_align_breaks(spark):
    rows = [(0, 0, 0, 100, 0), (0, 110, 0, 150, 6), (0, 300, 300, 400, 300)]
    centres = spark.createDataFrame([("p0", 1, 105.0, 0.0), ("p0", 2, 350.0, 200.0)], "page_id string, break_id long, x double, y double")
    got = vec.align_breaks(_segments(spark, rows), centres).toPandas().sort_values("seg_id")
    second = got.iloc[1]
    assert second["y1"] == pytest.approx(3) and second["y2"] == pytest.approx(3)
    assert got.iloc[2][["x1", "y1", "x2", "y2"]].tolist() == [300, 300, 400, 300]


def test_export_document(spark):
    prims = spark.createDataFrame(
        [
            ("p", "a", "LINE", "02_PART_VISIBLE", 0.95, 100.0, 100.0, 500.0, 100.0, None, None, None),
            ("p", "b", "CIRCLE", "02_PART_VISIBLE", 0.9, 600.0, 400.0, None, None, 50.0, None, None),
            ("p", "c", "ARC", None, 0.6, 600.0, 400.0, None, None, 80.0, 30.0, 120.0),
            ("p", "d", "LWPOLYLINE", "09_BREAK_SYMBOLS", 0.4, None, None, None, None, None, None, None),
            ("p", "e", "CIRCLE", "02_PART_VISIBLE", 0.9, 1.0, 1.0, None, None, 0.0, None, None),
        ],
        "page_id string, id string, type string, layer string, confidence double, x1 double, y1 double, x2 double, y2 double, "
        "radius double, start_angle_deg double, end_angle_deg double",
    ).withColumns(
        {
            "vertices": F.when(
                F.col("type") == "LWPOLYLINE",
                F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (10, 5), (20, 0)]]),
            ),
            "closed": F.lit(False),
            "text": F.lit(None).cast("string"),
            "height": F.lit(None).cast("double"),
            "rotation_deg": F.lit(None).cast("double"),
        }
    )
    pages = spark.createDataFrame([("p", 10.0, 800)], "page_id string, px_per_mm double, height_px int")
    got = {r["id"]: r for r in vec.entities(prims, pages).collect()}
    assert sorted(got) == ["a", "b", "c", "d"]
    assert (got["a"]["x1_mm"], got["a"]["y1_mm"]) == (10.0, 70.0)
    assert (got["c"]["start_deg"], got["c"]["end_deg"]) == (240.0, 330.0)
    assert got["d"]["layer"] == "90_QA_LOW_CONFIDENCE" and got["d"]["source_layer"] == "09_BREAK_SYMBOLS"
    summary = {r["type"]: r["n"] for r in vec.primitives_summary(prims).collect()}
    assert summary["LINE"] == 1
    assert vec.entities(prims.limit(0), pages).count() == 0


def test_empty_page_needs_review(spark):
    pages = spark.createDataFrame([("p",)], "page_id string")
    empty = spark.createDataFrame([], "page_id string, type string, confidence double")
    r = vec.doc_review(empty, pages).first()
    assert r["requires_review"] and r["warnings"] == ["no_primitives_detected", "no_line_primitives"]


def test_nearest_segments_in_a_crowded_cell(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(300):
        x, y, a, size = rng.uniform(0, 160), rng.uniform(0, 160), rng.uniform(0, math.pi), rng.choice([0, 8, 90, 300])
        rows.append((0, x, y, x + size * math.cos(a), y + size * math.sin(a)))
    rows += rows[:20]
    spots = [("p0", i, rng.uniform(-40, 200), rng.uniform(-40, 200)) for i in range(60)]

    def far(row, x, y):
        x1, y1, x2, y2 = row[1:]
        run = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = 0 if run < 1e-9 else min(max(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / run, 0), 1)
        return math.dist((x1 + t * (x2 - x1), y1 + t * (y2 - y1)), (x, y))

    want = {}
    for _, i, x, y in spots:
        two = sorted((far(r, x, y), k) for k, r in enumerate(rows))[:2]
        if two[1][0] <= 25:
            want[i] = tuple(k for _, k in two)
    centres = spark.createDataFrame(spots, "page_id string, break_id long, x double, y double")
    got = {r.break_id: (r.seg_a, r.seg_b) for r in vec.nearest_segments(_segments(spark, rows), centres).collect()}
    assert len(want) > 30
    assert got == want
