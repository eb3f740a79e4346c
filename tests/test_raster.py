from __future__ import annotations

import math
import random
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from draftlake.operators import components as cc
from draftlake.operators import raster
from draftlake.operators.chains import _tile_stretches, extract_chains
from draftlake.plans import pages
from draftlake.sources import files


def _ink(spark, points, page="p"):
    rows = sorted({(page, int(x), int(y)) for x, y in points})
    return spark.createDataFrame(rows, "page_id string, x int, y int")


def _set(df):
    return {(r["x"], r["y"]) for r in df.collect()}


def _noise(seed, w, h, share):
    rng = random.Random(seed)
    return {(x, y) for x in range(w) for y in range(h) if rng.random() < share}


def test_compare_identical_and_empty(spark):
    a = _ink(spark, _noise(1, 30, 20, 0.2))
    assert raster.raster_iou(a, a).first()["iou"] == 1.0
    same = raster.distances(a, a).first()
    assert same["chamfer"] == 0.0 and same["hausdorff"] == 0.0
    alone = raster.distances(a, a.limit(0)).first()
    assert math.isinf(alone["chamfer"]) and math.isinf(alone["hausdorff"])


def test_nearest_ink_far_and_near(spark):
    rng = random.Random(2)
    a = {(rng.randrange(700), rng.randrange(500)) for _ in range(150)}
    b = {(rng.randrange(90), rng.randrange(80)) for _ in range(200)} | {(320 + i, 250) for i in range(30)} | {(690, 490)}
    got = {(r["x"], r["y"]): r["dist"] for r in raster.nearest_ink(_ink(spark, a), _ink(spark, b)).collect()}
    want = {p: min(math.dist(p, q) for q in b) for p in a}
    assert got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 1e-9 for p in a)


def test_percentile_matches_numpy(spark):
    a, b = _noise(3, 40, 40, 0.1), _noise(4, 40, 40, 0.05)
    got = raster.distances(_ink(spark, a), _ink(spark, b)).first()
    d1 = [min(math.dist(p, q) for q in b) for p in a]
    d2 = [min(math.dist(p, q) for q in a) for p in b]
    assert got["chamfer"] == pytest.approx((np.mean(d1) + np.mean(d2)) / 2)
    assert got["hausdorff"] == pytest.approx(max(np.percentile(d1, 99), np.percentile(d2, 99)))


def _flood(points):
    left, label = set(points), {}
    for start in sorted(points, key=lambda p: (p[1], p[0])):
        if start not in left:
            continue
        todo, part = [start], start[1] * cc.ROW + start[0]
        left.discard(start)
        while todo:
            x, y = todo.pop()
            label[x, y] = part
            for q in [(x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]:
                if q in left:
                    left.discard(q)
                    todo.append(q)
    return label


def test_components_across_tiles(spark):
    t = cc.TILE
    points = {(x + t - 20, y + t - 20) for x, y in _noise(5, 40, 40, 0.42)}
    points |= {(x, 5) for x in range(3 * t)} | {(t - 1, 2 * t), (t, 2 * t + 1)} | {(t, 3 * t), (t - 1, 3 * t + 1)}
    # A comb: many teeth hang on one spine across tiles.
    points |= {(x, y + 900) for x in range(0, 600, 6) for y in range(30)} | {(x, 930) for x in range(600)}
    got = {(r["x"], r["y"]): r["comp"] for r in cc.pixels_of(cc.components(_ink(spark, points))).collect()}
    assert got == _flood(points)


def test_component_count_is_translation_invariant(spark):
    points = _noise(6, 60, 50, 0.3)
    moved = {(x + 230, y + 240) for x, y in points}
    count = lambda p: cc.components(_ink(spark, p)).select("comp").distinct().count()
    assert count(points) == count(moved)


def test_thin_equals_whole_page(spark):
    t = cc.TILE
    points = {(x, y) for x in range(t - 60, t + 60) for y in range(t - 9, t + 12)}
    points |= {(x, y) for x in range(t - 30, t - 5) for y in range(t - 50, t + 70)}
    img = np.zeros((t + 102, t + 102), dtype=bool)
    for x, y in points:
        img[y + 1, x + 1] = True
    while True:
        after = cc._thin_pass(cc._thin_pass(img, True), False)
        if (after == img).all():
            break
        img = after
    ys, xs = np.nonzero(img)
    assert _set(cc.thin(_ink(spark, points))) == {(x - 1, y - 1) for x, y in zip(xs.tolist(), ys.tolist(), strict=True)}


def test_chains_of_a_cross_and_a_ring(spark):
    t = cc.TILE
    cross = {(x, 40) for x in range(t - 40, t + 41)} | {(t, y) for y in range(10, 71)}
    ring = {(300 + round(60 * math.cos(a / 200)), 300 + round(60 * math.sin(a / 200))) for a in range(1257)}
    chains = extract_chains(cc.thin(_ink(spark, cross | ring), corners=False)).toPandas()
    sizes = chains.groupby("chain_id").size()
    closed = chains[chains["closed"]].groupby("chain_id").size()
    assert len(closed) == 1 and closed.iloc[0] > 250
    assert len(sizes) == 5
    for _, chain in chains.groupby("chain_id"):
        chain = chain.sort_values("ord")
        step = np.maximum(chain["x"].diff().abs(), chain["y"].diff().abs()).dropna()
        assert (step == 1).all()


def test_long_chain_across_many_tiles(spark):
    t = cc.TILE
    path = [(x, 100 + x // 7) for x in range(3 * t)]
    chains = extract_chains(_ink(spark, path)).toPandas().sort_values("ord")
    assert chains["chain_id"].nunique() == 1
    assert list(zip(chains["x"], chains["y"], strict=True)) in (path, path[::-1])


def _walked(points):
    """Stretches by walking from pixel to pixel: {pixel: (first, place, length, loop)}."""
    near = {(y, x): [(y + b, x + a) for b in (-1, 0, 1) for a in (-1, 0, 1) if (a or b) and (x + a, y + b) in points] for x, y in points}
    out = {}
    for first in [*sorted(p for p in near if len(near[p]) < 2), *sorted(near)]:
        if first in out:
            continue
        path, loop = [first], len(near[first]) == 2
        while ahead := [q for q in near[path[-1]] if q not in path]:
            path.append(ahead[0])
        out |= {p: (first, i, len(path), loop) for i, p in enumerate(path)}
    return out


def _without_crossings(points):
    count = {p: sum((p[0] + a, p[1] + b) in points for a in (-1, 0, 1) for b in (-1, 0, 1)) - 1 for p in points}
    return {p for p in points if count[p] < 3}


def test_tile_stretches_as_walked():
    square = {(x, y) for x in range(60, 80) for y in range(60, 75) if (x in (60, 79)) != (y in (60, 74))}
    triangle, lone, pair = {(0, 0), (1, 0), (0, 1)}, {(90, 0)}, {(95, 95), (96, 96)}
    cases = [_without_crossings(_noise(k, 58, 58, 0.1 + 0.03 * k)) for k in range(6)]
    cases += [set(square), triangle | lone | pair | square, {(5, y) for y in range(250)}, lone]
    cases.append(cases[0] | {(x + 60, y + 60) for x, y in cases[1]} | {(x + 130, y) for x, y in square})
    loops = 0
    for points in cases:
        got = _tile_stretches(pd.DataFrame([("p", x, y) for x, y in points], columns=["page_id", "x", "y"]))
        want = _walked(points)
        loops += sum(w[3] for w in want.values())
        found = {(r.y, r.x): ((r.part // cc.ROW, r.part % cc.ROW), r.pos, r.n, r.loop) for r in got.itertuples()}
        assert found == want
    assert loops > 200


def test_runs_round_trip_and_dilate(spark):
    points = _noise(7, 50, 30, 0.4)
    ink = _ink(spark, points)
    assert _set(raster.open_runs(ink, "x", 1)) == points
    want = {(x + dx, y + dy) for x, y in points for dx in range(-2, 3) for dy in range(-1, 3)}
    assert _set(raster.dilate(ink, 5, 4)) == {(x + dx, y + dy) for x, y in points for dx in range(-2, 3) for dy in range(-1, 3)} == want
    assert _set(raster.dilate(ink, 3, 2)) == {(x + dx, y + dy) for x, y in points for dx in (-1, 0, 1) for dy in (0, 1)}


def test_erode(spark):
    ink = _ink(spark, {(x, 3) for x in range(10, 60)} | {(x, 9) for x in range(30)})
    assert _set(raster.erode_runs(ink, "x", 40)) == {(x, 3) for x in range(30, 41)}


def test_adaptive_threshold_numpy(spark):
    h, w = 40, 50
    gray = np.fromfunction(lambda y, x: (x * 3 + y * 7) % 256, (h, w)).astype(int)
    gray[10:14, 5:45] = 0
    rows = [("p", x, y, int(gray[y, x])) for y in range(h) for x in range(w)]
    got = _set(raster.adaptive_threshold(spark.createDataFrame(rows, "page_id string, x int, y int, v int")))
    k = np.array(raster._gauss(31))
    pad = np.pad(gray.astype(float), 15, mode="edge")
    blur = np.apply_along_axis(lambda r: np.convolve(r, k, mode="valid"), 1, pad)
    blur = np.apply_along_axis(lambda r: np.convolve(r, k, mode="valid"), 0, blur)
    white = gray > np.rint(blur) - 10
    ink = ~white if white.mean() * 255 > 127 else white
    ys, xs = np.nonzero(ink)
    assert got == set(zip(xs.tolist(), ys.tolist(), strict=True))


def test_grid_cells(spark):
    lines = {(x, y) for y in range(0, 200, 50) for x in range(200)} | {(x, y) for x in range(0, 200, 50) for y in range(200)}
    sizes = spark.createDataFrame([("p", 200, 200), ("q", 10, 10)], "page_id string, width int, height int")
    got = {r["page_id"]: r["cells"] for r in cc.grid_cells(_ink(spark, lines), sizes).collect()}
    assert got == {"p": 16, "q": 0}


def test_segment_peels_frame_text_and_rest(spark):
    frame = {(x, y) for x in range(400) for y in (0, 299)} | {(x, y) for y in range(300) for x in (0, 399)}
    letter = {(x + 50, y + 50) for x in range(6) for y in range(8)}
    speck = {(200, 200), (201, 200)}
    blob = {(x + 250, y + 100) for x in range(100) for y in range(100)}
    sizes = spark.createDataFrame([("p", 400, 300)], "page_id string, width int, height int")
    rows = cc.segment(_ink(spark, frame | letter | speck | blob), sizes).collect()
    by = {}
    for r in rows:
        by.setdefault(r["class"], set()).add((r["x"], r["y"]))
    assert by["frame_titleblock"] == frame
    assert letter <= by["text"] and by["noise"] == speck
    assert not by["visible_geometry"] & (frame | letter | speck)
    assert all(r["confidence"] == cc.CLASS_CONFIDENCE[r["class"]] for r in rows)


def _png(path, gray: np.ndarray) -> None:
    h, w = gray.shape
    raw = b"".join(b"\x00" + gray[y].tobytes() for y in range(h))
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n"
        + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0))
        + chunk(b"IDAT", zlib.compress(raw))
        + chunk(b"IEND", b"")
    )


def test_scan_pixels(spark, tmp_path):
    gray = np.fromfunction(lambda y, x: (x * 3 + y * 7) % 256, (30, 40)).astype(np.uint8)
    _png(tmp_path / "one.png", gray)
    (tmp_path / "broken.png").write_bytes(b"not an image")
    got = files.scan_pixels(spark, str(tmp_path)).toPandas()
    assert set(got["page_id"]) == {"one"} and len(got) == gray.size
    back = np.zeros_like(gray)
    back[got["y"], got["x"]] = got["v"]
    assert (back == gray).all()
    bad = files.undecodable(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[-1], r.reason) for r in bad] == [("broken.png", "not a readable image")]


@pytest.mark.parametrize("shape", ["line", "rectangle", "circle"])
def test_drawing_to_primitives(spark, shape):
    none = F.lit(None).cast("double")
    spec = {
        "line": [("LINE", 50, 200, 550, 200)],
        "rectangle": [("LINE", 100, 80, 500, 80), ("LINE", 500, 80, 500, 320), ("LINE", 500, 320, 100, 320), ("LINE", 100, 320, 100, 80)],
        "circle": [("CIRCLE", 200, 200, 0, 0)],
    }[shape]
    drawn = spark.createDataFrame(
        [("p", t, "02_PART_VISIBLE", float(a), float(b), float(c), float(d)) for t, a, b, c, d in spec],
        "page_id string, type string, layer string, x1 double, y1 double, x2 double, y2 double",
    ).withColumns({"radius": F.lit(100.0), "start_angle_deg": none, "end_angle_deg": none})
    sizes = spark.createDataFrame([("p", 600, 400, "detail_drawing")], "page_id string, width int, height int, page_type string")
    ink = raster.rasterise(drawn, None, sizes.select("page_id", "width", "height"))
    primitives = pages.vectorise(ink).toPandas()
    if shape == "circle":
        assert set(primitives["type"]) <= {"CIRCLE", "ARC"} and abs(primitives["radius"].iloc[0] - 100) < 2
    else:
        assert (primitives["type"] == "LINE").sum() >= len(spec)
    if shape == "rectangle":
        judged = pages.quality(pages.vectorise(ink), ink, sizes).first()
        assert judged["chamfer_px"] < 2 and judged["raster_iou"] > 0.3


def test_prepared_page_like_numpy(spark):
    """A tilted drawing on a gray page, against a plain computation of every step."""
    rng = np.random.default_rng(4)
    height, width = 120, 160
    page = np.full((height, width), 200.0) + rng.normal(0, 3, (height, width))
    for y in range(20, 100, 16):
        for x in range(12, 150):
            page[int(round(y + (x - 80) * np.tan(np.radians(4.0)))), x] = 40
    gray = np.clip(page, 0, 255).astype(int)
    pixels = spark.createDataFrame(
        [("p", int(x), int(y), int(gray[y, x])) for y in range(height) for x in range(width)], "page_id string, x int, y int, v int"
    )
    upright, rows = pages.prepare(pixels)
    row = rows.first()
    dark = {(r.x, r.y) for r in raster.binarize(pixels).collect()}
    best, score = 0.0, -1
    for i in range(101):
        a = np.radians(-10 + i * 0.2)
        xs, ys = np.array([p[0] for p in dark]), np.array([p[1] for p in dark])
        dx, dy = xs - width / 2, ys - height / 2
        rx, ry = np.floor(np.cos(a) * dx + np.sin(a) * dy + width / 2 + 0.5), np.floor(np.cos(a) * dy - np.sin(a) * dx + height / 2 + 0.5)
        on = (rx >= 0) & (rx < width) & (ry >= 0) & (ry < height)
        value = np.bincount(ry[on].astype(int), minlength=height).var()
        if value > score + 1e-9:
            best, score = -10 + i * 0.2, value
    assert abs(row.skew_deg - best) < 1e-6 and abs(abs(best) - 4.0) < 0.5
    assert abs(row.contrast - min(1, gray.std() / 80)) < 1e-6
    assert abs(row.fg_ratio - upright.count() / (width * height)) < 1e-9
    lines = {r.y for r in upright.groupBy("y").count().where("count > 60").collect()}
    assert len(lines) >= 5
    assert (row.width, row.height, row.has_frame) == (width, height, False)
    assert "high_skew" not in row.warnings
