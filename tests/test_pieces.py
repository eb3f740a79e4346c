"""Ink travels and is kept as pieces of tiles, not as rows of pixels."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from draftlake.operators import chains, pieces, raster
from draftlake.operators import components as cc
from draftlake.session import settle_dense

INK = "page_id string, x int, y int"


def _noise(seed, wide, tall, share, left=0, top=0):
    rng = random.Random(seed)
    return [(x + left, y + top) for x in range(wide) for y in range(tall) if rng.random() < share]


def _strokes(spark):
    """Two strokes of two pixels each over several tiles."""
    points = {(x, y) for x in range(10, 590) for y in (250, 251)} | {(x, y) for x in (300, 301) for y in range(5, 395)}
    return spark.createDataFrame([("p", x, y) for x, y in points], INK)


def test_pieces_keep_every_pixel(spark):
    rows = [("p", x, y) for x, y in _noise(1, 90, 60, 0.4, 230, 220)] * 2 + [(None, 3, 4), ("q", -1, -300), ("q", 1 << 30, 1 << 30)]
    random.Random(2).shuffle(rows)
    ink = spark.createDataFrame([*rows, ("p", None, 4), (None, None, None)], INK).coalesce(1)
    held = pieces.packed(ink)
    assert Counter(map(tuple, pieces.unpacked(held).collect())) == Counter(rows)
    assert held.where("tx is not null and ty is not null").count() == 4 + 3
    lone = [np.frombuffer(r.codes, "<f8").tolist() for r in held.where("tx is null").collect()]
    assert sorted(map(repr, lone)) == ["[nan, 4.0]", "[nan, nan]"]


def test_solid_runs_in_any_order(spark):
    points = _noise(3, 60, 20, 0.7, 40)
    rows = [("p", *p) for p in points + points[::3]] + [(None, 5, 5), ("p", None, 3)]
    random.Random(4).shuffle(rows)
    ink = spark.createDataFrame(rows, INK).repartition(3)
    for axis, line in (("x", "y"), ("y", "x")):
        got = {tuple(r) for r in pieces.solid_runs(ink, axis).collect()}
        want = {tuple(r) for r in raster.runs(ink.where("x is not null").distinct(), axis).collect()}
        assert got == want


def test_strokes_are_thin_after_one_round_of_tiles(spark, monkeypatch):
    """Before, a second round went over the same tiles, and every round kept rows of pixels."""
    kept, settle = [], cc.settle
    monkeypatch.setattr(cc, "settle", lambda df: kept.append(settle(df)) or kept[-1])
    assert cc.thin(_strokes(spark)).count() < 1100
    assert len(kept) == 1 and kept[0].count() <= 6


def test_thin_and_corners_of_noise_as_on_the_whole_page(spark):
    points = _noise(5, 300, 60, 0.75, 100, 230)
    img = np.zeros((400, 500), bool)
    for x, y in points:
        img[y + 1, x + 1] = True
    while True:
        after = cc._thin_pass(cc._thin_pass(img, True), False)
        if (after == img).all():
            break
        img = after
    ink = spark.createDataFrame([("p", x, y) for x, y in points] + [(None, x, y) for x, y in points] + [("p", None, 1)], INK)
    for corners, want in ((True, img), (False, cc._drop_corners(cc._drop_corners(img, True), False))):
        got = Counter((r.page_id, r.x, r.y) for r in cc.thin(ink, corners=corners).collect())
        ys, xs = np.nonzero(want)
        assert got == Counter((p, x - 1, y - 1) for p in ("p", None) for x, y in zip(xs.tolist(), ys.tolist(), strict=True))


def test_chains_alike_by_page_and_by_tiles(spark, monkeypatch):
    """Before, every page was put together from tiles by joins."""
    t = pieces.TILE
    ring = lambda cx, cy, r: {(cx + round(r * math.cos(a / 90)), cy + round(r * math.sin(a / 90))) for a in range(566)}
    drawn = {(x, 40) for x in range(t - 40, t + 41)} | {(t, y) for y in range(10, 71)} | ring(t, t, 30) | ring(t + 90, t - 3, 20) | ring(60, 60, 12) | {(x, x) for x in range(300, 330)}
    skeleton = cc.thin(spark.createDataFrame([("p", x, y) for x, y in drawn], INK), corners=False)
    noise = [("q", *p) for p in _noise(6, 70, 50, 0.22, t - 30, t - 20)] + [("r", t, 5), ("r", t - 1, 4), ("r", t + 1, 6), ("r", t, 7)]
    ink = skeleton.unionByName(spark.createDataFrame(noise, INK)).localCheckpoint()
    own, late = chains._chains_by_tiles, []
    monkeypatch.setattr(chains, "_chains_by_tiles", lambda *a: late.append(1) or own(*a))
    rows = lambda df: sorted(map(tuple, df.select("page_id", "chain_id", "ord", "x", "y", "closed").collect()))
    got = rows(chains.extract_chains(ink))
    assert not late and len({r[:2] for r in got}) > 30 and len({r[1] for r in got if r[5] and r[0] == "p"}) == 3
    monkeypatch.setattr(chains, "PAGE_PIXELS", 0)
    assert got == rows(chains.extract_chains(ink)) and late


def test_a_painted_tile_is_one_row(spark):
    """Before, every pixel left its task as a row."""
    rows = [("p", "LINE", "L", 0.0, 5.0, 2000.0, 5.0, None, None, None), ("p", "CIRCLE", "L", 300.0, 260.0, None, None, 40.0, None, None)]
    shapes = spark.createDataFrame(rows, "page_id string, type string, layer string, x1 double, y1 double, x2 double, y2 double, radius double, start_angle_deg double, end_angle_deg double")
    ink = raster.rasterise(shapes, None, spark.createDataFrame([("p", 600, 400)], "page_id string, width int, height int"))
    assert "explode(codes" in ink._jdf.queryExecution().optimizedPlan().toString()
    assert ink.where("x >= 600 or y >= 400").count() == 0 and ink.distinct().count() == ink.count()


def test_angles_far_from_an_end_are_not_computed_twice(monkeypatch):
    rng = np.random.default_rng(7)
    dy, dx = rng.integers(-50, 50, 4000).astype(float), rng.integers(-50, 50, 4000).astype(float)
    start, sweep = rng.integers(-400, 400, 4000).astype(float), rng.integers(0, 360, 4000).astype(float)
    turned = np.fmod(np.degrees(raster._atan2(dy, dx)) - start, 360.0)
    want = np.where(turned < 0, np.fmod(turned + 360.0, 360.0), turned) <= sweep
    own, asked = raster._atan2, []
    monkeypatch.setattr(raster, "_atan2", lambda y, x: asked.append(len(y)) or own(y, x))
    assert (raster._on_arc(dy, dx, start, sweep) == want).all()
    assert sum(asked) < 400 and raster._on_arc(dy, dx, start, np.full(4000, 360.0)).all()


def test_masks_meet_as_pieces(spark):
    """Before, both masks went into a join as rows of pixels."""
    a = spark.createDataFrame([("p", x, y) for x, y in _noise(8, 40, 40, 0.5, 240)] * 2 + [(None, 1, 1), ("p", None, 1)], INK)
    b = spark.createDataFrame([("p", x, y) for x, y in _noise(9, 40, 40, 0.5, 240)] + [(None, 1, 1), ("p", None, 1)], INK)
    met = raster.mask_intersect(a, b)
    assert "Join" not in met._jdf.queryExecution().optimizedPlan().toString()
    assert Counter(map(tuple, met.collect())) == Counter(map(tuple, a.join(b.distinct(), ["page_id", "x", "y"], "left_semi").collect()))


def test_components_get_pieces(spark, monkeypatch):
    """Before, pixels were exchanged twice as rows."""
    sent, packed = [], cc.packed
    monkeypatch.setattr(cc, "packed", lambda ink: sent.append(packed(ink)) or sent[-1])
    assert cc.components(_strokes(spark).coalesce(1)).select("comp").distinct().count() == 1
    assert len(sent) == 1 and sent[0].count() == 4


def test_a_dense_table_keeps_rows_and_types(spark):
    df = spark.range(30_000).select(
        F.concat(F.lit("p"), F.col("id") % 3).alias("page_id"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("n"),
        F.struct((F.col("id") / 2).alias("v"), (F.col("id") % 2 == 0).alias("even")).alias("s"), F.array("id").alias("a"),
    )
    back = settle_dense(df)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()
