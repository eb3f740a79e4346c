"""What travels in the large joins: columns and rows ahead of the exchanges, not only results."""

from __future__ import annotations

import random


from pyspark.sql import functions as F

from draftlake.operators import raster
from draftlake.operators import vector as vec

SEGMENTS = "page_id string, seg_id long, x1 double, y1 double, x2 double, y2 double, rms_px double, inliers long"


def segments(spark, count=120, seed=1):
    rng = random.Random(seed)
    rows = [(f"p{k % 2}", k, *(float(rng.randrange(60)) for _ in range(4)), 0.5, 10) for k in range(count)]
    return spark.createDataFrame(rows, SEGMENTS)


def joined_columns(df):
    """Names of the columns that enter any join of the plan."""
    found, todo = set(), [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        own = [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "Join":
            found |= {c.output().apply(k).name() for c in own for k in range(c.output().size())}
        todo += own
    return found


def test_drawing_exchanges_shapes_not_pixels(spark):
    rows = [("p", "LINE", "L", 0.0, 5.0, 2000.0, 5.0, None, None, None), ("p", "CIRCLE", "L", 300.0, 260.0, None, None, 40.0, None, None)]
    shapes = spark.createDataFrame(rows, "page_id string, type string, layer string, x1 double, y1 double, x2 double, y2 double, radius double, start_angle_deg double, end_angle_deg double")
    sizes = spark.createDataFrame([("p", 600, 400), ("q", 10, 10)], "page_id string, width int, height int")
    ink = raster.rasterise(shapes, None, sizes)
    assert ink._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {(r.x, r.y) for r in ink.collect()}
    assert {(x, y) for x in range(600) for y in (5, 6)} <= got
    assert {(340, 260), (341, 260), (260, 260), (300, 220), (300, 301)} <= got and (300, 260) not in got


def test_arc_ends_as_the_jvm_computes_them(spark):
    points = [(float(y), float(x)) for x in range(-9, 10) for y in range(-9, 10)] + [(75.0**0.5, 5.0), (5.0, 75.0**0.5), (-(75.0**0.5), 5.0)]
    want = [r.a for r in spark.createDataFrame(points, "y double, x double").select("y", "x", F.atan2("y", "x").alias("a")).collect()]
    got = raster._atan2(*map(raster.np.array, zip(*points, strict=True)))
    assert got.tolist() == want


def test_snapping_files_a_candidate_under_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(vec, "spread", None)  # 25 copies of every candidate
    rows = [("p", k, 10.0 * k, 1.0, 10.0 * k + 3.0, 1.0, 0.5, 10) for k in range(8)]
    got = vec.snap_endpoints(spark.createDataFrame(rows, SEGMENTS)).collect()
    assert sorted((r.seg_id, r.x1, r.x2) for r in got) == [(k, 10.0 * k + 1.5, 10.0 * k + 1.5) for k in range(8)]


def test_candidates_travel_without_what_follows_from_their_ends(spark):
    travel = joined_columns(vec.collinear_pairs(segments(spark)))
    assert {"a_x1", "b_x1", "a_copies"} <= travel
    assert not travel & {"a_len", "b_len", "a_ang", "b_ang", "a_rms_px", "b_inliers"}


def test_merge_options_are_ids(spark, monkeypatch):
    kept, settle = [], vec.settle
    monkeypatch.setattr(vec, "settle", lambda df: kept.append(set(df.columns)) or settle(df))
    rows = [("p", k, 20.0 * k, 1.0, 20.0 * k + 15.0, 1.0, 0.5, 10) for k in range(9)]
    got = vec.merge_collinear(spark.createDataFrame(rows, SEGMENTS)).collect()
    assert [(r.seg_id, round(r.x1, 6), round(r.x2, 6), r.inliers) for r in got] == [(0, 0.0, 175.0, 90)]
    options = [c for c in kept if {"i", "j"} <= c and "m" not in c]
    assert options and all(c == {"page_id", "i", "j"} for c in options)


def test_near_points_are_filed_in_few_cells(spark):
    points = spark.createDataFrame([("p", float(x), float(y)) for x in range(0, 400, 5) for y in range(0, 40, 5)], "page_id string, x double, y double")
    near = vec.near_points(points, 4.0)
    assert "array(struct(dx" not in near._jdf.queryExecution().analyzed().toString()
    assert near.count() == 0
    assert vec.near_points(points, 5.0).count() == 79 * 8 + 80 * 7


def test_a_segment_is_exchanged_once_per_cell(spark):
    rows = [("p", 1, 0.0, 0.0, 90.0, 0.0, 0.5, 10), ("p", 1, 0.0, 0.0, 90.0, 0.0, 0.5, 10), ("p", 2, 0.0, 3.0, 90.0, 3.0, 0.5, 10)]
    centres = spark.createDataFrame([("p", 7, 45.0, 1.0)], "page_id string, break_id long, x double, y double")
    near = vec.nearest_segments(spark.createDataFrame(rows, SEGMENTS), centres)
    assert "array_distinct" in near._jdf.queryExecution().analyzed().toString()
    assert [(r.seg_a, r.seg_b, r.dist_a, r.dist_b) for r in near.collect()] == [(1, 2, 1.0, 2.0)]


def test_an_exchange_is_read_in_bounded_parts(spark):
    from draftlake.plans.fixtures import open_source

    names = ["spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = [spark.conf.get(n, None) for n in names]
    try:
        open_source(spark, "")
        ink = spark.range(400_000).select(F.concat(F.lit("p"), F.col("id") % 7).alias("page_id"), F.hash("id").alias("x"), F.hash("id", F.lit(1)).alias("y"))
        both = raster.mask_union(ink, ink.withColumn("x", F.col("x") + 1))
        assert both.rdd.getNumPartitions() > 1  # the session's own number is 4, its size 64 MB
        assert [spark.conf.get(n) for n in names] == ["512", "8m"]
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_snapping_ends_on_points_without_a_place(spark):
    rows = [("p", 1, None, 1.0, 9.0, 1.0, 0.5, 10), (None, 2, 0.0, 0.0, 9.0, 9.0, 0.5, 10), ("p", None, 0.0, 0.0, 9.0, 9.0, 0.5, 10), ("p", 3, 9.0, 3.0, 30.0, 3.0, 0.5, 10)]
    got = vec.snap_endpoints(spark.createDataFrame(rows, SEGMENTS)).collect()
    assert sorted((r.seg_id, r.x1, r.x2, r.y2) for r in got if r.seg_id == 3) == [(3, 9.0, 30.0, 3.0)]
