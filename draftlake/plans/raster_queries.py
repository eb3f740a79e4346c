"""Raster queries: gray statistics, runs, masks, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.functions import rules
from draftlake.operators import raster
from draftlake.plans.fixtures import Source, oracle_with
from draftlake.plans.registry import joined, query, r6


def _ink_sizes(ink: DataFrame, width: int = 832, height: int = 512) -> DataFrame:
    """All derived ink pages are 832×512."""
    return ink.select("page_id").distinct().select("page_id", F.lit(width).alias("width"), F.lit(height).alias("height"))


# ------------------------------------------------------------------ gray values
@query(
    "a7_ink_stats",
    oracle_with(
        "pixels",
        body="""
SELECT page_id, COUNT(*) AS area, ROUND(CAST(COUNT(*) FILTER (v > 130) AS DOUBLE) / COUNT(*), 6) AS fg_ratio,
       ROUND(LEAST(GREATEST(STDDEV_POP(v) / 80.0, 0), 1), 6) AS contrast FROM pixels GROUP BY page_id""",
    ),
)
def a7(src: Source) -> DataFrame:
    gray = src["pixels"]
    ink = gray.withColumn("v", F.when(F.col("v") > 130, 255).otherwise(0))
    share = raster.ink_stats(ink).select("page_id", "area", r6("fg_ratio").alias("fg_ratio"))
    return share.join(raster.ink_stats(gray).select("page_id", r6("contrast").alias("contrast")), "page_id")


@query(
    "a8_noise_score",
    oracle_with(
        "pixels",
        body="""
, n AS (SELECT page_id, v, LAG(v) OVER h AS l, LEAD(v) OVER h AS r, LAG(v) OVER w AS u, LEAD(v) OVER w AS d FROM pixels
  WINDOW h AS (PARTITION BY page_id, y ORDER BY x), w AS (PARTITION BY page_id, x ORDER BY y)),
p AS (SELECT page_id, CAST(COALESCE(l, r) + COALESCE(r, l) + COALESCE(u, d) + COALESCE(d, u) - 4 * v AS DOUBLE) AS lap FROM n)
SELECT page_id, ROUND(VAR_POP(lap), 4) AS laplacian_var, ROUND(LEAST(GREATEST(VAR_POP(lap) / 1500.0, 0), 1), 6) AS noise FROM p GROUP BY page_id""",
    ),
)
def a8(src: Source) -> DataFrame:
    return raster.noise_score(src["pixels"]).select(
        "page_id", F.round("laplacian_var", 4).alias("laplacian_var"), r6("noise").alias("noise")
    )


@query(
    "a9_otsu",
    oracle_with(
        "pixels",
        body="""
, h AS (SELECT page_id, v, COUNT(*) AS n FROM pixels GROUP BY page_id, v),
c AS (SELECT page_id, v, CAST(SUM(n) OVER a AS BIGINT) AS n0, CAST(SUM(n * v) OVER a AS BIGINT) AS s0, CAST(SUM(n) OVER b AS BIGINT) AS total, CAST(SUM(n * v) OVER b AS BIGINT) AS s
  FROM h WINDOW a AS (PARTITION BY page_id ORDER BY v), b AS (PARTITION BY page_id)),
k AS (SELECT *, COALESCE(n0 * (total - n0) * POWER(CAST(s0 AS DOUBLE) / n0 - CAST(s - s0 AS DOUBLE) / NULLIF(total - n0, 0), 2), 0) AS between_var FROM c),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY between_var DESC, v) AS rn FROM k)
SELECT page_id, v AS threshold, (1.0 - CAST(n0 AS DOUBLE) / total) * 255 > 127 AS inverted FROM r WHERE rn = 1""",
    ),
)
def a9(src: Source) -> DataFrame:
    return raster.otsu(src["pixels"])


@query(
    "w9_adaptive_threshold",
    oracle_with(
        "pixels",
        body="""
, k AS (SELECT k, EXP(-k * k / 50.0) / SUM(EXP(-k * k / 50.0)) OVER () AS w FROM (SELECT CAST(UNNEST(RANGE(-15, 16)) AS DOUBLE) AS k) r),
size AS (SELECT page_id, MAX(x) AS mx, MAX(y) AS my FROM pixels GROUP BY page_id),
h AS (SELECT p.page_id, p.x, p.y, p.v, SUM(k.w * q.v) AS h FROM pixels p JOIN size s ON s.page_id = p.page_id CROSS JOIN k
  JOIN pixels q ON q.page_id = p.page_id AND q.y = p.y AND q.x = CAST(LEAST(GREATEST(p.x + k.k, 0), s.mx) AS INT) GROUP BY ALL),
m AS (SELECT p.page_id, p.x, p.y, p.v, SUM(k.w * q.h) AS m FROM h p JOIN size s ON s.page_id = p.page_id CROSS JOIN k
  JOIN h q ON q.page_id = p.page_id AND q.x = p.x AND q.y = CAST(LEAST(GREATEST(p.y + k.k, 0), s.my) AS INT) GROUP BY ALL),
t AS (SELECT page_id, x, y, v > ROUND_EVEN(m, 0) - 10 AS white FROM m),
f AS (SELECT page_id, AVG(CAST(white AS INT)) * 255 > 127 AS flip FROM t GROUP BY page_id)
SELECT t.page_id, x, y FROM t JOIN f ON f.page_id = t.page_id WHERE white <> flip""",
    ),
)
def w9(src: Source) -> DataFrame:
    return raster.adaptive_threshold(src["pixels"])


@query(
    "p12_quality_warnings",
    oracle_with(
        "qa_metrics",
        body="""
SELECT qa_id, CONCAT_WS('|', CASE WHEN c < 0.25 THEN 'low_contrast' END, CASE WHEN n < 0.15 THEN 'noisy_or_blurred' END,
  CASE WHEN f < 0.005 THEN 'almost_blank_page' END, CASE WHEN f > 0.8 THEN 'almost_solid_page' END, CASE WHEN ABS(s) > 5 THEN 'high_skew' END) AS warnings
FROM (SELECT qa_id, raster_iou - 0.6 AS c, chamfer_px / 10 AS n, hausdorff_px / 14 AS f, hausdorff_px - 6.5 AS s FROM qa_metrics) t""",
    ),
)
def p12(src: Source) -> DataFrame:
    flags = rules.quality_warnings(
        F.col("raster_iou") - 0.6, F.col("chamfer_px") / 10, F.col("hausdorff_px") / 14, F.col("hausdorff_px") - 6.5
    )
    return src["qa_metrics"].select("qa_id", joined(flags).alias("warnings"))


@query(
    "p13_route_page",
    oracle_with(
        "qa_metrics",
        body="""
SELECT qa_id, CASE WHEN f IS NULL THEN 'unknown' WHEN c < 0.25 AND f < 0.005 THEN 'bad_scan' WHEN f > 0.8 THEN 'bad_scan'
  WHEN d >= 0.45 AND k >= 18 THEN 'specification_sheet' WHEN d < 0.15 AND k < 4 THEN 'detail_drawing' ELSE 'unknown' END AS page_type,
  ROUND(CASE WHEN f IS NULL THEN 0.0 WHEN c < 0.25 AND f < 0.005 THEN 0.85 WHEN f > 0.8 THEN 0.7 WHEN d >= 0.45 AND k >= 18 THEN LEAST(0.95, 0.5 + 0.5 * d)
  WHEN d < 0.15 AND k < 4 THEN LEAST(0.85, 0.55 + 0.5 * (1 - d)) ELSE 0.4 END, 6) AS confidence,
  CASE WHEN f IS NULL THEN 'empty_image' WHEN c < 0.25 AND f < 0.005 THEN 'low_contrast_blank' WHEN f > 0.8 THEN 'almost_solid_page'
  WHEN d >= 0.45 AND k >= 18 THEN 'high_text_density_with_grid' WHEN d < 0.15 AND k < 4 THEN 'low_text_density' ELSE 'ambiguous' END AS rule
FROM (SELECT qa_id, raster_iou - 0.6 AS c, CASE WHEN qa_id % 23 = 0 THEN NULL ELSE hausdorff_px / 14 END AS f, chamfer_px / 9 AS d, CAST(qa_id % 31 AS INT) AS k FROM qa_metrics) t""",
    ),
)
def p13(src: Source) -> DataFrame:
    fg = F.when(F.col("qa_id") % 23 != 0, F.col("hausdorff_px") / 14)
    routed = rules.route_page(F.col("raster_iou") - 0.6, fg, F.col("chamfer_px") / 9, (F.col("qa_id") % 31).cast("int"))
    return (
        src["qa_metrics"]
        .withColumn("r", routed)
        .select(
            "qa_id",
            F.col("r.page_type").alias("page_type"),
            r6("r.confidence").alias("confidence"),
            F.substring_index("r.reason", ":", 1).alias("rule"),
        )
    )


# ------------------------------------------------------------------------ skew
@query(
    "a10_estimate_skew",
    oracle_with(
        "ink_a",
        body="""
, t AS (SELECT i.page_id, a.i, FLOOR(COS(RADIANS(-10.0 + a.i * 0.2)) * (x - 416.0) + SIN(RADIANS(-10.0 + a.i * 0.2)) * (y - 256.0) + 416.0 + 0.5) AS rx,
   FLOOR(COS(RADIANS(-10.0 + a.i * 0.2)) * (y - 256.0) - SIN(RADIANS(-10.0 + a.i * 0.2)) * (x - 416.0) + 256.0 + 0.5) AS ry
  FROM ink_a i, (SELECT UNNEST(RANGE(0, 101)) AS i) a),
c AS (SELECT page_id, i, ry, COUNT(*) AS c FROM t WHERE rx >= 0 AND rx < 832 AND ry >= 0 AND ry < 512 GROUP BY page_id, i, ry),
s AS (SELECT page_id, i, CAST(SUM(c * c) * 512 - SUM(c) * SUM(c) AS BIGINT) AS score FROM c GROUP BY page_id, i),
b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY score DESC, i) AS rn FROM s)
SELECT page_id, ROUND(-10.0 + i * 0.2, 6) + 0.0 AS angle FROM b WHERE rn = 1""",
    ),
)
def a10(src: Source) -> DataFrame:
    ink = src["ink_a"]
    return raster.estimate_skew(ink, _ink_sizes(ink))


# ------------------------------------------------------------- runs, morphology
_RUNS = """
, g AS (SELECT page_id, {line}, {axis}, {axis} - ROW_NUMBER() OVER (PARTITION BY page_id, {line} ORDER BY {axis}) AS k FROM ink_a),
runs AS (SELECT page_id, {line}, MIN({axis}) AS a0, MAX({axis}) AS a1 FROM g GROUP BY page_id, {line}, k)"""


@query(
    "w6_runs",
    oracle_with(
        "ink_a",
        body=_RUNS.format(line="y", axis="x") + " SELECT page_id, y, a0 AS x0, a1 AS x1, CAST(a1 - a0 + 1 AS INT) AS length FROM runs",
    ),
)
def w6(src: Source) -> DataFrame:
    return raster.runs(src["ink_a"])


@query(
    "w6_open_vertical",
    oracle_with(
        "ink_a",
        body=_RUNS.format(line="x", axis="y")
        + " SELECT page_id, x, CAST(UNNEST(RANGE(a0, a1 + 1)) AS INT) AS y FROM runs WHERE a1 - a0 + 1 >= 4",
    ),
)
def w6_open(src: Source) -> DataFrame:
    return raster.open_runs(src["ink_a"], "y", 4)


@query(
    "j13_run_edges",
    oracle_with(
        "ink_a",
        body=_RUNS.format(line="y", axis="x")
        + """
SELECT a.page_id, a.y AS ay, a.a0 AS ax0, a.a1 AS ax1, b.y AS by, b.a0 AS bx0, b.a1 AS bx1 FROM runs a JOIN runs b
ON b.page_id = a.page_id AND b.y = a.y + 1 AND a.a0 <= b.a1 + 1 AND b.a0 <= a.a1 + 1""",
    ),
)
def j13(src: Source) -> DataFrame:
    return raster.run_edges(raster.runs(src["ink_a"]))


@query(
    "j10_neighbours",
    oracle_with(
        "ink_a",
        body="""
, o AS (SELECT dx, dy FROM (SELECT UNNEST([-1, 0, 1]) AS dx) a, (SELECT UNNEST([-1, 0, 1]) AS dy) b WHERE dx <> 0 OR dy <> 0),
c AS (SELECT i.page_id, i.x, i.y, COUNT(n.x) AS neighbours FROM ink_a i CROSS JOIN o LEFT JOIN ink_a n ON n.page_id = i.page_id AND n.x = i.x + o.dx AND n.y = i.y + o.dy GROUP BY ALL)
SELECT *, CASE WHEN neighbours = 1 THEN 'end' WHEN neighbours >= 3 THEN 'junction' END AS role FROM c""",
    ),
)
def j10(src: Source) -> DataFrame:
    return raster.neighbours(src["ink_a"])


@query(
    "a13_mask_bbox",
    oracle_with(
        "ink_a",
        body="SELECT page_id, MIN(x) AS x0, MIN(y) AS y0, MAX(x) AS x1, MAX(y) AS y1, COUNT(*) AS pixels FROM ink_a GROUP BY page_id",
    ),
)
def a13(src: Source) -> DataFrame:
    return raster.mask_bbox(src["ink_a"])


@query("u2_mask_union", oracle_with("ink_a", "ink_b", body="SELECT * FROM ink_a UNION SELECT * FROM ink_b"))
def u2(src: Source) -> DataFrame:
    return raster.mask_union(src["ink_a"], src["ink_b"])


@query("u3_mask_subtract", oracle_with("ink_a", "ink_b", body="SELECT * FROM ink_a EXCEPT SELECT * FROM ink_b"))
def u3(src: Source) -> DataFrame:
    return raster.mask_subtract(src["ink_a"], src["ink_b"])


@query("u4_mask_intersect", oracle_with("ink_a", "ink_b", body="SELECT * FROM ink_a INTERSECT SELECT * FROM ink_b"))
def u4(src: Source) -> DataFrame:
    return raster.mask_intersect(src["ink_a"], src["ink_b"])


@query(
    "u5_dilate",
    oracle_with(
        "ink_a",
        body="""
SELECT DISTINCT page_id, CAST(x + dx AS INT) AS x, CAST(y + dy AS INT) AS y FROM ink_a, (SELECT UNNEST([-1, 0, 1]) AS dx) a, (SELECT UNNEST([0, 1]) AS dy) b""",
    ),
)
def u5(src: Source) -> DataFrame:
    return raster.dilate(src["ink_a"], 3, 2)


# --------------------------------------------------------------------- compare
@query(
    "a15_raster_iou",
    oracle_with(
        "ink_a",
        "ink_b",
        body="""
SELECT page_id, CAST(SUM(a * b) AS BIGINT) AS intersection, COUNT(*) AS union, ROUND(CAST(SUM(a * b) AS DOUBLE) / COUNT(*), 6) AS iou
FROM (SELECT COALESCE(a.page_id, b.page_id) AS page_id, CASE WHEN a.x IS NULL THEN 0 ELSE 1 END AS a, CASE WHEN b.x IS NULL THEN 0 ELSE 1 END AS b
      FROM ink_a a FULL JOIN ink_b b ON b.page_id = a.page_id AND b.x = a.x AND b.y = a.y) t GROUP BY page_id""",
    ),
)
def a15(src: Source) -> DataFrame:
    return raster.raster_iou(src["ink_a"], src["ink_b"]).withColumn("iou", r6("iou"))


_NEAR = """
, d AS (SELECT a.page_id, a.x, a.y, SQRT(MIN((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS dist
  FROM {a} a JOIN {b} b ON b.page_id = a.page_id GROUP BY a.page_id, a.x, a.y)"""


@query(
    "j11_nearest_ink",
    oracle_with("ink_a", "ink_b", body=_NEAR.format(a="ink_a", b="ink_b") + " SELECT page_id, x, y, ROUND(dist, 6) AS dist FROM d"),
)
def j11(src: Source) -> DataFrame:
    return raster.nearest_ink(src["ink_a"], src["ink_b"]).withColumn("dist", r6("dist"))


_BOTH = (
    _NEAR.format(a="ink_a", b="ink_b")
    + _NEAR.format(a="ink_b", b="ink_a").replace(", d AS", ", e AS")
    + """
, s AS (SELECT page_id, AVG(dist) AS m, QUANTILE_CONT(dist, 0.99) AS p FROM d GROUP BY page_id
  UNION ALL SELECT page_id, AVG(dist), QUANTILE_CONT(dist, 0.99) FROM e GROUP BY page_id)"""
)


@query(
    "a16_chamfer", oracle_with("ink_a", "ink_b", body=_BOTH + " SELECT page_id, ROUND(AVG(m), 6) AS chamfer FROM s GROUP BY page_id")
)
def a16(src: Source) -> DataFrame:
    return raster.distances(src["ink_a"], src["ink_b"]).select("page_id", r6("chamfer").alias("chamfer"))


@query(
    "a17_hausdorff",
    oracle_with("ink_a", "ink_b", body=_BOTH + " SELECT page_id, ROUND(MAX(p), 6) AS hausdorff FROM s GROUP BY page_id"),
)
def a17(src: Source) -> DataFrame:
    return raster.distances(src["ink_a"], src["ink_b"]).select("page_id", r6("hausdorff").alias("hausdorff"))


@query(
    "a18_deviation_map",
    oracle_with(
        "ink_a",
        "ink_b",
        body=_NEAR.format(a="ink_a", b="ink_b")
        + """
, p AS (SELECT page_id, QUANTILE_CONT(dist, 0.99) AS p FROM d GROUP BY page_id)
SELECT d.page_id, d.x, d.y, ROUND(d.dist, 6) AS dist, CAST(FLOOR(LEAST(GREATEST(d.dist / GREATEST(1.0, p.p), 0), 1) * 255) AS INT) AS heat FROM d JOIN p ON p.page_id = d.page_id""",
    ),
)
def a18(src: Source) -> DataFrame:
    return raster.deviation_map(src["ink_a"], src["ink_b"]).withColumn("dist", r6("dist"))


# ---------------------------------------------------------- component summaries
@query(
    "a12_text_density",
    oracle_with(
        "component_table",
        "page_sizes",
        body="""
, c AS (SELECT page_id, COUNT(*) FILTER (area BETWEEN 10 AND 600 AND x1 - x0 + 1 BETWEEN 4 AND 60 AND y1 - y0 + 1 BETWEEN 4 AND 60) AS blobs FROM component_table GROUP BY page_id)
SELECT s.page_id, COALESCE(blobs, 0) AS blobs, ROUND(LEAST(1.0, COALESCE(blobs, 0) / GREATEST(1.0, CAST(width * height AS DOUBLE) / 50000)), 6) AS density
FROM page_sizes s LEFT JOIN c ON c.page_id = s.page_id""",
    ),
)
def a12(src: Source) -> DataFrame:
    return raster.text_density(src["component_table"], src["page_sizes"]).withColumn("density", r6("density"))


@query(
    "a14_detect_frame",
    oracle_with(
        "component_table",
        "page_sizes",
        body="""
, b AS (SELECT c.*, (x1 - x0 + 1) * (y1 - y0 + 1) AS box, s.width, s.height FROM component_table c JOIN page_sizes s ON s.page_id = c.page_id),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY box DESC, comp) AS rn FROM b WHERE box >= 0.4 * width * height)
SELECT s.page_id, COALESCE(r.x0, 0) AS x1, COALESCE(r.y0, 0) AS y1, COALESCE(r.x1 + 1, s.width) AS x2, COALESCE(r.y1 + 1, s.height) AS y2, r.comp IS NOT NULL AS found, r.comp
FROM page_sizes s LEFT JOIN r ON r.page_id = s.page_id AND r.rn = 1""",
    ),
)
def a14(src: Source) -> DataFrame:
    return raster.detect_frame(src["component_table"], src["page_sizes"])


# ------------------------------------------------------------------- rasterise
@query(
    "i7_rasterise_lines",
    oracle_with(
        "segments",
        "page_sizes",
        body="""
, l AS (SELECT s.page_id, x1, y1, x2, y2, GREATEST(ABS(x2 - x1), ABS(y2 - y1), 1) AS n, p.width, p.height FROM segments s JOIN page_sizes p ON p.page_id = s.page_id),
k AS (SELECT *, UNNEST(RANGE(0, CAST(n AS BIGINT) + 1)) AS k FROM l),
t AS (SELECT DISTINCT page_id, width, height, CAST(ROUND_EVEN(x1 + k / n * (x2 - x1), 0) AS INT) AS x, CAST(ROUND_EVEN(y1 + k / n * (y2 - y1), 0) AS INT) AS y FROM k),
d AS (SELECT DISTINCT page_id, width, height, x + dx AS x, y + dy AS y FROM t, (SELECT UNNEST([0, 1]) AS dx) a, (SELECT UNNEST([0, 1]) AS dy) b)
SELECT page_id, y, COUNT(*) AS ink, CAST(SUM(x) AS BIGINT) AS sum_x FROM d WHERE x >= 0 AND y >= 0 AND x < width AND y < height GROUP BY page_id, y""",
    ),
)
def i7_lines(src: Source) -> DataFrame:
    shapeless = {c: F.lit(None).cast("double") for c in ("radius", "start_angle_deg", "end_angle_deg")}
    lines = src["segments"].withColumns({"type": F.lit("LINE"), "layer": F.lit("02_PART_VISIBLE"), **shapeless})
    ink = raster.rasterise(lines, None, src["page_sizes"])
    return ink.groupBy("page_id", "y").agg(F.count("*").alias("ink"), F.sum("x").alias("sum_x"))


@query("i7_rasterise")
def i7(src: Source) -> DataFrame:
    from draftlake.plans.vector_queries import _polylines

    curves = _polylines(src).withColumn("layer", F.lit("02_PART_VISIBLE"))
    return raster.rasterise(src["primitives"], curves, src["page_sizes"]).groupBy("page_id").agg(F.count("*").alias("ink"))


@query("page_preparation")
def page_preparation(src: Source) -> DataFrame:
    """Gray pixels to quality rows: threshold, deskew, frame, density, warnings."""
    from draftlake.plans import pages

    _, rows = pages.prepare(src["pixels"])
    return rows.withColumns({c: r6(c) for c in ("contrast", "noise", "fg_ratio", "text_density")}).withColumn("warnings", joined("warnings"))
