"""Vector queries: primitives, fits, proximities, export entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.functions import geometry as geo
from draftlake.functions import rules
from draftlake.operators import proximity
from draftlake.operators import vector as vec
from draftlake.plans.fixtures import Source, oracle_with
from draftlake.plans.registry import joined, query, r6
from draftlake.schemas import LAYERS

_PAGES = """
, scale AS (SELECT page_id, CASE WHEN dpi IS NULL THEN NULL ELSE CAST(dpi AS DOUBLE) / CAST(25.4 AS DOUBLE) END AS ppm,
  CAST(COALESCE(height_px, 0) AS DOUBLE) AS h FROM pages_meta)"""


def _pages(src: Source) -> DataFrame:
    return src["pages_meta"].select(
        "page_id", (F.col("dpi").cast("double") / F.lit(25.4)).alias("px_per_mm"), "height_px"
    )


_FIT = """
, s AS (SELECT page_id, chain_id, COUNT(*) AS inliers, AVG(x) AS mx, AVG(y) AS my, VAR_POP(x) AS sxx, VAR_POP(y) AS syy, COVAR_POP(x, y) AS sxy,
  COVAR_POP(x, x * x + y * y) AS sxz, COVAR_POP(y, x * x + y * y) AS syz FROM chain_points GROUP BY page_id, chain_id),
d AS (SELECT *, sxx * syy - sxy * sxy AS det FROM s),
c AS (SELECT *, CASE WHEN inliers >= 3 AND det > 1e-9 * (sxx + syy) * (sxx + syy) THEN (sxz * syy - syz * sxy) / (2 * det) END AS cx,
  CASE WHEN inliers >= 3 AND det > 1e-9 * (sxx + syy) * (sxx + syy) THEN (syz * sxx - sxz * sxy) / (2 * det) END AS cy FROM d),
fits AS (SELECT page_id, chain_id, cx, cy, SQRT(sxx + syy + (mx - cx) * (mx - cx) + (my - cy) * (my - cy)) AS r, inliers FROM c)"""

_RESIDUALS = """
, res AS (SELECT p.page_id, p.chain_id, SQRT(AVG(POWER(SQRT((x - cx) * (x - cx) + (y - cy) * (y - cy)) - r, 2))) AS rms FROM chain_points p
  JOIN fits f ON f.page_id = p.page_id AND f.chain_id = p.chain_id WHERE r IS NOT NULL GROUP BY p.page_id, p.chain_id)"""

_ARCS = """
, raw AS (SELECT p.page_id, p.chain_id, DEGREES(ATAN2(y - cy, x - cx)) AS d FROM chain_points p
  JOIN fits f ON f.page_id = p.page_id AND f.chain_id = p.chain_id WHERE r IS NOT NULL),
ang AS (SELECT DISTINCT page_id, chain_id, d - 360.0 * FLOOR(d / 360.0) AS a FROM raw),
nxt AS (SELECT *, LEAD(a) OVER (PARTITION BY page_id, chain_id ORDER BY a) AS b FROM ang),
ext AS (SELECT page_id, chain_id, MIN(a) AS lo, MAX(a) AS hi, COALESCE(MAX(b - a), 0) AS g FROM nxt GROUP BY page_id, chain_id),
top AS (SELECT n.page_id, n.chain_id, ARG_MIN(n.a, n.a) AS ga, ARG_MIN(n.b, n.a) AS gb FROM nxt n JOIN ext e ON e.page_id = n.page_id AND e.chain_id = n.chain_id
  WHERE n.b - n.a = e.g GROUP BY n.page_id, n.chain_id),
fin AS (SELECT e.*, t.ga, t.gb, 360.0 - (hi - lo) AS wrap, 360.0 - GREATEST(g, 360.0 - (hi - lo)) AS coverage FROM ext e
  LEFT JOIN top t ON t.page_id = e.page_id AND t.chain_id = e.chain_id)"""


def _rounded(df: DataFrame, *more: str) -> DataFrame:
    """Ends of segments and further columns as the SQL rounds them."""
    return df.withColumns({c: r6(c) for c in (*vec.ENDS, *more)})


# -------------------------------------------------------------- column formulas
@query(
    "p22_confidence_from_rms",
    oracle_with(
        "segments",
        body="SELECT seg_id, ROUND(CASE WHEN rms_px IS NULL OR rms_px <= 0 THEN 0.85 ELSE LEAST(GREATEST(1.0 - rms_px / 6.0, 0.05), 0.99) END, 6) AS confidence FROM segments",
    ),
)
def p22(src: Source) -> DataFrame:
    return src["segments"].select("seg_id", r6(rules.confidence_from_rms(F.col("rms_px"))).alias("confidence"))


def _shapes(src: Source) -> tuple[DataFrame, DataFrame]:
    """Accepted circles and arcs of ``chain_points``, as one table, and the points."""
    points = src["chain_points"]
    fits = vec.fit_rms(points, vec.fit_circles(points)).where("accepted")
    extent = vec.arc_extent(points, fits)
    return fits.join(extent.select("page_id", "chain_id", "start_deg", "end_deg"), ["page_id", "chain_id"]), points


def _polylines(src: Source) -> DataFrame:
    def vertex(i):
        return F.struct(
            ((F.col("a") * (i + 1) * 7 + i * 31) % 600).cast("double").alias("x"),
            ((F.col("b") * (i + 2) * 11 + i * i) % 400).cast("double").alias("y"),
        )

    sized = src["polyline_sizes"]
    return sized.withColumn("vertices", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: vertex(i.cast("bigint"))))


def _breaks(src: Source) -> DataFrame:
    return _polylines(src).select("page_id", F.col("id").alias("break_id"), "vertices", (F.size("vertices") * 10).alias("area"))


@query(
    "p23_to_primitives",
    oracle_with(
        "segments",
        "polyline_sizes",
        body="""
SELECT 'LINE' AS type, '02_PART_VISIBLE' AS layer, 'ransac_tls' AS fit_method, COUNT(*) AS n, CAST(SUM(inliers) AS BIGINT) AS pixels,
       ROUND(SUM(CASE WHEN rms_px <= 0 THEN 0.85 ELSE LEAST(GREATEST(1.0 - rms_px / 6.0, 0.05), 0.99) END), 4) AS confidence
FROM segments WHERE SQRT((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) >= 1.5
UNION ALL SELECT 'LWPOLYLINE', '09_BREAK_SYMBOLS', 'contour', COUNT(*), CAST(SUM(n * 10) AS BIGINT), ROUND(COUNT(*) * 0.4, 4) FROM polyline_sizes WHERE n >= 4""",
    ),
)
def p23(src: Source) -> DataFrame:
    both = vec.assemble(vec.line_primitives(src["segments"]), vec.break_primitives(_breaks(src)))
    return both.groupBy("type", "layer", "fit_method").agg(
        F.count("*").alias("n"), F.sum("source_pixels").alias("pixels"), F.round(F.sum("confidence"), 4).alias("confidence")
    )


_SURE = "CASE WHEN rms_px IS NULL OR rms_px <= 0 THEN 0.85 ELSE LEAST(GREATEST(1.0 - rms_px / 6.0, 0.05), 0.99) END"


@query(
    "u1_assemble_primitives",
    oracle_with(
        "segments",
        "polyline_sizes",
        "chain_points",
        body=_FIT
        + _RESIDUALS
        + _ARCS
        + f"""
, lines AS (SELECT * FROM segments WHERE SQRT((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) >= 1.5),
rounds AS (SELECT f.page_id, CASE WHEN coverage <= 330 THEN 'ARC' ELSE 'CIRCLE' END AS type, f.inliers, res.rms AS rms_px FROM fits f
  JOIN res ON res.page_id = f.page_id AND res.chain_id = f.chain_id JOIN fin ON fin.page_id = f.page_id AND fin.chain_id = f.chain_id
  WHERE rms <= 2 AND f.inliers >= 30 AND r >= 1),
whole AS (
  SELECT page_id, 'LINE' AS type, '02_PART_VISIBLE' AS layer, inliers AS pixels, {_SURE} AS sure FROM lines
  UNION ALL SELECT page_id, 'LINE', '04_CENTER_AXIS', inliers, {_SURE} FROM lines WHERE inliers > 40
  UNION ALL SELECT page_id, type, '02_PART_VISIBLE', inliers, {_SURE} FROM rounds
  UNION ALL SELECT page_id, 'LWPOLYLINE', '09_BREAK_SYMBOLS', n * 10, 0.4 FROM polyline_sizes WHERE n >= 4)
SELECT page_id, type, layer, COUNT(*) AS n, CAST(SUM(pixels) AS BIGINT) AS pixels, ROUND(SUM(sure), 4) AS confidence FROM whole GROUP BY page_id, type, layer""",
    ),
)
def u1(src: Source) -> DataFrame:
    rounds, _ = _shapes(src)
    segments = src["segments"]
    centre = segments.where(F.col("inliers") > 40)
    whole = vec.assemble(
        vec.line_primitives(segments),
        vec.line_primitives(centre, vec.CENTER_LAYER),
        vec.round_primitives(rounds),
        vec.break_primitives(_breaks(src)),
    )
    return whole.groupBy("page_id", "type", "layer").agg(
        F.count("*").alias("n"), F.sum("source_pixels").alias("pixels"), F.round(F.sum("confidence"), 4).alias("confidence")
    )


@query(
    "p24_to_mm",
    oracle_with(
        "segments",
        "pages_meta",
        body=_PAGES
        + """
SELECT s.seg_id, ROUND(s.x1 / COALESCE(NULLIF(p.ppm, 0), 1), 6) AS x_mm, ROUND((COALESCE(p.h, 0) - s.y1) / COALESCE(NULLIF(p.ppm, 0), 1), 6) + 0.0 AS y_mm
FROM segments s LEFT JOIN scale p ON p.page_id = s.page_id""",
    ),
)
def p24(src: Source) -> DataFrame:
    placed = src["segments"].join(_pages(src), "page_id", "left")
    return placed.select(
        "seg_id",
        r6(geo.to_mm_x(F.col("x1"), F.col("px_per_mm"))).alias("x_mm"),
        r6(geo.to_mm_y(F.col("y1"), F.col("height_px"), F.col("px_per_mm"))).alias("y_mm"),
    )


_MOD = "(({0}) - 360.0 * FLOOR(({0}) / 360.0))"


@query(
    "p25_flip_arc",
    oracle_with(
        "primitives",
        body=f"SELECT id, ROUND({_MOD.format('-end_angle_deg')}, 6) + 0.0 AS start_deg, ROUND({_MOD.format('-start_angle_deg')}, 6) + 0.0 AS end_deg FROM primitives WHERE type = 'ARC'",
    ),
)
def p25(src: Source) -> DataFrame:
    arcs = src["primitives"].where(F.col("type") == "ARC")
    flipped = arcs.withColumn("f", geo.flip_arc(F.col("start_angle_deg"), F.col("end_angle_deg")))
    return flipped.select("id", r6("f.start_deg").alias("start_deg"), r6("f.end_deg").alias("end_deg"))


@query(
    "p26_export_layer",
    oracle_with(
        "primitives",
        body="SELECT id, CASE WHEN confidence < 0.5 THEN '90_QA_LOW_CONFIDENCE' ELSE COALESCE(layer, '02_PART_VISIBLE') END AS export_layer, layer AS source_layer FROM primitives",
    ),
)
def p26(src: Source) -> DataFrame:
    return src["primitives"].select(
        "id",
        rules.export_layer(F.col("layer"), F.col("confidence")).alias("export_layer"),
        F.col("layer").alias("source_layer"),
    )


_ENTITIES = """
, placed AS (SELECT q.*, COALESCE(NULLIF(p.ppm, 0), 1) AS s, COALESCE(p.h, 0) AS h FROM primitives q LEFT JOIN scale p ON p.page_id = q.page_id),
prim_entities AS (SELECT page_id, id, type, CASE WHEN confidence < 0.5 THEN '90_QA_LOW_CONFIDENCE' ELSE COALESCE(layer, '02_PART_VISIBLE') END AS layer,
  COALESCE(layer, '02_PART_VISIBLE') AS source_layer, x1 / s AS x1_mm, (h - y1) / s AS y1_mm,
  CASE WHEN type = 'LINE' THEN x2 / s END AS x2_mm, CASE WHEN type = 'LINE' THEN (h - y2) / s END AS y2_mm,
  CASE WHEN type IN ('CIRCLE', 'ARC') THEN radius / s END AS radius_mm,
  CASE WHEN type = 'TEXT' THEN text END AS text, CASE WHEN type = 'TEXT' THEN GREATEST(2.5, height / GREATEST(s, 1.0)) END AS text_height_mm
  FROM placed WHERE type = 'LINE' OR (type IN ('CIRCLE', 'ARC') AND radius > 0) OR (type = 'TEXT' AND text <> ''))"""


@query(
    "p27_entities",
    oracle_with(
        "primitives",
        "pages_meta",
        "ocr_blocks",
        body=_PAGES
        + _ENTITIES
        + """
SELECT id, type, layer, source_layer, ROUND(x1_mm, 6) + 0.0 AS x1_mm, ROUND(y1_mm, 6) + 0.0 AS y1_mm, ROUND(x2_mm, 6) + 0.0 AS x2_mm, ROUND(y2_mm, 6) + 0.0 AS y2_mm,
       ROUND(radius_mm, 6) AS radius_mm, text, ROUND(text_height_mm, 6) AS text_height_mm FROM prim_entities
UNION ALL SELECT b.block_id, 'TEXT', CASE WHEN b.kind = 'dimension_text' THEN '06_DIM_TEXT' ELSE '07_TEXT_NOTES' END,
  CASE WHEN b.kind = 'dimension_text' THEN '06_DIM_TEXT' ELSE '07_TEXT_NOTES' END, ROUND(b.x1 / COALESCE(NULLIF(p.ppm, 0), 1), 6) + 0.0,
  ROUND((COALESCE(p.h, 0) - b.y1) / COALESCE(NULLIF(p.ppm, 0), 1), 6) + 0.0, NULL, NULL, NULL, b.text, 3.5
FROM ocr_blocks b LEFT JOIN scale p ON p.page_id = b.page_id WHERE b.text <> ''""",
    ),
)
def p27(src: Source) -> DataFrame:
    pages = _pages(src)
    drawn = vec.assemble(vec.entities(src["primitives"], pages), vec.text_entities(src["ocr_blocks"], pages))
    return drawn.select(
        "id",
        "type",
        "layer",
        "source_layer",
        *[r6(c).alias(c) for c in ("x1_mm", "y1_mm", "x2_mm", "y2_mm", "radius_mm")],
        "text",
        r6("text_height_mm").alias("text_height_mm"),
    )


_ANG = "DEGREES(ATAN2(y2 - y1, x2 - x1))"
_FOLD = f"({_ANG} - 180.0 * FLOOR({_ANG} / 180.0))"
_LEN = "SQRT((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))"


@query(
    "p28_snap_angles",
    oracle_with(
        "segments",
        body=f"""
, m AS (SELECT *, {_FOLD} AS ang, {_LEN} AS len FROM segments),
c AS (SELECT m.*, t.a AS target, LEAST(ABS(ang - t.a), 180 - ABS(ang - t.a)) AS gap FROM m, (SELECT UNNEST([0.0::DOUBLE, 45.0, 90.0, 135.0]) AS a) t),
b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY page_id, seg_id ORDER BY gap, target) AS rn FROM c),
s AS (SELECT *, ABS(x2 - x1) + ABS(y2 - y1) >= 1e-6 AND gap <= 1.5 AS snapped, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy,
  COS(RADIANS(target)) * len / 2 AS ux, SIN(RADIANS(target)) * len / 2 AS uy FROM b WHERE rn = 1)
SELECT seg_id, snapped, ROUND(CASE WHEN snapped THEN cx - ux ELSE x1 END, 6) + 0.0 AS x1, ROUND(CASE WHEN snapped THEN cy - uy ELSE y1 END, 6) + 0.0 AS y1,
  ROUND(CASE WHEN snapped THEN cx + ux ELSE x2 END, 6) + 0.0 AS x2, ROUND(CASE WHEN snapped THEN cy + uy ELSE y2 END, 6) + 0.0 AS y2 FROM s""",
    ),
)
def p28(src: Source) -> DataFrame:
    return vec.snap_angles(src["segments"]).select("seg_id", "snapped", *[r6(c).alias(c) for c in vec.ENDS])


@query(
    "p29_rotate_points",
    oracle_with(
        "ink_a",
        body="""
, t AS (SELECT *, RADIANS((CAST(SUBSTR(page_id, 2) AS BIGINT) % 21 - 10) * 0.7) AS a FROM ink_a)
SELECT DISTINCT page_id, CAST(ROUND_EVEN((x - 416.0) * COS(a) + (y - 256.0) * SIN(a) + 416.0, 0) AS INT) AS x,
       CAST(ROUND_EVEN((y - 256.0) * COS(a) - (x - 416.0) * SIN(a) + 256.0, 0) AS INT) AS y FROM t""",
    ),
)
def p29(src: Source) -> DataFrame:
    ink = src["ink_a"]
    number = F.substring("page_id", 2, 18).cast("long")
    turns = ink.select("page_id").distinct().withColumns(
        {"angle_deg": (number % 21 - 10) * F.lit(0.7), "width": F.lit(832), "height": F.lit(512)}
    )
    return vec.rotate_points(ink, turns)


@query(
    "j12_layer_of_role",
    oracle_with(
        "ocr_blocks",
        body="""
SELECT block_id, CASE kind WHEN 'titleblock_text' THEN 'text' WHEN 'dimension_text' THEN 'dimension_text' ELSE kind END AS role,
       COALESCE(l.layer, '02_PART_VISIBLE') AS layer
FROM ocr_blocks b LEFT JOIN (VALUES {roles}) l(role, layer)
  ON l.role = CASE kind WHEN 'titleblock_text' THEN 'text' WHEN 'dimension_text' THEN 'dimension_text' ELSE kind END""".replace(
            "{roles}", ", ".join(f"('{r}', '{n}')" for n, _, r, _ in LAYERS)
        ),
    ),
)
def j12_roles(src: Source) -> DataFrame:
    role = F.when(F.col("kind") == "titleblock_text", "text").otherwise(F.col("kind"))
    return vec.layer_of_role(src["ocr_blocks"].select("block_id", role.alias("role")))


# -------------------------------------------------------------------- summaries
@query(
    "a1_primitives_summary",
    oracle_with("primitives", body="SELECT page_id, COALESCE(type, '?') AS type, COUNT(*) AS n FROM primitives GROUP BY ALL"),
)
def a1(src: Source) -> DataFrame:
    return vec.primitives_summary(src["primitives"])


_WEAK = "COUNT(*) FILTER (COALESCE(NULLIF(confidence, 0), 1) < 0.55)"


@query(
    "a2_low_confidence",
    oracle_with(
        "primitives", body=f"SELECT page_id, COUNT(*) AS primitives, {_WEAK} AS low_confidence FROM primitives GROUP BY page_id"
    ),
)
def a2(src: Source) -> DataFrame:
    return vec.low_confidence(src["primitives"])


_COUNTS = f"""
, c AS (SELECT page_id, COUNT(*) AS n, {_WEAK} AS low, COUNT(*) FILTER (type = 'LINE') AS lines FROM primitives
  GROUP BY page_id),
j AS (SELECT p.page_id, COALESCE(n, 0) AS n, COALESCE(low, 0) AS low, COALESCE(lines, 0) AS lines FROM pages_meta p LEFT JOIN c ON c.page_id = p.page_id)"""


@query(
    "a3_doc_review",
    oracle_with(
        "primitives",
        "pages_meta",
        body=_COUNTS
        + """
SELECT page_id, n = 0 OR low > GREATEST(5, FLOOR(0.1 * n)) AS requires_review,
       CONCAT_WS('|', CASE WHEN n = 0 THEN 'no_primitives_detected' END, CASE WHEN lines = 0 THEN 'no_line_primitives' END) AS warnings FROM j""",
    ),
)
def a3(src: Source) -> DataFrame:
    return vec.doc_review(src["primitives"], src["pages_meta"]).withColumn("warnings", joined("warnings"))


@query(
    "a4_review_summary",
    oracle_with(
        "primitives",
        "pages_meta",
        body=_COUNTS
        + """
SELECT page_id, n > 0 AND low = 0 AS ok, CASE WHEN n = 0 THEN 'no_primitives' WHEN low > 0 THEN CAST(low AS VARCHAR) || ' primitives have low confidence' END AS warning FROM j""",
    ),
)
def a4(src: Source) -> DataFrame:
    return vec.review_summary(src["primitives"], src["pages_meta"])


@query(
    "j12_layer_dim",
    oracle_with(
        "primitives",
        body="""
, layers AS (SELECT * FROM (VALUES ('02_PART_VISIBLE', 7, 'geometry', 'CONTINUOUS'), ('04_CENTER_AXIS', 1, 'centerline', 'CENTER'),
  ('99_RASTER_REFERENCE', 9, 'raster', 'CONTINUOUS')) v(layer, color, role, linetype))
SELECT q.id, q.layer, l.color, l.role, l.linetype FROM primitives q LEFT JOIN layers l ON l.layer = q.layer""",
    ),
)
def j12(src: Source) -> DataFrame:
    return vec.layer_dim(src["primitives"].select("id", "layer"))


@query(
    "a5_fit_circles",
    oracle_with(
        "chain_points",
        body=_FIT + " SELECT page_id, chain_id, ROUND(cx, 6) AS cx, ROUND(cy, 6) AS cy, ROUND(r, 6) AS r, inliers FROM fits",
    ),
)
def a5(src: Source) -> DataFrame:
    return vec.fit_circles(src["chain_points"]).select(
        "page_id", "chain_id", *[r6(c).alias(c) for c in ("cx", "cy", "r")], "inliers"
    )


@query(
    "a6_fit_rms",
    oracle_with(
        "chain_points",
        body=_FIT
        + _RESIDUALS
        + """
SELECT f.page_id, f.chain_id, ROUND(rms, 6) AS rms_px, COALESCE(rms <= 2 AND inliers >= 30, FALSE) AS accepted
FROM fits f LEFT JOIN res ON res.page_id = f.page_id AND res.chain_id = f.chain_id""",
    ),
)
def a6(src: Source) -> DataFrame:
    points = src["chain_points"]
    return vec.fit_rms(points, vec.fit_circles(points)).select("page_id", "chain_id", r6("rms_px").alias("rms_px"), "accepted")


@query(
    "w5_arc_extent",
    oracle_with(
        "chain_points",
        body=_FIT
        + _ARCS
        + """
SELECT page_id, chain_id, ROUND(coverage, 6) AS coverage, CASE WHEN coverage > 330 THEN 'CIRCLE' ELSE 'ARC' END AS type,
  ROUND(CASE WHEN coverage <= 330 THEN CASE WHEN wrap > g THEN lo ELSE gb END END, 6) AS start_deg,
  ROUND(CASE WHEN coverage <= 330 THEN CASE WHEN wrap > g THEN hi ELSE ga END END, 6) AS end_deg FROM fin""",
    ),
)
def w5(src: Source) -> DataFrame:
    points = src["chain_points"]
    return vec.arc_extent(points, vec.fit_circles(points)).select(
        "page_id", "chain_id", r6("coverage").alias("coverage"), "type", r6("start_deg").alias("start_deg"), r6("end_deg").alias("end_deg")
    )


@query(
    "w8_chord_deviation",
    oracle_with(
        "chain_points",
        body="""
, e AS (SELECT page_id, chain_id, ARG_MIN(x, ord) AS px, ARG_MIN(y, ord) AS py, ARG_MAX(x, ord) AS qx, ARG_MAX(y, ord) AS qy FROM chain_points GROUP BY page_id, chain_id),
d AS (SELECT p.page_id, p.chain_id, ord, ABS((x - px) * (qy - py) - (y - py) * (qx - px)) / SQRT((qx - px) * (qx - px) + (qy - py) * (qy - py)) AS off
  FROM chain_points p JOIN e ON e.page_id = p.page_id AND e.chain_id = p.chain_id)
SELECT page_id, chain_id, ROUND(MAX(off), 6) AS max_dev, ROUND(SQRT(AVG(off * off)), 6) AS rms_px, COUNT(*) AS n FROM d GROUP BY page_id, chain_id""",
    ),
)
def w8(src: Source) -> DataFrame:
    return vec.chord_deviation(src["chain_points"]).select(
        "page_id", "chain_id", r6("max_dev").alias("max_dev"), r6("rms_px").alias("rms_px"), "n"
    )


@query(
    "w10_polyline_edges",
    oracle_with(
        "polyline_sizes",
        body="""
, v AS (SELECT page_id, id, n, closed, i, CAST((a * (i + 1) * 7 + i * 31) % 600 AS DOUBLE) AS x, CAST((b * (i + 2) * 11 + i * i) % 400 AS DOUBLE) AS y
  FROM (SELECT *, UNNEST(RANGE(0, n)) AS i FROM polyline_sizes) t WHERE n >= 2)
SELECT a.page_id, a.id, CAST(a.i AS INT) AS ord, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON b.id = a.id
 AND b.i = CASE WHEN a.i + 1 < a.n THEN a.i + 1 WHEN a.closed THEN 0 ELSE -1 END""",
    ),
)
def w10(src: Source) -> DataFrame:
    return vec.polyline_edges(_polylines(src))


# ----------------------------------------------------------------- proximities
@query(
    "j7_near_points",
    oracle_with(
        "segments",
        body="""
, pts AS (SELECT page_id, x, y, COUNT(*) AS n FROM (SELECT page_id, x1 AS x, y1 AS y FROM segments UNION ALL SELECT page_id, x2, y2 FROM segments) u GROUP BY page_id, x, y)
, cut AS (SELECT *, CAST(FLOOR(x / 4) AS BIGINT) AS cx, CAST(FLOOR(y / 4) AS BIGINT) AS cy FROM pts),
about AS (SELECT * FROM (VALUES (-1), (0), (1)) v(d))
SELECT a.page_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by, a.n AS n_a, b.n AS n_b, ROUND(SQRT((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)), 6) AS dist
FROM (SELECT c.*, cx + i.d AS tx, cy + j.d AS ty FROM cut c, about i, about j) a
JOIN cut b ON b.page_id = a.page_id AND b.cx = a.tx AND b.cy = a.ty AND (a.x < b.x OR (a.x = b.x AND a.y < b.y))
WHERE (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) <= 16""",
    ),
)
def j7(src: Source) -> DataFrame:
    return vec.near_points(vec.endpoints(src["segments"])).withColumn("dist", r6("dist"))


@query(
    "j7_near_spots",
    oracle_with(
        "segments",
        body="""
, pts AS (SELECT page_id, x, y, COUNT(*) AS n FROM (SELECT page_id, x1 AS x, y1 AS y FROM segments UNION ALL SELECT page_id, x2, y2 FROM segments) u GROUP BY page_id, x, y)
, cut AS (SELECT *, CAST(FLOOR(x / 4) AS BIGINT) AS cx, CAST(FLOOR(y / 4) AS BIGINT) AS cy FROM pts),
about AS (SELECT * FROM (VALUES (-1), (0), (1)) v(d)),
met AS (SELECT a.page_id, a.x, a.y, b.x AS nx, b.y AS ny, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS d2
  FROM (SELECT c.*, cx + i.d AS tx, cy + j.d AS ty FROM cut c, about i, about j) a
  JOIN cut b ON b.page_id = a.page_id AND b.cx = a.tx AND b.cy = a.ty AND (a.x <> b.x OR a.y <> b.y)),
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY page_id, x, y ORDER BY d2, nx, ny) AS rn, COUNT(*) OVER (PARTITION BY page_id, x, y) AS near FROM met WHERE d2 <= 16)
SELECT p.page_id, p.x, p.y, p.n, COALESCE(b.near, 0) AS neighbours, b.nx AS near_x, b.ny AS near_y, ROUND(SQRT(b.d2), 6) AS dist
FROM pts p LEFT JOIN best b ON b.page_id = p.page_id AND b.x = p.x AND b.y = p.y AND b.rn = 1""",
    ),
)
def j7_spots(src: Source) -> DataFrame:
    return proximity.near_spots(vec.endpoints(src["segments"])).withColumn("dist", r6("dist"))


@query(
    "j8_collinear_pairs",
    oracle_with(
        "segments",
        body=f"""
, d AS (SELECT page_id, x1, y1, x2, y2, MIN(seg_id) AS id, COUNT(*) AS copies, {_LEN} AS len, {_FOLD} AS ang FROM segments GROUP BY page_id, x1, y1, x2, y2),
near AS (SELECT a.page_id, a.id AS a_id, b.id AS b_id, a.copies AS a_copies, b.copies AS b_copies, a.len AS la, b.len AS lb,
   a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2
  FROM d a JOIN d b ON b.page_id = a.page_id AND b.id <> a.id
  WHERE a.len >= 1 AND b.len >= 1 AND LEAST(ABS(a.ang - b.ang), 180 - ABS(a.ang - b.ang)) <= 1.5
   AND ABS((b.x1 - a.x1) * (a.y2 - a.y1) - (b.y1 - a.y1) * (a.x2 - a.x1)) / a.len <= 2 AND ABS((b.x2 - a.x1) * (a.y2 - a.y1) - (b.y2 - a.y1) * (a.x2 - a.x1)) / a.len <= 2),
m AS (SELECT *, (ax1 + ax2 + bx1 + bx2) / 4 AS mx, (ay1 + ay2 + by1 + by2) / 4 AS my FROM near),
t AS (SELECT *, 0.5 * ATAN2(2 * ((ax1 - mx) * (ay1 - my) + (ax2 - mx) * (ay2 - my) + (bx1 - mx) * (by1 - my) + (bx2 - mx) * (by2 - my)),
  (ax1 - mx) * (ax1 - mx) + (ax2 - mx) * (ax2 - mx) + (bx1 - mx) * (bx1 - mx) + (bx2 - mx) * (bx2 - mx)
  - ((ay1 - my) * (ay1 - my) + (ay2 - my) * (ay2 - my) + (by1 - my) * (by1 - my) + (by2 - my) * (by2 - my))) AS th FROM m),
p AS (SELECT *, (ax1 - mx) * COS(th) + (ay1 - my) * SIN(th) AS p1, (ax2 - mx) * COS(th) + (ay2 - my) * SIN(th) AS p2,
  (bx1 - mx) * COS(th) + (by1 - my) * SIN(th) AS p3, (bx2 - mx) * COS(th) + (by2 - my) * SIN(th) AS p4 FROM t),
q AS (SELECT *, GREATEST(p1, p2, p3, p4) - LEAST(p1, p2, p3, p4) AS merged FROM p)
SELECT page_id, a_id, b_id, a_copies, b_copies, ROUND(merged, 6) AS merged_len FROM q WHERE merged <= la + lb + 12""",
    ),
)
def j8(src: Source) -> DataFrame:
    return vec.collinear_pairs(src["segments"]).withColumn("merged_len", r6("merged_len"))


_NEAREST_TWO = """
, t AS (SELECT s.page_id, c.break_id, s.seg_id, s.x1, s.y1, s.x2, s.y2, c.x, c.y,
   LEAST(GREATEST(((c.x - x1) * (x2 - x1) + (c.y - y1) * (y2 - y1)) / CASE WHEN (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) < 1e-9 THEN 1 ELSE (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) END, 0.0), 1.0) AS k
  FROM segments s JOIN break_centres c ON c.page_id = s.page_id),
d AS (SELECT page_id, break_id, seg_id, SQRT(POWER(x1 + k * (x2 - x1) - x, 2) + POWER(y1 + k * (y2 - y1) - y, 2)) AS dist FROM t),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY page_id, break_id ORDER BY dist, seg_id) AS rn FROM d)"""


@query(
    "j9_nearest_segments",
    oracle_with(
        "segments",
        "break_centres",
        body=_NEAREST_TWO
        + """
SELECT a.page_id, a.break_id, a.seg_id AS seg_a, b.seg_id AS seg_b, ROUND(a.dist, 6) AS dist_a, ROUND(b.dist, 6) AS dist_b
FROM r a JOIN r b ON b.page_id = a.page_id AND b.break_id = a.break_id AND a.rn = 1 AND b.rn = 2 WHERE b.dist <= 25""",
    ),
)
def j9(src: Source) -> DataFrame:
    return vec.nearest_segments(src["segments"], src["break_centres"]).withColumns(
        {"dist_a": r6("dist_a"), "dist_b": r6("dist_b")}
    )


# A page's breaks turn their two segments one after the other.
@query(
    "j9_align_breaks",
    oracle_with(
        "segments",
        "break_centres",
        body=_NEAREST_TWO
        + """
, two AS (SELECT a.page_id, a.seg_id AS seg_a, b.seg_id AS seg_b, ROW_NUMBER() OVER (PARTITION BY a.page_id ORDER BY a.break_id) AS k
  FROM r a JOIN r b ON b.page_id = a.page_id AND b.break_id = a.break_id AND a.rn = 1 AND b.rn = 2 WHERE b.dist <= 25),
met AS (SELECT DISTINCT page_id, seg_id FROM (SELECT page_id, seg_a AS seg_id FROM two UNION ALL SELECT page_id, seg_b FROM two) t),
state AS (
  SELECT m.page_id, CAST(0 AS BIGINT) AS k, LIST({'id': s.seg_id, 'x1': s.x1, 'y1': s.y1, 'x2': s.x2, 'y2': s.y2}) AS segs
  FROM met m JOIN segments s ON s.page_id = m.page_id AND s.seg_id = m.seg_id GROUP BY m.page_id
  UNION ALL
  SELECT page_id, k, LIST_TRANSFORM(segs, lambda s: CASE WHEN s.id IN (ga.id, gb.id) THEN {'id': s.id,
      'x1': (s.x1 + s.x2) / 2 - ux * SQRT((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1)) / 2, 'y1': (s.y1 + s.y2) / 2 - uy * SQRT((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1)) / 2,
      'x2': (s.x1 + s.x2) / 2 + ux * SQRT((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1)) / 2, 'y2': (s.y1 + s.y2) / 2 + uy * SQRT((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1)) / 2} ELSE s END)
  FROM (SELECT *, (d.x2 - d.x1) / len AS ux, (d.y2 - d.y1) / len AS uy FROM (SELECT *, CASE WHEN la >= lb THEN ga ELSE gb END AS d, CASE WHEN GREATEST(la, lb) = 0 THEN 1 ELSE GREATEST(la, lb) END AS len
    FROM (SELECT *, SQRT((ga.x2 - ga.x1) * (ga.x2 - ga.x1) + (ga.y2 - ga.y1) * (ga.y2 - ga.y1)) AS la, SQRT((gb.x2 - gb.x1) * (gb.x2 - gb.x1) + (gb.y2 - gb.y1) * (gb.y2 - gb.y1)) AS lb
      FROM (SELECT s.page_id, t.k, s.segs, LIST_FILTER(s.segs, lambda e: e.id = t.seg_a)[1] AS ga, LIST_FILTER(s.segs, lambda e: e.id = t.seg_b)[1] AS gb
        FROM state s JOIN two t ON t.page_id = s.page_id AND t.k = s.k + 1) q0) q1) q2) q3),
last AS (SELECT page_id, UNNEST(segs) AS s FROM (SELECT page_id, ARG_MAX(segs, k) AS segs FROM state GROUP BY page_id) t)
SELECT g.page_id, g.seg_id, g.rms_px, g.inliers, ROUND(COALESCE(l.s.x1, g.x1), 6) AS x1, ROUND(COALESCE(l.s.y1, g.y1), 6) AS y1, ROUND(COALESCE(l.s.x2, g.x2), 6) AS x2, ROUND(COALESCE(l.s.y2, g.y2), 6) AS y2
FROM segments g LEFT JOIN last l ON l.page_id = g.page_id AND l.s.id = g.seg_id""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def j9_align(src: Source) -> DataFrame:
    return _rounded(vec.align_breaks(src["segments"], src["break_centres"]))


@query(
    "l5_top_k_nearest",
    oracle_with(
        "segments",
        "break_centres",
        body="""
, t AS (SELECT s.page_id, c.break_id, s.seg_id, s.x1, s.y1, s.x2, s.y2, c.x, c.y,
   LEAST(GREATEST(((c.x - x1) * (x2 - x1) + (c.y - y1) * (y2 - y1)) / CASE WHEN (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) < 1e-9 THEN 1 ELSE (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) END, 0.0), 1.0) AS k
  FROM segments s JOIN break_centres c ON c.page_id = s.page_id),
d AS (SELECT break_id, seg_id, SQRT(POWER(x1 + k * (x2 - x1) - x, 2) + POWER(y1 + k * (y2 - y1) - y, 2)) AS dist FROM t)
SELECT break_id, COUNT(*) AS segments, ROUND(AVG(dist), 6) AS mean_dist
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY break_id ORDER BY dist, seg_id) AS rn FROM d WHERE dist <= 60) r WHERE rn <= 2 GROUP BY break_id HAVING COUNT(*) = 2""",
    ),
)
def l5(src: Source) -> DataFrame:
    two = vec.nearest_segments(src["segments"], src["break_centres"], radius=60.0)
    return two.select("break_id", F.lit(2).cast("long").alias("segments"), r6((F.col("dist_a") + F.col("dist_b")) / 2).alias("mean_dist"))


@query(
    "a19_merged_segment",
    oracle_with(
        "segments",
        body="""
, c AS (SELECT *, seg_id % 5 AS cluster FROM segments),
pts AS (SELECT page_id, cluster, x1 AS x, y1 AS y FROM c UNION ALL SELECT page_id, cluster, x2, y2 FROM c),
ax AS (SELECT page_id, cluster, AVG(x) AS mx, AVG(y) AS my, 0.5 * ATAN2(2 * COVAR_SAMP(x, y), VAR_SAMP(x) - VAR_SAMP(y)) AS th FROM pts GROUP BY page_id, cluster),
sp AS (SELECT p.page_id, p.cluster, MIN((x - mx) * COS(th) + (y - my) * SIN(th)) AS lo, MAX((x - mx) * COS(th) + (y - my) * SIN(th)) AS hi FROM pts p
  JOIN ax ON ax.page_id = p.page_id AND ax.cluster = p.cluster GROUP BY p.page_id, p.cluster),
q AS (SELECT page_id, cluster, COUNT(*) AS members, SQRT(SUM(rms_px * rms_px * inliers) / GREATEST(SUM(inliers), 1)) AS rms_px, CAST(SUM(inliers) AS BIGINT) AS inliers FROM c GROUP BY page_id, cluster)
SELECT ax.page_id, ax.cluster, members, ROUND(rms_px, 6) AS rms_px, inliers, ROUND(mx + COS(th) * lo, 4) AS x1, ROUND(my + SIN(th) * lo, 4) AS y1,
  ROUND(mx + COS(th) * hi, 4) AS x2, ROUND(my + SIN(th) * hi, 4) AS y2
FROM ax JOIN sp ON sp.page_id = ax.page_id AND sp.cluster = ax.cluster JOIN q ON q.page_id = ax.page_id AND q.cluster = ax.cluster""",
    ),
)
def a19(src: Source) -> DataFrame:
    clustered = src["segments"].withColumn("cluster", F.col("seg_id") % 5)
    return vec.merged_segment(clustered, ["page_id", "cluster"]).select(
        "page_id", "cluster", "members", r6("rms_px").alias("rms_px"), "inliers", *[F.round(c, 4).alias(c) for c in vec.ENDS]
    )


# ------------------------------------------------------------------- iterative
_SAME = "ABS({0}x - {1}x) <= 1e-8 + 1e-5 * ABS({1}x) AND ABS({0}y - {1}y) <= 1e-8 + 1e-5 * ABS({1}y)".format


# Every round of the recursion cuts the pieces that fail at their farthest point.
@query(
    "i4_split_polylines",
    oracle_with(
        "chain_points",
        body=f"""
, whole AS (SELECT page_id, chain_id, MIN(ord) AS lo, MAX(ord) AS hi, ARG_MIN(x, ord) AS ax, ARG_MIN(y, ord) AS ay, ARG_MAX(x, ord) AS bx, ARG_MAX(y, ord) AS by_, COUNT(*) AS n
  FROM chain_points GROUP BY page_id, chain_id),
shut AS (SELECT *, n >= 4 AND {_SAME("a", "b").replace("by", "by_")} AS closed FROM whole),
far AS (SELECT w.page_id, w.chain_id, MAX({{'d': (x - ax) * (x - ax) + (y - ay) * (y - ay), 'back': -ord, 'x': x, 'y': y}}) AS m FROM shut w
  JOIN chain_points p ON p.page_id = w.page_id AND p.chain_id = w.chain_id WHERE closed GROUP BY w.page_id, w.chain_id),
piece AS (
  SELECT page_id, chain_id, lo, ax, ay, hi, bx, by_ FROM shut WHERE NOT closed
  UNION ALL SELECT s.page_id, s.chain_id, lo, ax, ay, -m.back, m.x, m.y FROM shut s JOIN far f ON f.page_id = s.page_id AND f.chain_id = s.chain_id
  UNION ALL SELECT s.page_id, s.chain_id, -m.back, m.x, m.y, hi, bx, by_ FROM shut s JOIN far f ON f.page_id = s.page_id AND f.chain_id = s.chain_id),
cut AS (
  SELECT * FROM piece
  UNION ALL
  SELECT page_id, chain_id, CASE WHEN k = 0 THEN lo ELSE -m.back END, CASE WHEN k = 0 THEN ax ELSE m.x END, CASE WHEN k = 0 THEN ay ELSE m.y END,
    CASE WHEN k = 0 THEN -m.back ELSE hi END, CASE WHEN k = 0 THEN m.x ELSE bx END, CASE WHEN k = 0 THEN m.y ELSE by_ END
  FROM (SELECT c.page_id, c.chain_id, lo, ax, ay, hi, bx, by_, MAX({{'d': ABS((x - ax) * (by_ - ay) - (y - ay) * (bx - ax)) / SQRT((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)), 'back': -ord, 'x': x, 'y': y}}) AS m
    FROM cut c JOIN chain_points p ON p.page_id = c.page_id AND p.chain_id = c.chain_id AND p.ord BETWEEN c.lo AND c.hi
    WHERE NOT ({_SAME("a", "b").replace("by", "by_")}) GROUP BY c.page_id, c.chain_id, lo, ax, ay, hi, bx, by_) j, (SELECT UNNEST([0, 1]) AS k) h
  WHERE m.d > {vec.LINE_RESIDUAL_PX} AND -m.back <> lo AND -m.back <> hi),
fit AS (SELECT c.page_id, c.chain_id, lo, ax, ay, hi, bx, by_, COUNT(*) AS n,
    MAX({{'d': ABS((x - ax) * (by_ - ay) - (y - ay) * (bx - ax)) / SQRT((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)), 'back': -ord}}) AS m,
    AVG(POWER(((x - ax) * (by_ - ay) - (y - ay) * (bx - ax)) / SQRT((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)), 2)) AS ms
  FROM cut c JOIN chain_points p ON p.page_id = c.page_id AND p.chain_id = c.chain_id AND p.ord BETWEEN c.lo AND c.hi
  WHERE NOT ({_SAME("a", "b").replace("by", "by_")}) GROUP BY c.page_id, c.chain_id, lo, ax, ay, hi, bx, by_)
SELECT page_id, chain_id, lo AS from_ord, hi AS to_ord, ROUND(ax, 6) AS x1, ROUND(ay, 6) AS y1, ROUND(bx, 6) AS x2, ROUND(by_, 6) AS y2, ROUND(SQRT(ms), 6) AS rms_px, n AS inliers
FROM fit WHERE m.d <= {vec.LINE_RESIDUAL_PX} OR -m.back = lo OR -m.back = hi""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def i4(src: Source) -> DataFrame:
    return _rounded(vec.split_polylines(src["chain_points"]), "rms_px")


@query("i5_merge_collinear")
def i5(src: Source) -> DataFrame:
    return vec.merge_collinear(src["segments"])


# Seeds are chosen one by one inside groups of positions that reach each other.
@query(
    "i6_snap_endpoints",
    oracle_with(
        "segments",
        body=f"""
, ep AS (SELECT page_id, seg_id, seg_id * 2 AS pt, x1 AS x, y1 AS y FROM segments UNION ALL SELECT page_id, seg_id, seg_id * 2 + 1, x2, y2 FROM segments),
spot AS (SELECT page_id, x, y, MIN(pt) AS pt, FLOOR(x / 4) AS cx, FLOOR(y / 4) AS cy FROM ep GROUP BY page_id, x, y),
near AS (SELECT a.page_id, a.pt AS p, b.pt AS q FROM (SELECT * FROM spot, (SELECT UNNEST([-1, 0, 1]) AS dx) i, (SELECT UNNEST([-1, 0, 1]) AS dy) j) a
  JOIN spot b ON b.page_id = a.page_id AND b.cx = a.cx + a.dx AND b.cy = a.cy + a.dy
  WHERE a.pt <> b.pt AND SQRT((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {vec.ENDPOINT_TOLERANCE_PX}),
reach AS (SELECT page_id, p, p AS q FROM near UNION SELECT r.page_id, r.p, n.q FROM reach r JOIN near n ON n.page_id = r.page_id AND n.p = r.q),
grp AS (SELECT page_id, p, MIN(q) AS g FROM reach GROUP BY page_id, p),
turn AS (SELECT grp.page_id, grp.g, grp.p, ROW_NUMBER() OVER (PARTITION BY grp.page_id, grp.g ORDER BY grp.p) AS k, a.qs FROM grp
  JOIN (SELECT page_id, p, LIST(q) AS qs FROM near GROUP BY page_id, p) a ON a.page_id = grp.page_id AND a.p = grp.p),
grow AS (SELECT page_id, g, k, [p] AS seeds FROM turn WHERE k = 1
  UNION ALL SELECT w.page_id, w.g, t.k, CASE WHEN LIST_HAS_ANY(w.seeds, t.qs) THEN w.seeds ELSE LIST_APPEND(w.seeds, t.p) END
  FROM grow w JOIN turn t ON t.page_id = w.page_id AND t.g = w.g AND t.k = w.k + 1),
seed AS (SELECT page_id, UNNEST(seeds) AS p FROM (SELECT page_id, g, ARG_MAX(seeds, k) AS seeds FROM grow GROUP BY page_id, g) t
  UNION ALL SELECT s.page_id, s.pt FROM spot s LEFT JOIN grp ON grp.page_id = s.page_id AND grp.p = s.pt WHERE grp.p IS NULL),
owner AS (SELECT page_id, p, MAX(seed) AS seed FROM (SELECT page_id, p, p AS seed FROM seed UNION ALL SELECT n.page_id, n.q, n.p FROM near n JOIN seed s ON s.page_id = n.page_id AND s.p = n.p) t
  GROUP BY page_id, p),
owned AS (SELECT ep.*, o.seed FROM ep JOIN spot s ON s.page_id = ep.page_id AND s.x = ep.x AND s.y = ep.y JOIN owner o ON o.page_id = s.page_id AND o.p = s.pt),
mean AS (SELECT page_id, seg_id, pt, AVG(x) OVER (PARTITION BY page_id, seed) AS x, AVG(y) OVER (PARTITION BY page_id, seed) AS y FROM owned)
SELECT s.page_id, s.seg_id, s.rms_px, s.inliers, ROUND(a.x, 6) AS x1, ROUND(a.y, 6) AS y1, ROUND(b.x, 6) AS x2, ROUND(b.y, 6) AS y2 FROM segments s
JOIN mean a ON a.page_id = s.page_id AND a.pt = s.seg_id * 2 JOIN mean b ON b.page_id = s.page_id AND b.pt = s.seg_id * 2 + 1""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def i6(src: Source) -> DataFrame:
    return _rounded(vec.snap_endpoints(src["segments"]))
