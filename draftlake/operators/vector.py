"""Operators on vector primitives: segments, circles, arcs, chains, export entities."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.functions import geometry as geo
from draftlake.functions import rules
from draftlake.operators.fence import fence
from draftlake.operators.grid import cell, spread
from draftlake.operators.grouped import grouped
from draftlake.operators.ordered import first_per_key, with_next
from draftlake.operators.segments import page_merged, page_pairs, page_snapped
from draftlake.schemas import DEFAULT_LAYER, layer_table
from draftlake.session import settle, settle_dense, spread_rows

# ---------------------------------------------------------------- fixed values
LINE_RESIDUAL_PX = 1.5
CIRCLE_RESIDUAL_PX = 2.0
CIRCLE_MIN_INLIERS = 30
FULL_TURN_COVERAGE_DEG = 330.0
MIN_LINE_PX = 1.5
MIN_RADIUS_PX = 1.0
MIN_BREAK_VERTICES = 4
BREAK_CONFIDENCE = 0.4

ENDPOINT_TOLERANCE_PX = 4.0
CHAIN_POINTS = 65_536  # of a chain that is cut inside a task
PAGE_SEGMENTS = 8_192  # of a page whose segments meet inside a task
SNAP_BLOCK = 8  # cells along a block in which points and candidates meet
NEAR_CELLS = 4.0  # side of a cell in tolerances where near points meet
COLLINEAR_ANGLE_DEG = 1.5
COLLINEAR_DISTANCE_PX = 2.0
COLLINEAR_GAP_PX = 12.0
MIN_MERGE_PX = 1.0
BREAK_RADIUS_PX = 25.0

CENTER_LAYER = "04_CENTER_AXIS"
DIM_TEXT_LAYER = "06_DIM_TEXT"
NOTE_LAYER = "07_TEXT_NOTES"
BREAK_LAYER = "09_BREAK_SYMBOLS"
METHODS = {"LINE": "ransac_tls", "CIRCLE": "kasa_ls", "ARC": "kasa_ls_arc", "LWPOLYLINE": "contour"}
MIN_TEXT_MM = 2.5
NOTE_TEXT_MM = 3.5
# ---------------------------------------------------------- end of fixed values

ENDS = ("x1", "y1", "x2", "y2")


def ends() -> list[Column]:
    return [F.col(c) for c in ENDS]


# ------------------------------------------------------------ primitive tables
def _prefixed_id(prefix: str, *parts: str) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8))


def _fit_columns(kind: str, rms: str | None = "rms_px") -> dict[str, Column]:
    residual = F.col(rms) if rms else F.lit(None).cast("double")
    return {
        "type": F.lit(kind),
        "fit_method": F.lit(METHODS[kind]),
        "fit_rms_px": residual,
        "fit_inliers": F.col("inliers"),
        "source_pixels": F.col("inliers"),
        "confidence": rules.confidence_from_rms(residual) if rms else F.lit(BREAK_CONFIDENCE),
    }


_META = ["type", "layer", "confidence", "fit_method", "fit_rms_px", "fit_inliers", "source_pixels"]


def line_primitives(segments: DataFrame, layer: str = DEFAULT_LAYER) -> DataFrame:
    kept = segments.where(geo.length(*ends()) >= MIN_LINE_PX)
    return kept.withColumns({**_fit_columns("LINE"), "layer": F.lit(layer)}).select(
        "page_id", _prefixed_id("ln_", "page_id", F.col("seg_id")).alias("id"), *_META, *ENDS
    )


def round_primitives(circles: DataFrame) -> DataFrame:
    """Circles and arcs; an arc has ``start_deg``/``end_deg``, a circle has nulls there."""
    kept = circles.where(F.col("r") >= MIN_RADIUS_PX)
    is_arc = F.col("start_deg").isNotNull()
    both = {
        name: F.when(is_arc, arc).otherwise(circle)
        for (name, arc), circle in zip(_fit_columns("ARC").items(), _fit_columns("CIRCLE").values(), strict=True)
    }
    prefix = F.when(is_arc, "ar_").otherwise("ci_")
    return kept.withColumns({**both, "layer": F.lit(DEFAULT_LAYER)}).select(
        "page_id",
        F.concat(prefix, F.substring(F.md5(F.concat_ws(":", "page_id", "chain_id")), 1, 8)).alias("id"),
        *_META,
        F.col("cx"),
        F.col("cy"),
        F.col("r").alias("radius"),
        F.col("start_deg").alias("start_angle_deg"),
        F.col("end_deg").alias("end_angle_deg"),
    )


def break_primitives(breaks: DataFrame) -> DataFrame:
    """Break outlines: ``vertices array<struct<x,y>>`` and their pixel ``area``."""
    kept = breaks.where(F.size("vertices") >= MIN_BREAK_VERTICES).withColumn("inliers", F.size("vertices"))
    return kept.withColumns({**_fit_columns("LWPOLYLINE", None), "layer": F.lit(BREAK_LAYER)}).select(
        "page_id",
        _prefixed_id("bk_", "page_id", F.col("break_id")).alias("id"),
        *[c for c in _META if c != "source_pixels"],
        F.col("area").cast("int").alias("source_pixels"),
        "vertices",
        F.lit(True).alias("closed"),
    )


def assemble(*tables: DataFrame) -> DataFrame:
    """One primitive table from lines, centre lines, circles, arcs and breaks."""
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table, allowMissingColumns=True)
    return whole


def layer_dim(primitives: DataFrame) -> DataFrame:
    """Colour, role and line type of each primitive's layer (null for unknown layers)."""
    return primitives.join(F.broadcast(layer_table(primitives.sparkSession)), "layer", "left")


def layer_of_role(df: DataFrame, role: str = "role") -> DataFrame:
    by_role = layer_table(df.sparkSession).select(F.col("role").alias(role), F.col("layer").alias("_layer"))
    found = df.join(F.broadcast(by_role), role, "left")
    return found.withColumn("layer", F.coalesce("_layer", F.lit(DEFAULT_LAYER))).drop("_layer")


# --------------------------------------------------------------------- export
def entities(primitives: DataFrame, pages: DataFrame) -> DataFrame:
    """Drawable entities in millimetres, y up.

    ``pages``: page_id, px_per_mm, height_px.  A primitive that cannot be drawn
    is left out; its siblings stay.
    """
    placed = primitives.join(pages.select("page_id", "px_per_mm", "height_px"), "page_id", "left")
    ppm, height = F.col("px_per_mm"), F.col("height_px")
    scale = F.coalesce(F.nullif(ppm, F.lit(0.0)), F.lit(1.0))
    mm_x = lambda c: geo.to_mm_x(F.col(c), ppm)
    mm_y = lambda c: geo.to_mm_y(F.col(c), height, ppm)
    kind = F.col("type")
    radius = F.coalesce(F.col("radius"), F.lit(0.0)) / scale
    text_height = F.greatest(
        F.lit(MIN_TEXT_MM), F.coalesce(F.col("height"), F.lit(NOTE_TEXT_MM)) / F.greatest(scale, F.lit(1.0))
    )
    has_points = F.size("vertices") >= 2 if "vertices" in primitives.columns else F.lit(False)
    drawable = (
        F.when(kind == "LINE", F.col("x1").isNotNull() & F.col("x2").isNotNull())
        .when(kind.isin("CIRCLE", "ARC"), F.col("x1").isNotNull() & (radius > 0))
        .when(kind == "LWPOLYLINE", has_points)
        .when(kind == "TEXT", F.coalesce(F.col("text"), F.lit("")) != "")
        .otherwise(False)
    )
    arc = geo.flip_arc(F.col("start_angle_deg"), F.col("end_angle_deg"))
    columns = [
        F.col("page_id"),
        F.col("id"),
        kind.alias("type"),
        rules.export_layer(F.col("layer"), F.col("confidence")).alias("layer"),
        F.coalesce("layer", F.lit(DEFAULT_LAYER)).alias("source_layer"),
        mm_x("x1").alias("x1_mm"),
        mm_y("y1").alias("y1_mm"),
        F.when(kind == "LINE", mm_x("x2")).alias("x2_mm"),
        F.when(kind == "LINE", mm_y("y2")).alias("y2_mm"),
        F.when(kind.isin("CIRCLE", "ARC"), radius).alias("radius_mm"),
        F.when(kind == "ARC", arc["start_deg"]).alias("start_deg"),
        F.when(kind == "ARC", arc["end_deg"]).alias("end_deg"),
        F.when(kind == "TEXT", F.col("text")).alias("text"),
        F.when(kind == "TEXT", text_height).alias("text_height_mm"),
        F.when(kind == "TEXT", F.coalesce(F.col("rotation_deg"), F.lit(0.0))).alias("rotation_deg"),
    ]
    if "vertices" in primitives.columns:
        to_mm = lambda v: F.struct(
            geo.to_mm_x(v["x"], ppm).alias("x"), geo.to_mm_y(v["y"], height, ppm).alias("y")
        )
        columns += [F.transform("vertices", to_mm).alias("vertices_mm"), F.coalesce("closed", F.lit(False)).alias("closed")]
    return placed.where(drawable).select(*columns)


def text_entities(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """OCR text as entities on the dimension or note layer."""
    placed = blocks.where(F.coalesce(F.col("text"), F.lit("")) != "").join(
        pages.select("page_id", "px_per_mm", "height_px"), "page_id", "left"
    )
    rotation = F.coalesce(F.col("rotation_deg"), F.lit(0.0)) if "rotation_deg" in blocks.columns else F.lit(0.0)
    layer = F.when(F.col("kind") == "dimension_text", DIM_TEXT_LAYER).otherwise(NOTE_LAYER)
    return placed.select(
        "page_id",
        F.col("block_id").alias("id"),
        F.lit("TEXT").alias("type"),
        layer.alias("layer"),
        layer.alias("source_layer"),
        geo.to_mm_x(F.coalesce(F.col("x1"), F.lit(0.0)), F.col("px_per_mm")).alias("x1_mm"),
        geo.to_mm_y(F.coalesce(F.col("y1"), F.lit(0.0)), F.col("height_px"), F.col("px_per_mm")).alias("y1_mm"),
        "text",
        F.lit(NOTE_TEXT_MM).alias("text_height_mm"),
        rotation.alias("rotation_deg"),
    )


def polyline_edges(polylines: DataFrame) -> DataFrame:
    """Edges between consecutive vertices plus the closing edge; works inside each row."""
    v, n = F.col("vertices"), F.size("vertices")
    following = F.when(F.col("closed"), F.concat(F.slice(v, 2, n), F.slice(v, 1, 1))).otherwise(F.slice(v, 2, n))
    pairs = F.arrays_zip(v.alias("a"), following.alias("b"))
    return (
        polylines.where(n >= 2)
        .select("page_id", "id", F.posexplode(pairs).alias("ord", "e"))
        .where(F.col("e.b").isNotNull())
        .select(
            "page_id",
            "id",
            "ord",
            F.col("e.a.x").alias("x1"),
            F.col("e.a.y").alias("y1"),
            F.col("e.b.x").alias("x2"),
            F.col("e.b.y").alias("y2"),
        )
    )


# ------------------------------------------------------------------ summaries
def primitives_summary(primitives: DataFrame) -> DataFrame:
    return primitives.groupBy("page_id", F.coalesce("type", F.lit("?")).alias("type")).agg(F.count("*").alias("n"))


def low_confidence(primitives: DataFrame) -> DataFrame:
    return primitives.groupBy("page_id").agg(
        F.count("*").alias("primitives"), F.count_if(rules.weak(F.col("confidence"))).alias("low_confidence")
    )


def _review_counts(primitives: DataFrame, pages: DataFrame) -> DataFrame:
    counts = primitives.groupBy("page_id").agg(
        F.count("*").alias("n"),
        F.count_if(rules.weak(F.col("confidence"))).alias("low"),
        F.count_if(F.col("type") == "LINE").alias("lines"),
    )
    return pages.select("page_id").join(counts, "page_id", "left").na.fill(0, ["n", "low", "lines"])


def doc_review(primitives: DataFrame, pages: DataFrame) -> DataFrame:
    """Document review flag: nothing drawn, or more than max(5, a tenth) weak primitives."""
    limit = F.greatest(F.lit(5), F.floor(F.lit(0.1) * F.col("n")))
    return _review_counts(primitives, pages).select(
        "page_id",
        ((F.col("n") == 0) | (F.col("low") > limit)).alias("requires_review"),
        F.array_compact(
            F.array(
                F.when(F.col("n") == 0, "no_primitives_detected"), F.when(F.col("lines") == 0, "no_line_primitives")
            )
        ).alias("warnings"),
    )


def review_summary(primitives: DataFrame, pages: DataFrame) -> DataFrame:
    warning = F.when(F.col("n") == 0, "no_primitives").when(
        F.col("low") > 0, F.concat(F.col("low").cast("string"), F.lit(" primitives have low confidence"))
    )
    return _review_counts(primitives, pages).select("page_id", warning.isNull().alias("ok"), warning.alias("warning"))


# -------------------------------------------------------------- circles, arcs
CHAIN = ["page_id", "chain_id"]


def fit_circles(points: DataFrame, keys: list[str] = CHAIN) -> DataFrame:
    """Algebraic least-squares circle per chain, in one aggregation.

    Minimising the error of x²+y²+Dx+Ey+F is a linear regression of z = x²+y², so
    built-in (co)variances, which combine map-side, give D and E directly.
    """
    z = F.col("x") * F.col("x") + F.col("y") * F.col("y")
    s = points.withColumn("z", z).groupBy(*keys).agg(
        F.count("*").alias("inliers"),
        F.avg("x").alias("mx"),
        F.avg("y").alias("my"),
        F.avg("z").alias("mz"),
        F.var_pop("x").alias("sxx"),
        F.var_pop("y").alias("syy"),
        F.covar_pop("x", "y").alias("sxy"),
        F.covar_pop("x", "z").alias("sxz"),
        F.covar_pop("y", "z").alias("syz"),
    )
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    solvable = (F.col("inliers") >= 3) & (det > F.lit(1e-9) * (F.col("sxx") + F.col("syy")) * (F.col("sxx") + F.col("syy")))
    cx = (F.col("sxz") * F.col("syy") - F.col("syz") * F.col("sxy")) / (F.lit(2.0) * det)
    cy = (F.col("syz") * F.col("sxx") - F.col("sxz") * F.col("sxy")) / (F.lit(2.0) * det)
    # r² = cx²+cy²-F with F from the mean residual, rewritten about the centroid.
    squared = F.col("sxx") + F.col("syy") + (F.col("mx") - F.col("cx")) ** 2 + (F.col("my") - F.col("cy")) ** 2
    return (
        s.withColumns({"cx": F.when(solvable, cx), "cy": F.when(solvable, cy)})
        .withColumn("r", F.when(squared > 0, F.sqrt(squared)))
        .select(*keys, "cx", "cy", "r", "inliers")
    )


def fit_rms(points: DataFrame, fits: DataFrame, keys: list[str] = CHAIN) -> DataFrame:
    """Fits with their radial residual and whether the fit is accepted."""
    off = F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2) - F.col("r")
    # Every chain has points, so one join and one aggregation carry the fit along.
    judged = (
        points.join(fits.select(*keys, "cx", "cy", "r", "inliers"), keys)
        .groupBy(*keys, "cx", "cy", "r", "inliers")
        .agg(F.sqrt(F.avg(off * off)).alias("rms_px"))
    )
    good = (F.col("rms_px") <= CIRCLE_RESIDUAL_PX) & (F.col("inliers") >= CIRCLE_MIN_INLIERS)
    return judged.withColumn("accepted", F.coalesce(good, F.lit(False)))


def arc_extent(points: DataFrame, fits: DataFrame, keys: list[str] = CHAIN) -> DataFrame:
    """Angular coverage per fit; below a full turn also the arc's two ends.

    The arc starts after its largest gap.  The gap over 360° wins only when it is
    strictly larger; among equal gaps the first wins.
    """
    centred = points.join(fits.where(F.col("r").isNotNull()).select(*keys, "cx", "cy"), keys)
    degrees = F.pmod(F.degrees(F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"))), F.lit(360.0))
    angles = centred.select(*keys, degrees.alias("angle")).distinct()
    gaps = with_next(angles, keys, ["angle"], "angle", "next").withColumn("gap", F.col("next") - F.col("angle"))
    extent = gaps.groupBy(*keys).agg(
        F.min("angle").alias("lo"),
        F.max("angle").alias("hi"),
        F.max(
            F.when(
                F.col("next").isNotNull(),
                F.struct("gap", (-F.col("angle")).alias("first"), F.col("next").alias("after")),
            )
        ).alias("top"),
    )
    wrap = F.lit(360.0) - (F.col("hi") - F.col("lo"))
    inner = F.coalesce(F.col("top.gap"), F.lit(0.0))
    over_zero = wrap > inner
    coverage = F.lit(360.0) - F.greatest(inner, wrap)
    is_arc = F.col("coverage") <= FULL_TURN_COVERAGE_DEG
    return (
        extent.withColumns({"coverage": coverage, "_over": over_zero})
        .select(
            *keys,
            "coverage",
            F.when(is_arc, "ARC").otherwise("CIRCLE").alias("type"),
            F.when(is_arc, F.when(F.col("_over"), F.col("lo")).otherwise(F.col("top.after"))).alias("start_deg"),
            F.when(is_arc, F.when(F.col("_over"), F.col("hi")).otherwise(-F.col("top.first"))).alias("end_deg"),
        )
    )


# ------------------------------------------------------------ chains to lines
def chord_deviation(points: DataFrame, keys: list[str] = CHAIN) -> DataFrame:
    """Farthest point from the chord of each chain, and the rms distance."""
    at = F.struct("x", "y")
    chords = points.groupBy(*keys).agg(
        F.min_by(at, "ord").alias("p"), F.max_by(at, "ord").alias("q"), F.count("*").alias("n")
    )
    off = geo.line_distance(
        F.col("x"), F.col("y"), F.col("p.x"), F.col("p.y"), F.col("q.x"), F.col("q.y")
    )
    worst = F.max(F.struct(F.col("off"), (-F.col("ord")).alias("back")))
    return (
        points.join(chords, keys)
        .withColumn("off", off)
        .groupBy(*keys)
        .agg(worst.alias("worst"), F.sqrt(F.avg(F.col("off") * F.col("off"))).alias("rms_px"), F.count("*").alias("n"))
        .select(*keys, F.col("worst.off").alias("max_dev"), (-F.col("worst.back")).alias("at_ord"), "rms_px", "n")
    )


def _close(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Equal up to the usual floating tolerance (1e-8 absolute, 1e-5 relative)."""
    near = lambda a, b: F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b)
    return near(ax, bx) & near(ay, by)


def split_polylines(points: DataFrame, tol: float = LINE_RESIDUAL_PX, keys: list[str] = CHAIN) -> DataFrame:
    """Straight pieces of every chain: cut at the farthest point until all are within ``tol``.

    Chains of up to CHAIN_POINTS points are cut as arrays, each inside a task; the others, and
    those with a missing number, in rounds over all tasks.
    """
    named = points
    for k in keys:
        named = named.where(F.col(k).isNotNull())
    odd = F.lit(False)
    for c in ("ord", "x", "y"):
        odd = odd | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    sizes = named.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(odd).alias("_odd"))
    late = settle(sizes.where((F.col("_n") > CHAIN_POINTS) | F.col("_odd")).select(*keys))
    rounds = not late.isEmpty()
    soon = named.join(late, keys, "left_anti") if rounds else named
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    own = [f"{k} {kinds[k]}" for k in keys]
    schema = ", ".join([*own, f"from_ord {kinds['ord']}", f"to_ord {kinds['ord']}", "x1 double, y1 double, x2 double, y2 double, rms_px double, inliers long"])
    soon = soon.select(*keys, "ord", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    done = settle(grouped(soon, keys, lambda rows: _split_chain(rows, tol, keys), schema))
    return done.unionByName(_split_in_rounds(named.join(late, keys, "left_semi"), tol, keys)) if rounds else done


def _split_chain(rows: dict[str, np.ndarray], tol: float, keys: list[str]) -> dict:
    """The straight pieces of one chain; all pieces of a depth are measured and cut at once."""
    order = np.lexsort((rows["y"], rows["x"], rows["ord"]))
    at, x, y = rows["ord"][order], rows["x"][order] + 0.0, rows["y"][order] + 0.0  # no negative zero
    close = lambda a, b: (np.abs(x[a] - x[b]) <= 1e-8 + 1e-5 * np.abs(x[b])) & (np.abs(y[a] - y[b]) <= 1e-8 + 1e-5 * np.abs(y[b]))
    before, behind = np.searchsorted(at, at, "left"), np.searchsorted(at, at, "right") - 1
    # A piece: its first and last row, and the two points its line goes through.
    low, high = np.array([0]), np.array([len(at) - 1])
    a, b = low, high
    if len(at) >= 4 and close(a, b)[0]:
        # A closed chain has no chord: cut it first at the vertex farthest from its start.
        reach = (x - x[0]) ** 2 + (y - y[0]) ** 2
        far = np.flatnonzero(reach == reach.max())
        c = far[at[far] == at[far[0]]][-1:]
        low, high, a, b = np.r_[low, before[c]], np.r_[behind[c], high], np.r_[a, c], np.r_[c, b]
    out = []
    while True:
        chord = ~close(a, b)
        low, high, a, b = low[chord], high[chord], a[chord], b[chord]
        if not len(low):
            break
        many = high - low + 1
        first = np.cumsum(many) - many
        owner = np.repeat(np.arange(len(low)), many)
        row = np.arange(len(owner)) - (first - low)[owner]
        dx, dy = x[b] - x[a], y[b] - y[a]
        run = np.sqrt(dx * dx + dy * dy)
        cross = (x[row] - x[a][owner]) * dy[owner] - (y[row] - y[a][owner]) * dx[owner]
        with np.errstate(divide="ignore", invalid="ignore"):
            off = np.where((run >= 1e-9)[owner], np.abs(cross) / run[owner], 0.0)
        worst = np.maximum.reduceat(off, first)
        # The first position of the largest distance; of several points there the last.
        hit = np.flatnonzero(off == worst[owner])
        c = row[hit[np.searchsorted(owner[hit], np.arange(len(low)))]]
        hit = hit[at[row[hit]] == at[c][owner[hit]]]
        c = row[hit[np.searchsorted(owner[hit], np.arange(len(low)), "right") - 1]]
        fails = (worst > tol) & (at[c] != at[a]) & (at[c] != at[b])
        fits = ~fails
        if fits.any():
            rms = np.sqrt(np.add.reduceat(off * off, first)[fits] / many[fits])
            out.append((at[a[fits]], at[b[fits]], x[a[fits]], y[a[fits]], x[b[fits]], y[b[fits]], rms, many[fits]))
        low, high, a, b, c = low[fails], high[fails], a[fails], b[fails], c[fails]
        low, high, a, b = np.r_[low, before[c]], np.r_[behind[c], high], np.r_[a, c], np.r_[c, b]
    if not out:
        return {}
    names = ["from_ord", "to_ord", *ENDS, "rms_px", "inliers"]
    return {**{k: rows[k][0] for k in keys}, **{n: np.concatenate(v) for n, v in zip(names, zip(*out, strict=True), strict=True)}}


def _split_in_rounds(points: DataFrame, tol: float, keys: list[str]) -> DataFrame:
    """``split_polylines`` of chains of any length.

    All failing pieces of all chains are cut in the same round.  Points carry the
    bounds of their piece, finished pieces leave the loop, and a long chain is
    spread over tasks because only aggregates per piece are exchanged.
    """
    at = F.struct("ord", "x", "y")
    bounds = points.groupBy(*keys).agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count("*").alias("_n"))
    with_bounds = points.join(bounds, keys)
    # A closed chain has no chord: cut it first at the vertex farthest from its start.
    reach = (F.col("x") - F.col("a.x")) ** 2 + (F.col("y") - F.col("a.y")) ** 2
    closed = (F.col("_n") >= 4) & _close(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))
    far = (
        with_bounds.where(closed)
        .groupBy(*keys)
        .agg(F.max(F.struct(reach.alias("d"), (-F.col("ord")).alias("back"), at.alias("m"))).alias("far"))
        .select(*keys, F.col("far.m").alias("cut"))
    )
    current = settle(_recut(with_bounds.join(far, keys, "left").drop("_n"), keys))
    done: DataFrame | None = None
    while True:
        piece = [*keys, "a", "b"]
        off = geo.line_distance(F.col("x"), F.col("y"), F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))
        stats = (
            current.withColumn("off", F.coalesce(off, F.lit(0.0)))
            .groupBy(*piece)
            .agg(
                F.max(F.struct(F.col("off"), (-F.col("ord")).alias("back"), at.alias("m"))).alias("worst"),
                F.sum(F.col("off") * F.col("off")).alias("ss"),
                F.count("*").alias("n"),
            )
        )
        inner = (F.col("worst.m.ord") != F.col("a.ord")) & (F.col("worst.m.ord") != F.col("b.ord"))
        chord = ~_close(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))
        judged = settle(stats.where(chord).withColumn("fails", (F.col("worst.off") > tol) & inner))
        pieces = judged.where(~F.col("fails")).select(
            *keys,
            F.col("a.ord").alias("from_ord"),
            F.col("b.ord").alias("to_ord"),
            F.col("a.x").alias("x1"),
            F.col("a.y").alias("y1"),
            F.col("b.x").alias("x2"),
            F.col("b.y").alias("y2"),
            F.sqrt(F.col("ss") / F.col("n")).alias("rms_px"),
            F.col("n").alias("inliers"),
        )
        done = pieces if done is None else done.unionByName(pieces)
        cuts = judged.where("fails").select(*piece, F.col("worst.m").alias("cut"))
        if cuts.isEmpty():
            return done
        current = settle(_recut(current.join(cuts, piece), keys))


def _recut(points: DataFrame, keys: list[str]) -> DataFrame:
    """Assign points to the halves of a piece; the cut point belongs to both."""
    at = F.col("cut.ord")
    left = F.struct(F.col("a").alias("a"), F.col("cut").alias("b"))
    right = F.struct(F.col("cut").alias("a"), F.col("b").alias("b"))
    whole = F.struct(F.col("a").alias("a"), F.col("b").alias("b"))
    halves = (
        F.when(at.isNull(), F.array(whole))
        .when(F.col("ord") < at, F.array(left))
        .when(F.col("ord") > at, F.array(right))
        .otherwise(F.array(left, right))
    )
    return points.select(*keys, "ord", "x", "y", F.explode(halves).alias("_h")).select(
        *keys, "ord", "x", "y", F.col("_h.a").alias("a"), F.col("_h.b").alias("b")
    )


# ---------------------------------------------------------------- proximities
def endpoints(segments: DataFrame) -> DataFrame:
    """Two rows per segment; ``pt`` is the point's order within the page."""
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("x1").alias("x"), F.col("y1").alias("y")),
        F.struct(F.lit(1).alias("side"), F.col("x2").alias("x"), F.col("y2").alias("y")),
    )
    return segments.select("page_id", "seg_id", F.inline(sides)).withColumn("pt", F.col("seg_id") * 2 + F.col("side"))


def near_points(points: DataFrame, tol: float = ENDPOINT_TOLERANCE_PX) -> DataFrame:
    """Pairs of distinct positions on a page at most ``tol`` apart, with their multiplicities.

    Points at one position are counted first, so copies never multiply.  A position is
    filed under its own cell and looks into the cells its larger partners can lie in, so
    every pair meets once; cells are wider than the reach, so that is less than two cells
    on average.
    """
    side, reach = NEAR_CELLS * tol, tol * (1 + 1e-9) + 1e-9
    placed = F.col("page_id").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()
    spots = points.where(placed).groupBy("page_id", "x", "y").agg(F.count("*").alias("n"))
    # Both sides get their cells from a generator, so they read the same exchange of the spots.
    b = fence(spots, {"cx": cell("x", side), "cy": cell("y", side)})
    b = b.select("page_id", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("n").alias("n_b"), "cx", "cy")
    seen = lambda c, back: F.explode(F.sequence(cell(F.col(c) - back, side), cell(F.col(c) + reach, side)))
    a = spots.withColumn("cx", seen("x", 0.0)).withColumn("cy", seen("y", reach))
    a = a.select("page_id", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("n").alias("n_a"), "cx", "cy")
    dist = geo.length(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    met = a.join(b, ["page_id", "cx", "cy"]).where(F.struct("ax", "ay") < F.struct("bx", "by"))
    return met.withColumn("dist", dist).where(F.col("dist") <= tol).select("page_id", "ax", "ay", "bx", "by", "n_a", "n_b", "dist")


def _by_page(segments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments, and which of them are of pages with up to PAGE_SEGMENTS of them and of crowded pages."""
    kept = settle_dense(segments)
    crowded = settle(kept.groupBy("page_id").agg(F.count("*").alias("_n")).where(F.col("_n") > PAGE_SEGMENTS).select("page_id"))
    soon = kept if crowded.isEmpty() else kept.join(crowded, "page_id", "left_anti")
    return kept, soon, kept.join(crowded, "page_id", "left_semi")


def _whole() -> Column:
    """Page, id and place of a segment are known; any other meets no segment."""
    known = F.col("page_id").isNotNull() & F.col("seg_id").isNotNull()
    for c in ENDS:
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return known


def _merge_rule(gap: float = COLLINEAR_GAP_PX) -> dict:
    return {"angle": COLLINEAR_ANGLE_DEG, "distance": COLLINEAR_DISTANCE_PX, "gap": gap, "shortest": MIN_MERGE_PX}


# Directions are cut into buckets twice as wide as the angle tolerance.
_BUCKET_DEG = 2 * COLLINEAR_ANGLE_DEG
_BUCKETS = int(round(180.0 / _BUCKET_DEG))


def _principal(xs: list[Column], ys: list[Column]) -> dict[str, Column]:
    """Segment spanned by points along their principal axis."""
    n = float(len(xs))
    mx, my = sum(xs[1:], xs[0]) / n, sum(ys[1:], ys[0]) / n
    sxx = sum([(x - mx) * (x - mx) for x in xs[1:]], (xs[0] - mx) * (xs[0] - mx))
    syy = sum([(y - my) * (y - my) for y in ys[1:]], (ys[0] - my) * (ys[0] - my))
    sxy = sum([(x - mx) * (y - my) for x, y in zip(xs[1:], ys[1:], strict=True)], (xs[0] - mx) * (ys[0] - my))
    return {"mx": mx, "my": my, "theta": F.lit(0.5) * F.atan2(F.lit(2.0) * sxy, sxx - syy)}


def _span(df: DataFrame, points: list[tuple[str, str]]) -> DataFrame:
    """Columns m_x1..m_y2: extreme projections of the points on their principal axis."""
    xs, ys = [F.col(x) for x, _ in points], [F.col(y) for _, y in points]
    axis = fence(df, {f"_{k}": v for k, v in _principal(xs, ys).items()})
    axis = fence(axis, {"_ux": F.cos("_theta"), "_uy": F.sin("_theta")})
    along = [(x - F.col("_mx")) * F.col("_ux") + (y - F.col("_my")) * F.col("_uy") for x, y in zip(xs, ys, strict=True)]
    axis = fence(axis, {"_lo": F.least(*along), "_hi": F.greatest(*along)})
    return fence(
        axis,
        {
            "m_x1": F.col("_mx") + F.col("_ux") * F.col("_lo"),
            "m_y1": F.col("_my") + F.col("_uy") * F.col("_lo"),
            "m_x2": F.col("_mx") + F.col("_ux") * F.col("_hi"),
            "m_y2": F.col("_my") + F.col("_uy") * F.col("_hi"),
        },
    ).drop("_mx", "_my", "_theta", "_ux", "_uy", "_lo", "_hi")


def distinct_segments(segments: DataFrame) -> DataFrame:
    """Copies of one geometry folded together: least id, summed inliers, weighted rms.

    Segments too short to merge stay apart, copies included.
    """
    weight = F.col("rms_px") * F.col("rms_px") * F.col("inliers")
    short = geo.length(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) < MIN_MERGE_PX
    own = F.when(short, F.col("seg_id")).alias("_own")
    return segments.groupBy("page_id", *ENDS, own).agg(
        F.min("seg_id").alias("seg_id"),
        F.count("*").alias("copies"),
        F.sqrt(F.sum(weight) / F.greatest(F.sum("inliers"), F.lit(1))).alias("rms_px"),
        F.sum("inliers").alias("inliers"),
    )


def collinear_candidates(segments: DataFrame, gap: float = COLLINEAR_GAP_PX, focus: str | None = None) -> DataFrame:
    """Unordered pairs of segments that could be collinear; a superset of the true pairs.

    Two segments can only merge when their midpoints are at most la+lb+gap+4 apart
    and each lies almost on the other's line.  Segments are therefore keyed by page,
    direction bucket, size class, and position in a frame turned to that direction:
    long cells along the line, thin cells across it.  The larger segment looks into
    the few cells of its size class within reach; the smaller one files itself under
    every size class from its own up and under the one or two directions it may match.

    ``focus`` names a boolean column: only pairs with such a segment are searched.
    """
    if focus is not None:
        # Pages without such a segment are done.
        segments = segments.join(segments.where(focus).select("page_id").distinct(), "page_id", "left_semi")
    usable = fence(
        spread_rows(segments, "page_id", "seg_id"),
        {
            "len": geo.length(*ends()),
            "ang": geo.folded_angle(*ends()),
            "midx": (F.col("x1") + F.col("x2")) / 2.0,
            "midy": (F.col("y1") + F.col("y2")) / 2.0,
        },
    ).where(F.col("len") >= MIN_MERGE_PX)
    # Class k covers lengths up to 2^k - gap - 4, so a larger segment of class k and
    # any smaller one have midpoints at most len + 2^k apart.
    usable = usable.withColumn("cls", F.ceil(F.log2(F.col("len") + gap + 4.0)).cast("int"))
    usable = usable.withColumn("dir", (F.floor(F.col("ang") / _BUCKET_DEG) % _BUCKETS).cast("int"))
    top = usable.groupBy("page_id").agg(F.max("cls").alias("top"))

    # Directions differ by at most half a bucket plus the tolerance.
    slope = math.sin(math.radians(_BUCKET_DEG / 2 + COLLINEAR_ANGLE_DEG)) * 1.001
    unit = F.pow(F.lit(2.0), F.col("k"))
    along_cell, across_cell = unit * 4.0, unit * (4.0 * slope) + 2.0 * COLLINEAR_DISTANCE_PX + 2.0

    def placed(df: DataFrame) -> DataFrame:
        turn = F.radians((F.col("d") + 0.5) * _BUCKET_DEG)
        return fence(
            df,
            {
                "s": F.col("midx") * F.cos(turn) + F.col("midy") * F.sin(turn),
                "t": F.col("midy") * F.cos(turn) - F.col("midx") * F.sin(turn),
                "along": along_cell,
                "across": across_cell,
            },
        )

    # Lengths and angles follow from the ends and are found again behind the exchange; the
    # larger segment's class is the cell's.
    extra = [c for c in ("rms_px", "inliers", "copies", focus) if c in segments.columns]
    carried = ["page_id", "seg_id", *ENDS, "cls", *extra]
    big = placed(usable.withColumns({"k": F.col("cls"), "d": F.col("dir")}))
    reach = F.col("len") + F.pow(F.lit(2.0), F.col("k")) + 4.0
    aside = reach * slope + COLLINEAR_DISTANCE_PX + 1.0
    cells = lambda c, far, size: F.sequence(F.floor((F.col(c) - far) / F.col(size)), F.floor((F.col(c) + far) / F.col(size)))
    big = big.withColumn("cs", F.explode(cells("s", reach, "along"))).withColumn("ct", F.explode(cells("t", aside, "across")))
    where = ["page_id", "kd", "cs", "ct"]
    kd = (F.col("k") * _BUCKETS + F.col("d")).alias("kd")
    big = big.select(*[F.col(c).alias(c if c == "page_id" else f"a_{c}") for c in carried if c != "cls"], kd, "cs", "ct")
    side = lambda delta: F.pmod(F.floor((F.col("ang") + delta) / _BUCKET_DEG), F.lit(_BUCKETS)).cast("int")
    near_dirs = F.array_distinct(F.array(side(-COLLINEAR_ANGLE_DEG - 1e-9), side(COLLINEAR_ANGLE_DEG + 1e-9)))
    small = usable.join(top, "page_id").withColumn("k", F.explode(F.sequence("cls", "top"))).withColumn("d", F.explode(near_dirs))
    small = placed(small).withColumns({"cs": F.floor(F.col("s") / F.col("along")), "ct": F.floor(F.col("t") / F.col("across"))})
    small = small.select(*[F.col(c).alias(c if c == "page_id" else f"b_{c}") for c in carried], kd, "cs", "ct")
    if focus is None:
        pairs = big.join(small, where)
    else:
        # Focused segments on either side; pairs focused on both sides only once.
        a_in, b_in = F.col(f"a_{focus}"), F.col(f"b_{focus}")
        pairs = big.where(a_in).join(small, where).unionByName(big.where(~a_in).join(small.where(b_in), where))
    # Equal classes meet twice, once from each side.
    pairs = pairs.where(
        (F.col("a_seg_id") != F.col("b_seg_id"))
        & ((F.floor(F.col("kd") / _BUCKETS) != F.col("b_cls")) | (F.col("a_seg_id") < F.col("b_seg_id")))
    )
    return measured(pairs.drop("kd", "cs", "ct", "b_cls"))


def measured(pairs: DataFrame) -> DataFrame:
    """Pairs with the lengths and the folded directions of both segments."""
    own = lambda s: [F.col(f"{s}_{c}") for c in ENDS]
    return fence(pairs, {f"{s}_{name}": of(*own(s)) for s in "ab" for name, of in (("len", geo.length), ("ang", geo.folded_angle))})


def _mergeable(pairs: DataFrame, gap: float = COLLINEAR_GAP_PX) -> DataFrame:
    """Keep pairs (a, b) whose merge test holds with ``a`` as the base line."""
    a = [F.col(f"a_{c}") for c in ENDS]
    off = F.greatest(
        geo.line_distance(F.col("b_x1"), F.col("b_y1"), *a), geo.line_distance(F.col("b_x2"), F.col("b_y2"), *a)
    )
    near = pairs.where(
        (F.least("a_len", "b_len") >= MIN_MERGE_PX)
        & (geo.angle_gap(F.col("a_ang"), F.col("b_ang")) <= COLLINEAR_ANGLE_DEG)
        & (off <= COLLINEAR_DISTANCE_PX)
    )
    spanned = _span(near, [("a_x1", "a_y1"), ("a_x2", "a_y2"), ("b_x1", "b_y1"), ("b_x2", "b_y2")])
    merged = geo.length(F.col("m_x1"), F.col("m_y1"), F.col("m_x2"), F.col("m_y2"))
    return fence(spanned, {"m_len": merged}).where(F.col("m_len") <= F.col("a_len") + F.col("b_len") + gap)


def _both_orders(pairs: DataFrame) -> DataFrame:
    """Every pair as (a, b) and as (b, a), from one evaluation of the pair search."""
    close = pairs.where(geo.angle_gap(F.col("a_ang"), F.col("b_ang")) <= COLLINEAR_ANGLE_DEG)
    names = [c[2:] for c in pairs.columns if c.startswith("a_")]
    order = lambda first, second: F.struct(
        *[F.col(f"{first}_{n}").alias(f"a_{n}") for n in names], *[F.col(f"{second}_{n}").alias(f"b_{n}") for n in names]
    )
    return close.select("page_id", F.inline(F.array(order("a", "b"), order("b", "a"))))


def collinear_pairs(segments: DataFrame) -> DataFrame:
    """Ordered pairs (a, b) of distinct geometries that may merge; not symmetric.

    ``b`` must lie within two pixels of ``a``'s line, so (a, b) can hold when
    (b, a) does not.  Pages of up to PAGE_SEGMENTS segments are searched as arrays, each
    inside a task; crowded ones by joins on cells.
    """
    columns = ["page_id", "seg_id", *ENDS]
    kept, soon, crowded = _by_page(segments.select(*columns))
    ids = kept.schema["seg_id"].dataType.simpleString()
    schema = f"page_id string, a_id {ids}, b_id {ids}, a_copies long, b_copies long, merged_len double"
    rule = _merge_rule()
    found = grouped(soon.where(_whole()), ["page_id"], lambda rows: page_pairs(rows, rule), schema)
    # Also without crowded pages: an empty table costs the join a few empty stages.
    dull = {"rms_px": F.lit(0.0), "inliers": F.lit(0)}
    return found.unionByName(_collinear_in_cells(crowded.withColumns(dull)))


def _collinear_in_cells(segments: DataFrame) -> DataFrame:
    """``collinear_pairs`` of pages of any size."""
    pairs = collinear_candidates(distinct_segments(segments).drop("rms_px", "inliers"))
    return _mergeable(_both_orders(pairs)).select(
        "page_id",
        F.col("a_seg_id").alias("a_id"),
        F.col("b_seg_id").alias("b_id"),
        F.col("a_copies").alias("a_copies"),
        F.col("b_copies").alias("b_copies"),
        F.col("m_len").alias("merged_len"),
    )


def merged_segment(segments: DataFrame, keys: list[str]) -> DataFrame:
    """One segment per cluster: principal axis, extreme projections, weighted rms."""
    points = segments.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")),
                F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")),
            )
        ),
    )
    axes = (
        points.groupBy(*keys)
        .agg(
            F.avg("x").alias("mx"),
            F.avg("y").alias("my"),
            F.var_samp("x").alias("sxx"),
            F.var_samp("y").alias("syy"),
            F.covar_samp("x", "y").alias("sxy"),
        )
        .withColumn("theta", F.lit(0.5) * F.atan2(F.lit(2.0) * F.col("sxy"), F.col("sxx") - F.col("syy")))
        .select(*keys, "mx", "my", F.cos("theta").alias("ux"), F.sin("theta").alias("uy"))
    )
    along = (F.col("x") - F.col("mx")) * F.col("ux") + (F.col("y") - F.col("my")) * F.col("uy")
    spans = points.join(axes, keys).groupBy(*keys).agg(F.min(along).alias("lo"), F.max(along).alias("hi"))
    weight = F.col("rms_px") * F.col("rms_px") * F.col("inliers")
    quality = segments.groupBy(*keys).agg(
        F.count("*").alias("members"),
        F.sqrt(F.sum(weight) / F.greatest(F.sum("inliers"), F.lit(1))).alias("rms_px"),
        F.sum("inliers").alias("inliers"),
    )
    return (
        axes.join(spans, keys)
        .join(quality, keys)
        .select(
            *keys,
            (F.col("mx") + F.col("ux") * F.col("lo")).alias("x1"),
            (F.col("my") + F.col("uy") * F.col("lo")).alias("y1"),
            (F.col("mx") + F.col("ux") * F.col("hi")).alias("x2"),
            (F.col("my") + F.col("uy") * F.col("hi")).alias("y2"),
            "rms_px",
            "inliers",
            "members",
        )
    )


def merge_collinear(segments: DataFrame) -> DataFrame:
    """Merge collinear segments until no pair can merge.

    Every round merges a set of disjoint pairs on all pages at once: a pair goes
    through when it is the first choice of both its segments.  Choices are ordered
    by a hash, so long runs of dashes halve each round instead of growing one by one.
    The merged segment keeps the smaller id and is tested again with its new line.
    A page of up to PAGE_SEGMENTS segments takes its rounds as arrays inside a task; crowded
    pages, and segments without a page or place, in rounds over all tasks.
    """
    columns = ["page_id", "seg_id", *ENDS, "rms_px", "inliers"]
    kept, soon, crowded = _by_page(segments.select(*columns))
    if kept.schema["seg_id"].dataType.simpleString() != "bigint":
        return _merge_in_rounds(kept)  # the order of the choices is a hash of the ids as they are
    rule, schema = _merge_rule(), distinct_segments(kept).select(*columns).schema
    done = settle_dense(grouped(soon.where(_whole()), ["page_id"], lambda rows: page_merged(rows, rule), schema))
    return done.unionByName(_merge_in_rounds(crowded.unionByName(soon.where(~_whole()))))


def _merge_in_rounds(segments: DataFrame) -> DataFrame:
    """``merge_collinear`` of pages of any size."""
    columns = ["page_id", "seg_id", *ENDS, "rms_px", "inliers"]
    shape = [*ENDS, "rms_px", "inliers"]
    current = settle(distinct_segments(segments).select(*columns, F.lit(True).alias("fresh")))
    # An option is two ids; geometry is looked up for the chosen ones only.
    options = settle(_merge_options(collinear_candidates(current.drop("rms_px", "inliers"))))
    while not options.isEmpty():
        rank = F.struct(F.xxhash64("i", "j").alias("h"), "i", "j")
        touched = options.select("page_id", F.explode(F.array("i", "j")).alias("seg"), rank.alias("rank"))
        best = touched.groupBy("page_id", "seg").agg(F.min("rank").alias("rank"))
        # A pair chosen by both its segments appears twice among the best.
        agreed = best.groupBy("page_id", "rank").agg(F.count("*").alias("votes")).where(F.col("votes") == 2)
        agreed = settle(agreed.select("page_id", F.col("rank.i").alias("i"), F.col("rank.j").alias("j")))
        side = lambda s, id: current.select("page_id", F.col("seg_id").alias(id), *[F.col(c).alias(f"{s}_{c}") for c in shape])
        chosen = settle(_merged(agreed.join(side("a", "i"), ["page_id", "i"]).join(side("b", "j"), ["page_id", "j"])))
        absorbed = chosen.select("page_id", F.col("j").alias("seg_id"))
        grown = chosen.select("page_id", F.col("i").alias("seg_id"), "m")
        kept = current.join(absorbed, ["page_id", "seg_id"], "left_anti").join(grown, ["page_id", "seg_id"], "left")
        current = settle(
            kept.select(
                "page_id",
                "seg_id",
                *[F.coalesce(F.col(f"m.{c}"), F.col(c)).alias(c) for c in shape],
                F.col("m").isNotNull().alias("fresh"),
            )
        )
        # Options between segments that did not change stay valid; only the grown
        # segments are searched again.
        changed = agreed.select("page_id", F.explode(F.array("i", "j")).alias("seg"))
        old = options
        for end in ("i", "j"):
            old = old.join(changed.withColumnRenamed("seg", end), ["page_id", end], "left_anti")
        new = _merge_options(collinear_candidates(current.drop("rms_px", "inliers"), focus="fresh"))
        options = settle(old.select("page_id", "i", "j").unionByName(new))
    return current.select(*columns)


def _merge_options(pairs: DataFrame) -> DataFrame:
    """Valid merges: page_id, i, j (i absorbs j, i < j)."""
    carried = ["seg_id", *ENDS, "len", "ang"]
    a_first = F.col("a_seg_id") < F.col("b_seg_id")
    swap = lambda mine, other, c: F.when(a_first, F.col(f"{mine}_{c}")).otherwise(F.col(f"{other}_{c}")).alias(f"{mine}_{c}")
    sides = F.struct(*[swap("a", "b", c) for c in carried], *[swap("b", "a", c) for c in carried])
    low_first = pairs.select("page_id", F.inline(F.array(sides)))
    return _mergeable(low_first).select("page_id", F.col("a_seg_id").alias("i"), F.col("b_seg_id").alias("j"))


def _merged(pairs: DataFrame) -> DataFrame:
    """page_id, i, j and the merged geometry ``m`` of valid merges with their segments a and b."""
    inliers = F.col("a_inliers") + F.col("b_inliers")
    weight = F.col("a_rms_px") ** 2 * F.col("a_inliers") + F.col("b_rms_px") ** 2 * F.col("b_inliers")
    return _mergeable(measured(pairs)).select(
        "page_id",
        "i",
        "j",
        F.struct(
            F.col("m_x1").alias("x1"),
            F.col("m_y1").alias("y1"),
            F.col("m_x2").alias("x2"),
            F.col("m_y2").alias("y2"),
            F.sqrt(weight / F.greatest(inliers, F.lit(1))).alias("rms_px"),
            inliers.alias("inliers"),
        ).alias("m"),
    )


def snap_angles(segments: DataFrame, tolerance: float = geo.SNAP_TOLERANCE_DEG) -> DataFrame:
    snapped = segments.withColumn("_s", geo.snap_segment(*ends(), tolerance=tolerance))
    return snapped.withColumns({c: F.col(f"_s.{c}") for c in [*ENDS, "snapped"]}).drop("_s")


def snap_endpoints(segments: DataFrame, tol: float = ENDPOINT_TOLERANCE_PX, compat: bool = False) -> DataFrame:
    """Pull segment ends that are within ``tol`` of a seed point to their common mean.

    Seeds are taken in point order: a point becomes a seed when no earlier seed is
    within ``tol``; every point belongs to the last seed in range.  Cells have a
    diagonal of ``tol``, so a cell holds at most one seed and only its earliest open
    point can become one.  Points meet candidates in blocks of SNAP_BLOCK cells a side;
    candidates are also filed under the blocks they reach, one to four in all, so a
    point meets a bounded number of them and pairs of points are never listed.
    ``compat=True`` leaves the seed point itself where it was.  A page of up to PAGE_SEGMENTS
    segments takes its points one after the other inside a task; crowded pages take rounds.
    """
    kept, soon, crowded = _by_page(segments)
    ids = kept.schema["seg_id"].dataType.simpleString()
    known = F.col("page_id").isNotNull() & F.col("seg_id").isNotNull()
    ends_of = soon.where(known).select("page_id", "seg_id", *[F.col(c).cast("double").alias(c) for c in ENDS])
    schema = f"page_id string, seg_id {ids}, x1 double, y1 double, x2 double, y2 double"
    placed = grouped(ends_of, ["page_id"], lambda rows: page_snapped(rows, tol, compat), schema)
    snapped = soon.drop(*ENDS).join(placed, ["page_id", "seg_id"])
    return snapped if crowded.isEmpty() else snapped.unionByName(_snap_in_rounds(crowded, tol, compat))


def _snap_in_rounds(segments: DataFrame, tol: float, compat: bool) -> DataFrame:
    """``snap_endpoints`` of pages of any size."""
    side = tol / math.sqrt(2.0) * (1 - 1e-9)
    points = settle(
        endpoints(segments).withColumns({"cx": cell("x", side), "cy": cell("y", side)}).repartition("page_id", "cx", "cy")
    )
    spots = points.groupBy("page_id", "cx", "cy", "x", "y").agg(F.min("pt").alias("pt"))
    here, block = ["page_id", "cx", "cy"], ["page_id", "bx", "by"]

    def in_block(spots: DataFrame) -> DataFrame:
        return spots.withColumns({"bx": cell("cx", SNAP_BLOCK), "by": cell("cy", SNAP_BLOCK)})

    def seen_from(near: DataFrame, name: str) -> DataFrame:
        """Candidates or seeds, filed under every block they can reach (two cells off)."""
        reached = lambda c: F.explode(F.sequence(cell(F.col(c) - 2, SNAP_BLOCK), cell(F.col(c) + 2, SNAP_BLOCK)))
        wide = near.withColumn("bx", reached("cx")).withColumn("by", reached("cy"))
        return wide.select(*block, *[F.col(c).alias(f"{name}_{c}") for c in ("x", "y", "pt")])

    def within(name: str) -> Column:
        return geo.length(F.col("x"), F.col("y"), F.col(f"{name}_x"), F.col(f"{name}_y")) <= tol

    # A point without page or place meets nothing and would never be decided.
    placed = F.col("page_id").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("pt").isNotNull()
    undecided, seeds = settle(spots.where(placed)), None
    while not undecided.isEmpty():
        first = undecided.groupBy(*here).agg(F.min(F.struct("pt", "x", "y")).alias("f"))
        first = first.select(*here, "f.pt", "f.x", "f.y")
        blocked = (
            in_block(undecided).join(seen_from(first, "c"), block)
            .where((F.col("pt") < F.col("c_pt")) & within("c"))
            .select("page_id", F.col("c_pt").alias("pt"))
            .distinct()
        )
        fresh = settle(first.join(blocked, ["page_id", "pt"], "left_anti").select(*here, "x", "y", "pt"))
        covered = (
            in_block(undecided).join(seen_from(fresh, "s"), block).where(within("s")).select("page_id", "pt").distinct()
        )
        undecided = settle(undecided.join(covered, ["page_id", "pt"], "left_anti"))
        seeds = fresh if seeds is None else seeds.unionByName(fresh)
    if seeds is None:
        return segments
    owner = (
        in_block(spots).join(seen_from(seeds, "s"), block)
        .where(within("s"))
        .groupBy("page_id", "x", "y")
        .agg(F.max("s_pt").alias("seed"))
    )
    owned = points.join(owner, ["page_id", "x", "y"])
    means = owned.groupBy("page_id", "seed").agg(
        F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.count("*").alias("members")
    )
    stays = (F.col("pt") == F.col("seed")) if compat else F.lit(False)
    alone = F.col("members") == 1
    moved = owned.join(means, ["page_id", "seed"]).select(
        "page_id",
        "seg_id",
        "side",
        F.when(stays | alone, F.col("x")).otherwise(F.col("mean_x")).alias("x"),
        F.when(stays | alone, F.col("y")).otherwise(F.col("mean_y")).alias("y"),
    )
    pick = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    placed = moved.groupBy("page_id", "seg_id").agg(
        pick("x", 0).alias("x1"), pick("y", 0).alias("y1"), pick("x", 1).alias("x2"), pick("y", 1).alias("y2")
    )
    return segments.drop(*ENDS).join(placed, ["page_id", "seg_id"])


# -------------------------------------------------------------- break symbols
def nearest_segments(segments: DataFrame, centres: DataFrame, radius: float = BREAK_RADIUS_PX) -> DataFrame:
    """The two segments closest to each break centre, where both are within ``radius``.

    Segments are sampled every four radii; a centre within reach of a segment is in
    the cell of one of its samples or next to it.  Cells are told apart inside the row,
    so a segment travels once per cell.
    """
    step = 4.0 * radius
    samples = F.sequence(F.lit(0), F.ceil(geo.length(*ends()) / step).cast("int"))

    def at(i: Column) -> Column:
        along = F.least(i * step / F.greatest(geo.length(*ends()), F.lit(1e-9)), F.lit(1.0))
        place = lambda low, high: cell(F.col(low) + along * (F.col(high) - F.col(low)), step)
        return F.struct(place("x1", "x2").alias("cx"), place("y1", "y2").alias("cy"))

    cells = F.array_distinct(F.transform(samples, at))
    # Equal rows count once; the exchange by cells serves this and the join.
    filed = segments.select("page_id", "seg_id", *ENDS, F.inline(cells)).repartition("page_id", "cx", "cy").distinct()
    asked = spread(
        centres.select("page_id", "break_id", F.col("x").alias("bx"), F.col("y").alias("by")).withColumns(
            {"cx": cell("bx", step), "cy": cell("by", step)}
        ),
        "cx",
        "cy",
    )
    dist = geo.segment_distance(F.col("bx"), F.col("by"), *ends())
    met = filed.join(asked, ["page_id", "cx", "cy"]).withColumn("dist", dist).where(F.col("dist") <= radius)
    # A cell lists a segment once, so the closest two are among the closest two of a cell:
    # at most 18 rows a break leave the cells, which the join has already brought together.
    close = first_per_key(met, ["page_id", "cx", "cy", "break_id"], F.asc("dist"), F.asc("seg_id"), count=2)
    found = close.groupBy("page_id", "break_id", "seg_id").agg(F.first("dist").alias("dist"))
    two = first_per_key(found, ["page_id", "break_id"], F.asc("dist"), F.asc("seg_id"), count=2)
    return (
        two.groupBy("page_id", "break_id")
        .agg(
            F.min(F.struct("dist", "seg_id")).alias("near"), F.max(F.struct("dist", "seg_id")).alias("far"), F.count("*").alias("n")
        )
        .where(F.col("n") == 2)
        .select(
            "page_id",
            "break_id",
            F.col("near.seg_id").alias("seg_a"),
            F.col("far.seg_id").alias("seg_b"),
            F.col("near.dist").alias("dist_a"),
            F.col("far.dist").alias("dist_b"),
        )
    )


def align_breaks(segments: DataFrame, centres: DataFrame, radius: float = BREAK_RADIUS_PX) -> DataFrame:
    """Turn the two segments next to each break into the direction of the longer one.

    Breaks apply in id order.  Each round applies all breaks that are first in line
    for both their segments, so independent breaks run together.  Only segments next to a
    break take part in the rounds; one join at the end brings them back to the others.
    """
    waiting = settle(nearest_segments(segments, centres, radius).select("page_id", "break_id", "seg_a", "seg_b"))
    involved = waiting.select("page_id", F.explode(F.array("seg_a", "seg_b")).alias("seg_id")).distinct()
    current = settle(segments.select("page_id", "seg_id", *ENDS).join(involved, ["page_id", "seg_id"], "left_semi"))
    while not waiting.isEmpty():
        touched = waiting.select("page_id", "break_id", F.explode(F.array("seg_a", "seg_b")).alias("seg_id"))
        turn = touched.groupBy("page_id", "seg_id").agg(F.min("break_id").alias("break_id"))
        ready = turn.groupBy("page_id", "break_id").agg(F.count("*").alias("n")).where(F.col("n") == 2)
        now = waiting.join(ready.select("page_id", "break_id"), ["page_id", "break_id"])
        shape = F.struct(*ENDS, geo.length(*ends()).alias("len"))
        lookup = current.select("page_id", "seg_id", shape.alias("g"))
        pairs = now.join(
            lookup.select("page_id", F.col("seg_id").alias("seg_a"), F.col("g").alias("ga")), ["page_id", "seg_a"]
        ).join(lookup.select("page_id", F.col("seg_id").alias("seg_b"), F.col("g").alias("gb")), ["page_id", "seg_b"])
        lead = F.when(F.col("ga.len") >= F.col("gb.len"), F.col("ga")).otherwise(F.col("gb"))
        turned = (
            pairs.withColumn("lead", lead)
            .select(
                "page_id",
                "lead",
                F.inline(
                    F.array(
                        F.struct(F.col("seg_a").alias("seg_id"), F.col("ga").alias("g")),
                        F.struct(F.col("seg_b").alias("seg_id"), F.col("gb").alias("g")),
                    )
                ),
            )
            .withColumn("_l", F.when(F.col("lead.len") == 0, 1.0).otherwise(F.col("lead.len")))
        )
        ux = (F.col("lead.x2") - F.col("lead.x1")) / F.col("_l") * F.col("g.len") / 2.0
        uy = (F.col("lead.y2") - F.col("lead.y1")) / F.col("_l") * F.col("g.len") / 2.0
        mx, my = (F.col("g.x1") + F.col("g.x2")) / 2.0, (F.col("g.y1") + F.col("g.y2")) / 2.0
        placed = turned.select(
            "page_id",
            "seg_id",
            F.struct((mx - ux).alias("x1"), (my - uy).alias("y1"), (mx + ux).alias("x2"), (my + uy).alias("y2")).alias("_t"),
        )
        joined = current.join(placed, ["page_id", "seg_id"], "left")
        current = settle(joined.withColumns({c: F.coalesce(F.col(f"_t.{c}"), F.col(c)) for c in ENDS}).drop("_t"))
        waiting = settle(waiting.join(ready.select("page_id", "break_id"), ["page_id", "break_id"], "left_anti"))
    final = current.select("page_id", "seg_id", F.struct(*ENDS).alias("_t"))
    back = segments.join(final, ["page_id", "seg_id"], "left")
    return back.withColumns({c: F.coalesce(F.col(f"_t.{c}"), F.col(c)) for c in ENDS}).drop("_t")


def rotate_points(ink: DataFrame, turns: DataFrame) -> DataFrame:
    """Turn ink pixels about the page centre onto the nearest pixel.

    ``turns``: page_id, angle_deg, width, height; each page has its own angle and size, and
    pages that are not listed stay as they are.
    """
    joined = ink.join(turns.select("page_id", "angle_deg", "width", "height"), "page_id", "left")
    turned = geo.rotate_about(
        F.col("x").cast("double"), F.col("y").cast("double"), F.col("width") / 2.0, F.col("height") / 2.0, F.col("angle_deg")
    )
    nearest = lambda c: F.coalesce(F.bround(f"_p.{c}", 0).cast("int"), c).alias(c)
    return joined.withColumn("_p", turned).select("page_id", nearest("x"), nearest("y")).distinct()
