"""Plane geometry on double columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
SNAP_ANGLES_DEG = (0.0, 45.0, 90.0, 135.0)
SNAP_TOLERANCE_DEG = 1.5
# ---------------------------------------------------------- end of fixed values


def length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def folded_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Direction in degrees, modulo 180."""
    return F.pmod(F.degrees(F.atan2(y2 - y1, x2 - x1)), F.lit(180.0))


def angle_gap(a: Column, b: Column) -> Column:
    """Smallest difference of two folded directions."""
    return F.least(F.abs(a - b), F.lit(180.0) - F.abs(a - b))


def line_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point to the infinite line; null for a degenerate line."""
    run = length(x1, y1, x2, y2)
    cross = (px - x1) * (y2 - y1) - (py - y1) * (x2 - x1)
    return F.when(run >= 1e-9, F.abs(cross) / run)


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point to a closed segment."""
    dx, dy = x2 - x1, y2 - y1
    squared = dx * dx + dy * dy
    along = ((px - x1) * dx + (py - y1) * dy) / F.when(squared < 1e-9, 1.0).otherwise(squared)
    along = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    return length(px, py, x1 + along * dx, y1 + along * dy)


def snap_segment(
    x1: Column,
    y1: Column,
    x2: Column,
    y2: Column,
    angles: Sequence[float] = SNAP_ANGLES_DEG,
    tolerance: float = SNAP_TOLERANCE_DEG,
) -> Column:
    """``struct<x1,y1,x2,y2,snapped>``: rotate about the midpoint onto a near standard direction."""
    angle = folded_angle(x1, y1, x2, y2)
    ranked = [F.struct(angle_gap(angle, F.lit(a)).alias("gap"), F.lit(a).alias("target")) for a in angles]
    best = F.array_min(F.array(*ranked))
    half = length(x1, y1, x2, y2) / 2.0
    cx, cy = (x1 + x2) / 2.0, (y1 + y2) / 2.0
    ux, uy = F.cos(F.radians(best["target"])) * half, F.sin(F.radians(best["target"])) * half
    hit = (F.abs(x2 - x1) + F.abs(y2 - y1) >= 1e-6) & (best["gap"] <= tolerance)
    moved = [("x1", cx - ux, x1), ("y1", cy - uy, y1), ("x2", cx + ux, x2), ("y2", cy + uy, y2)]
    return F.struct(*[F.when(hit, new).otherwise(old).alias(name) for name, new, old in moved], hit.alias("snapped"))


def to_mm_x(x: Column, ppm: Column) -> Column:
    return x / _scale(ppm)


def to_mm_y(y: Column, page_height: Column, ppm: Column) -> Column:
    """Millimetres with the axis pointing up."""
    return (F.coalesce(page_height.cast("double"), F.lit(0.0)) - y) / _scale(ppm)


def _scale(ppm: Column) -> Column:
    return F.coalesce(F.nullif(ppm, F.lit(0.0)), F.lit(1.0))


def flip_arc(start_deg: Column, end_deg: Column) -> Column:
    """Arc ends after the vertical flip: both negated, swapped, folded into [0, 360)."""
    turn = F.lit(360.0)
    start, end = F.coalesce(start_deg, F.lit(0.0)), F.coalesce(end_deg, turn)
    return F.struct(F.pmod(-end, turn).alias("start_deg"), F.pmod(-start, turn).alias("end_deg"))


def rotate_about(x: Column, y: Column, cx: Column, cy: Column, angle_deg: Column) -> Column:
    """``struct<x,y>`` (doubles) after turning by an angle in image coordinates (y down)."""
    cos, sin = F.cos(F.radians(angle_deg)), F.sin(F.radians(angle_deg))
    return F.struct(
        ((x - cx) * cos + (y - cy) * sin + cx).alias("x"),
        ((y - cy) * cos - (x - cx) * sin + cy).alias("y"),
    )
