"""Decision columns: page scale, quality warnings, routing, review, export names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
A4_WIDTH_INCH = 8.27
DPI_MIN, DPI_MAX = 72, 600
MM_PER_INCH = 25.4
PREVIEW_MAX_SIDE = 1600

CONTRAST_FULL_SCALE = 80.0
NOISE_FULL_SCALE = 1500.0
LOW_CONTRAST = 0.25
NOISY = 0.15
ALMOST_BLANK = 0.005
ALMOST_SOLID = 0.8
HIGH_SKEW_DEG = 5

SPEC_TEXT_DENSITY = 0.45
SPEC_GRID_CELLS = 18
DETAIL_TEXT_DENSITY = 0.15
DETAIL_GRID_CELLS = 4

IOU_WARN_BELOW = 0.85
CHAMFER_WARN_ABOVE = 6.0
HAUSDORFF_WARN_ABOVE = 12.0
LOW_CONFIDENCE_WARN_COUNT = 5

LOW_CONFIDENCE = 0.55  # counting weak primitives
EXPORT_LOW_CONFIDENCE = 0.5  # moving a primitive to the review layer
LOW_CONFIDENCE_LAYER = "90_QA_LOW_CONFIDENCE"
# ---------------------------------------------------------- end of fixed values


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def event_key(page_id: Column, file_id: Column, batch_id: Column, event_id: Column) -> Column:
    """Partition key of an envelope; an empty id counts as missing."""
    blank = F.lit("")
    return F.coalesce(F.nullif(page_id, blank), F.nullif(file_id, blank), F.nullif(batch_id, blank), event_id)


def estimated_dpi(width_px: Column) -> Column:
    return F.bround(clip(width_px / F.lit(A4_WIDTH_INCH), float(DPI_MIN), float(DPI_MAX)), 0).cast("int")


def px_per_mm(dpi: Column) -> Column:
    return F.when(dpi != 0, dpi / F.lit(MM_PER_INCH))


def preview_scale(width: Column, height: Column, max_side: int = PREVIEW_MAX_SIDE) -> Column:
    return F.least(F.lit(1.0), F.lit(float(max_side)) / F.greatest(width, height))


def quality_warnings(contrast: Column, noise: Column, fg_ratio: Column, skew_deg: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(contrast < LOW_CONTRAST, "low_contrast"),
            F.when(noise < NOISY, "noisy_or_blurred"),
            F.when(fg_ratio < ALMOST_BLANK, "almost_blank_page"),
            F.when(fg_ratio > ALMOST_SOLID, "almost_solid_page"),
            F.when(F.abs(skew_deg) > HIGH_SKEW_DEG, "high_skew"),
        )
    )


def route_page(contrast: Column, fg_ratio: Column, density: Column, cells: Column) -> Column:
    """``struct<page_type, confidence, reason>`` by rule; null inputs mean no decodable pixels."""

    def verdict(kind: str, confidence: Column, reason: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("page_type"), confidence.cast("double").alias("confidence"), reason.alias("reason")
        )

    shown = F.format_string("%.2f", density)
    return (
        F.when(fg_ratio.isNull(), verdict("unknown", F.lit(0.0), F.lit("empty_image")))
        .when(
            (contrast < LOW_CONTRAST) & (fg_ratio < ALMOST_BLANK),
            verdict("bad_scan", F.lit(0.85), F.lit("low_contrast_blank")),
        )
        .when(fg_ratio > ALMOST_SOLID, verdict("bad_scan", F.lit(0.7), F.lit("almost_solid_page")))
        .when(
            (density >= SPEC_TEXT_DENSITY) & (cells >= SPEC_GRID_CELLS),
            verdict(
                "specification_sheet",
                F.least(F.lit(0.95), F.lit(0.5) + F.lit(0.5) * density),
                F.concat(
                    F.lit("high_text_density_with_grid:density="), shown, F.lit(",cells="), cells.cast("string")
                ),
            ),
        )
        .when(
            (density < DETAIL_TEXT_DENSITY) & (cells < DETAIL_GRID_CELLS),
            verdict(
                "detail_drawing",
                F.least(F.lit(0.85), F.lit(0.55) + F.lit(0.5) * (F.lit(1.0) - density)),
                F.concat(F.lit("low_text_density:density="), shown),
            ),
        )
        .otherwise(
            verdict(
                "unknown",
                F.lit(0.4),
                F.concat(F.lit("ambiguous:density="), shown, F.lit(",cells="), cells.cast("string")),
            )
        )
    )


def finite_or_zero(metric: Column) -> Column:
    """Missing, NaN and infinite distances count as 0 in the review rule."""
    return F.when(F.isnan(metric) | (F.abs(metric) == float("inf")), 0.0).otherwise(F.coalesce(metric, F.lit(0.0)))


def review_required(
    iou: Column,
    chamfer: Column,
    hausdorff: Column,
    low_confidence_count: Column,
    page_type: Column,
    *,
    iou_below: float = IOU_WARN_BELOW,
    chamfer_above: float = CHAMFER_WARN_ABOVE,
    hausdorff_above: float = HAUSDORFF_WARN_ABOVE,
    low_count: int = LOW_CONFIDENCE_WARN_COUNT,
) -> Column:
    """``struct<review, codes, warnings>``: codes are stable, warnings carry numbers."""
    iou, chamfer, hausdorff = finite_or_zero(iou), finite_or_zero(chamfer), finite_or_zero(hausdorff)
    page_type = F.coalesce(F.nullif(page_type, F.lit("")), F.lit("unknown"))
    checks = [
        (iou < iou_below, "low_raster_iou", F.format_string("low_raster_iou:%.2f", iou)),
        (chamfer > chamfer_above, "high_chamfer", F.format_string("high_chamfer:%.2fpx", chamfer)),
        (hausdorff > hausdorff_above, "high_hausdorff", F.format_string("high_hausdorff:%.2fpx", hausdorff)),
        (
            low_confidence_count >= low_count,
            "low_confidence_primitives",
            F.concat(F.lit("low_confidence_primitives:"), low_confidence_count.cast("string")),
        ),
        (page_type == "unknown", "page_type_unknown", F.lit("page_type_unknown")),
    ]
    codes = F.array_compact(F.array(*[F.when(test, code) for test, code, _ in checks]))
    shown = F.array_compact(F.array(*[F.when(test, text) for test, _, text in checks]))
    return F.struct((F.size(codes) > 0).alias("review"), codes.alias("codes"), shown.alias("warnings"))


def weak(confidence: Column) -> Column:
    """Weak primitive test: a missing or zero confidence counts as full confidence."""
    return F.coalesce(F.nullif(confidence, F.lit(0.0)), F.lit(1.0)) < LOW_CONFIDENCE


def confidence_from_rms(rms: Column) -> Column:
    return F.when(rms.isNull() | (rms <= 0), 0.85).otherwise(clip(F.lit(1.0) - rms / F.lit(6.0), 0.05, 0.99))


def export_layer(layer: Column, confidence: Column) -> Column:
    from draftlake.schemas import DEFAULT_LAYER

    return F.when(confidence < EXPORT_LOW_CONFIDENCE, LOW_CONFIDENCE_LAYER).otherwise(
        F.coalesce(layer, F.lit(DEFAULT_LAYER))
    )


def member_name(page_index: Column, original_name: Column) -> Column:
    safe = F.translate(F.coalesce(original_name, F.lit("")), "/\\", "__")
    safe = F.when(safe == "", "page").otherwise(safe)
    return F.format_string("page_%03d_%s.dxf", F.coalesce(page_index, F.lit(0)), safe)


def status_class(status: Column) -> Column:
    return (
        F.when(status >= 500, "5xx")
        .when(status >= 400, "4xx")
        .when(status >= 300, "3xx")
        .when(status >= 200, "2xx")
        .otherwise("1xx")
    )
