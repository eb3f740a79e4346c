"""Operators on recognised text blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.functions import text as tx
from draftlake.operators.fence import fence


def with_dimension(df: DataFrame, column: str = "text", alias: str = "dimension", when: Column | None = None) -> DataFrame:
    """Add the parsed dimension struct (an ``unknown`` reading where ``when`` is false).

    Normalising and rule matching are separate fenced steps, so the ten patterns
    run once per row and only the winning pattern's groups are extracted.
    """
    source = F.coalesce(F.col(column), F.lit(""))
    norm, rule = tx.normalize_dim(source), tx.dimension_rule(F.col("_norm"))
    if when is not None:
        norm, rule = F.when(when, norm).otherwise(""), F.when(when, rule).otherwise(0)
    stepped = fence(fence(df, {"_norm": norm}), {"_rule": rule})
    parsed = tx.dimension_fields(F.col("_rule"), F.col("_norm"), F.col(column))
    return fence(stepped, {alias: parsed}).drop("_norm", "_rule")


def enrich_ocr(blocks: DataFrame) -> DataFrame:
    """Parse blocks that read like dimensions, and notes in title blocks.

    A non-empty ``parsed`` column that came with the block is kept as it is.
    """
    text = F.col("text")
    given = F.col("parsed").isNotNull() if "parsed" in blocks.columns else F.lit(False)
    is_dimension = ~given & ((F.col("kind") == "dimension_text") | tx.looks_like_dimension(text))
    is_notes = ~given & ~is_dimension & (F.col("kind") == "titleblock_text")
    marked = blocks.withColumns({"_dim": is_dimension, "_notes": is_notes})
    parsed = with_dimension(marked, when=F.col("_dim"))
    return parsed.withColumns(
        {
            "kind": F.when(F.col("_dim") & (F.col("kind") == "unknown"), "dimension_text").otherwise(F.col("kind")),
            "dimension": F.when(F.col("_dim"), F.col("dimension")),
            "notes": F.when(F.col("_notes"), tx.parse_notes(text)),
            "rotation_deg": F.coalesce(F.col("rotation_deg"), F.lit(0.0))
            if "rotation_deg" in blocks.columns
            else F.lit(0.0),
            "confidence": F.coalesce(F.col("confidence"), F.lit(0.0)),
            **{c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("x1", "y1", "x2", "y2")},
        }
    ).drop("_dim", "_notes")


def dimensions(enriched: DataFrame) -> DataFrame:
    """Recognised dimensions with their anchor point."""
    found = F.col("dimension.kind").isNotNull() & (F.col("dimension.kind") != "unknown")
    return enriched.where(found).select(
        "page_id",
        "block_id",
        F.col("dimension.kind").alias("kind"),
        F.col("dimension.value").alias("value"),
        F.coalesce("dimension.unit", F.lit("mm")).alias("unit"),
        F.col("dimension.tolerance").alias("tolerance"),
        F.col("x1").alias("anchor_x"),
        F.col("y1").alias("anchor_y"),
        F.col("text").alias("raw_text"),
    )


def attach_ocr(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pages with their block counts; pages whose text is not ready keep nulls."""
    per_page = blocks.groupBy("page_id").agg(
        F.count("*").alias("blocks"), F.count_if(F.col("kind") == "titleblock_text").alias("titleblocks")
    )
    return pages.join(per_page, "page_id", "left")
