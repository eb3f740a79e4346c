"""Explicit schemas and small fixed dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CORRUPT = "_corrupt"

# ---------------------------------------------------------------- fixed values
# Names, orders and thresholds below are part of the data contract.

TOPICS = [
    "file.uploaded",
    "archive.extracted",
    "page.extracted",
    "page.preprocessed",
    "page.routed",
    "page.discarded_specification",
    "page.segmentation.requested",
    "page.segmentation.done",
    "page.ocr.requested",
    "page.ocr.done",
    "page.geometry.requested",
    "page.geometry.done",
    "page.qa.requested",
    "page.qa.done",
    "page.review.required",
    "page.review.accepted",
    "page.export.requested",
    "page.export.done",
    "page.failed",
    "deadletter",
]

# consumer, topic, ids the handler insists on
CONSUMERS = [
    ("ingest_worker", "file.uploaded", "file_id,artifact_uri"),
    ("ingest_worker", "archive.extracted", "file_id,artifact_uri"),
    ("preprocess_service", "page.extracted", "page_id"),
    ("ocr_service", "page.ocr.requested", "page_id"),
    ("geometry_service", "page.geometry.requested", "page_id"),
    ("qa_service", "page.qa.requested", "page_id"),
    ("dxf_export_service", "page.export.requested", "page_id"),
]
PROGRESS_CONSUMER = "api_progress"

# name, colour index, role, line type
LAYERS = [
    ("00_FRAME", 8, "frame", "CONTINUOUS"),
    ("01_TITLE_BLOCK", 8, "titleblock", "CONTINUOUS"),
    ("02_PART_VISIBLE", 7, "geometry", "CONTINUOUS"),
    ("03_PART_HIDDEN", 5, "hidden", "DASHED"),
    ("04_CENTER_AXIS", 1, "centerline", "CENTER"),
    ("05_DIM_LINES", 3, "dimension", "CONTINUOUS"),
    ("06_DIM_TEXT", 3, "dimension_text", "CONTINUOUS"),
    ("07_TEXT_NOTES", 7, "text", "CONTINUOUS"),
    ("08_HATCH", 2, "hatch", "CONTINUOUS"),
    ("09_BREAK_SYMBOLS", 4, "break_symbol", "CONTINUOUS"),
    ("10_TABLES_ON_DRAWING", 8, "tables", "CONTINUOUS"),
    ("90_QA_LOW_CONFIDENCE", 6, "qa", "CONTINUOUS"),
    ("99_RASTER_REFERENCE", 9, "raster", "CONTINUOUS"),
]
DEFAULT_LAYER = "02_PART_VISIBLE"

MASK_CLASSES = [
    "visible_geometry",
    "hidden_geometry",
    "centerline",
    "dimension_graphics",
    "text",
    "hatch",
    "break_symbol",
    "frame_titleblock",
    "stamp_signature",
    "noise",
]

BATCH_STATUSES = ["created", "processing", "ready", "failed"]
FILE_STATUSES = ["uploaded", "extracting", "extracted", "failed"]
PAGE_STATUSES = [
    "created",
    "extracted",
    "preprocessed",
    "routed",
    "segmented",
    "ocr_done",
    "geometry_done",
    "qa_done",
    "review_required",
    "reviewed",
    "exported",
    "skipped",
    "failed",
]
PAGE_TYPES = ["detail_drawing", "assembly_drawing", "specification_sheet", "bad_scan", "unknown"]
ARTIFACT_KINDS = [
    "raw",
    "normalized",
    "binary",
    "preview",
    "mask_visible_geometry",
    "mask_hidden_geometry",
    "mask_centerline",
    "mask_dimension_graphics",
    "mask_text",
    "mask_hatch",
    "mask_break_symbol",
    "mask_frame_titleblock",
    "mask_noise",
    "ocr_blocks",
    "cad_json",
    "dxf",
    "qa_overlay",
    "qa_heatmap",
    "export_zip",
    "skipped_specification",
]
# ---------------------------------------------------------- end of fixed values


# Schemas are DDL strings: readers and from_json take them as they are.
ENVELOPE_FIELDS = [
    "event_id",
    "event_type",
    "batch_id",
    "file_id",
    "page_id",
    "artifact_uri",
    "attempt",
    "created_at",
    "payload",
]
ENVELOPE = ", ".join(f"{name} {'int' if name == 'attempt' else 'string'}" for name in ENVELOPE_FIELDS)
ENVELOPE_PARSE = f"{ENVELOPE}, {CORRUPT} string"

BBOX = "struct<x1:double,y1:double,x2:double,y2:double>"
PARSED_DIMENSION = (
    "kind string, value double, unit string, tolerance string, "
    "extra struct<count:int,angle_deg:double,pitch:double,thread_designator:string>, raw string"
)

_PRIMITIVE = (
    "struct<id:string,type:string,layer:string,confidence:double,"
    "fit:struct<method:string,rms_px:double,inliers:int>,source_pixels:int,warnings:array<string>,"
    "p1:array<double>,p2:array<double>,center:array<double>,radius:double,"
    "start_angle_deg:double,end_angle_deg:double,vertices:array<array<double>>,closed:boolean,"
    "text:string,position:array<double>,height:double,rotation_deg:double>"
)
CAD_DOCUMENT = (
    "schema_version string, "
    "document struct<batch_id:string,file_id:string,page_id:string,units:string,dpi:int,"
    "px_per_mm:double,page_type:string,image_size_px:array<int>>, "
    "layers array<struct<name:string,role:string,color:int>>, "
    f"primitives array<{_PRIMITIVE}>, "
    "ocr array<struct<id:string,text:string,bbox_px:array<double>,rotation_deg:double,"
    "confidence:double,kind:string,parsed:string>>, "
    "dimensions array<struct<id:string,kind:string,value:double,unit:string,tolerance:string,"
    "anchor_px:array<double>,raw_text:string>>, "
    "constraints array<struct<kind:string,primitives:array<string>>>, "
    "qa struct<requires_review:boolean,warnings:array<string>,raster_iou:double,"
    "chamfer_px:double,hausdorff_px:double>"
)

_STAMPS = "created_at timestamp"
CATALOGUE = {
    "users": (f"id string, email string, display_name string, role string, {_STAMPS}"),
    "batches": (
        f"id string, name string, status string, created_by string, metadata string, {_STAMPS}, updated_at timestamp"
    ),
    "files": (
        "id string, batch_id string, original_name string, mime_type string, size_bytes long, "
        f"storage_uri string, status string, error string, metadata string, {_STAMPS}, updated_at timestamp"
    ),
    "pages": (
        "id string, batch_id string, file_id string, page_index int, page_type string, status string, "
        "width_px int, height_px int, dpi int, raw_image_uri string, normalized_image_uri string, "
        f"preview_uri string, skip_reason string, confidence double, metadata string, {_STAMPS}, updated_at timestamp"
    ),
    "artifacts": (
        "id string, batch_id string, page_id string, kind string, uri string, mime_type string, "
        f"metadata string, {_STAMPS}"
    ),
    "jobs": (
        "id string, batch_id string, page_id string, stage string, status string, attempt int, "
        f"error string, payload string, {_STAMPS}, updated_at timestamp"
    ),
    "job_events": (
        f"id string, job_id string, batch_id string, page_id string, event_type string, payload string, {_STAMPS}"
    ),
    "page_classifications": (
        f"id string, page_id string, page_type string, confidence double, reason string, model_version string, {_STAMPS}"
    ),
    "ocr_blocks": (
        "id string, page_id string, text string, bbox_px string, rotation double, confidence double, "
        f"kind string, parsed string, {_STAMPS}"
    ),
    "cad_primitives": (
        "id string, page_id string, primitive_id string, type string, layer string, geometry string, "
        f"confidence double, fit string, {_STAMPS}"
    ),
    "cad_constraints": (f"id string, page_id string, kind string, primitives string, {_STAMPS}"),
    "qa_metrics": (
        "id string, page_id string, chamfer_px double, hausdorff_px double, raster_iou double, "
        f"requires_review boolean, warnings string, metadata string, {_STAMPS}"
    ),
    "review_sessions": (
        f"id string, page_id string, user_id string, status string, note string, {_STAMPS}, updated_at timestamp"
    ),
    "review_edits": (
        f"id string, session_id string, page_id string, operation string, payload string, {_STAMPS}"
    ),
    "exports": (
        "id string, batch_id string, page_id string, format string, uri string, status string, "
        f"error string, metadata string, {_STAMPS}, updated_at timestamp"
    ),
    "model_versions": (
        f"id string, role string, name string, version string, weights_uri string, metadata string, enabled boolean, {_STAMPS}"
    ),
}


def _local(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A fixed table as a local relation (no Python task behind it)."""
    literal = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    values = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def layer_table(spark: SparkSession) -> DataFrame:
    """The 13-row layer catalogue (fixed size, safe to broadcast)."""
    return _local(spark, LAYERS, "layer, color, role, linetype")


def consumer_table(spark: SparkSession) -> DataFrame:
    """Topic subscriptions (fixed size, safe to broadcast)."""
    return _local(spark, CONSUMERS, "consumer, topic, required")


def topic_table(spark: SparkSession) -> DataFrame:
    return _local(spark, [(t,) for t in TOPICS], "topic")
