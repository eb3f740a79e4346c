"""Catalogue queries: filters, patches, joins, newest rows, listings, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.functions import rules
from draftlake.operators import catalog
from draftlake.plans.fixtures import Source, oracle_with
from draftlake.plans.registry import joined, query, r6

LATEST_QA = """
latest_qa AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY created_at DESC, qa_id DESC) AS rn
  FROM qa_metrics) t WHERE rn = 1)"""


@query(
    "flagship_review_by_batch",
    oracle_with("qa_metrics", "pages_meta", body="")
    + ","
    + LATEST_QA
    + """
SELECT p.batch_id, p.page_type, COUNT(*) AS pages,
       CAST(SUM(CASE WHEN q.raster_iou < 0.85 OR q.chamfer_px > 6 OR q.hausdorff_px > 12 OR q.low_confidence_count >= 5
                     OR p.page_type = 'unknown' THEN 1 ELSE 0 END) AS BIGINT) AS need_review,
       ROUND(AVG(q.raster_iou), 6) AS avg_iou
FROM latest_qa q JOIN pages_meta p ON p.page_id = q.page_id GROUP BY p.batch_id, p.page_type""",
)
def flagship(src: Source) -> DataFrame:
    return catalog.pages_needing_review(src["pages_meta"], src["qa_metrics"])


@query(
    "p7_filter_pages",
    oracle_with(
        "pages_meta",
        body="""
SELECT 'all' AS tab, page_id FROM pages_meta
UNION ALL SELECT 'drawings', page_id FROM pages_meta WHERE page_type IN ('detail_drawing', 'assembly_drawing')
UNION ALL SELECT 'specs', page_id FROM pages_meta WHERE page_type = 'specification_sheet' OR status = 'skipped'
UNION ALL SELECT 'review', page_id FROM pages_meta WHERE status = 'review_required'
UNION ALL SELECT 'exported', page_id FROM pages_meta WHERE status = 'exported'
UNION ALL SELECT 'failed', page_id FROM pages_meta WHERE status = 'failed'""",
    ),
)
def p7(src: Source) -> DataFrame:
    # One scan: each page lists the tabs it shows on.
    tabs = ["all", "drawings", "specs", "review", "exported", "failed"]
    shown = F.array_compact(F.array(*[F.when(catalog.page_filter(t), t) for t in tabs]))
    return src["pages_meta"].select(F.explode(shown).alias("tab"), "page_id")


@query(
    "p8_exportable",
    oracle_with(
        "pages_meta",
        body="""
SELECT page_id, page_type, status, (page_type = 'specification_sheet' OR status = 'skipped') AS hidden
FROM pages_meta WHERE page_type <> 'specification_sheet'""",
    ),
)
def p8(src: Source) -> DataFrame:
    return catalog.exportable(src["pages_meta"]).select(
        "page_id", "page_type", "status", catalog.hidden_on_card().alias("hidden")
    )


_PATCH = """
patch AS (SELECT page_id, CAST(MAX(artifact_id % 3) * 800 AS INT) AS new_width, CAST(MAX(artifact_id % 2) * 900 AS INT) AS new_height,
  CAST(MIN(artifact_id % 7) + 100 AS INT) AS new_dpi, 'preprocessed' AS new_status,
  CASE WHEN MIN(artifact_id) % 3 = 0 THEN '' ELSE 'manual' END AS new_skip_reason, MAX(created_at) AS patched_at
  FROM artifacts WHERE kind = 'normalized' GROUP BY page_id)"""


@query(
    "p9_apply_patch",
    oracle_with("pages_meta", "artifacts", body="")
    + ","
    + _PATCH
    + """
SELECT b.page_id, COALESCE(NULLIF(p.new_width, 0), b.width_px) AS width_px, COALESCE(NULLIF(p.new_height, 0), b.height_px) AS height_px,
       COALESCE(b.dpi, p.new_dpi) AS dpi, COALESCE(p.new_status, b.status) AS status,
       CASE WHEN p.page_id IS NOT NULL THEN NULLIF(p.new_skip_reason, '') END AS skip_reason, COALESCE(p.patched_at, b.created_at) AS updated_at
FROM pages_meta b LEFT JOIN patch p ON p.page_id = b.page_id""",
)
def p9(src: Source) -> DataFrame:
    normalized = src["artifacts"].where(F.col("kind") == "normalized")
    patch = normalized.groupBy("page_id").agg(
        (F.max(F.col("artifact_id") % 3) * 800).cast("int").alias("new_width"),
        (F.max(F.col("artifact_id") % 2) * 900).cast("int").alias("new_height"),
        (F.min(F.col("artifact_id") % 7) + 100).cast("int").alias("new_dpi"),
        F.lit("preprocessed").alias("new_status"),
        F.when(F.min("artifact_id") % 3 == 0, "").otherwise("manual").alias("new_skip_reason"),
        F.max("created_at").alias("patched_at"),
    )
    return catalog.apply_patch(src["pages_meta"], patch).select(
        "page_id", "width_px", "height_px", "dpi", "status", "skip_reason", "updated_at"
    )


@query(
    "p10_merge_meta",
    oracle_with(
        "pages_meta",
        body="""
SELECT page_id, page_id AS k_dummy, json_extract_string(m, '$.k') AS k, json_extract_string(m, '$.dpi') AS dpi, json_extract_string(m, '$.q.w') AS w
FROM (SELECT page_id, json_merge_patch(CASE WHEN dpi IS NULL THEN '{}' ELSE metadata END,
        '{"dpi":' || CAST(COALESCE(dpi, 0) AS VARCHAR) || ',"q":{"w":' || CAST(COALESCE(width_px, -1) AS VARCHAR) || '}}') AS m FROM pages_meta) t""",
    ),
)
def p10(src: Source) -> DataFrame:
    new = F.to_json(
        F.struct(
            F.coalesce("dpi", F.lit(0)).alias("dpi"), F.struct(F.coalesce("width_px", F.lit(-1)).alias("w")).alias("q")
        )
    )
    merged = catalog.merge_meta(F.when(F.col("dpi").isNotNull(), F.col("metadata")), new)
    return src["pages_meta"].withColumn("m", merged).select(
        "page_id",
        F.col("page_id").alias("k_dummy"),
        F.get_json_object("m", "$.k").alias("k"),
        F.get_json_object("m", "$.dpi").alias("dpi"),
        F.get_json_object("m", "$.q.w").alias("w"),
    )


@query(
    "p11_page_scale",
    """
SELECT o_orderkey, CAST(ROUND_EVEN(LEAST(GREATEST(w / 8.27, 72.0), 600.0), 0) AS INT) AS dpi,
       ROUND(CAST(ROUND_EVEN(LEAST(GREATEST(w / 8.27, 72.0), 600.0), 0) AS DOUBLE) / CAST(25.4 AS DOUBLE), 6) AS ppm,
       ROUND(LEAST(1.0, 1600.0 / GREATEST(w, h)), 6) AS preview
FROM (SELECT o_orderkey, CAST(100 + o_custkey * 7 % 6000 AS DOUBLE) AS w, CAST(100 + o_orderkey * 3 % 5000 AS DOUBLE) AS h FROM orders) t""",
)
def p11(src: Source) -> DataFrame:
    sized = src.raw("orders").select(
        "o_orderkey",
        (100 + F.col("o_custkey") * 7 % 6000).cast("double").alias("w"),
        (100 + F.col("o_orderkey") * 3 % 5000).cast("double").alias("h"),
    )
    dpi = rules.estimated_dpi(F.col("w"))
    return sized.select(
        "o_orderkey",
        dpi.alias("dpi"),
        r6(rules.px_per_mm(dpi)).alias("ppm"),
        r6(rules.preview_scale(F.col("w"), F.col("h"))).alias("preview"),
    )


@query(
    "p30_member_name",
    oracle_with(
        "files_meta",
        "pages_meta",
        body="""
SELECT p.page_id, 'page_' || LPAD(CAST(COALESCE(p.page_index, 0) AS VARCHAR), 3, '0') || '_' ||
       CASE WHEN COALESCE(f.original_name, '') = '' THEN 'page' ELSE REPLACE(REPLACE(f.original_name, '/', '_'), CHR(92), '_') END || '.dxf' AS member
FROM pages_meta p LEFT JOIN files_meta f ON f.file_id = p.file_id""",
    ),
)
def p30(src: Source) -> DataFrame:
    named = src["pages_meta"].join(src["files_meta"].select("file_id", "original_name"), "file_id", "left")
    return named.select("page_id", rules.member_name(F.col("page_index"), F.col("original_name")).alias("member"))


_MANIFEST = """
SELECT p.batch_id, a.page_id, a.artifact_id, a.uri, COALESCE(p.page_index, 0) AS page_index, COALESCE(f.original_name, '') AS name,
       'page_' || LPAD(CAST(COALESCE(p.page_index, 0) AS VARCHAR), 3, '0') || '_' ||
       CASE WHEN COALESCE(f.original_name, '') = '' THEN 'page' ELSE REPLACE(REPLACE(f.original_name, '/', '_'), CHR(92), '_') END || '.dxf' AS member
FROM {source} a LEFT JOIN pages_meta p ON p.page_id = a.page_id LEFT JOIN files_meta f ON f.file_id = p.file_id"""


@query(
    "j1_export_manifest",
    oracle_with(
        "artifacts",
        "pages_meta",
        "files_meta",
        body=_MANIFEST.format(
            source="(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY created_at DESC, artifact_id DESC) AS rn "
            "FROM artifacts WHERE kind = 'dxf') t WHERE rn = 1)"
        ),
    ),
)
def j1(src: Source) -> DataFrame:
    return catalog.export_manifest(src["artifacts"], src["pages_meta"], src["files_meta"])


@query(
    "j1_export_manifest_all",
    oracle_with(
        "artifacts", "pages_meta", "files_meta", body=_MANIFEST.format(source="(SELECT * FROM artifacts WHERE kind = 'dxf')")
    ),
)
def j1_all(src: Source) -> DataFrame:
    return catalog.export_manifest(src["artifacts"], src["pages_meta"], src["files_meta"], every=True)


@query(
    "j2_batch_detail",
    oracle_with(
        "batches_meta",
        "files_meta",
        "pages_meta",
        body="""
SELECT batch_id, 0 AS section_no, 'batch' AS section, batch_id AS item_id, name AS label, status, created_at FROM batches_meta
UNION ALL SELECT batch_id, 1, 'file', file_id, original_name, status, created_at FROM files_meta WHERE batch_id IN (SELECT batch_id FROM batches_meta)
UNION ALL SELECT batch_id, 2, 'page', page_id, page_type, status, created_at FROM pages_meta WHERE batch_id IN (SELECT batch_id FROM batches_meta)""",
    ),
)
def j2(src: Source) -> DataFrame:
    return catalog.batch_detail(src["batches_meta"], src["files_meta"], src["pages_meta"])


@query(
    "j4_require_batch",
    oracle_with(
        "files_meta",
        "batches_meta",
        body="SELECT file_id, batch_id, batch_id IN (SELECT batch_id FROM batches_meta WHERE status <> 'ready') AS accepted FROM files_meta",
    ),
)
def j4(src: Source) -> DataFrame:
    # Files of batches that are closed for uploads have no parent here.
    ok, bad = catalog.require_batch(src["files_meta"], src["batches_meta"].where("status <> 'ready'"))
    return (
        ok.select("file_id", "batch_id")
        .withColumn("accepted", F.lit(True))
        .unionByName(bad.select("file_id", "batch_id").withColumn("accepted", F.lit(False)))
    )


@query(
    "j5_append_new",
    oracle_with(
        "envelopes",
        body="""
, base AS (SELECT DISTINCT page_id, event_type AS stage FROM envelopes WHERE page_id IS NOT NULL AND attempt <= 2),
incoming AS (SELECT page_id, event_type AS stage FROM envelopes WHERE attempt > 2)
SELECT page_id, stage FROM base
UNION ALL SELECT DISTINCT page_id, stage FROM incoming i WHERE page_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.page_id = i.page_id AND b.stage = i.stage)
UNION ALL SELECT page_id, stage FROM incoming WHERE page_id IS NULL""",
    ),
)
def j5(src: Source) -> DataFrame:
    jobs = src["envelopes"].select("page_id", F.col("event_type").alias("stage"), "attempt")
    base = jobs.where((F.col("attempt") <= 2) & F.col("page_id").isNotNull()).select("page_id", "stage").distinct()
    return catalog.append_new(base, jobs.where(F.col("attempt") > 2).select("page_id", "stage"), ["page_id", "stage"])


@query(
    "j6_cascade_delete",
    oracle_with(
        "batches_meta",
        "files_meta",
        "pages_meta",
        "artifacts",
        body="""
, doomed AS (SELECT batch_id FROM batches_meta WHERE status = 'created')
SELECT 'batches' AS tab, batch_id AS id FROM batches_meta WHERE batch_id NOT IN (SELECT batch_id FROM doomed)
UNION ALL SELECT 'files', file_id FROM files_meta WHERE batch_id NOT IN (SELECT batch_id FROM doomed)
UNION ALL SELECT 'pages', page_id FROM pages_meta WHERE batch_id NOT IN (SELECT batch_id FROM doomed)
UNION ALL SELECT 'artifacts', CAST(artifact_id AS VARCHAR) FROM artifacts
  WHERE page_id NOT IN (SELECT page_id FROM pages_meta WHERE batch_id IN (SELECT batch_id FROM doomed))""",
    ),
)
def j6(src: Source) -> DataFrame:
    batches = src["batches_meta"]
    left = catalog.cascade_delete(
        batches.where(F.col("status") == "created"), batches, src["files_meta"], src["pages_meta"], src["artifacts"]
    )
    ids = {"batches": "batch_id", "files": "file_id", "pages": "page_id", "artifacts": "artifact_id"}
    parts = [
        df.select(F.lit(name).alias("tab"), F.col(ids[name]).cast("string").alias("id")) for name, df in left.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "w1_latest_artifact",
    oracle_with(
        "artifacts",
        body="""
SELECT artifact_id, page_id, kind, uri, created_at FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY page_id, kind
  ORDER BY created_at DESC, artifact_id DESC) AS rn FROM artifacts) t WHERE rn = 1""",
    ),
)
def w1(src: Source) -> DataFrame:
    return catalog.latest_artifact(src["artifacts"])


@query(
    "w2_latest_qa",
    oracle_with("qa_metrics", body="")
    + ","
    + LATEST_QA
    + " SELECT qa_id, page_id, raster_iou, chamfer_px, hausdorff_px, low_confidence_count, created_at FROM latest_qa",
)
def w2(src: Source) -> DataFrame:
    return catalog.latest_qa(src["qa_metrics"])


@query(
    "w3_page_index",
    oracle_with(
        "artifacts",
        body="""
SELECT page_id AS file_id, path, CAST(ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY path) - 1 AS BIGINT) AS page_index
FROM (SELECT page_id, 'page-' || LPAD(CAST(artifact_id AS VARCHAR), 9, '0') || '.png' AS path FROM artifacts) t""",
    ),
)
def w3(src: Source) -> DataFrame:
    rendered = src["artifacts"].select(
        F.col("page_id").alias("file_id"),
        F.concat(F.lit("page-"), F.lpad(F.col("artifact_id").cast("string"), 9, "0"), F.lit(".png")).alias("path"),
    )
    return catalog.page_index(rendered)


@query(
    "l1_list_batches",
    oracle_with("batches_meta", body="SELECT * FROM batches_meta ORDER BY created_at DESC, batch_id DESC LIMIT 50 OFFSET 2"),
)
def l1(src: Source) -> DataFrame:
    return catalog.list_batches(src["batches_meta"], limit=900, offset="2")


@query(
    "l2_children",
    oracle_with(
        "files_meta",
        "pages_meta",
        "artifacts",
        body="""
SELECT 'files' AS what, file_id AS id FROM files_meta WHERE batch_id = 'b3'
UNION ALL SELECT 'pages', page_id FROM pages_meta WHERE batch_id = 'b3'
UNION ALL SELECT 'artifacts', CAST(artifact_id AS VARCHAR) FROM artifacts WHERE page_id = 'p7'
UNION ALL SELECT 'page', page_id FROM pages_meta WHERE page_id = 'p7'""",
    ),
)
def l2(src: Source) -> DataFrame:
    pages = src["pages_meta"]
    named = lambda what, df, c: df.select(F.lit(what).alias("what"), F.col(c).cast("string").alias("id"))
    return (
        named("files", catalog.children_of(src["files_meta"], "batch_id", "b3", "file_id"), "file_id")
        .unionByName(named("pages", catalog.children_of(pages, "batch_id", "b3", "page_id"), "page_id"))
        .unionByName(
            named("artifacts", catalog.children_of(src["artifacts"], "page_id", "p7", "artifact_id"), "artifact_id")
        )
        .unionByName(named("page", catalog.by_id(pages, "page_id", "p7"), "page_id"))
    )


@query(
    "l3_event_tail",
    oracle_with(
        "envelopes",
        body="SELECT event_id, event_type, created_at FROM envelopes ORDER BY created_at DESC, event_id DESC LIMIT 50",
    ),
)
def l3(src: Source) -> DataFrame:
    return catalog.event_tail(src["envelopes"].select("event_id", "event_type", "created_at"))


@query(
    "l4_preview_artifact",
    oracle_with(
        "artifacts",
        body="""
SELECT page_id, artifact_id, kind, uri FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY created_at, artifact_id) AS rn
  FROM artifacts WHERE kind IN ('preview', 'normalized', 'raw')) t WHERE rn = 1""",
    ),
)
def l4(src: Source) -> DataFrame:
    return catalog.preview_artifact(src["artifacts"]).select("page_id", "artifact_id", "kind", "uri")


@query(
    "a20_batch_rollup",
    oracle_with(
        "batches_meta",
        "files_meta",
        "pages_meta",
        body="""
, f AS (SELECT batch_id, COUNT(*) AS files, COUNT(*) FILTER (status = 'failed') AS failed_files FROM files_meta GROUP BY batch_id),
p AS (SELECT batch_id, COUNT(*) AS pages, COUNT(*) FILTER (status = 'exported') AS exported_pages, COUNT(*) FILTER (status = 'review_required') AS review_pages,
  COUNT(*) FILTER (status = 'failed') AS failed_pages, COUNT(*) FILTER (status = 'skipped') AS skipped_pages,
  COUNT(*) FILTER (status IN ('exported', 'skipped', 'failed')) AS done_pages FROM pages_meta GROUP BY batch_id)
SELECT b.batch_id, COALESCE(files, 0) AS files, COALESCE(failed_files, 0) AS failed_files, COALESCE(pages, 0) AS pages,
  COALESCE(exported_pages, 0) AS exported_pages, COALESCE(review_pages, 0) AS review_pages, COALESCE(failed_pages, 0) AS failed_pages,
  COALESCE(skipped_pages, 0) AS skipped_pages, COALESCE(done_pages, 0) AS done_pages,
  CASE WHEN pages > 0 AND failed_pages = pages THEN 'failed' WHEN pages > 0 AND done_pages = pages THEN 'ready'
       WHEN files > 0 OR pages > 0 THEN 'processing' ELSE 'created' END AS rolled_status
FROM batches_meta b LEFT JOIN f ON f.batch_id = b.batch_id LEFT JOIN p ON p.batch_id = b.batch_id""",
    ),
)
def a20(src: Source) -> DataFrame:
    return catalog.batch_rollup(src["batches_meta"], src["files_meta"], src["pages_meta"])


@query(
    "a20_pages_by_status",
    oracle_with(
        "pages_meta",
        body="""
SELECT batch_id, status, CAST(GROUPING(batch_id, status) AS INT) AS level, COUNT(*) AS pages FROM pages_meta GROUP BY ROLLUP (batch_id, status)""",
    ),
)
def a20_rollup(src: Source) -> DataFrame:
    return catalog.pages_by_status(src["pages_meta"])


@query("a21_uploaded_bytes", oracle_with("files_meta", body="SELECT COUNT(*) AS files, CAST(SUM(size_bytes) AS BIGINT) AS bytes FROM files_meta"))
def a21_bytes(src: Source) -> DataFrame:
    return catalog.uploaded_bytes(src["files_meta"])


@query("a21_produced_events", oracle_with("envelopes", body="SELECT event_type, COUNT(*) AS produced FROM envelopes GROUP BY event_type"))
def a21_events(src: Source) -> DataFrame:
    return catalog.produced_events(src["envelopes"])


@query(
    "a21_request_counts",
    oracle_with(
        "requests",
        body="""
SELECT method, route, CASE WHEN status >= 500 THEN '5xx' WHEN status >= 400 THEN '4xx' WHEN status >= 300 THEN '3xx' ELSE '2xx' END AS status_class,
       COUNT(*) AS requests FROM requests GROUP BY ALL""",
    ),
)
def a21_requests(src: Source) -> DataFrame:
    return catalog.request_counts(src["requests"])


@query(
    "a21_duration_histogram",
    oracle_with(
        "requests",
        body="""
SELECT method, route, le, COUNT(*) FILTER (seconds <= le) AS requests
FROM requests, (SELECT UNNEST([0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, CAST('inf' AS DOUBLE)]) AS le) b GROUP BY ALL""",
    ),
)
def a21_histogram(src: Source) -> DataFrame:
    return catalog.duration_histogram(src["requests"])


@query(
    "p14_review_required",
    oracle_with(
        "qa_metrics",
        "pages_meta",
        body="""
SELECT q.qa_id, c <> '' AS review, c AS codes FROM (
 SELECT q.*, CONCAT_WS('|', CASE WHEN iou < 0.85 THEN 'low_raster_iou' END, CASE WHEN ch > 6 THEN 'high_chamfer' END,
   CASE WHEN q.hausdorff_px > 12 THEN 'high_hausdorff' END, CASE WHEN q.low_confidence_count >= 5 THEN 'low_confidence_primitives' END,
   CASE WHEN COALESCE(p.page_type, 'unknown') = 'unknown' THEN 'page_type_unknown' END) AS c
 FROM (SELECT *, CASE WHEN qa_id % 10 = 0 THEN 0.0 ELSE raster_iou END AS iou, CASE WHEN qa_id % 8 = 0 THEN 0.0 ELSE chamfer_px END AS ch FROM qa_metrics) q
 LEFT JOIN pages_meta p ON p.page_id = q.page_id) q""",
    ),
)
def p14(src: Source) -> DataFrame:
    # Missing IoU and an infinite chamfer distance stand for a page without raster.
    qa = src["qa_metrics"].withColumns(
        {
            "iou": F.when(F.col("qa_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("raster_iou")),
            "ch": F.when(F.col("qa_id") % 8 == 0, F.lit(float("inf"))).otherwise(F.col("chamfer_px")),
        }
    )
    judged = qa.join(src["pages_meta"].select("page_id", "page_type"), "page_id", "left").withColumn(
        "rule",
        rules.review_required(
            F.col("iou"), F.col("ch"), F.col("hausdorff_px"), F.col("low_confidence_count"), F.col("page_type")
        ),
    )
    return judged.select("qa_id", F.col("rule.review").alias("review"), joined("rule.codes").alias("codes"))
