"""Event-log queries (batch form; the streaming form is compared in the tests)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.plans.fixtures import Source, oracle_with
from draftlake.plans.registry import query, r6
from draftlake.streaming import events as ev

_REASON = """
CASE WHEN NOT json_valid(raw) THEN 'malformed'
     WHEN COALESCE(json_extract_string(raw, '$.event_id'), '') = '' THEN 'event_id'
     WHEN COALESCE(json_extract_string(raw, '$.event_type'), '') = '' THEN 'event_type'
     WHEN COALESCE(json_extract_string(raw, '$.created_at'), '') = '' THEN 'created_at'
     WHEN COALESCE(CAST(json_extract_string(raw, '$.attempt') AS INT), 0) < 1 THEN 'attempt' END"""


@query(
    "p5_event_key",
    oracle_with(
        "envelopes",
        body="SELECT event_id, COALESCE(NULLIF(page_id, ''), NULLIF(file_id, ''), NULLIF(batch_id, ''), event_id) AS event_key FROM envelopes",
    ),
)
def p5(src: Source) -> DataFrame:
    return ev.with_key(src["envelopes"]).select("event_id", "event_key")


@query(
    "p6_validate_events",
    oracle_with(
        "raw_events",
        body=f"""
SELECT row_id, reason, CASE WHEN reason = 'malformed' THEN NULL ELSE json_extract_string(j, '$.event_id') END AS event_id,
       CASE WHEN reason = 'malformed' THEN NULL ELSE CAST(json_extract_string(j, '$.attempt') AS INT) END AS attempt,
       CASE WHEN reason = 'malformed' THEN NULL ELSE json_extract_string(j, '$.payload.k') END AS k
FROM (SELECT row_id, {_REASON} AS reason, CASE WHEN json_valid(raw) THEN raw ELSE '{{{{}}}}' END AS j FROM raw_events) t""".replace(
            "{{{{}}}}", "{}"
        ).replace("{{}}", "{}"),
    ),
)
def p6(src: Source) -> DataFrame:
    return ev.parse_events(src["raw_events"]).select(
        "row_id", "reason", "event_id", "attempt", F.get_json_object("payload", "$.k").alias("k")
    )


@query(
    "t1_parse_events",
    oracle_with(
        "raw_events",
        body=f"""
SELECT CASE WHEN reason IS NULL THEN 'accepted' ELSE 'deadletter' END AS topic,
       CASE WHEN reason IS NULL THEN 'page.extracted' ELSE 'deadletter.malformed' END AS event_type,
       reason, COUNT(*) AS n, COUNT(DISTINCT raw) AS texts
FROM (SELECT raw, {_REASON} AS reason FROM raw_events) t GROUP BY ALL""",
    ),
)
def t1(src: Source) -> DataFrame:
    parsed = ev.parse_events(src["raw_events"])
    dead = ev.rejected(parsed).withColumn("raw", F.get_json_object("payload", "$.raw"))
    good = ev.accepted(parsed).select(
        F.lit("accepted").alias("topic"), "event_type", F.lit(None).cast("string").alias("reason"), "raw"
    )
    both = good.unionByName(dead.select("topic", "event_type", "reason", "raw"))
    return both.groupBy("topic", "event_type", "reason").agg(
        F.count("*").alias("n"), F.countDistinct("raw").alias("texts")
    )


@query(
    "t2_route_events",
    oracle_with(
        "envelopes",
        body="""
, subs AS (SELECT * FROM (VALUES ('ingest_worker', 'file.uploaded'), ('ingest_worker', 'archive.extracted'), ('preprocess_service', 'page.extracted'),
  ('ocr_service', 'page.ocr.requested'), ('geometry_service', 'page.geometry.requested'), ('qa_service', 'page.qa.requested'),
  ('dxf_export_service', 'page.export.requested')) v(consumer, topic))
SELECT e.event_id, e.event_type, s.consumer FROM envelopes e JOIN subs s ON s.topic = e.event_type
WHERE CASE WHEN s.consumer = 'ingest_worker' THEN COALESCE(e.file_id, '') <> '' AND COALESCE(e.artifact_uri, '') <> '' ELSE COALESCE(e.page_id, '') <> '' END
UNION ALL SELECT event_id, event_type, 'api_progress' FROM envelopes""",
    ),
)
def t2(src: Source) -> DataFrame:
    return ev.route_events(src["envelopes"]).select("event_id", "event_type", "consumer")


@query(
    "t3_fan_out",
    oracle_with(
        "envelopes",
        body="""
, flagged AS (SELECT *, CAST(json_extract_string(payload, '$.k') AS INT) > 50 AS review FROM envelopes),
m AS (SELECT * FROM (VALUES ('page.extracted', 'page.preprocessed', FALSE), ('page.extracted', 'page.ocr.requested', FALSE),
  ('page.extracted', 'page.geometry.requested', FALSE), ('page.geometry.requested', 'page.geometry.done', FALSE),
  ('page.geometry.requested', 'page.qa.requested', FALSE), ('page.qa.requested', 'page.qa.done', FALSE),
  ('page.qa.requested', 'page.review.required', TRUE), ('page.qa.requested', 'page.export.requested', FALSE),
  ('page.ocr.requested', 'page.ocr.done', FALSE), ('page.export.requested', 'page.export.done', FALSE)) v(src, dst, cond))
SELECT e.event_id AS cause_id, e.event_type AS cause_type, m.dst AS event_type, e.page_id
FROM flagged e JOIN m ON m.src = e.event_type WHERE NOT m.cond OR e.review""",
    ),
)
def t3(src: Source) -> DataFrame:
    flagged = src["envelopes"].withColumn(
        "payload",
        F.to_json(F.struct((F.get_json_object("payload", "$.k").cast("int") > 50).alias("requires_review"))),
    )
    return ev.fan_out(flagged).select("cause_id", "cause_type", "event_type", "page_id")


@query(
    "t4_dedupe_events",
    oracle_with(
        "envelopes",
        body="""
SELECT event_id, event_type, page_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY COALESCE(NULLIF(page_id, ''), '#' || event_id), event_type
  ORDER BY created_at, event_id) AS rn FROM envelopes) t WHERE rn = 1""",
    ),
)
def t4(src: Source) -> DataFrame:
    return ev.dedupe_events(src["envelopes"]).select("event_id", "event_type", "page_id")


@query(
    "t5_retry_or_dead",
    oracle_with(
        "envelopes",
        body="""
SELECT event_id, CASE WHEN attempt >= 5 THEN 'deadletter' ELSE event_type END AS topic,
       CAST(CASE WHEN attempt >= 5 THEN 1 ELSE attempt + 1 END AS INT) AS attempt,
       CASE WHEN attempt >= 5 THEN event_type END AS original_topic, CASE WHEN attempt >= 5 THEN event_id END AS original_id,
       CASE WHEN attempt >= 5 THEN 'boom' END AS error
FROM envelopes""",
    ),
)
def t5(src: Source) -> DataFrame:
    failures = src["envelopes"].withColumn("error", F.lit("boom"))
    return ev.retry_or_dead(failures).select(
        "event_id",
        "topic",
        "attempt",
        F.get_json_object("payload", "$.original_topic").alias("original_topic"),
        F.get_json_object("payload", "$.original_event.event_id").alias("original_id"),
        F.get_json_object("payload", "$.error").alias("error"),
    )


@query(
    "t6_progress",
    oracle_with(
        "envelopes", body="SELECT event_id, batch_id FROM envelopes WHERE COALESCE(batch_id, '') = '' OR batch_id = 'b3'"
    ),
)
def t6(src: Source) -> DataFrame:
    return ev.progress(src["envelopes"], "b3").select("event_id", "batch_id")


_STATUS = """
CASE event_type WHEN 'file.uploaded' THEN 'created' WHEN 'page.extracted' THEN 'extracted' WHEN 'page.preprocessed' THEN 'preprocessed'
  WHEN 'page.discarded_specification' THEN 'skipped' WHEN 'page.ocr.done' THEN 'ocr_done' WHEN 'page.geometry.done' THEN 'geometry_done'
  WHEN 'page.qa.done' THEN 'qa_done' WHEN 'page.review.required' THEN 'review_required' WHEN 'page.export.done' THEN 'exported'
  WHEN 'page.failed' THEN 'failed' END"""


@query(
    "t7_page_state",
    oracle_with(
        "envelopes",
        body=f"""
SELECT page_id, status, CASE WHEN status = 'skipped' THEN 'specification_sheet' END AS skip_reason, created_at AS since
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY created_at DESC, event_id DESC) AS rn
      FROM (SELECT *, {_STATUS} AS status FROM envelopes) s WHERE status IS NOT NULL AND page_id IS NOT NULL) t WHERE rn = 1""",
    ),
)
def t7(src: Source) -> DataFrame:
    return ev.page_state(src["envelopes"])


@query(
    "t8_batch_complete",
    oracle_with(
        "envelopes",
        "pages_meta",
        body="""
, done AS (SELECT DISTINCT page_id FROM envelopes WHERE event_type = 'page.export.done' AND page_id IS NOT NULL)
SELECT p.batch_id, COUNT(*) AS expected, COUNT(d.page_id) AS exported, COUNT(*) = COUNT(d.page_id) AS complete
FROM pages_meta p LEFT JOIN done d ON d.page_id = p.page_id WHERE p.page_type <> 'specification_sheet' GROUP BY p.batch_id""",
    ),
)
def t8(src: Source) -> DataFrame:
    return ev.batch_complete(ev.exported_pages(src["envelopes"]), src["pages_meta"])


@query(
    "t9_stage_latency",
    oracle_with(
        "envelopes",
        body="""
, stages AS (SELECT * FROM (VALUES ('ocr', 'page.ocr.requested', 'page.ocr.done'), ('geometry', 'page.geometry.requested', 'page.geometry.done'),
  ('qa', 'page.qa.requested', 'page.qa.done'), ('export', 'page.export.requested', 'page.export.done')) v(stage, req, done)),
asked AS (SELECT e.page_id, s.stage, e.event_id, e.created_at AS requested_at FROM envelopes e JOIN stages s ON s.req = e.event_type WHERE e.page_id IS NOT NULL),
fin AS (SELECT e.page_id, s.stage, e.created_at AS done_at FROM envelopes e JOIN stages s ON s.done = e.event_type WHERE e.page_id IS NOT NULL)
SELECT page_id, stage, event_id, requested_at, MIN(done_at) AS done_at,
       ROUND(CAST(epoch_us(MIN(done_at)) - epoch_us(requested_at) AS DOUBLE) / 1000000, 6) AS seconds
FROM (SELECT a.*, f.done_at FROM asked a LEFT JOIN fin f ON f.page_id = a.page_id AND f.stage = a.stage AND f.done_at >= a.requested_at) t
GROUP BY page_id, stage, event_id, requested_at""",
    ),
)
def t9(src: Source) -> DataFrame:
    return ev.stage_latency(src["envelopes"]).withColumn("seconds", r6("seconds"))


@query(
    "t10_event_rates",
    oracle_with(
        "envelopes",
        body="""
SELECT time_bucket(INTERVAL '15 seconds', created_at) AS window_start, event_type, COUNT(*) AS events FROM envelopes GROUP BY ALL""",
    ),
)
def t10(src: Source) -> DataFrame:
    return ev.event_rates(src["envelopes"])


@query(
    "t11_retain",
    oracle_with(
        "envelopes",
        body="SELECT event_id, created_at FROM envelopes WHERE created_at >= (SELECT MAX(created_at) FROM envelopes) - INTERVAL 7 DAY",
    ),
)
def t11(src: Source) -> DataFrame:
    return ev.retain(src["envelopes"].select("event_id", "created_at"))


@query(
    "t12_reprocess_events",
    oracle_with(
        "pages_meta",
        body="""
SELECT md5('reprocess:' || page_id) AS event_id, 'page.extracted' AS event_type, batch_id, file_id, page_id,
       NULLIF(raw_image_uri, '') AS artifact_uri, 1 AS attempt, '{"reprocess":true}' AS payload FROM pages_meta""",
    ),
)
def t12(src: Source) -> DataFrame:
    return ev.reprocess_events(src["pages_meta"])


@query(
    "t12_export_events",
    oracle_with(
        "pages_meta",
        "artifacts",
        body="""
, docs AS (SELECT page_id, uri FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY created_at DESC, artifact_id DESC) AS rn
  FROM artifacts WHERE kind = 'cad_json') t WHERE rn = 1)
SELECT md5('export:' || p.page_id) AS event_id, 'page.export.requested' AS event_type, p.batch_id, p.file_id, p.page_id,
       d.uri AS artifact_uri, 1 AS attempt, '{"dxf_version":"R2010"}' AS payload
FROM pages_meta p LEFT JOIN docs d ON d.page_id = p.page_id WHERE p.page_type <> 'specification_sheet'""",
    ),
)
def t12_export(src: Source) -> DataFrame:
    return ev.export_events(src["pages_meta"], src["artifacts"])


@query(
    "t13_review_edits",
    oracle_with(
        "envelopes",
        body="""
SELECT event_id, page_id, CAST(i AS INT) AS ord, CASE i WHEN 0 THEN 'move' WHEN 1 THEN 'delete' ELSE '' END AS operation,
       CASE i WHEN 0 THEN 7 WHEN 1 THEN CAST(attempt AS INT) ELSE 0 END AS target, 'n' || event_id AS note
FROM envelopes, (SELECT UNNEST([0, 1, 2]) AS i) k WHERE event_type = 'page.review.required' AND i < 1 + attempt % 3""",
    ),
)
def t13(src: Source) -> DataFrame:
    edit = [
        F.struct(F.lit("move").alias("operation"), F.lit(7).alias("target")),
        F.struct(F.lit("delete").alias("operation"), F.col("attempt").alias("target")),
        F.struct(F.lit(None).cast("string").alias("operation"), F.lit(0).alias("target")),
    ]
    edited = (
        src["envelopes"]
        .where(F.col("event_type") == "page.review.required")
        .withColumn("edits", F.slice(F.array(*edit), 1, (1 + F.col("attempt") % 3).cast("int")))
        .withColumn("payload", F.to_json(F.struct("edits", F.concat(F.lit("n"), "event_id").alias("note"))))
        .withColumn("event_type", F.lit("page.review.edited"))
    )
    return ev.review_edits(edited).select(
        "event_id", "page_id", "ord", "operation", F.get_json_object("payload", "$.target").cast("int").alias("target"), "note"
    )
