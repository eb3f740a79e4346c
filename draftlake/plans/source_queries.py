"""Source, sink and streaming queries.  Inputs are derived by Spark into the shared folder first."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.operators import backends, ocr
from draftlake.operators import vector as vec
from draftlake.operators.ordered import first_per_key
from draftlake.plans.event_queries import _REASON, _STATUS
from draftlake.plans.fixtures import Source, oracle_with
from draftlake.plans.registry import query
from draftlake.session import shared_dir
from draftlake.sources import files, stored, tables
from draftlake.streaming import events as ev
from draftlake.streaming import counters, runs, stateful


def _scratch(src: Source, name: str) -> str:
    """A new folder under the shared folder."""
    return f"{shared_dir(src.spark)}/{name}-{uuid.uuid4().hex}"


@query("s1_scan_files")
def s1(src: Source) -> DataFrame:
    found = files.classify_files(stored.scan_heads(src.spark, src.folder, "*.parquet"))
    return found.select("name", "length", "kind", "archive_format")


@query(
    "s2_scan_images",
    oracle_with(
        "pixels",
        body="""
, size AS (SELECT page_id, MAX(x) + 1 AS w, MAX(y) + 1 AS h FROM pixels GROUP BY page_id),
dots AS (SELECT page_id, x, y, MAX(v) AS v FROM pixels GROUP BY page_id, x, y),
across AS (SELECT page_id, h, CAST(UNNEST(RANGE(w)) AS INT) AS x FROM size),
grid AS (SELECT page_id, x, CAST(UNNEST(RANGE(h)) AS INT) AS y FROM across)
SELECT g.page_id, g.x, g.y, COALESCE(d.v, 255) AS v FROM grid g LEFT JOIN dots d ON d.page_id = g.page_id AND d.x = g.x AND d.y = g.y""",
    ),
)
def s2(src: Source) -> DataFrame:
    """Pages written as images, then read back pixel by pixel."""
    pixels, path = src["pixels"], _scratch(src, "images")
    sizes = pixels.groupBy("page_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    stored.write_images(pixels, sizes, path)
    return files.scan_pixels(src.spark, path)


@query(
    "s3_read_cad",
    oracle_with(
        "polyline_sizes",
        "pages_meta",
        body="SELECT id, n AS vertices, closed, 'LWPOLYLINE' AS type FROM polyline_sizes",
    ),
)
def s3(src: Source) -> DataFrame:
    from draftlake.plans.vector_queries import _polylines

    path = _scratch(src, "cad")
    corners = F.transform("vertices", lambda v: F.array(v["x"], v["y"]))
    one = F.struct("id", F.lit("LWPOLYLINE").alias("type"), F.lit("02_PART_VISIBLE").alias("layer"), corners.alias("vertices"), "closed")
    docs = _polylines(src).select(
        F.lit("0.1").alias("schema_version"), F.struct("page_id").alias("document"), F.array(one).alias("primitives")
    )
    docs.write.json(path)
    src.spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(path)
    read = tables.cad_primitives(tables.read_cad(src.spark, path, lines=True))
    return read.select("id", F.size("vertices").alias("vertices"), "closed", "type")


@query(
    "s3_cad_roundtrip",
    oracle_with(
        "primitives",
        "pages_meta",
        body="""
, r AS (SELECT *, type IN ('CIRCLE', 'ARC', 'TEXT') AS single FROM primitives)
SELECT r.page_id, r.id, type, layer, confidence, x1, y1, CASE WHEN COALESCE(single, FALSE) THEN NULL ELSE x2 END AS x2,
       CASE WHEN COALESCE(single, FALSE) THEN NULL ELSE y2 END AS y2, radius, start_angle_deg, end_angle_deg, text, height, rotation_deg,
       CAST(m.dpi AS DOUBLE) / 25.4 AS px_per_mm, m.height_px
FROM r LEFT JOIN pages_meta m ON m.page_id = r.page_id""",
    ),
)
def s3_roundtrip(src: Source) -> DataFrame:
    path, blocks = _scratch(src, "cad"), src["ocr_blocks"]
    tables.write_cad(src["pages_meta"], src["primitives"], blocks, ocr.dimensions(ocr.enrich_ocr(blocks)), path)
    read = tables.cad_primitives(tables.read_cad(src.spark, f"{path}/primitives", lines=True))
    return read.select(
        *"page_id id type layer confidence x1 y1 x2 y2 radius start_angle_deg end_angle_deg text height rotation_deg px_per_mm height_px".split()
    )


@query(
    "s3_cad_heads",
    oracle_with(
        "primitives",
        "pages_meta",
        body="""
, c AS (SELECT page_id, COUNT(*) AS n, COUNT(*) FILTER (COALESCE(NULLIF(confidence, 0), 1) < 0.55) AS low FROM primitives GROUP BY page_id)
SELECT p.page_id, p.batch_id, p.file_id, p.page_type, COALESCE(n, 0) = 0 OR COALESCE(low, 0) > GREATEST(5, FLOOR(0.1 * COALESCE(n, 0))) AS requires_review
FROM pages_meta p LEFT JOIN c ON c.page_id = p.page_id""",
    ),
)
def s3_heads(src: Source) -> DataFrame:
    path, blocks = _scratch(src, "cad"), src["ocr_blocks"]
    tables.write_cad(src["pages_meta"], src["primitives"], blocks, ocr.dimensions(ocr.enrich_ocr(blocks)), path)
    heads = tables.read_cad(src.spark, f"{path}/head", lines=True)
    return heads.select("document.page_id", "document.batch_id", "document.file_id", "document.page_type", "qa.requires_review")


_VALID = "COALESCE(event_type, '') <> ''"


@query(
    "s4_s5_event_roundtrip",
    oracle_with(
        "envelopes", body=f"SELECT event_id, event_type, page_id, batch_id, attempt, payload FROM envelopes WHERE {_VALID}"
    ),
)
def s4(src: Source) -> DataFrame:
    path = _scratch(src, "log")
    runs.write_events(src["envelopes"], f"{path}/in")
    parsed = ev.accepted(ev.parse_events(runs.read_events(src.spark, f"{path}/in")))
    wanted = parsed.select("event_id", "event_type", "page_id", "batch_id", "attempt", "payload")
    return runs.drain(wanted, f"{path}/out", f"{path}/ckpt")


@query("s6_catalog")
def s6(src: Source) -> DataFrame:
    path = _scratch(src, "catalogue")
    stamp = F.col("created_at").cast("timestamp").alias("created_at")
    src["batches_meta"].select(F.col("batch_id").alias("id"), "name", "status", stamp).write.parquet(f"{path}/batches")
    src["pages_meta"].select(
        F.col("page_id").alias("id"), "batch_id", "file_id", "page_index", "page_type", "status", "width_px", "height_px", "dpi", stamp
    ).write.parquet(f"{path}/pages")
    found = tables.catalog(src.spark, path, views=False)
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in found.items()]
    whole = counts[0]
    for part in counts[1:]:
        whole = whole.unionByName(part)
    return whole


@query(
    "s7_write_artifacts",
    oracle_with(
        "artifacts",
        "pages_meta",
        body="""
SELECT COALESCE(p.batch_id, 'unknown') AS batch_id, 'pages/' || COALESCE(p.batch_id, 'unknown') || '/' || COALESCE(p.file_id, 'unknown') || '/' || a.page_id || '/' || a.kind AS key, COUNT(*) AS n
FROM artifacts a LEFT JOIN pages_meta p ON p.page_id = a.page_id GROUP BY ALL""",
    ),
)
def s7(src: Source) -> DataFrame:
    path = _scratch(src, "artifacts")
    pages = src["pages_meta"].select("page_id", "file_id", "batch_id")
    placed = src["artifacts"].join(pages, "page_id", "left")
    for _ in range(2):  # a repeated run replaces, it does not append
        tables.write_artifacts(placed, path, "kind")
    return src.spark.read.parquet(path).groupBy("batch_id", "key").agg(F.count("*").alias("n"))


@query(
    "s8_entity_sink",
    oracle_with(
        "primitives",
        body="""
SELECT page_id, COUNT(*) AS entities, COUNT(*) FILTER (type = 'ARC') AS arcs FROM primitives
WHERE type = 'LINE' OR (type IN ('CIRCLE', 'ARC') AND radius > 0) OR (type = 'TEXT' AND text <> '') GROUP BY page_id""",
    ),
)
def s8(src: Source) -> DataFrame:
    path = _scratch(src, "entities")
    pages = src["pages_meta"].select(
        "page_id", (F.col("dpi").cast("double") / F.lit(25.4)).alias("px_per_mm"), "height_px"
    )
    tables.write_entities(vec.entities(src["primitives"], pages), path)
    text = src.spark.read.parquet(f"{path}/text")
    lines = text.select("page_id", F.explode(F.split("text", "\n")).alias("value"))
    # Entity kinds stand on the line after code 0 and are the only such words in the text.
    return lines.groupBy("page_id").agg(
        F.count_if(F.col("value").isin("LINE", "CIRCLE", "ARC", "TEXT", "LWPOLYLINE")).alias("entities"),
        F.count_if(F.col("value") == "ARC").alias("arcs"),
    )


@query("s9_expand_archives")
def s9(src: Source) -> DataFrame:
    """Archives zipped by Spark tasks from the documents of each source, then expanded."""
    import io
    import zipfile

    import pandas as pd

    def pack(batches):
        for pdf in batches:
            rows = []
            for doc in pdf.itertuples(index=False):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as box:
                    box.writestr(f"docs/{doc.doc_id}.txt", doc.text)
                    box.writestr("../escape.txt" if doc.doc_id % 10 == 0 else "scan.png", b"\x89PNG\r\n\x1a\n0000")
                rows.append((str(doc.doc_id), f"set{doc.doc_id}.zip", buffer.getvalue()))
            yield pd.DataFrame(rows, columns=["file_id", "name", "content"])

    packed = src.raw("documents").select("doc_id", "text").mapInPandas(pack, "file_id string, name string, content binary")
    children, failed = files.expand_archives(packed)
    good = children.groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    bad = failed.groupBy(F.col("violation").alias("kind")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("bytes"))
    return good.unionByName(bad)


@query("f1_backend")
def f1(src: Source) -> DataFrame:
    """A toy model (mean gray of an image row) behind the plug point."""

    def load():
        def model(pdf):
            import pandas as pd

            mean = pdf["v"].map(lambda v: float(sum(v)) / max(len(v), 1))
            return pd.DataFrame(
                {
                    "page_id": pdf["page_id"],
                    "page_type": ["bad_scan" if m < 60 else "detail_drawing" for m in mean],
                    "confidence": mean / 255.0,
                    "reason": "mean_gray",
                }
            )

        return model

    return backends.classify_pages(src["pixels"], load).select("page_id", "page_type", F.round("confidence", 6).alias("confidence"))


# --------------------------------------------------------------- streaming twins
def _event_stream(src: Source, files_per_trigger: int = 1) -> tuple[DataFrame, str]:
    """The envelopes as a stream of several files."""
    path = _scratch(src, "stream")
    table = src["envelopes"].withColumn("created_at", F.col("created_at").cast("timestamp"))
    table.repartitionByRange(4, "created_at").write.parquet(f"{path}/in")
    return runs.read_table_stream(src.spark, f"{path}/in", table.schema, files_per_trigger), path


@query(
    "t1_split_stream",
    oracle_with(
        "raw_events",
        body=f"""
SELECT CASE WHEN reason IS NULL THEN 'accepted' ELSE reason END AS side, COUNT(*) AS n FROM (SELECT {_REASON} AS reason FROM raw_events) t GROUP BY ALL""",
    ),
)
def t1_stream(src: Source) -> DataFrame:
    path = _scratch(src, "split")
    src["raw_events"].select("raw").repartition(4).write.text(f"{path}/in")
    raw = runs.read_events(src.spark, f"{path}/in", files_per_trigger=2)
    runs.split_stream(raw, f"{path}/good", f"{path}/dead", f"{path}/ckpt").awaitTermination()
    good = src.spark.read.parquet(f"{path}/good").select(F.lit("accepted").alias("side"))
    dead = src.spark.read.parquet(f"{path}/dead").select(F.col("reason").alias("side"))
    return good.unionByName(dead).groupBy("side").agg(F.count("*").alias("n"))


@query(
    "t7_page_state_stream",
    oracle_with(
        "envelopes",
        body=f"""
SELECT page_id, status FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY created_at DESC, event_id DESC) AS rn
  FROM (SELECT *, {_STATUS} AS status FROM envelopes) s WHERE status IS NOT NULL AND page_id IS NOT NULL) t WHERE rn = 1""",
    ),
)
def t7_stream(src: Source) -> DataFrame:
    events, path = _event_stream(src)
    versions = runs.drain(ev.page_state(events), f"{path}/out", f"{path}/ckpt", mode="update")
    return first_per_key(versions, ["page_id"], F.desc("_epoch")).select("page_id", "status")


@query(
    "t8_completion_stream",
    oracle_with(
        "envelopes",
        "pages_meta",
        body="""
, done AS (SELECT DISTINCT page_id FROM envelopes WHERE event_type = 'page.export.done' AND page_id IS NOT NULL)
SELECT p.batch_id, COUNT(*) AS expected, COUNT(d.page_id) AS exported, COUNT(*) = COUNT(d.page_id) AS complete
FROM pages_meta p LEFT JOIN done d ON d.page_id = p.page_id WHERE p.page_type <> 'specification_sheet' GROUP BY p.batch_id""",
    ),
)
def t8_stream(src: Source) -> DataFrame:
    events, path = _event_stream(src, files_per_trigger=2)

    def save(result: DataFrame, epoch: int) -> None:
        result.write.mode("overwrite").parquet(f"{path}/result/_epoch={epoch}")

    runs.completion_stream(events, src["pages_meta"], f"{path}/seen", f"{path}/ckpt", save).awaitTermination()
    versions = src.spark.read.option("basePath", f"{path}/result").parquet(f"{path}/result/_epoch=*")
    return first_per_key(versions, ["batch_id"], F.desc("_epoch")).select("batch_id", "expected", "exported", "complete")


# The files of a stream may arrive in any order, so the delays below exceed the
# 30 days of the log and nothing is late.
_DELAY = "40 days"


@query(
    "t10_event_rates_stream",
    oracle_with(
        "envelopes",
        body="SELECT time_bucket(INTERVAL '15 seconds', created_at) AS window_start, event_type, COUNT(*) AS events FROM envelopes GROUP BY ALL",
    ),
)
def t10_stream(src: Source) -> DataFrame:
    events, path = _event_stream(src)
    versions = runs.drain(ev.event_rates(events, watermark=_DELAY), f"{path}/out", f"{path}/ckpt", mode="update")
    return first_per_key(versions, ["window_start", "event_type"], F.desc("_epoch")).drop("_epoch")


@query(
    "t4_dedupe_stream",
    oracle_with(
        "envelopes",
        body="SELECT DISTINCT page_id, event_type, CASE WHEN page_id IS NULL THEN event_id END AS lone_id FROM envelopes",
    ),
)
def t4_stream(src: Source) -> DataFrame:
    events, path = _event_stream(src)
    once = runs.drain(ev.dedupe_events(events, _DELAY), f"{path}/out", f"{path}/ckpt")
    return once.select("page_id", "event_type", F.when(F.col("page_id").isNull(), F.col("event_id")).alias("lone_id"))


def _late_log(src: Source) -> tuple[DataFrame, str]:
    """The event log as a stream in time order; events on their last attempt arrive behind the watermark.

    Files are written one after the other, each by one task behind an exchange, so the log is read
    and filtered by many, and read one at a time.  After those of the log
    come two closing events, far ahead in time, and then the late ones: a row is late if it is
    behind the watermark of the micro-batch before.
    """
    path = _scratch(src, "late")
    log = src["envelopes"].withColumn("created_at", F.col("created_at").cast("timestamp"))
    late = F.col("attempt") > ev.MAX_ATTEMPTS
    days = log.agg(F.min("created_at"), F.max("created_at")).first()
    step = (days[1] - days[0]) / _PARTS
    for k in range(_PARTS):
        start, stop = F.lit(days[0] + k * step), F.lit(days[0] + (k + 1) * step)
        own = (F.col("created_at") >= start) & ((F.col("created_at") < stop) if k < _PARTS - 1 else F.lit(True))
        log.where(own & ~late).repartition(1).write.mode("append").parquet(f"{path}/in")
    for ahead in (2, 3):
        fixed = {"event_id": F.lit(_CLOSING), "page_id": F.lit(_CLOSING), "event_type": F.lit("page.qa.done"), "created_at": F.lit(days[1] + timedelta(days=ahead))}
        log.where(~late).limit(1).select(*[fixed.get(c, F.col(c)).alias(c) for c in log.columns]).write.mode("append").parquet(f"{path}/in")
    log.where(late).repartition(1).write.mode("append").parquet(f"{path}/in")
    return runs.read_table_stream(src.spark, f"{path}/in", log.schema, 1), path


_PARTS, _CLOSING = 4, "closing"
_MOVES = ", ".join(f"('{a}', '{b}')" for a, more in ev.NEXT_STATUS.items() for b in more)


def _moves_sql(rows: str) -> str:
    return f"""
, own AS (SELECT page_id, event_id, created_at AS moved_at, status AS to_status, LAG(status) OVER (PARTITION BY page_id ORDER BY created_at, event_id) AS from_status
  FROM (SELECT *, {_STATUS} AS status FROM envelopes WHERE {rows}) s WHERE status IS NOT NULL AND page_id <> ''),
known AS (SELECT * FROM (VALUES {_MOVES}) v(a, b))
SELECT page_id, event_id, moved_at, from_status, to_status, k.a IS NOT NULL AS legal
FROM own LEFT JOIN known k ON k.a = COALESCE(from_status, '') AND k.b = to_status"""


@query("t7_page_moves", oracle_with("envelopes", body=_moves_sql("TRUE")))
def t7_moves(src: Source) -> DataFrame:
    return stateful.page_moves(src["envelopes"])


@query("t7_page_moves_stream", oracle_with("envelopes", body=_moves_sql(f"attempt <= {ev.MAX_ATTEMPTS}")))
def t7_moves_stream(src: Source) -> DataFrame:
    """Legal and illegal moves, each from its own table."""
    events, path = _late_log(src)
    runs.split_moves(stateful.page_moves_stream(events, "1 hour"), f"{path}/legal", f"{path}/illegal", f"{path}/ckpt").awaitTermination()
    sides = [src.spark.read.parquet(f"{path}/{s}").withColumn("legal", F.lit(s == "legal")) for s in ("legal", "illegal")]
    return sides[0].unionByName(sides[1]).where(F.col("page_id") != _CLOSING).drop("_epoch")


@query(
    "t9_first_completion_stream",
    oracle_with(
        "envelopes",
        body=f"""
, stages AS (SELECT * FROM (VALUES ('ocr', 'page.ocr.requested', 'page.ocr.done'), ('geometry', 'page.geometry.requested', 'page.geometry.done'),
  ('qa', 'page.qa.requested', 'page.qa.done'), ('export', 'page.export.requested', 'page.export.done')) v(stage, req, done)),
live AS (SELECT * FROM envelopes WHERE attempt <= {ev.MAX_ATTEMPTS} AND page_id <> ''),
asked AS (SELECT e.page_id, s.stage, e.event_id, e.created_at AS requested_at FROM live e JOIN stages s ON s.req = e.event_type),
fin AS (SELECT e.page_id, s.stage, e.created_at AS done_at FROM live e JOIN stages s ON s.done = e.event_type)
SELECT a.page_id, a.stage, a.event_id, a.requested_at, MIN(f.done_at) AS done_at
FROM asked a LEFT JOIN fin f ON f.page_id = a.page_id AND f.stage = a.stage AND f.done_at BETWEEN a.requested_at AND a.requested_at + INTERVAL 6 HOUR
GROUP BY ALL""",
    ),
)
def t9_first_stream(src: Source) -> DataFrame:
    """One row per request, without a completion once its six hours are over."""
    events, path = _late_log(src)
    with stateful.rocks_state(src.spark):
        return runs.drain(stateful.first_completions_stream(events, "6 hours", "1 hour"), f"{path}/out", f"{path}/ckpt")


@query(
    "t5_retry_stream",
    oracle_with(
        "envelopes",
        body=f"""
, judged AS (SELECT event_id, CAST(attempt AS INT) AS first, artifact_uri IS NULL AS hopeless, event_type = 'page.failed' AS flaky FROM envelopes)
SELECT event_id, CASE WHEN hopeless THEN 'dead' ELSE 'done' END AS side,
       CAST(CASE WHEN hopeless THEN GREATEST(first, {ev.MAX_ATTEMPTS}) WHEN flaky THEN GREATEST(first, 4) ELSE first END AS INT) AS attempt FROM judged""",
    ),
)
def t5_stream(src: Source) -> DataFrame:
    """Events without an artifact never succeed; those of failed pages do at the fourth attempt."""
    path, table = _scratch(src, "retry"), src["envelopes"].withColumn("created_at", F.col("created_at").cast("timestamp"))
    table.write.parquet(f"{path}/log/first")

    def judge(events: DataFrame) -> DataFrame:
        flaky = (F.col("event_type") == "page.failed") & (F.col("attempt") < 4)
        return events.withColumn("error", F.when(F.col("artifact_uri").isNull(), "no artifact").when(flaky, "not yet"))

    runs.retry_stream(src.spark, f"{path}/log", table.schema, judge, f"{path}/done", f"{path}/dead", f"{path}/ckpt")
    done = src.spark.read.parquet(f"{path}/done").select("event_id", F.lit("done").alias("side"), F.col("attempt").cast("int").alias("attempt"))
    attempt = F.get_json_object("payload", "$.original_event.attempt").cast("int").alias("attempt")
    return done.unionByName(src.spark.read.parquet(f"{path}/dead").select("event_id", F.lit("dead").alias("side"), attempt))


_KNOWN = ", ".join(f"'{t}'" for t in counters.topics())


@query(
    "a21_live_counters",
    oracle_with(
        "envelopes",
        body=f"SELECT CASE WHEN event_type IN ({_KNOWN}) THEN event_type ELSE '{counters.OTHER}' END AS event_type, COUNT(*) AS events FROM envelopes GROUP BY 1",
    ),
)
def a21_live(src: Source) -> DataFrame:
    """Events by type as a stream reports them while it writes the log; nothing is read again."""
    events, path = _event_stream(src, files_per_trigger=1)
    live = counters.TopicCounters()
    src.spark.streams.addListener(live)
    try:
        stream = counters.counted(events).writeStream.format("parquet").option("path", f"{path}/out")
        running = stream.option("checkpointLocation", f"{path}/ckpt").trigger(availableNow=True).start()
        running.awaitTermination()
        return live.settled(running).table(events)
    finally:
        src.spark.streams.removeListener(live)


@query(
    "t9_stage_pairs_stream",
    oracle_with(
        "envelopes",
        body="""
, stages AS (SELECT * FROM (VALUES ('ocr', 'page.ocr.requested', 'page.ocr.done'), ('geometry', 'page.geometry.requested', 'page.geometry.done'),
  ('qa', 'page.qa.requested', 'page.qa.done'), ('export', 'page.export.requested', 'page.export.done')) v(stage, req, done))
SELECT a.page_id, s.stage, a.event_id, a.created_at AS requested_at, d.created_at AS done_at FROM envelopes a JOIN stages s ON s.req = a.event_type
JOIN envelopes d ON d.page_id = a.page_id AND d.event_type = s.done AND d.created_at BETWEEN a.created_at AND a.created_at + INTERVAL 6 HOUR""",
    ),
)
def t9_stream(src: Source) -> DataFrame:
    """Matched pairs; unmatched requests stay in state until the watermark passes them."""
    events, path = _event_stream(src)
    pairs = runs.drain(ev.stage_pairs_stream(events, "6 hours", _DELAY), f"{path}/out", f"{path}/ckpt")
    return pairs.where(F.col("done_at").isNotNull())
