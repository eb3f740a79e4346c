"""Operators on event envelopes: validate, route, fan out, de-duplicate, retry, summarise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlake.functions import rules
from draftlake.operators.catalog import exportable, latest_artifact
from draftlake.operators.ordered import first_per_key
from draftlake.schemas import CORRUPT, ENVELOPE_FIELDS, ENVELOPE_PARSE, PROGRESS_CONSUMER, consumer_table

# ---------------------------------------------------------------- fixed values
MAX_ATTEMPTS = 5
RETENTION = "7 days"
RATE_WINDOW = "15 seconds"
DEADLETTER = "deadletter"
MALFORMED = "deadletter.malformed"

STATUS_BY_EVENT = {
    "file.uploaded": "created",
    "page.extracted": "extracted",
    "page.preprocessed": "preprocessed",
    "page.routed": "routed",
    "page.discarded_specification": "skipped",
    "page.segmentation.done": "segmented",
    "page.ocr.done": "ocr_done",
    "page.geometry.done": "geometry_done",
    "page.qa.done": "qa_done",
    "page.review.required": "review_required",
    "page.review.accepted": "reviewed",
    "page.export.done": "exported",
    "page.failed": "failed",
}
SPEC_SKIP_REASON = "specification_sheet"
# status: statuses that may follow it; the empty name stands ahead of the first event.
# Recognition and geometry run side by side, export follows QA with or without a review,
# and a page may be processed again from any end.
NEXT_STATUS = {
    "": ("created", "extracted"),
    "created": ("extracted", "failed"),
    "extracted": ("preprocessed", "skipped", "failed"),
    "preprocessed": ("routed", "segmented", "ocr_done", "geometry_done", "skipped", "failed"),
    "routed": ("segmented", "ocr_done", "geometry_done", "skipped", "failed"),
    "segmented": ("ocr_done", "geometry_done", "failed"),
    "ocr_done": ("geometry_done", "qa_done", "failed"),
    "geometry_done": ("ocr_done", "qa_done", "failed"),
    "qa_done": ("review_required", "exported", "failed"),
    "review_required": ("reviewed", "exported", "failed"),
    "reviewed": ("exported", "failed"),
    "exported": ("extracted",),
    "skipped": ("extracted",),
    "failed": ("extracted",),
}

# stage: (request topic, completion topic)
STAGES = {
    "segmentation": ("page.segmentation.requested", "page.segmentation.done"),
    "ocr": ("page.ocr.requested", "page.ocr.done"),
    "geometry": ("page.geometry.requested", "page.geometry.done"),
    "qa": ("page.qa.requested", "page.qa.done"),
    "export": ("page.export.requested", "page.export.done"),
}
# event: topics that follow it, in order; those of REVIEW_TOPICS only where a review is asked for
FOLLOW_UPS = {
    "page.extracted": ("page.preprocessed", "page.ocr.requested", "page.geometry.requested"),
    "page.geometry.requested": ("page.geometry.done", "page.qa.requested"),
    "page.qa.requested": ("page.qa.done", "page.review.required", "page.export.requested"),
    "page.ocr.requested": ("page.ocr.done",),
    "page.export.requested": ("page.export.done",),
}
REVIEW_TOPICS = ("page.review.required",)
# ---------------------------------------------------------- end of fixed values


def with_key(events: DataFrame) -> DataFrame:
    return events.withColumn(
        "event_key", rules.event_key(F.col("page_id"), F.col("file_id"), F.col("batch_id"), F.col("event_id"))
    )


# ------------------------------------------------------------------ validate
def _invalid_reason(corrupt: Column) -> Column:
    blank = F.lit("")
    return (
        F.when(corrupt, "malformed")
        .when(F.coalesce(F.col("event_id"), blank) == "", "event_id")
        .when(F.coalesce(F.col("event_type"), blank) == "", "event_type")
        .when(F.coalesce(F.col("created_at"), blank) == "", "created_at")
        .when(F.coalesce(F.col("attempt"), F.lit(0)) < 1, "attempt")
    )


def parse_events(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Parse JSON text into envelope columns plus ``reason`` (null when valid)."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = raw.withColumn("_e", F.from_json(F.col(column), ENVELOPE_PARSE, options))
    flat = parsed.select(*raw.columns, *[F.col(f"_e.{f}").alias(f) for f in ENVELOPE_FIELDS], f"_e.{CORRUPT}", "_e")
    corrupt = F.col("_e").isNull() | F.col(CORRUPT).isNotNull()
    return flat.withColumn("reason", _invalid_reason(corrupt)).drop(CORRUPT, "_e")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).drop("reason")


def rejected(parsed: DataFrame, column: str = "raw") -> DataFrame:
    """Dead-letter envelopes that carry the raw text and the reason."""
    payload = F.to_json(F.struct(F.col(column).alias("raw"), F.col("reason").alias("error")))
    return parsed.where(F.col("reason").isNotNull()).select(
        F.lit(DEADLETTER).alias("topic"), F.lit(MALFORMED).alias("event_type"), F.col("reason"), payload.alias("payload")
    )


# ------------------------------------------------------------------- routing
def route_events(events: DataFrame) -> DataFrame:
    """One row per (event, subscribed consumer) whose required ids are present.

    The progress consumer takes every event; the subscription table is a fixed
    seven-row dimension.
    """
    blank = F.lit("")
    present = lambda c: F.coalesce(F.col(c), blank) != ""
    subscriptions = consumer_table(events.sparkSession)
    needs = lambda c: F.array_contains(F.split("required", ","), c)
    guard = F.lit(True)
    for c in ("file_id", "page_id", "artifact_uri"):
        guard = guard & (~needs(c) | present(c))
    served = (
        events.join(F.broadcast(subscriptions), events["event_type"] == subscriptions["topic"])
        .where(guard)
        .select(*events.columns, "consumer")
    )
    return served.unionByName(events.withColumn("consumer", F.lit(PROGRESS_CONSUMER)))


def fan_out(events: DataFrame) -> DataFrame:
    """Follow-up topics of stage results, one output row per topic.

    A QA result asks for review only when flagged, and always for export.
    """
    source = F.col("event_type")
    review = F.coalesce(F.get_json_object("payload", "$.requires_review") == "true", F.lit(False))
    topics = F.lit(None).cast("array<string>")
    for cause, names in FOLLOW_UPS.items():
        own = [F.when(review, t) if t in REVIEW_TOPICS else F.lit(t) for t in names]
        topics = F.when(source == cause, F.array_compact(F.array(*own))).otherwise(topics)
    return events.select(
        F.col("event_id").alias("cause_id"),
        source.alias("cause_type"),
        F.posexplode(topics).alias("step", "event_type"),
        "batch_id",
        "file_id",
        "page_id",
        "artifact_uri",
        "created_at",
    )


# --------------------------------------------------------------------- dedupe
def dedupe_events(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Keep one event per (page, type); events without a page pass through.

    A batch keeps the earliest event.  A stream keeps the first to arrive within
    the watermark, so its state is bounded.
    """
    keyed = events.withColumn("_key", F.coalesce(F.nullif(F.col("page_id"), F.lit("")), F.concat(F.lit("#"), "event_id")))
    if events.isStreaming:
        timed = keyed.withWatermark("created_at", watermark)
        return timed.dropDuplicatesWithinWatermark(["_key", "event_type"]).drop("_key")
    return first_per_key(keyed, ["_key", "event_type"], F.asc("created_at"), F.asc("event_id")).drop("_key")


# ---------------------------------------------------------------------- retry
def retry_or_dead(failures: DataFrame, max_attempts: int = MAX_ATTEMPTS, error: str = "error") -> DataFrame:
    """Failed events: one more attempt, or a dead letter holding the original event."""
    spent = F.col("attempt") >= max_attempts
    fields = [c for c in failures.columns if c != error]
    message = F.col(error) if error in failures.columns else F.lit("handler failed")
    letter = F.to_json(
        F.struct(
            F.col("event_type").alias("original_topic"),
            F.struct(*fields).alias("original_event"),
            message.alias("error"),
        )
    )
    return failures.select(
        "event_id",
        F.when(spent, DEADLETTER).otherwise(F.col("event_type")).alias("topic"),
        "batch_id",
        "file_id",
        "page_id",
        F.when(spent, F.lit(1)).otherwise(F.col("attempt") + 1).alias("attempt"),
        F.when(spent, letter).otherwise(F.col("payload")).alias("payload"),
        "created_at",
    )


def retried(failures: DataFrame, max_attempts: int = MAX_ATTEMPTS, error: str = "error") -> DataFrame:
    """Failed events that may be tried again, as whole envelopes with one more attempt."""
    more = failures.where(F.col("attempt") < max_attempts)
    return more.withColumn("attempt", (F.col("attempt") + 1).cast(failures.schema["attempt"].dataType)).drop(error)


def dead_letters(failures: DataFrame, max_attempts: int = MAX_ATTEMPTS, error: str = "error") -> DataFrame:
    """Dead letters of the failed events whose attempts are used up."""
    return retry_or_dead(failures.where(F.col("attempt") >= max_attempts), max_attempts, error)


# ------------------------------------------------------------------- progress
def progress(events: DataFrame, batch_id: str = "") -> DataFrame:
    """Events of one batch plus events without a batch; an empty filter keeps all."""
    if not batch_id:
        return events
    return events.where(F.coalesce(F.col("batch_id"), F.lit("")).isin("", batch_id))


def status_of() -> Column:
    pairs = [F.lit(x) for item in STATUS_BY_EVENT.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.col("event_type"))


def page_state(events: DataFrame) -> DataFrame:
    """Last status of every page.  A stream runs in update mode with one row per page."""
    moves = events.where(F.coalesce(F.col("page_id"), F.lit("")) != "").withColumn("_status", status_of())
    newest = F.max(F.when(F.col("_status").isNotNull(), F.struct("created_at", "event_id", "_status")))
    return (
        moves.groupBy("page_id")
        .agg(newest.alias("last"))
        .where(F.col("last").isNotNull())
        .select(
            "page_id",
            F.col("last._status").alias("status"),
            F.when(F.col("last._status") == "skipped", SPEC_SKIP_REASON).alias("skip_reason"),
            F.col("last.created_at").alias("since"),
        )
    )


def exported_pages(events: DataFrame) -> DataFrame:
    done = events.where((F.col("event_type") == "page.export.done") & F.col("page_id").isNotNull())
    return done.select("page_id").dropDuplicates()


def due_pages(pages: DataFrame) -> DataFrame:
    return exportable(pages).select("batch_id", "page_id")


def completion(due: DataFrame, exported: DataFrame) -> DataFrame:
    """Batches with expected and exported page counts, from exported pages per batch."""
    expected = due.groupBy("batch_id").agg(F.count("*").alias("expected"))
    both = expected.join(exported.select("batch_id", "exported"), "batch_id", "left").na.fill(0, ["exported"])
    return both.withColumn("complete", F.col("expected") == F.col("exported"))


def batch_complete(exported: DataFrame, pages: DataFrame) -> DataFrame:
    """Batches with expected and exported page counts; complete when equal."""
    due = due_pages(pages)
    done = due.join(exported.select("page_id").distinct(), "page_id").groupBy("batch_id").agg(F.count("*").alias("exported"))
    return completion(due, done)


def stage_of(side: int) -> Column:
    pairs = [F.lit(x) for stage, topics in STAGES.items() for x in (topics[side], stage)]
    return F.try_element_at(F.create_map(*pairs), F.col("event_type"))


def stage_latency(events: DataFrame, block: str = "HOUR") -> DataFrame:
    """Every stage request with the first completion at or after it (null if none).

    One ordered pass instead of pairing requests with completions.  Time blocks
    split a busy page; each block also knows the first completion of later blocks.
    """
    at = F.col("created_at")
    marks = (
        events.where(F.coalesce(F.col("page_id"), F.lit("")) != "")
        .withColumns({"_asked": stage_of(0), "_done": stage_of(1)})
        .withColumn("stage", F.coalesce("_asked", "_done"))
        .where(F.col("stage").isNotNull())
        .select(
            "page_id",
            "stage",
            "event_id",
            at.alias("requested_at"),
            F.when(F.col("_done").isNotNull(), at).alias("_done_at"),
            F.date_trunc(block, at).alias("_block"),
        )
    )
    keys = ["page_id", "stage"]
    later = Window.partitionBy(*keys).orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    blocks = (
        marks.groupBy(*keys, "_block")
        .agg(F.min("_done_at").alias("_first"))
        .select(*keys, "_block", F.min("_first").over(later).alias("_later"))
    )
    onward = Window.partitionBy(*keys, "_block").orderBy("requested_at").rangeBetween(0, Window.unboundedFollowing)
    ordered = marks.withColumn("_next", F.min("_done_at").over(onward))
    return (
        ordered.where(F.col("_done_at").isNull())
        .join(blocks, [*keys, "_block"], "left")
        .select(*keys, "event_id", "requested_at", F.coalesce("_next", "_later").alias("done_at"))
        .withColumn(
            "seconds",
            (F.unix_micros(F.col("done_at").cast("timestamp")) - F.unix_micros(F.col("requested_at").cast("timestamp")))
            / 1_000_000,
        )
    )


def stage_pairs_stream(events: DataFrame, within: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """Streaming twin of ``stage_latency``: outer join of requests and completions.

    State is bounded by the watermark (by default the time bound) and the time bound.
    A request emits every completion inside the bound; the earliest is the one that
    counts.  A request without one is emitted once the watermark has passed it.
    """
    delay = watermark or within
    usable = events.where(F.coalesce(F.col("page_id"), F.lit("")) != "")
    asked = (
        usable.withColumn("stage", stage_of(0))
        .where(F.col("stage").isNotNull())
        .select("page_id", "stage", "event_id", F.col("created_at").alias("requested_at"))
        .withWatermark("requested_at", delay)
        .alias("asked")
    )
    done = (
        usable.withColumn("stage", stage_of(1))
        .where(F.col("stage").isNotNull())
        .select(
            F.col("page_id").alias("done_page"), F.col("stage").alias("done_stage"), F.col("created_at").alias("done_at")
        )
        .withWatermark("done_at", delay)
        .alias("done")
    )
    return asked.join(
        done,
        (F.col("page_id") == F.col("done_page"))
        & (F.col("stage") == F.col("done_stage"))
        & (F.col("done_at") >= F.col("requested_at"))
        & (F.col("done_at") <= F.col("requested_at") + F.expr(f"INTERVAL {within}")),
        "leftOuter",
    ).select("page_id", "stage", "event_id", "requested_at", "done_at")


def event_rates(events: DataFrame, width: str = RATE_WINDOW, watermark: str = "1 minute") -> DataFrame:
    """Event counts per type and tumbling window."""
    timed = events.withWatermark("created_at", watermark) if events.isStreaming else events
    return (
        timed.groupBy(F.window("created_at", width).alias("w"), "event_type")
        .agg(F.count("*").alias("events"))
        .select(F.col("w.start").alias("window_start"), "event_type", "events")
    )


def retain(events: DataFrame, keep: str = RETENTION) -> DataFrame:
    """Events not older than ``keep`` before the newest event."""
    newest = events.select(F.max("created_at"))
    return events.where(F.col("created_at") >= newest.scalar() - F.expr(f"INTERVAL {keep}"))


# ------------------------------------------------------------------- requests
def _request_id(kind: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(kind), "page_id"))


def reprocess_events(pages: DataFrame) -> DataFrame:
    """Envelopes that send pages back to preprocessing."""
    return pages.select(
        _request_id("reprocess").alias("event_id"),
        F.lit("page.extracted").alias("event_type"),
        "batch_id",
        "file_id",
        "page_id",
        F.nullif(F.col("raw_image_uri"), F.lit("")).alias("artifact_uri"),
        F.lit(1).alias("attempt"),
        F.lit('{"reprocess":true}').alias("payload"),
    )


def export_events(pages: DataFrame, artifacts: DataFrame, dxf_version: str = "R2010") -> DataFrame:
    """One export request per exportable page, pointing at its newest CAD document."""
    documents = latest_artifact(artifacts.where(F.col("kind") == "cad_json")).select("page_id", "uri")
    return (
        exportable(pages)
        .join(documents, "page_id", "left")
        .select(
            _request_id("export").alias("event_id"),
            F.lit("page.export.requested").alias("event_type"),
            "batch_id",
            "file_id",
            "page_id",
            F.col("uri").alias("artifact_uri"),
            F.lit(1).alias("attempt"),
            F.to_json(F.struct(F.lit(dxf_version).alias("dxf_version"))).alias("payload"),
        )
    )


def review_edits(events: DataFrame) -> DataFrame:
    """One row per edit inside review events, in order."""
    body = F.from_json("payload", "edits array<string>, note string")
    return (
        events.where(F.col("event_type") == "page.review.edited")
        .withColumn("_body", body)
        .select("event_id", "page_id", F.col("_body.note").alias("note"), F.posexplode("_body.edits").alias("ord", "edit"))
        .select(
            "event_id",
            "page_id",
            "ord",
            F.coalesce(F.get_json_object("edit", "$.operation"), F.lit("")).alias("operation"),
            F.col("edit").alias("payload"),
            "note",
        )
    )
