"""Queries over the batch, file, page and artifact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.functions import rules
from draftlake.operators.ordered import first_per_key, running

# ---------------------------------------------------------------- fixed values
PAGE_LIMIT_DEFAULT = 50
PAGE_LIMIT_MAX = 500
EVENT_TAIL = 50
SPEC = "specification_sheet"
VIEWABLE_KINDS = ["preview", "normalized", "raw"]
DURATION_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
# ---------------------------------------------------------- end of fixed values


# ------------------------------------------------------------------- filters
def page_filter(name: str) -> Column:
    """Predicate behind one dashboard tab; an unknown name keeps every page."""
    kind, status = F.col("page_type"), F.col("status")
    tabs = {
        "drawings": kind.isin("detail_drawing", "assembly_drawing"),
        "specs": (kind == SPEC) | (status == "skipped"),
        "review": status == "review_required",
        "exported": status == "exported",
        "failed": status == "failed",
    }
    return tabs.get(name, F.lit(True))


def filter_pages(pages: DataFrame, name: str) -> DataFrame:
    return pages.where(page_filter(name))


def exportable(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("page_type") != SPEC)


def hidden_on_card() -> Column:
    return (F.col("page_type") == SPEC) | (F.col("status") == "skipped")


# ------------------------------------------------------------------- updates
def apply_patch(base: DataFrame, patch: DataFrame, key: str = "page_id") -> DataFrame:
    """Preprocessing results onto pages: keep known values where the patch is empty.

    ``patch`` columns: key, new_width, new_height, new_dpi, new_status,
    new_skip_reason, patched_at.
    """
    zero, blank, hit = F.lit(0), F.lit(""), F.col("patched_at").isNotNull()
    changes = {
        "width_px": F.coalesce(F.nullif(F.col("new_width"), zero), F.col("width_px")),
        "height_px": F.coalesce(F.nullif(F.col("new_height"), zero), F.col("height_px")),
        "dpi": F.coalesce(F.col("dpi"), F.col("new_dpi")),
        "status": F.coalesce(F.col("new_status"), F.col("status")),
        "skip_reason": F.when(hit, F.nullif(F.col("new_skip_reason"), blank)).otherwise(
            F.col("skip_reason") if "skip_reason" in base.columns else F.lit(None).cast("string")
        ),
        "updated_at": F.coalesce(F.col("patched_at"), F.col("created_at")),
    }
    return (
        base.join(patch, key, "left")
        .withColumns(changes)
        .drop("new_width", "new_height", "new_dpi", "new_status", "new_skip_reason", "patched_at")
    )


def merge_meta(old: Column, new: Column) -> Column:
    """Shallow merge of two JSON objects given as text; the right side wins.

    Values stay raw JSON text, so nested objects and numbers survive.  Needs
    ``spark.sql.mapKeyDedupPolicy=LAST_WIN`` (set by ``tune``).
    """
    as_map = lambda text: F.from_json(F.coalesce(text, F.lit("{}")), "map<string,variant>")
    return F.to_json(F.map_concat(as_map(old), as_map(new)))


def append_new(base: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Insert rows whose key is absent; the first of equal incoming keys wins.

    A null in the key never conflicts, like a partial unique index.
    """
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    fresh = incoming.where(keyed).dropDuplicates(keys).join(base.select(*keys), keys, "left_anti")
    return base.unionByName(fresh).unionByName(incoming.where(~keyed))


def cascade_delete(
    doomed: DataFrame, batches: DataFrame, files: DataFrame, pages: DataFrame, artifacts: DataFrame
) -> dict[str, DataFrame]:
    """Remaining rows of every table after deleting batches; children go first."""
    gone = doomed.select("batch_id")
    gone_pages = pages.join(gone, "batch_id", "left_semi").select("page_id")
    return {
        "batches": batches.join(gone, "batch_id", "left_anti"),
        "files": files.join(gone, "batch_id", "left_anti"),
        "pages": pages.join(gone, "batch_id", "left_anti"),
        "artifacts": artifacts.join(gone_pages, "page_id", "left_anti"),
    }


# --------------------------------------------------------------------- joins
def export_manifest(artifacts: DataFrame, pages: DataFrame, files: DataFrame, every: bool = False) -> DataFrame:
    """One row per exported drawing with its member name inside the batch archive.

    By default only the newest export of a page; ``every=True`` keeps all of them.
    """
    drawings = artifacts.where(F.col("kind") == "dxf").select("artifact_id", "page_id", "uri", "created_at")
    if not every:
        drawings = first_per_key(drawings, ["page_id"], F.desc("created_at"), F.desc("artifact_id"))
    return (
        drawings.join(pages.select("page_id", "file_id", "batch_id", "page_index"), "page_id", "left")
        .join(files.select("file_id", "original_name"), "file_id", "left")
        .select(
            "batch_id",
            "page_id",
            "artifact_id",
            "uri",
            F.coalesce("page_index", F.lit(0)).alias("page_index"),
            F.coalesce("original_name", F.lit("")).alias("name"),
            rules.member_name(F.col("page_index"), F.col("original_name")).alias("member"),
        )
    )


def batch_detail(batches: DataFrame, files: DataFrame, pages: DataFrame) -> DataFrame:
    """Every batch with its files and pages as one flat table.

    Sections ``batch``, ``file`` and ``page`` share the columns, so a batch with
    very many pages never has to fit into one row.  Sort by
    (batch_id, section_no, created_at, item_id) to print it.
    """
    kept = batches.select("batch_id")

    def section(number: int, name: str, df: DataFrame, item: str, label: Column) -> DataFrame:
        return df.select(
            "batch_id",
            F.lit(number).alias("section_no"),
            F.lit(name).alias("section"),
            F.col(item).alias("item_id"),
            label.alias("label"),
            "status",
            "created_at",
        )

    head = section(0, "batch", batches, "batch_id", F.col("name"))
    file_rows = section(1, "file", files, "file_id", F.col("original_name"))
    page_rows = section(2, "page", pages, "page_id", F.col("page_type"))
    children = file_rows.unionByName(page_rows).join(kept, "batch_id", "left_semi")
    return head.unionByName(children)


def require_batch(files: DataFrame, batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files by whether their batch exists."""
    known = batches.select("batch_id")
    return files.join(known, "batch_id", "left_semi"), files.join(known, "batch_id", "left_anti")


# ------------------------------------------------------------ newest, ranked
def latest_artifact(artifacts: DataFrame) -> DataFrame:
    return first_per_key(artifacts, ["page_id", "kind"], F.desc("created_at"), F.desc("artifact_id"))


def latest_qa(qa: DataFrame) -> DataFrame:
    return first_per_key(qa, ["page_id"], F.desc("created_at"), F.desc("qa_id"))


def page_index(rendered: DataFrame) -> DataFrame:
    """Zero-based index of rendered pages within a file, by path."""
    numbered = running(rendered, ["file_id"], ["path"], {"page_index": F.lit(1)})
    return numbered.withColumn("page_index", F.col("page_index") - 1)


def preview_artifact(artifacts: DataFrame) -> DataFrame:
    """The oldest viewable artifact of every page."""
    viewable = artifacts.where(F.col("kind").isin(VIEWABLE_KINDS))
    return first_per_key(viewable, ["page_id"], F.asc("created_at"), F.asc("artifact_id"))


def list_batches(batches: DataFrame, limit: int | str | None = None, offset: int | str | None = None) -> DataFrame:
    """A page of batches, newest first; a limit outside 1..500 falls back to 50."""

    def number(value, default: int) -> int:
        try:
            return int(value)
        except (TypeError, ValueError):
            return default

    size = number(limit, PAGE_LIMIT_DEFAULT)
    size = size if 1 <= size <= PAGE_LIMIT_MAX else PAGE_LIMIT_DEFAULT
    skip = max(number(offset, 0), 0)
    return batches.orderBy(F.desc("created_at"), F.desc("batch_id")).offset(skip).limit(size)


def children_of(df: DataFrame, column: str, value: str, item: str) -> DataFrame:
    """Rows of one parent, oldest first."""
    return df.where(F.col(column) == value).orderBy("created_at", item)


def by_id(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(F.col(column) == value)


def event_tail(events: DataFrame, count: int = EVENT_TAIL) -> DataFrame:
    return events.orderBy(F.desc("created_at"), F.desc("event_id")).limit(count)


# ---------------------------------------------------------------- aggregates
def batch_rollup(batches: DataFrame, files: DataFrame, pages: DataFrame) -> DataFrame:
    """Counts per batch and the status they imply."""
    file_counts = files.groupBy("batch_id").agg(
        F.count("*").alias("files"), F.count_if(F.col("status") == "failed").alias("failed_files")
    )
    done = F.col("status").isin("exported", "skipped", "failed")
    page_counts = pages.groupBy("batch_id").agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("status") == "exported").alias("exported_pages"),
        F.count_if(F.col("status") == "review_required").alias("review_pages"),
        F.count_if(F.col("status") == "failed").alias("failed_pages"),
        F.count_if(F.col("status") == "skipped").alias("skipped_pages"),
        F.count_if(done).alias("done_pages"),
    )
    counts = [c for c in [*file_counts.columns, *page_counts.columns] if c != "batch_id"]
    joined = batches.join(file_counts, "batch_id", "left").join(page_counts, "batch_id", "left")
    filled = joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})
    implied = (
        F.when((F.col("pages") > 0) & (F.col("failed_pages") == F.col("pages")), "failed")
        .when((F.col("pages") > 0) & (F.col("done_pages") == F.col("pages")), "ready")
        .when((F.col("files") > 0) | (F.col("pages") > 0), "processing")
        .otherwise("created")
    )
    return filled.select("batch_id", *counts, implied.alias("rolled_status"))


def pages_by_status(pages: DataFrame) -> DataFrame:
    """Page counts per (batch, status) with batch totals and a grand total."""
    return (
        pages.rollup("batch_id", "status")
        .agg(F.count("*").alias("pages"), F.grouping_id().cast("int").alias("level"))
        .select("batch_id", "status", "level", "pages")
    )


def uploaded_bytes(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def produced_events(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("produced"))


def request_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("method", "route", rules.status_class(F.col("status")).alias("status_class")).agg(
        F.count("*").alias("requests")
    )


def duration_histogram(requests: DataFrame) -> DataFrame:
    """Cumulative latency buckets per (method, route), the last bucket unbounded."""
    counts = [F.count_if(F.col("seconds") <= b).alias(f"b{i}") for i, b in enumerate(DURATION_BUCKETS)]
    per_route = requests.groupBy("method", "route").agg(*counts, F.count("*").alias("b_all"))
    pairs = [
        F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("requests")) for i, b in enumerate(DURATION_BUCKETS)
    ] + [F.struct(F.lit(float("inf")).alias("le"), F.col("b_all").alias("requests"))]
    return per_route.select("method", "route", F.inline(F.array(*pairs)))


def pages_needing_review(pages: DataFrame, qa: DataFrame) -> DataFrame:
    """Pages per batch and type whose newest QA row fails the review rule."""
    judged = (
        latest_qa(qa)
        .join(pages.select("page_id", "batch_id", "page_type"), "page_id")
        .withColumn(
            "rule",
            rules.review_required(
                F.col("raster_iou"),
                F.col("chamfer_px"),
                F.col("hausdorff_px"),
                F.col("low_confidence_count"),
                F.col("page_type"),
            ),
        )
    )
    return judged.groupBy("batch_id", "page_type").agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("rule.review")).alias("need_review"),
        F.round(F.avg("raster_iou"), 6).alias("avg_iou"),
    )
