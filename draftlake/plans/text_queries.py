"""Recognised-text and ingest queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.functions import ingest
from draftlake.functions import text as tx
from draftlake.operators import archive, ocr
from draftlake.plans.fixtures import Source, oracle_with
from draftlake.plans.registry import joined, query

_N = r"[-+]?\d+(?:\.\d+)?"
_NORM = (
    r"REGEXP_REPLACE(TRANSLATE(REGEXP_REPLACE(text, '^\s+|\s+$', '', 'g'), ',ØⵄⲞ⊘⌀Ф°º˚x×ХхX', '.ØØØØØØ°°°xxxxx'), '\s+', ' ', 'g')"
)
_PATTERNS = {
    "p1": rf"(?i)^\s*(\d+)\s*(?:отв(?:\.|ерсти[яей])?|holes?)\s*Ø\s*({_N})\s*(.*)$",
    "p2": rf"(?i)^\s*({_N})\s*x\s*({_N})\s*°\s*$",
    "p3": rf"^\s*Ø\s*({_N})(.*)$",
    "p4": rf"(?i)^\s*R\s*({_N})\s*(.*)$",
    "p5": rf"(?i)^\s*M\s*({_N})(?:\s*x\s*({_N}))?\s*(.*)$",
    "p6": rf"^\s*({_N})\s*±\s*({_N})\s*$",
    "p7": rf"^\s*({_N})\s*([+-])\s*({_N})\s*$",
    "p8": rf"^\s*({_N})\s*([A-Za-z]{{1,2}}\d{{1,2}})\s*$",
    "p9": r"^\s*([A-Za-z]{1,2}\d{1,2})\s*$",
    "p10": rf"(?i)^\s*({_N})\s*(mm|мм)?\s*$",
}
_TOL = rf"""
CASE WHEN REGEXP_MATCHES(rest, '^\s*[A-Za-z]{{1,2}}\d{{1,2}}\s*$') THEN TRIM(rest)
     WHEN REGEXP_MATCHES(rest, '^\s*±\s*{_N}\s*$') THEN '±' || REGEXP_EXTRACT(rest, '({_N})', 1)
     WHEN REGEXP_MATCHES(rest, '^\s*[+-]\s*{_N}\s*$') THEN REGEXP_EXTRACT(rest, '^\s*([+-])', 1) || REGEXP_EXTRACT(rest, '^\s*[+-]\s*({_N})', 1) END"""


def _x(p: str, group: int) -> str:
    return f"REGEXP_EXTRACT(s, '{_PATTERNS[p]}', {group})"


_RULE = "CASE " + " ".join(f"WHEN REGEXP_MATCHES(s, '{p}') THEN {n[1:]}" for n, p in _PATTERNS.items()) + " ELSE 0 END"
_PARSED = f"""
SELECT block_id, page_id, text, kind0, x1, y1, confidence,
  CASE rule WHEN 1 THEN 'diameter' WHEN 2 THEN 'chamfer' WHEN 3 THEN 'diameter' WHEN 4 THEN 'radius' WHEN 5 THEN 'thread'
    WHEN 9 THEN 'tolerance' WHEN 0 THEN 'unknown' ELSE 'linear' END AS kind,
  CAST(CASE rule WHEN 1 THEN {_x('p1', 2)} WHEN 2 THEN {_x('p2', 1)} WHEN 3 THEN {_x('p3', 1)} WHEN 4 THEN {_x('p4', 1)} WHEN 5 THEN {_x('p5', 1)}
    WHEN 6 THEN {_x('p6', 1)} WHEN 7 THEN {_x('p7', 1)} WHEN 8 THEN {_x('p8', 1)} WHEN 10 THEN {_x('p10', 1)} END AS DOUBLE) AS value,
  CASE WHEN text = '' THEN 'mm' WHEN rule IN (0, 9) THEN NULL ELSE 'mm' END AS unit,
  CASE rule WHEN 6 THEN '±' || {_x('p6', 2)} WHEN 7 THEN {_x('p7', 2)} || {_x('p7', 3)} WHEN 8 THEN {_x('p8', 2)} WHEN 9 THEN {_x('p9', 1)}
    ELSE {_TOL} END AS tolerance,
  CAST(CASE rule WHEN 1 THEN {_x('p1', 1)} END AS INT) AS count,
  CAST(CASE rule WHEN 2 THEN {_x('p2', 2)} END AS DOUBLE) AS angle_deg,
  CAST(CASE rule WHEN 5 THEN NULLIF({_x('p5', 2)}, '') END AS DOUBLE) AS pitch,
  CASE rule WHEN 5 THEN 'M' || {_x('p5', 1)} END AS thread_designator
FROM (SELECT *, CASE rule WHEN 1 THEN {_x('p1', 3)} WHEN 3 THEN {_x('p3', 2)} WHEN 4 THEN {_x('p4', 2)} WHEN 5 THEN {_x('p5', 3)} ELSE '' END AS rest
      FROM (SELECT *, {_RULE} AS rule FROM (SELECT *, kind AS kind0, {_NORM} AS s FROM ocr_blocks) a) b) c"""


@query(
    "p15_looks_like_dimension",
    oracle_with("ocr_blocks", body="SELECT block_id, REGEXP_MATCHES(text, '[ØФRM±°xX×]') AS looks FROM ocr_blocks"),
)
def p15(src: Source) -> DataFrame:
    return src["ocr_blocks"].select("block_id", tx.looks_like_dimension(F.col("text")).alias("looks"))


@query("p16_normalize_dim", oracle_with("ocr_blocks", body=f"SELECT block_id, {_NORM} AS norm FROM ocr_blocks"))
def p16(src: Source) -> DataFrame:
    return src["ocr_blocks"].select("block_id", tx.normalize_dim(F.col("text")).alias("norm"))


@query(
    "p17_parse_dimension",
    oracle_with(
        "ocr_blocks",
        body=f"SELECT block_id, kind, value, unit, tolerance, count, angle_deg, pitch, thread_designator, text AS raw FROM ({_PARSED}) p",
    ),
)
def p17(src: Source) -> DataFrame:
    return ocr.with_dimension(src["ocr_blocks"].select("block_id", "text")).select("block_id", "dimension.*")


@query(
    "p18_extract_tolerance",
    oracle_with("ocr_blocks", body=f"SELECT block_id, {_TOL} AS tolerance FROM (SELECT block_id, TRIM({_NORM}) AS rest FROM ocr_blocks) t"),
)
def p18(src: Source) -> DataFrame:
    return src["ocr_blocks"].select(
        "block_id", tx.extract_tolerance(F.trim(tx.normalize_dim(F.col("text")))).alias("tolerance")
    )


def _oracle_matches(pattern: str) -> str:
    hits = f"LIST_SORT(LIST_DISTINCT(LIST_TRANSFORM(REGEXP_EXTRACT_ALL(text, '{pattern}'), lambda h: TRIM(h))))"
    return f"CASE WHEN LEN({hits}) > 0 THEN ARRAY_TO_STRING({hits}, '|') END"


@query(
    "p19_parse_notes",
    oracle_with(
        "ocr_blocks",
        body=f"""
SELECT block_id, {_oracle_matches(r'(?i)ГОСТ\s*\d{3,5}(?:[-/]\d{2,4})?')} AS gost_refs,
       {_oracle_matches(r'(?i)R[az]\s*[\d.,]+')} AS surface_finish,
       {_oracle_matches(r'(?i)\d+(?:[.,]\d+)?\s*(?:kg|кг)')} AS mass,
       {_oracle_matches(r'(?i)(?:Сталь|Чугун|Алюминий|АМг|Д16|Латунь|Бронза|Steel|Iron|Aluminum)\s*[А-Яа-яA-Z0-9-]*')} AS material
FROM ocr_blocks""",
    ),
)
def p19(src: Source) -> DataFrame:
    notes = src["ocr_blocks"].withColumn("n", tx.parse_notes(F.col("text")))
    return notes.select(
        "block_id", *[joined(f"n.{c}").alias(c) for c in ("gost_refs", "surface_finish", "mass", "material")]
    )


_IS_DIM = "(kind0 = 'dimension_text' OR REGEXP_MATCHES(text, '[ØФRM±°xX×]'))"


@query(
    "p20_enrich_ocr",
    oracle_with(
        "ocr_blocks",
        body=f"""
SELECT block_id, CASE WHEN {_IS_DIM} AND kind0 = 'unknown' THEN 'dimension_text' ELSE kind0 END AS kind,
       CASE WHEN {_IS_DIM} THEN kind END AS dimension_kind, CASE WHEN {_IS_DIM} THEN value END AS value,
       NOT {_IS_DIM} AND kind0 = 'titleblock_text' AS has_notes, ROUND(confidence, 6) AS confidence
FROM ({_PARSED}) p""",
    ),
)
def p20(src: Source) -> DataFrame:
    return ocr.enrich_ocr(src["ocr_blocks"]).select(
        "block_id",
        "kind",
        F.col("dimension.kind").alias("dimension_kind"),
        F.col("dimension.value").alias("value"),
        F.col("notes").isNotNull().alias("has_notes"),
        F.round("confidence", 6).alias("confidence"),
    )


@query(
    "p21_dimensions",
    oracle_with(
        "ocr_blocks",
        body=f"""
SELECT page_id, block_id, kind, value, COALESCE(unit, 'mm') AS unit, tolerance, x1 AS anchor_x, y1 AS anchor_y, text AS raw_text
FROM ({_PARSED}) p WHERE {_IS_DIM} AND kind <> 'unknown'""",
    ),
)
def p21(src: Source) -> DataFrame:
    return ocr.dimensions(ocr.enrich_ocr(src["ocr_blocks"]))


@query(
    "j3_attach_ocr",
    oracle_with(
        "pages_meta",
        "ocr_blocks",
        body="""
SELECT p.page_id, p.status, o.blocks, o.titleblocks FROM pages_meta p
LEFT JOIN (SELECT page_id, COUNT(*) AS blocks, COUNT(*) FILTER (kind = 'titleblock_text') AS titleblocks FROM ocr_blocks
           GROUP BY page_id) o ON o.page_id = p.page_id""",
    ),
)
def j3(src: Source) -> DataFrame:
    return ocr.attach_ocr(src["pages_meta"].select("page_id", "status"), src["ocr_blocks"])


@query(
    "f2_sql_functions",
    oracle_with(
        "ocr_blocks",
        body=f"SELECT kind, COUNT(*) AS n, ROUND(SUM(value), 6) AS total FROM ({_PARSED}) p GROUP BY kind",
    ),
)
def f2(src: Source) -> DataFrame:
    from draftlake.functions.sql import register_sql_functions

    register_sql_functions(src.spark)
    return src.spark.sql(
        "SELECT d.kind AS kind, COUNT(*) AS n, ROUND(SUM(d.value), 6) AS total FROM "
        "(SELECT parse_dimension(text) AS d FROM {blocks}) GROUP BY d.kind",
        blocks=src["ocr_blocks"].select("text"),
    )


# ----------------------------------------------------------------- ingest side
_EXT = r"REGEXP_EXTRACT(LOWER(name), '(\.tar\.(?:gz|bz2|xz)|\.[^.]*)$', 1)"
_MAGIC = [
    ("89504E470D0A1A0A%", "image", ""),
    ("FFD8FF%", "image", ""),
    ("424D%", "image", ""),
    ("49492A00%", "image", ""),
    ("52494646________57454250%", "image", ""),
    ("255044462D%", "pdf", ""),
    ("504B0304%", "archive", "zip"),
    ("504B0506%", "archive", "zip"),
    ("377ABCAF271C%", "archive", "7z"),
    ("526172211A0700%", "archive", "rar"),
    ("1F8B%", "archive", "tar.gz"),
    ("425A68%", "archive", "tar.bz2"),
    ("FD377A585A00%", "archive", "tar.xz"),
]
_BY_MAGIC = " ".join(f"WHEN head_hex LIKE '{m}' THEN '{k}:{f}'" for m, k, f in _MAGIC)
_BY_EXT = " ".join(f"WHEN {_EXT} = '{e}' THEN 'archive:{f}'" for e, f in ingest.ARCHIVE_SUFFIX)


@query(
    "p1_detect_kind",
    oracle_with(
        "uploads",
        body=f"""
SELECT upload_id, CASE {_BY_MAGIC} WHEN LENGTH(head_hex) >= 530 AND SUBSTRING(head_hex, 515, 10) = '7573746172' THEN 'archive:tar'
  {_BY_EXT} WHEN {_EXT} = '.pdf' THEN 'pdf:' WHEN {_EXT} IN ('.png', '.jpg', '.jpeg', '.tif', '.tiff', '.webp', '.bmp') THEN 'image:' ELSE 'unknown:' END AS kind
FROM uploads""",
    ),
)
def p1(src: Source) -> DataFrame:
    found = ingest.detect_kind(F.unhex("head_hex"), F.col("name"))
    return (
        src["uploads"]
        .withColumn("d", found)
        .select("upload_id", F.concat_ws(":", "d.kind", "d.archive_format").alias("kind"))
    )


@query(
    "p2_mime_of",
    oracle_with(
        "files_meta",
        body="""
SELECT file_id, CASE WHEN declared_type NOT IN ('', 'application/octet-stream') THEN declared_type
  WHEN LOWER(original_name) LIKE '%.pdf' THEN 'application/pdf' WHEN LOWER(original_name) LIKE '%.png' THEN 'image/png'
  WHEN LOWER(original_name) LIKE '%.gz' THEN 'application/gzip' ELSE 'application/octet-stream' END AS mime FROM files_meta""",
    ),
)
def p2(src: Source) -> DataFrame:
    return src["files_meta"].select("file_id", ingest.mime_of(F.col("declared_type"), F.col("original_name")).alias("mime"))


@query(
    "p3_storage_key",
    oracle_with(
        "artifacts",
        body="""
SELECT artifact_id, 'pages/' || page_id || '/' || kind AS key, CASE WHEN artifact_id % 3 = 0 THEN NULL WHEN artifact_id % 3 = 1 THEN 'pages/' || CAST(artifact_id AS VARCHAR) ELSE 'bare/' || kind END AS parsed,
       CASE WHEN artifact_id % 3 = 0 THEN 'bucket_mismatch' END AS violation
FROM artifacts""",
    ),
)
def p3(src: Source) -> DataFrame:
    number = F.col("artifact_id") % 3
    uri = (
        F.when(number == 0, F.regexp_replace("uri", "bucket", "other"))
        .when(number == 1, F.col("uri"))
        .otherwise(F.concat(F.lit("/bare/"), "kind"))
    )
    return (
        src["artifacts"]
        .withColumn("u", ingest.parse_uri(uri, "bucket"))
        .select(
            "artifact_id",
            ingest.storage_key(F.lit("/pages/"), F.col("page_id"), F.lit(""), F.col("kind")).alias("key"),
            F.col("u.key").alias("parsed"),
            F.col("u.violation").alias("violation"),
        )
    )


# Clean "x/../" pairs a few times; enough for the names in the table.
_STEP = r"REGEXP_REPLACE({}, '(^|/)([^/.][^/]*|\.[^/.][^/]*)/\.\.(/|$)', '\1', 'g')"
_FLAT = r"REGEXP_REPLACE(REGEXP_REPLACE(name, '/+', '/', 'g'), '(^|/)(\./)+', '\1', 'g')"
_CLEAN = _STEP.format(_STEP.format(_STEP.format(_FLAT)))
_VIOLATION = rf"""
CASE WHEN type IN ('symlink', 'hardlink') THEN 'link' WHEN name = '' THEN 'empty'
     WHEN name LIKE '/%' OR SUBSTRING(name, 1, 1) = CHR(92) OR SUBSTRING(name, 2, 1) = ':' THEN 'absolute'
     WHEN REGEXP_MATCHES({_CLEAN}, '(^|/)\.\.') THEN 'traversal' END"""


@query(
    "p4_entry_violation",
    oracle_with("archive_entries", body=f"SELECT archive_id, ord, name, {_VIOLATION} AS violation FROM archive_entries"),
)
def p4(src: Source) -> DataFrame:
    return src["archive_entries"].select(
        "archive_id", "ord", "name", ingest.entry_violation(F.col("name"), F.col("type")).alias("violation")
    )


@query(
    "w4_archive_audit",
    oracle_with(
        "archive_entries",
        body=f"""
, run AS (SELECT *, SUM(1) OVER w AS n_files, SUM(size) OVER w AS n_bytes, {_VIOLATION} AS path_violation FROM archive_entries
  WINDOW w AS (PARTITION BY archive_id ORDER BY ord)),
judged AS (SELECT *, CASE WHEN depth > 8 THEN 'depth' WHEN n_files > 35 THEN 'files' WHEN path_violation IS NOT NULL THEN path_violation
  WHEN n_bytes > 700000 THEN 'bytes' END AS violation FROM run)
SELECT archive_id, COUNT(*) AS entries, CAST(SUM(size) AS BIGINT) AS total_bytes, MIN(ord) FILTER (violation IS NOT NULL) AS stopped_at,
       ARG_MIN(violation, ord) FILTER (violation IS NOT NULL) AS violation FROM judged GROUP BY archive_id""",
    ),
)
def w4(src: Source) -> DataFrame:
    # Limits small enough to be hit by the derived archives.
    return archive.archive_audit(src["archive_entries"], max_files=35, max_bytes=700_000)
