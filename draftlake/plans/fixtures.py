"""Domain tables derived from the driver's parquet tables.

One SQL text per table, valid in Spark and DuckDB, so both sides of a check
start from the same rows.  The number of pages, files and batches grows with
the data: a page is a range of order, customer or user keys, not a remainder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.session import bound_tasks

# (l_orderkey, l_linenumber) repeats in the driver's data; ids must not.  Every row stays and
# is numbered inside its order; rows that are equal in all columns may swap numbers.
_LINES = """
(SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_discount, l_tax,
        CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax) AS BIGINT) AS l_linenumber
 FROM {lineitem})
"""

_PAGE_OF_ORDER = "'p' || CAST(CAST(FLOOR(l_orderkey / 100) AS BIGINT) AS STRING)"

_OCR_TEXT = """
CASE (l_orderkey + l_linenumber) % 22
  WHEN 0 THEN 'Ø' || q || 'H11' WHEN 1 THEN 'R' || q WHEN 2 THEN 'M' || q || 'x1.5' WHEN 3 THEN q || '±0,2'
  WHEN 4 THEN '1×45°' WHEN 5 THEN q || ' отв. Ø10' WHEN 6 THEN 'Сталь 45 ГОСТ 1050-88 Ra 1,6'
  WHEN 7 THEN q || '-0.1' WHEN 8 THEN 'note ' || q || ' ###' WHEN 9 THEN 'Ф' || q
  WHEN 10 THEN '  M' || q || ' ' WHEN 11 THEN 'H' || CAST(l_linenumber AS STRING) WHEN 12 THEN q || 'js6'
  WHEN 13 THEN '2 holes Ø' || q || ' ±0.1' WHEN 14 THEN q || ' мм' WHEN 15 THEN 'R' || q || ' +0.2'
  WHEN 16 THEN '⌀ ' || q || ' - 0,05' WHEN 17 THEN q || '+0.2' WHEN 18 THEN '' WHEN 19 THEN '3х45°'
  WHEN 20 THEN 'Bronze, Steel 20 mass 0.42 kg Rz 6.3 гост 2590-2006' ELSE q || '.5' END
"""

# table -> (source tables, SQL)
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "envelopes": (
        ("events",),
        """
SELECT CAST(event_id AS STRING) AS event_id,
       CASE event_type
         WHEN 'view' THEN CASE event_id % 5 WHEN 0 THEN 'page.extracted' WHEN 1 THEN 'page.ocr.requested'
              WHEN 2 THEN 'page.geometry.requested' WHEN 3 THEN 'page.qa.requested' ELSE 'page.export.requested' END
         WHEN 'click' THEN CASE event_id % 2 WHEN 0 THEN 'page.preprocessed' ELSE 'page.ocr.done' END
         WHEN 'signup' THEN CASE event_id % 3 WHEN 0 THEN 'file.uploaded' WHEN 1 THEN 'archive.extracted' ELSE 'page.geometry.done' END
         WHEN 'purchase' THEN CASE event_id % 2 WHEN 0 THEN 'page.qa.done' ELSE 'page.export.done' END
         ELSE CASE event_id % 3 WHEN 0 THEN 'page.failed' WHEN 1 THEN 'page.review.required' ELSE 'page.discarded_specification' END
       END AS event_type,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE 'b' || CAST(CAST(FLOOR(user_id / 15) AS BIGINT) AS STRING) END AS batch_id,
       CASE WHEN event_id % 7 = 0 THEN '' ELSE 'f' || CAST(CAST(FLOOR(user_id / 3) AS BIGINT) AS STRING) END AS file_id,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'p' || CAST(user_id AS STRING) END AS page_id,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE 's3://bucket/pages/' || CAST(event_id AS STRING) END AS artifact_uri,
       CAST(1 + event_id % 6 AS INT) AS attempt, ts AS created_at, props AS payload
FROM {events}
""",
    ),
    "raw_events": (
        ("events",),
        """
SELECT event_id AS row_id,
       CASE event_id % 12
         WHEN 0 THEN '{{}}'
         WHEN 1 THEN 'not json ' || CAST(event_id AS STRING)
         WHEN 2 THEN '{{"event_id":"' || CAST(event_id AS STRING) || '","event_type":"page.extracted","attempt":0,"created_at":"2024-01-01T00:00:00Z"}}'
         WHEN 3 THEN '{{"event_id":"' || CAST(event_id AS STRING) || '","event_type":"","attempt":1,"created_at":"2024-01-01T00:00:00Z"}}'
         WHEN 4 THEN '{{"event_id":"' || CAST(event_id AS STRING) || '","event_type":"page.extracted","attempt":1}}'
         ELSE '{{"event_id":"' || CAST(event_id AS STRING) || '","event_type":"page.extracted","page_id":"p' || CAST(user_id AS STRING)
              || '","attempt":' || CAST(1 + event_id % 6 AS STRING) || ',"created_at":"2024-01-01T00:00:00Z","payload":' || props || '}}'
       END AS raw
FROM {events}
""",
    ),
    "pages_meta": (
        ("events",),
        """
SELECT 'p' || CAST(u AS STRING) AS page_id, 'f' || CAST(CAST(FLOOR(u / 3) AS BIGINT) AS STRING) AS file_id,
       'b' || CAST(CAST(FLOOR(u / 15) AS BIGINT) AS STRING) AS batch_id,
       CASE WHEN u % 17 = 0 THEN NULL ELSE CAST(u % 3 AS INT) END AS page_index,
       CASE (u * 7 + CAST(FLOOR(u / 10) AS INT)) % 5 WHEN 0 THEN 'assembly_drawing' WHEN 1 THEN 'specification_sheet' WHEN 2 THEN 'unknown' ELSE 'detail_drawing' END AS page_type,
       CASE (u + CAST(FLOOR(u / 10) AS INT)) % 6 WHEN 0 THEN 'exported' WHEN 1 THEN 'review_required' WHEN 2 THEN 'failed' WHEN 3 THEN 'skipped' WHEN 4 THEN 'qa_done' ELSE 'preprocessed' END AS status,
       CASE WHEN u % 9 = 0 THEN NULL ELSE CAST(600 AS INT) END AS width_px, CASE WHEN u % 9 = 0 THEN NULL ELSE CAST(400 AS INT) END AS height_px,
       CASE WHEN u % 4 = 0 THEN NULL ELSE CAST(200 + u % 5 AS INT) END AS dpi,
       CASE WHEN u % 5 = 0 THEN '' ELSE 's3://bucket/raw/' || CAST(u AS STRING) END AS raw_image_uri,
       '{{"k":' || CAST(u AS STRING) || ',"dpi":"none"}}' AS metadata,
       first_ts AS created_at
FROM (SELECT user_id AS u, MIN(ts) AS first_ts FROM {events} GROUP BY user_id) t
""",
    ),
    "files_meta": (
        ("events",),
        """
SELECT 'f' || CAST(f AS STRING) AS file_id, 'b' || CAST(CAST(FLOOR(f / 5) AS BIGINT) AS STRING) AS batch_id,
       CASE f % 4 WHEN 0 THEN 'dir/sheet' || CAST(f AS STRING) || '.PDF' WHEN 1 THEN 'scan' || CHR(92) || CAST(f AS STRING) || '.png'
            WHEN 2 THEN '' ELSE 'set' || CAST(f AS STRING) || '.tar.gz' END AS original_name,
       CASE f % 3 WHEN 0 THEN '' WHEN 1 THEN 'application/octet-stream' ELSE 'image/png' END AS declared_type,
       CAST(total AS BIGINT) AS size_bytes,
       CASE f % 4 WHEN 0 THEN 'extracted' WHEN 1 THEN 'uploaded' WHEN 2 THEN 'extracted' ELSE 'failed' END AS status,
       first_ts AS created_at
FROM (SELECT CAST(FLOOR(user_id / 3) AS BIGINT) AS f, MIN(ts) AS first_ts, SUM(CAST(FLOOR(value * 100) AS BIGINT)) AS total
      FROM {events} GROUP BY CAST(FLOOR(user_id / 3) AS BIGINT)) t
""",
    ),
    "batches_meta": (
        ("events",),
        """
SELECT 'b' || CAST(b AS STRING) AS batch_id, 'batch ' || CAST(b AS STRING) AS name,
       CASE b % 3 WHEN 0 THEN 'created' WHEN 1 THEN 'processing' ELSE 'ready' END AS status, first_ts AS created_at
FROM (SELECT CAST(FLOOR(user_id / 15) AS BIGINT) AS b, MIN(ts) AS first_ts FROM {events}
      GROUP BY CAST(FLOOR(user_id / 15) AS BIGINT)) t
""",
    ),
    "artifacts": (
        ("orders",),
        """
SELECT o_orderkey AS artifact_id, 'p' || CAST(CAST(FLOOR(o_custkey / 10) AS BIGINT) AS STRING) AS page_id,
       CASE o_orderkey % 5 WHEN 0 THEN 'dxf' WHEN 1 THEN 'preview' WHEN 2 THEN 'normalized' WHEN 3 THEN 'cad_json' ELSE 'raw' END AS kind,
       's3://bucket/pages/' || CAST(o_orderkey AS STRING) AS uri, o_orderdate AS created_at
FROM {orders}
""",
    ),
    "qa_metrics": (
        ("orders",),
        """
SELECT o_orderkey AS qa_id, 'p' || CAST(CAST(FLOOR(o_custkey / 10) AS BIGINT) AS STRING) AS page_id,
       CAST(70 + o_orderkey % 31 AS DOUBLE) / 100 AS raster_iou, CAST((o_orderkey * 7 + o_custkey) % 15 AS DOUBLE) / 2 AS chamfer_px,
       CAST(o_orderkey % 14 AS DOUBLE) AS hausdorff_px, CAST(o_custkey * 5 % 6 AS INT) AS low_confidence_count, o_orderdate AS created_at
FROM {orders}
""",
    ),
    "uploads": (
        ("orders",),
        """
SELECT o_orderkey AS upload_id,
       CASE o_orderkey % 19
         WHEN 0 THEN '89504E470D0A1A0A0000' WHEN 1 THEN '255044462D312E37' WHEN 2 THEN '504B0304AA' WHEN 3 THEN '504B0506'
         WHEN 4 THEN '377ABCAF271C00' WHEN 5 THEN '526172211A0700FF' WHEN 6 THEN '1F8B0800' WHEN 7 THEN '425A6839'
         WHEN 8 THEN 'FD377A585A0000' WHEN 9 THEN REPEAT('00', 257) || '7573746172' || REPEAT('00', 10)
         WHEN 10 THEN '49492A0008' WHEN 11 THEN '52494646000000005745425056503820' WHEN 12 THEN 'FFD8FFE0' WHEN 13 THEN '424D0000'
         WHEN 14 THEN REPEAT('00', 257) || '7573746172' WHEN 15 THEN '504B' ELSE '4142430000' END AS head_hex,
       'f' || CAST(o_custkey AS STRING) || CASE o_custkey % 13 WHEN 0 THEN '.PDF' WHEN 1 THEN '.tar.gz' WHEN 2 THEN '.png' WHEN 3 THEN '.txt'
         WHEN 4 THEN '.tgz' WHEN 5 THEN '.7z' WHEN 6 THEN '.tar.bz2' WHEN 7 THEN '.TIFF' WHEN 8 THEN '.rar' WHEN 9 THEN '.txz' WHEN 10 THEN '' WHEN 11 THEN '.tar' ELSE '.zip' END AS name
FROM {orders}
""",
    ),
    "ocr_blocks": (
        ("lineitem",),
        f"""
SELECT CAST(l_orderkey * 100 + l_linenumber AS STRING) AS block_id, {_PAGE_OF_ORDER} AS page_id,
       {_OCR_TEXT} AS text,
       CASE WHEN (l_orderkey + l_linenumber) % 22 IN (6, 20) THEN 'titleblock_text'
            WHEN (l_orderkey + l_linenumber) % 22 = 8 AND l_linenumber > 3 THEN 'dimension_text' ELSE 'unknown' END AS kind,
       CAST(l_partkey % 600 AS DOUBLE) AS x1, CAST(l_suppkey % 400 AS DOUBLE) AS y1,
       CAST(l_partkey % 600 + 40 AS DOUBLE) AS x2, CAST(l_suppkey % 400 + 12 AS DOUBLE) AS y2, l_tax * 10 AS confidence
FROM (SELECT *, CAST(CAST(l_quantity AS INT) AS STRING) AS q FROM {_LINES} d) t
""",
    ),
    "segments": (
        ("lineitem",),
        f"""
SELECT l_orderkey * 100 + l_linenumber AS seg_id, {_PAGE_OF_ORDER} AS page_id,
       CAST(l_partkey * 13 % 600 AS DOUBLE) AS x1, CAST(l_suppkey * 37 % 400 AS DOUBLE) AS y1,
       CAST((CASE WHEN l_linenumber <= 3 THEN l_partkey * 13 % 600 + 5 + l_partkey % 40 ELSE l_partkey * 7 % 600 END) AS DOUBLE) AS x2,
       CAST((l_suppkey * 37 + l_linenumber) % 400 AS DOUBLE) AS y2,
       l_discount * 60 AS rms_px, CAST(l_quantity AS INT) AS inliers
FROM {_LINES} t
""",
    ),
    "chain_points": (
        ("lineitem",),
        f"""
SELECT {_PAGE_OF_ORDER} AS page_id, CAST(FLOOR(l_orderkey / 20) AS BIGINT) AS chain_id, l_orderkey * 100 + l_linenumber AS ord,
       100 + (20 + CAST(FLOOR(l_orderkey / 20) AS BIGINT) % 40) * COS(RADIANS(CAST((l_orderkey * 100 + l_linenumber) * 7 % 300 AS DOUBLE))) + (l_partkey % 3 - 1) * 0.2 AS x,
       200 + (20 + CAST(FLOOR(l_orderkey / 20) AS BIGINT) % 40) * SIN(RADIANS(CAST((l_orderkey * 100 + l_linenumber) * 7 % 300 AS DOUBLE))) AS y
FROM {_LINES} t
""",
    ),
    "primitives": (
        ("lineitem",),
        f"""
SELECT 'n' || CAST(l_orderkey * 100 + l_linenumber AS STRING) AS id, {_PAGE_OF_ORDER} AS page_id,
       CASE (l_orderkey + l_linenumber) % 7 WHEN 0 THEN 'LINE' WHEN 1 THEN 'CIRCLE' WHEN 2 THEN 'ARC' WHEN 3 THEN 'TEXT' WHEN 4 THEN NULL ELSE 'LINE' END AS type,
       CASE l_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '04_CENTER_AXIS' WHEN 2 THEN '99_RASTER_REFERENCE' WHEN 3 THEN 'EXTRA' ELSE '02_PART_VISIBLE' END AS layer,
       CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE CAST(l_suppkey % 11 AS DOUBLE) / 10 END AS confidence,
       CAST(l_partkey % 600 AS DOUBLE) AS x1, CAST(l_suppkey * 37 % 400 AS DOUBLE) AS y1,
       CAST(l_partkey * 7 % 600 AS DOUBLE) AS x2, CAST((l_suppkey * 37 + l_linenumber) % 400 AS DOUBLE) AS y2,
       CAST(l_quantity - 3 AS DOUBLE) AS radius, CAST(l_partkey % 360 AS DOUBLE) AS start_angle_deg, CAST(l_suppkey * 3 % 360 AS DOUBLE) AS end_angle_deg,
       CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'T' || CAST(l_partkey AS STRING) END AS text,
       CAST(l_quantity AS DOUBLE) AS height, CAST(l_suppkey % 90 AS DOUBLE) AS rotation_deg
FROM {_LINES} t
""",
    ),
    # Three clusters of dots per page, each across a border of 256-pixel tiles in both directions.
    "ink_a": (
        ("lineitem",),
        """
SELECT DISTINCT 'p' || CAST(CAST(FLOOR(l_orderkey / 500) AS BIGINT) AS STRING) AS page_id,
       CAST(224 + l_partkey % 64 + 256 * (CAST(FLOOR(l_partkey / 64) AS BIGINT) % 3) AS INT) AS x, CAST(232 + l_suppkey * 5 % 48 AS INT) AS y
FROM {lineitem}
""",
    ),
    "ink_b": (
        ("lineitem",),
        """
SELECT DISTINCT 'p' || CAST(CAST(FLOOR(l_orderkey / 500) AS BIGINT) AS STRING) AS page_id,
       CAST(224 + (l_partkey + l_linenumber % 2) % 64 + 256 * (CAST(FLOOR(l_partkey / 64) AS BIGINT) % 3) AS INT) AS x,
       CAST(232 + (l_suppkey * 5 + CAST(l_quantity AS INT) % 2) % 48 AS INT) AS y
FROM {lineitem}
""",
    ),
    "component_table": (
        ("lineitem",),
        """
SELECT 'p' || CAST(CAST(FLOOR(l_orderkey / 100) AS BIGINT) AS STRING) AS page_id, l_orderkey * 10 + l_linenumber AS comp,
       COUNT(*) * CAST(MIN(l_quantity) AS BIGINT) * 3 AS area,
       MIN(l_partkey) % 500 AS x0, MIN(l_suppkey) % 300 AS y0,
       MIN(l_partkey) % 500 + (CASE WHEN l_orderkey % 89 = 0 THEN 480 ELSE CAST(MIN(l_quantity) AS BIGINT) END) AS x1,
       MIN(l_suppkey) % 300 + (CASE WHEN l_orderkey % 89 = 0 THEN 330 ELSE MIN(l_linenumber) * 3 END) AS y1
FROM {lineitem} GROUP BY l_orderkey, l_linenumber
""",
    ),
    "break_centres": (
        ("orders",),
        """
SELECT 'p' || CAST(CAST(FLOOR(b / 5) AS BIGINT) AS STRING) AS page_id, b AS break_id,
       CAST(lo * 17 % 600 AS DOUBLE) AS x, CAST(hi * 29 % 400 AS DOUBLE) AS y
FROM (SELECT CAST(FLOOR(o_orderkey / 20) AS BIGINT) AS b, MIN(o_custkey) AS lo, MAX(o_custkey) AS hi
      FROM {orders} GROUP BY CAST(FLOOR(o_orderkey / 20) AS BIGINT)) t
""",
    ),
    "polyline_sizes": (
        ("orders",),
        """
SELECT 'p' || CAST(CAST(FLOOR(o_orderkey / 100) AS BIGINT) AS STRING) AS page_id, 'k' || CAST(o_orderkey AS STRING) AS id,
       o_orderkey AS a, o_custkey AS b, CAST(1 + o_custkey % 6 AS INT) AS n, o_custkey % 3 = 0 AS closed
FROM {orders}
""",
    ),
    "archive_entries": (
        ("lineitem",),
        f"""
SELECT CAST(FLOOR(l_orderkey / 10) AS BIGINT) AS archive_id, (l_orderkey % 10) * 100 + l_linenumber AS ord,
       CASE WHEN l_partkey % 97 = 0 THEN '../etc/' WHEN l_partkey % 89 = 0 THEN '/abs/' WHEN l_partkey % 83 = 0 THEN 'C:/' WHEN l_partkey % 79 = 0 THEN 'a/../'
            WHEN l_partkey % 73 = 0 THEN 'sub/../../etc/' WHEN l_partkey % 71 = 0 THEN 'dir/..foo/' WHEN l_partkey % 67 = 0 THEN './a//b/../' ELSE 'dir/' END
         || CAST(l_partkey AS STRING) || CASE l_partkey % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.tar.gz' WHEN 2 THEN '.png' ELSE '.txt' END AS name,
       CASE WHEN l_suppkey % 61 = 0 THEN 'symlink' ELSE 'file' END AS type,
       CAST(l_quantity AS BIGINT) * 1000 AS size, CAST(1 + CAST(FLOOR(l_orderkey / 10) AS BIGINT) % 10 AS INT) AS depth
FROM {_LINES} t
""",
    ),
    "pixels": (
        ("embeddings",),
        """
SELECT 'p' || CAST(CAST(FLOOR(vec_id / 50) AS BIGINT) AS STRING) AS page_id, x, CAST(vec_id % 50 AS INT) AS y,
       CAST(FLOOR(LEAST(GREATEST(128 + 600 * CAST(e AS DOUBLE), 0), 255)) AS INT) AS v
FROM {embeddings}
""",
    ),
    "page_sizes": (
        ("events",),
        """
SELECT 'p' || CAST(user_id AS STRING) AS page_id, CAST(600 + MIN(event_id) % 3 * 100 AS INT) AS width, CAST(400 + MIN(event_id) % 2 * 50 AS INT) AS height
FROM {events} GROUP BY user_id
""",
    ),
    "requests": (
        ("events",),
        """
SELECT event_id AS request_id, CASE event_id % 3 WHEN 0 THEN 'POST' ELSE 'GET' END AS method,
       CASE event_type WHEN 'view' THEN '/api/pages' WHEN 'click' THEN '/api/batches' WHEN 'signup' THEN '/api/upload' ELSE '/api/exports' END AS route,
       CAST(200 + (event_id % 4) * 100 + event_id % 5 AS INT) AS status, value / 50 AS seconds
FROM {events}
""",
    ),
}


@dataclass(frozen=True)
class Source:
    """Driver tables and derived tables of one scale-factor folder."""

    spark: SparkSession
    folder: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        inputs, text = TABLES[name]
        if name == "pixels":
            # A vector becomes one image row.
            rows = self.raw("embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
            return self.spark.sql(text, embeddings=rows)
        return self.spark.sql(text, **{i: self.raw(i) for i in inputs})


def open_source(spark: SparkSession, folder: str) -> Source:
    return Source(bound_tasks(spark), folder)


def oracle_with(*names: str, body: str) -> str:
    """``WITH`` clause defining derived tables over the pre-registered views, then ``body``."""
    parts = []
    for name in names:
        inputs, text = TABLES[name]
        views = {i: i for i in inputs}
        if name == "pixels":
            views = {
                "embeddings": "(SELECT vec_id, CAST(UNNEST(RANGE(LEN(embedding))) AS INT) AS x, UNNEST(embedding) AS e FROM embeddings) r"
            }
        parts.append(f"{name} AS ({text.format(**views)})")
    return "WITH " + ",\n".join(parts) + "\n" + body
