"""Raw files, page images, archives."""

from __future__ import annotations

import bz2
import gzip
import hashlib
import io
import lzma
import tarfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.functions import ingest
from draftlake.operators import archive

CHUNK_PIXELS = 1 << 20
UNPACK_ROWS = 1000
UNPACK_BYTES = 16 << 20
# ---------------------------------------------------------------- fixed values
LUMA_BGR = (0.114, 0.587, 0.299)
UNPACKED = {"zip", "tar", "tar.gz", "tar.bz2", "tar.xz"}
# ---------------------------------------------------------- end of fixed values


def scan_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Stored objects: path, modified, length, content.  Drop ``content`` to list only."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("modificationTime").alias("modified"), "length", "content")


def classify_files(files: DataFrame) -> DataFrame:
    """Kind and archive format of scanned files, by leading bytes and name."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = ingest.detect_kind(F.substring("content", 1, 512), name)
    return files.withColumn("name", name).withColumn("_k", kind).select(
        "*", F.col("_k.kind").alias("kind"), F.col("_k.archive_format").alias("archive_format")
    ).drop("_k")


def _gray(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            flat = np.frombuffer(row.data, dtype=np.uint8).reshape(row.height * row.width, row.channels)
            if row.channels == 1:
                gray = flat[:, 0]
            else:
                gray = np.rint(flat[:, :3].astype(np.float64) @ np.array(LUMA_BGR)).astype(np.uint8)
            for start in range(0, len(gray), CHUNK_PIXELS):
                at = np.arange(start, min(start + CHUNK_PIXELS, len(gray)))
                yield pd.DataFrame(
                    {
                        "page_id": row.page_id,
                        "x": (at % row.width).astype(np.int32),
                        "y": (at // row.width).astype(np.int32),
                        "v": gray[at].astype(np.int32),
                    }
                )


def _images(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    images = (
        spark.read.format("image")
        .option("dropInvalid", "false")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    return images.select("image.origin", "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def scan_pixels(spark: SparkSession, folder: str, glob: str = "*.png") -> DataFrame:
    """Gray pixels of page images of any size; the page id is the file name without its suffix.

    Spark's image source decodes in the JVM; the numpy step emits bounded chunks.  Files
    that cannot be decoded have no pixels, ``undecodable`` lists them.
    """
    page = F.regexp_replace(F.element_at(F.split("origin", "/"), -1), r"\.[^.]*$", "").alias("page_id")
    named = _images(spark, folder, glob).where(F.col("width") > 0).select(page, "width", "height", "channels", "data")
    return named.mapInPandas(_gray, "page_id string, x int, y int, v int")


def undecodable(spark: SparkSession, folder: str, glob: str = "*.png") -> DataFrame:
    """(path, reason) of the page images that ``scan_pixels`` has no pixels of."""
    bad = _images(spark, folder, glob).where(~(F.col("width") > 0))
    return bad.select(F.col("origin").alias("path"), F.lit("not a readable image").alias("reason"))


# -------------------------------------------------------------------- archives
CHILD_SCHEMA = (
    "archive_id string, file_id string, ord long, name string, type string, size long, depth int, content binary, error string"
)


def _members(fmt: str, body: bytes) -> Iterator[tuple[str, str, int, object]]:
    """(name, type, size, reader) of every non-directory entry, in archive order."""
    if fmt == "zip":
        with zipfile.ZipFile(io.BytesIO(body)) as box:
            for info in box.infolist():
                if info.is_dir():
                    continue
                link = (info.external_attr >> 16) & 0o170000 == 0o120000
                yield info.filename, "symlink" if link else "file", info.file_size, lambda info=info: box.open(info)
        return
    opened = {"tar": io.BytesIO, "tar.gz": lambda b: gzip.GzipFile(fileobj=io.BytesIO(b))}
    opened["tar.bz2"] = lambda b: bz2.BZ2File(io.BytesIO(b))
    opened["tar.xz"] = lambda b: lzma.LZMAFile(io.BytesIO(b))
    with tarfile.open(fileobj=opened[fmt](body), mode="r|") as box:
        for info in box:
            if info.issym() or info.islnk():
                yield info.name, "symlink" if info.issym() else "hardlink", 0, None
            elif info.isfile():
                yield info.name, "file", info.size, lambda info=info: box.extractfile(info)


def _unpack(batches: Iterator[pd.DataFrame], max_files: int, max_bytes: int) -> Iterator[pd.DataFrame]:
    """One row per entry, or one row with an error for an archive that cannot be read.

    Rows leave in frames of at most UNPACK_ROWS rows, and UNPACK_BYTES or one entry more.
    """
    rows, load = [], 0

    def closed() -> pd.DataFrame:
        nonlocal rows, load
        out = pd.DataFrame(rows, columns=["archive_id", "file_id", "ord", "name", "type", "size", "depth", "content", "error"])
        rows, load = [], 0
        return out

    for pdf in batches:
        for row in pdf.itertuples(index=False):
            count = total = 0
            try:
                for name, kind, size, reader in _members(row.archive_format, row.content):
                    count, total = count + 1, total + size
                    # Content stays out once a limit is passed; the audit then names the violation.
                    body = reader().read(size) if reader and count <= max_files and total <= max_bytes else None
                    child = hashlib.md5(f"{row.file_id}/{count}/{name}".encode()).hexdigest()
                    rows.append((row.file_id, child, count, name, kind, size, row.depth, body, None))
                    load += len(body or b"")
                    if len(rows) >= UNPACK_ROWS or load >= UNPACK_BYTES:
                        yield closed()
                    if count > max_files or total > max_bytes:
                        break
            except (OSError, ValueError, EOFError, RuntimeError, zipfile.BadZipFile, tarfile.TarError, lzma.LZMAError) as exc:
                rows.append((row.file_id, None, 0, None, "archive", 0, row.depth, None, f"{type(exc).__name__}: {exc}"))
    if rows:
        yield closed()


def expand_archives(
    files: DataFrame,
    max_depth: int = archive.MAX_DEPTH,
    max_files: int = archive.MAX_FILES,
    max_bytes: int = archive.MAX_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(children, failed archives) of all archives, nested ones included.

    ``files``: file_id, name, content.  One archive with any violation yields no
    children.  Each nesting level is one round over the rows that are still archives.
    """
    from draftlake.session import settle

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _unpack(batches, max_files, max_bytes)

    def kinds(df: DataFrame) -> DataFrame:
        kind = ingest.detect_kind(F.substring("content", 1, 512), F.col("name"))
        return df.withColumn("_k", kind).select(
            "*", F.col("_k.kind").alias("kind"), F.col("_k.archive_format").alias("archive_format")
        ).drop("_k")

    level = kinds(files.select("file_id", "name", "content", F.lit(0).alias("depth")))
    children, failed, depth = None, None, 1
    while True:
        boxes = level.where(F.col("kind") == "archive").withColumn("depth", F.lit(depth))
        known = F.col("archive_format").isin(*UNPACKED)
        late = boxes.where(known) if depth > max_depth else boxes.where(~known)
        why = "depth" if depth > max_depth else "unsupported"
        bad = late.select(F.col("file_id").alias("archive_id"), F.lit(why).alias("violation"))
        if depth > max_depth:
            return children, failed.unionByName(bad)
        rows = settle(
            boxes.where(known).select("file_id", "archive_format", "depth", "content").mapInPandas(unpack, CHILD_SCHEMA)
        )
        listed = rows.where(F.col("error").isNull())
        audit = archive.archive_audit(listed, max_files, max_bytes, max_depth)
        broken = (
            audit.where(F.col("violation").isNotNull())
            .select("archive_id", "violation")
            .unionByName(rows.where(F.col("error").isNotNull()).select("archive_id", F.col("error").alias("violation")))
        )
        bad = settle(bad.unionByName(broken))
        good = settle(kinds(listed.join(bad.select("archive_id").distinct(), "archive_id", "left_anti").drop("error")))
        children = good if children is None else children.unionByName(good)
        failed = bad if failed is None else failed.unionByName(bad)
        level, depth = good, depth + 1
        if level.where(F.col("kind") == "archive").isEmpty():
            return children, failed


def archive_events(children: DataFrame, bucket: str, batch_id: str = "batch_id") -> DataFrame:
    """One ``archive.extracted`` envelope per unpacked file."""
    suffix = ingest.extension(F.col("name"))
    key = ingest.storage_key(
        F.lit("raw_extracted"),
        F.col(batch_id) if batch_id in children.columns else F.lit("unknown"),
        F.col("archive_id"),
        F.concat("file_id", suffix),
    )
    return children.select(
        F.md5(F.concat(F.lit("archive:"), "file_id")).alias("event_id"),
        F.lit("archive.extracted").alias("event_type"),
        "file_id",
        F.concat(F.lit(f"s3://{bucket}/"), key).alias("artifact_uri"),
        F.lit(1).alias("attempt"),
        F.to_json(F.struct(F.col("name").alias("original_name"), F.col("archive_id").alias("parent_file_id"))).alias("payload"),
    )
