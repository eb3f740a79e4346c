"""Stored objects through Python data sources: first bytes of files, gray page images.

Both go through Arrow's file systems, so any store with an Arrow URI works.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FILES_PER_TASK = 1000
# ---------------------------------------------------------------- fixed values
HEAD_BYTES = 512
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
BLANK = 255
# ---------------------------------------------------------- end of fixed values


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _hidden(name: str) -> bool:
    return name.startswith(("_", "."))


# ------------------------------------------------------------------ first bytes
@dataclass
class _Listing(InputPartition):
    """Files by path, or a folder that the task lists with all below it."""

    files: list[str]
    folder: str | None = None


class _HeadReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.uri, self.glob = options["path"], options.get("glob", "*")

    def partitions(self) -> list[_Listing]:
        """The driver lists one level; every folder on it is listed by its own task."""
        store, root = _opened(self.uri)
        found = [i for i in store.get_file_info(fs.FileSelector(root)) if not _hidden(i.base_name)]
        plain = sorted(i.path for i in found if i.is_file)
        parts = [_Listing(plain[k : k + FILES_PER_TASK]) for k in range(0, len(plain), FILES_PER_TASK)]
        return parts + [_Listing([], i.path) for i in found if i.type == fs.FileType.Directory] or [_Listing([])]

    def read(self, part: _Listing) -> Iterator[tuple]:
        store, root = _opened(self.uri)
        if part.folder is None:
            infos = store.get_file_info(part.files)
        else:
            infos = store.get_file_info(fs.FileSelector(part.folder, recursive=True))
        for info in infos:
            inside = info.path[len(root) :].strip("/").split("/")
            if not info.is_file or any(map(_hidden, inside)) or not fnmatch(info.base_name, self.glob):
                continue
            with store.open_input_file(info.path) as body:
                yield info.path, info.mtime, info.size, body.read(HEAD_BYTES)


class FileHeads(DataSource):
    """path, modified, length, content; ``content`` holds the first 512 bytes only."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, modified timestamp, length long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _HeadReader(dict(self.options))


def scan_heads(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Like ``scan_files`` with the first 512 bytes of every file; nothing more is read.

    Files and folders whose names begin with ``_`` or ``.`` are left out, as Spark's own
    sources do.  Empty files, which ``scan_files`` leaves out, have empty content; an empty
    folder gives an empty table.
    """
    spark.dataSource.register(FileHeads)
    return spark.read.format(FileHeads.name()).option("glob", glob).load(folder)


# ------------------------------------------------------------------ page images
def _png_chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


class _Page:
    """One page written line by line under a hidden name, renamed once it is whole."""

    def __init__(self, store: fs.FileSystem, root: str, page: str, width: int, height: int) -> None:
        self.store, self.width, self.height, self.next = store, width, height, 0
        self.target = f"{root}/{quote(page, safe='')}.png"
        self.draft = f"{root}/_{uuid.uuid4().hex}"
        self.out, self.pack = store.open_output_stream(self.draft), zlib.compressobj(1)
        self.blank = b"\0" + bytes([BLANK]) * width  # a line begins with its filter, none
        self.out.write(PNG_MAGIC + _png_chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)))

    def _emit(self, body: bytes) -> None:
        if body:
            self.out.write(_png_chunk(b"IDAT", body))

    def line(self, y: int, xs: np.ndarray, values: np.ndarray) -> None:
        if not self.next <= y < self.height:
            return
        self.skip_to(y)
        inside = (xs >= 0) & (xs < self.width)
        row = np.full(self.width, BLANK, np.uint8)
        row[xs[inside]] = np.clip(values[inside], 0, 255)
        self._emit(self.pack.compress(b"\0" + row.tobytes()))
        self.next = y + 1

    def skip_to(self, y: int) -> None:
        while self.next < y:
            self._emit(self.pack.compress(self.blank))
            self.next += 1

    def close(self) -> None:
        self.skip_to(self.height)
        self._emit(self.pack.flush())
        self.out.write(_png_chunk(b"IEND", b""))
        self.out.close()
        self.store.move(self.draft, self.target)


class _ImageWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.uri = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _opened(self.uri)
        store.create_dir(root, recursive=True)
        page, name = None, None
        for batch in iterator:
            ids, ys = batch.column("page_id").to_pylist(), batch.column("y").to_numpy()
            dots = batch.column("dots")
            widths, heights = (batch.column(c).to_pylist() for c in ("width", "height"))
            for k, own in enumerate(ids):
                if ys[k] < 0:  # the row with the page's size comes first
                    if own == name:
                        continue
                    if page:
                        page.close()
                    name, page = own, _Page(store, root, own, widths[k], heights[k])
                elif own == name:
                    line = dots[k].values
                    xs, values = (line.field(c).to_numpy(zero_copy_only=False) for c in ("x", "v"))
                    page.line(int(ys[k]), xs, values)
        if page:
            page.close()
        return WriterCommitMessage()


class GrayImages(DataSource):
    """Sink of ``write_images``."""

    @classmethod
    def name(cls) -> str:
        return "gray_images"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _ImageWriter(dict(self.options))


def write_images(pixels: DataFrame, sizes: DataFrame, folder: str) -> None:
    """One gray PNG per page of ``sizes``, which ``scan_pixels`` reads back.

    ``pixels``: page_id, x, y, v; ``sizes``: page_id, width, height.  Pixels that are missing
    or null are white, of repeated ones the largest value stays, those outside the size
    are left out, as are pages without a size; values are cut to 0..255.  Page ids are
    percent-encoded in file names.  A page streams through its task line by line.  A
    repeated task or run replaces whole files.
    """
    spark = pixels.sparkSession
    spark.dataSource.register(GrayImages)
    known = pixels.where(F.col("page_id").isNotNull() & F.col("x").isNotNull() & F.col("y").between(0, 2**31 - 1) & F.col("v").isNotNull())
    dot = F.struct(F.col("x").cast("int").alias("x"), F.col("v").cast("int").alias("v"))
    lines = known.groupBy("page_id", F.col("y").cast("int").alias("y")).agg(F.array_sort(F.collect_list(dot)).alias("dots"))
    none = F.lit(None)
    lines = lines.select("page_id", "y", none.cast("int").alias("width"), none.cast("int").alias("height"), "dots")
    real = sizes.where(F.col("page_id").isNotNull() & (F.col("width") > 0) & (F.col("height") > 0))
    heads = real.groupBy("page_id").agg(F.max("width").cast("int").alias("width"), F.max("height").cast("int").alias("height"))
    heads = heads.select("page_id", F.lit(-1).alias("y"), "width", "height", none.cast("array<struct<x:int,v:int>>").alias("dots"))
    rows = heads.unionByName(lines).repartition("page_id").sortWithinPartitions("page_id", "y")
    rows.write.format(GrayImages.name()).mode("append").save(folder)
