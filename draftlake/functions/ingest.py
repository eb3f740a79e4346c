"""Columns for incoming files: kind sniffing, MIME, keys, safe paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Leading bytes, as upper-case hex.
IMAGE_MAGIC = [
    "89504E470D0A1A0A",  # PNG
    "FFD8FF",  # JPEG
    "474946383761",  # GIF87a
    "474946383961",  # GIF89a
    "424D",  # BMP
    "00000100",  # ICO
    "00000200",  # CUR
    "49492A00",  # TIFF little endian
    "4D4D002A",  # TIFF big endian
]
PDF_MAGIC = "255044462D"
ARCHIVE_MAGIC = [
    ("504B0304", "zip"),
    ("504B0506", "zip"),
    ("504B0708", "zip"),
    ("377ABCAF271C", "7z"),
    ("526172211A0700", "rar"),
    ("526172211A070100", "rar"),
    ("1F8B", "tar.gz"),
    ("425A68", "tar.bz2"),
    ("FD377A585A00", "tar.xz"),
]
USTAR_HEX = "7573746172"
USTAR_OFFSET = 257
USTAR_MIN_LENGTH = 265

ARCHIVE_SUFFIX = [
    (".zip", "zip"),
    (".rar", "rar"),
    (".7z", "7z"),
    (".tar", "tar"),
    (".tar.gz", "tar.gz"),
    (".tgz", "tar.gz"),
    (".tar.bz2", "tar.bz2"),
    (".tbz2", "tar.bz2"),
    (".tar.xz", "tar.xz"),
    (".txz", "tar.xz"),
]
IMAGE_SUFFIX = [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".webp", ".bmp"]

MIME_BY_EXTENSION = {
    ".pdf": "application/pdf",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".tif": "image/tiff",
    ".tiff": "image/tiff",
    ".webp": "image/webp",
    ".zip": "application/zip",
    ".rar": "application/vnd.rar",
    ".7z": "application/x-7z-compressed",
    ".tar": "application/x-tar",
    ".gz": "application/gzip",
    ".bz2": "application/x-bzip2",
    ".xz": "application/x-xz",
}
OCTET_STREAM = "application/octet-stream"
# ---------------------------------------------------------- end of fixed values


def extension(name: Column) -> Column:
    """Lower-cased last suffix, with the three double ``.tar.*`` suffixes kept whole."""
    return F.regexp_extract(F.lower(name), r"(\.tar\.(?:gz|bz2|xz)|\.[^.]*)$", 1)


def _first(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), otherwise)


def detect_kind(head: Column, name: Column) -> Column:
    """``struct<kind, archive_format>``; leading bytes outrank the extension."""
    digits = F.hex(F.substring(head, 1, 12))
    ext = extension(name)
    answer = lambda kind, fmt="": F.struct(F.lit(kind).alias("kind"), F.lit(fmt).alias("archive_format"))
    is_image = reduce(lambda a, b: a | b, [digits.startswith(m) for m in IMAGE_MAGIC])
    is_webp = digits.startswith("52494646") & (F.substring(digits, 17, 8) == "57454250")
    is_tar = (F.octet_length(head) >= USTAR_MIN_LENGTH) & (
        F.hex(F.substring(head, USTAR_OFFSET + 1, 5)) == USTAR_HEX
    )
    return _first(
        [
            (is_image | is_webp, answer("image")),
            (digits.startswith(PDF_MAGIC), answer("pdf")),
            *[(digits.startswith(m), answer("archive", fmt)) for m, fmt in ARCHIVE_MAGIC],
            (is_tar, answer("archive", "tar")),
            *[(ext == suffix, answer("archive", fmt)) for suffix, fmt in ARCHIVE_SUFFIX],
            (ext == ".pdf", answer("pdf")),
            (ext.isin(IMAGE_SUFFIX), answer("image")),
        ],
        answer("unknown"),
    )


def mime_of(declared: Column, name: Column) -> Column:
    """Declared type unless empty or generic, else looked up by extension."""
    pairs = [F.lit(x) for item in MIME_BY_EXTENSION.items() for x in item]
    ext = F.regexp_extract(F.lower(name), r"(\.[^.]*)$", 1)
    stated = F.when(~declared.isin("", OCTET_STREAM), declared)
    return F.coalesce(stated, F.try_element_at(F.create_map(*pairs), ext), F.lit(OCTET_STREAM))


def storage_key(*parts: Column) -> Column:
    """Join path parts, trimming slashes and dropping empty parts."""
    trimmed = [F.nullif(F.regexp_replace(p, "^/+|/+$", ""), F.lit("")) for p in parts]
    return F.concat_ws("/", *trimmed)


def parse_uri(uri: Column, bucket: str) -> Column:
    """``struct<key, violation>`` of an ``s3://`` URI or a bare key."""
    found = F.regexp_extract(uri, r"^s3://([^/]+)/(.+)$", 1)
    is_uri = found != ""
    key = F.when(is_uri, F.regexp_extract(uri, r"^s3://([^/]+)/(.+)$", 2)).otherwise(
        F.regexp_replace(uri, "^/+", "")
    )
    violation = F.when(F.coalesce(uri, F.lit("")) == "", "empty").when(is_uri & (found != bucket), "bucket_mismatch")
    return F.struct(F.when(violation.isNull(), key).alias("key"), violation.alias("violation"))


def entry_violation(name: Column, entry_type: Column | None = None) -> Column:
    """Why an archive entry must not be unpacked, or null when it is safe."""
    climbs = lambda stack, part: (
        F.when(part.isin("", "."), stack)
        .when(part != "..", F.array_append(stack, part))
        .when((F.size(stack) > 0) & (F.element_at(stack, -1) != ".."), F.slice(stack, 1, F.size(stack) - 1))
        .otherwise(F.array_append(stack, part))
    )
    empty = F.array().cast("array<string>")
    # element_at on an empty array raises in ANSI mode, so the stack starts with a floor entry.
    floor = F.array(F.lit(".."))
    left_over = F.aggregate(F.split(name, "/"), floor, climbs)
    survivors = F.slice(left_over, 2, F.size(left_over))
    # Only names with ".." somewhere need the walk.
    climbing = F.exists(F.coalesce(survivors, empty), lambda part: part.startswith(".."))
    traversal = F.when(name.contains(".."), climbing).otherwise(False)
    verdict = (
        F.when(F.coalesce(name, F.lit("")) == "", "empty")
        .when(name.startswith("/") | name.startswith("\\") | (F.substring(name, 2, 1) == ":"), "absolute")
        .when(traversal, "traversal")
    )
    if entry_type is None:
        return verdict
    return F.when(entry_type.isin("symlink", "hardlink"), "link").otherwise(verdict)
