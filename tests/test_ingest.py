from __future__ import annotations

import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from draftlake.functions import ingest
from draftlake.sources import files


@pytest.mark.parametrize(
    "head,name,kind,fmt",
    [
        (b"\x89PNG\r\n\x1a\n", "a", "image", ""),
        (b"%PDF-1.4", "a.zip", "pdf", ""),
        (b"PK\x03\x04", "a.pdf", "archive", "zip"),
        (b"\x00" * 32, "weird.7z", "archive", "7z"),
        (b"\x00" * 257 + b"ustar" + b"\x00" * 3, "x", "archive", "tar"),
        (b"\x00" * 257 + b"ustar", "x", "unknown", ""),
        (b"", "photo.JPEG", "image", ""),
        (b"abc", "set.TAR.GZ", "archive", "tar.gz"),
    ],
)
def test_detect_kind(spark, head, name, kind, fmt):
    row = spark.createDataFrame([(bytearray(head), name)], "h binary, n string").select(
        ingest.detect_kind(F.col("h"), F.col("n")).alias("d")
    ).first()["d"]
    assert (row["kind"], row["archive_format"]) == (kind, fmt)


@pytest.mark.parametrize(
    "name,want",
    [
        ("subdir/file.txt", None),
        ("sub/../ok.txt", None),
        ("../etc/passwd", "traversal"),
        ("sub/../../etc/passwd", "traversal"),
        ("a/..foo", "traversal"),
        ("/etc/passwd", "absolute"),
        ("\\windows\\system32", "absolute"),
        ("C:/foo", "absolute"),
        ("", "empty"),
    ],
)
def test_entry_violation(spark, name, want):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(ingest.entry_violation(F.col("n")).alias("v")).first()["v"] == want


def _zip(entries: dict[str, bytes]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as box:
        for name, body in entries.items():
            box.writestr(name, body)
    return buffer.getvalue()


def _tar(entries: dict[str, bytes], mode: str = "w:gz", link: bool = False) -> bytes:
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode=mode) as box:
        for name, body in entries.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            box.addfile(info, io.BytesIO(body))
        if link:
            info = tarfile.TarInfo("link")
            info.type, info.linkname = tarfile.SYMTYPE, "/etc/passwd"
            box.addfile(info)
    return buffer.getvalue()


def test_expand_archives(spark):
    inner = _zip({"deep/scan.png": b"\x89PNG\r\n\x1a\n"})
    outer = _tar({"one.pdf": b"%PDF-1.4", "nested.zip": inner})
    matryoshka = _zip({"x.txt": b"x"})
    for _ in range(3):
        matryoshka = _zip({"next.zip": matryoshka})
    boxes = [
        ("good", "good.tar.gz", outer),
        ("evil", "evil.zip", _zip({"ok.txt": b"1", "../x": b"2"})),
        ("link", "link.tar", _tar({"a": b"1"}, "w", link=True)),
        ("many", "many.zip", _zip({f"f{i}": b"1" for i in range(6)})),
        ("torn", "torn.zip", b"PK\x03\x04 torn"),
        ("bz", "bz.tar.bz2", _tar({"b.txt": b"b"}, "w:bz2")),
        ("deep", "deep.zip", matryoshka),
        ("rar", "x.rar", b"Rar!\x1a\x07\x00"),
        ("page", "page.png", b"\x89PNG\r\n\x1a\n"),
    ]
    df = spark.createDataFrame([(i, n, bytearray(b)) for i, n, b in boxes], "file_id string, name string, content binary")
    children, failed = files.expand_archives(df, max_depth=3, max_files=5)
    rows = children.collect()
    assert sorted(r["name"] for r in rows if r["archive_id"] == "good") == ["nested.zip", "one.pdf"]
    assert [r["kind"] for r in rows if r["name"] == "deep/scan.png"] == ["image"]
    assert [bytes(r["content"]) for r in rows if r["archive_id"] == "bz"] == [b"b"]
    assert not {"evil", "link", "many", "torn", "rar", "page"} & {r["archive_id"] for r in rows}
    why = {r["archive_id"]: r["violation"] for r in failed.collect()}
    assert why["evil"] == "traversal" and why["link"] == "link" and why["many"] == "files" and why["rar"] == "unsupported"
    assert why["torn"].startswith("BadZipFile")
    assert "depth" in why.values()  # the fourth level of the nested set
    events = files.archive_events(children, "bucket").collect()
    assert len(events) == len(rows) and all(e["artifact_uri"].startswith("s3://bucket/raw_extracted/unknown/") for e in events)
