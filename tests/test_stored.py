"""File heads and page images through the data sources."""

from __future__ import annotations

import random

from draftlake.sources import files, stored

PIXELS = "page_id string, x int, y int, v int"


def test_heads(spark, tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    (tmp_path / "_hidden").mkdir()
    bodies = {"a.png": b"\x89PNG\r\n\x1a\n" + b"x" * 2000, "sub/b.zip": b"PK\x03\x04zz", "sub/deep/c.png": b"", "_hidden/d.png": b"1", "e.txt": b"t"}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    heads = stored.scan_heads(spark, str(tmp_path))
    got = {r.path.removeprefix(f"{tmp_path}/"): (r.length, bytes(r.content)) for r in heads.collect()}
    assert got == {n: (len(b), b[:512]) for n, b in bodies.items() if not n.startswith("_")}
    kinds = {r.name: (r.kind, r.archive_format) for r in files.classify_files(heads).collect()}
    whole = {r.name: (r.kind, r.archive_format) for r in files.classify_files(files.scan_files(spark, str(tmp_path))).collect()}
    assert kinds == whole | {"c.png": ("image", "")} and len(kinds) == 4  # scan_files has no empty files
    assert {r.path.rsplit("/", 1)[-1] for r in stored.scan_heads(spark, str(tmp_path), "*.png").collect()} == {"a.png", "c.png"}
    (tmp_path / "empty").mkdir()
    assert stored.scan_heads(spark, str(tmp_path / "empty")).collect() == []


def test_images_round_trip(spark, tmp_path):
    rng = random.Random(4)
    sizes = {f"p{k}": (rng.randrange(1, 40), rng.randrange(1, 30)) for k in range(12)} | {"blank": (5, 4)}
    dots = [(f"p{k}", rng.randrange(-2, 45), rng.randrange(-2, 35), rng.randrange(-20, 300)) for k in range(12) for _ in range(500)]
    odd = [("unsized", 1, 1, 9), (None, 1, 1, 9), ("p1", None, 0, 9), ("p1", 0, None, 9), ("p1", 0, 0, None)]
    folder = str(tmp_path / "images")
    pages = spark.createDataFrame([(p, *s) for p, s in sizes.items()] + [(None, 3, 3), ("flat", 0, 3)], "page_id string, width int, height int")
    for _ in range(2):  # a second run replaces the files
        stored.write_images(spark.createDataFrame(dots + odd, PIXELS), pages, folder)
    want = {(p, x, y): 255 for p, (w, h) in sizes.items() for x in range(w) for y in range(h)}
    drawn: dict = {}
    for p, x, y, v in dots:
        if (p, x, y) in want:
            drawn[p, x, y] = max(drawn.get((p, x, y), 0), min(max(v, 0), 255))
    got = {(r.page_id, r.x, r.y): r.v for r in files.scan_pixels(spark, folder).collect()}
    assert got == want | drawn
    assert files.undecodable(spark, folder).collect() == []
    stored.write_images(spark.createDataFrame([], PIXELS), pages.limit(0), str(tmp_path / "none"))
