"""Sinks: what is made again on the way to files, how it is stored, and how archives are unpacked."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

import pandas as pd
import pyspark.sql.functions as F

from draftlake.sources import files, tables

PRIMITIVES = (
    "page_id string, id string, type string, layer string, confidence double, x1 double, y1 double, x2 double, y2 double, radius double, "
    "start_angle_deg double, end_angle_deg double, text string, height double, rotation_deg double"
)


def counted(df, times):
    """``df``, with the rows that tasks make of it added to ``times``."""

    def run(batches):
        for pdf in batches:
            times.add(len(pdf))
            yield pdf

    return df.mapInPandas(run, df.schema)


def test_cad_rows_are_made_once_a_part_and_stored_small(spark, tmp_path):
    pages = spark.createDataFrame(
        [("b", "f", "p1", 254, "unknown", 600, 400), ("b", "f", "p2", None, None, None, None)],
        "batch_id string, file_id string, page_id string, dpi int, page_type string, width_px int, height_px int",
    )
    rows = [(p, f"n{k}", kind, "02_PART_VISIBLE", 0.5, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, "T", 8.0, 9.0)
            for k, (p, kind) in enumerate([("p1", "LINE"), ("p1", "ARC"), ("p3", "TEXT"), (None, None), ("p1", "LINE")] * 40)]
    made, texts, sizes = (spark.sparkContext.accumulator(0) for _ in range(3))
    primitives = spark.createDataFrame(rows, PRIMITIVES)
    ocr = spark.createDataFrame([("p1", f"o{k}", "12", 0.0, 0.0, 1.0, 1.0, 0.5, "unknown") for k in range(30)], "page_id string, block_id string, text string, x1 double, y1 double, x2 double, y2 double, confidence double, kind string")
    dims = spark.createDataFrame([("p2", "o1", "R", 2.0, "mm", None, 1.0, 1.0, "R2")], "page_id string, block_id string, kind string, value double, unit string, tolerance string, anchor_x double, anchor_y double, raw_text string")
    path = str(tmp_path / "cad")
    tables.write_cad(pages, counted(primitives, made), counted(ocr, texts), counted(dims, sizes), path)
    assert (made.value, texts.value, sizes.value) == (400, 30, 1)  # primitives are counted, too
    stored = [p for p in Path(path, "primitives").iterdir() if p.name.startswith("part-")]
    assert sum(p.stat().st_size for p in stored) < 10_000
    read = tables.cad_primitives(tables.read_cad(spark, f"{path}/primitives", lines=True))
    got = sorted(map(str, read.select("page_id", "id", "type", "px_per_mm", "height_px").collect()))
    known = {"p1": (10.0, 400)}
    want = spark.createDataFrame([(r[0], r[1], r[2], *known.get(r[0], (None, None))) for r in rows], read.select("page_id", "id", "type", "px_per_mm", "height_px").schema)
    assert got == sorted(map(str, want.collect()))
    heads = {r["page_id"]: r["r"] for r in tables.read_cad(spark, f"{path}/head", lines=True).select("document.page_id", F.col("qa.requires_review").alias("r")).collect()}
    assert heads == {"p1": True, "p2": True}


def test_entities_are_made_once(spark, tmp_path):
    schema = (
        "page_id string, id string, type string, layer string, source_layer string, x1_mm double, y1_mm double, x2_mm double, y2_mm double, "
        "radius_mm double, start_deg double, end_deg double, text string, text_height_mm double, rotation_deg double"
    )
    kinds = ["LINE", "CIRCLE", "ARC", "TEXT", None, "OTHER"]
    rows = [("p", f"e{k:03}", kinds[k % 6], "L", "L", 1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0, "note", 1.0, 0.0) for k in range(60)]
    made = spark.sparkContext.accumulator(0)
    tables.write_entities(counted(spark.createDataFrame(rows, schema), made), str(tmp_path))
    assert made.value == 60
    text = {r["id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/text").collect()}
    assert sorted(text) == [r[1] for r in rows if r[2] in ("LINE", "CIRCLE", "ARC", "TEXT")]
    assert text["e000"].split("\n")[:6] == ["0", "LINE", "8", "L", "10", "1.000000"]
    assert spark.read.parquet(f"{tmp_path}/table").count() == 60


def packed(names):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as box:
        for name in names:
            box.writestr(name, name.encode())
    return buffer.getvalue()


def test_entries_leave_in_bounded_frames(monkeypatch):
    boxes = pd.DataFrame({"file_id": [f"a{k}" for k in range(50)], "archive_format": "zip", "depth": 1, "content": [packed(["x.txt", "y.txt", "z.txt"])] * 49 + [b"broken"]})
    whole = list(files._unpack(iter([boxes[:25], boxes[25:]]), 10, 1000))
    assert len(whole) == 1 and len(whole[0]) == 49 * 3 + 1
    monkeypatch.setattr(files, "UNPACK_ROWS", 40)
    cut = list(files._unpack(iter([boxes]), 10, 1000))
    assert max(map(len, cut)) == 40
    pd.testing.assert_frame_equal(pd.concat(cut, ignore_index=True), whole[0])
    assert whole[0]["error"].notna().tolist() == [False] * 147 + [True]
    assert list(whole[0]["ord"][:3]) == [1, 2, 3] and whole[0]["content"][1] == b"y.txt"
