from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from draftlake.functions import text as tx
from draftlake.operators import ocr

CASES = [
    ("Ø40", dict(kind="diameter", value=40.0, unit="mm")),
    ("Ф40", dict(kind="diameter", value=40.0)),
    ("Ø40H11", dict(kind="diameter", value=40.0, tolerance="H11")),
    ("R25", dict(kind="radius", value=25.0)),
    ("M12", dict(kind="thread", value=12.0, thread_designator="M12", pitch=None)),
    ("M12x1.5", dict(kind="thread", value=12.0, pitch=1.5)),
    ("80±0.2", dict(kind="linear", value=80.0, tolerance="±0.2")),
    ("10±0,2", dict(kind="linear", value=10.0, tolerance="±0.2")),
    ("10+0.2", dict(kind="linear", value=10.0, tolerance="+0.2")),
    ("10-0.1", dict(kind="linear", value=10.0, tolerance="-0.1")),
    ("1x45°", dict(kind="chamfer", value=1.0, angle_deg=45.0)),
    ("1×45°", dict(kind="chamfer", value=1.0, angle_deg=45.0)),
    ("H11", dict(kind="tolerance", value=None, tolerance="H11", unit=None)),
    ("40H11", dict(kind="linear", value=40.0, tolerance="H11")),
    ("2 отв. Ø10", dict(kind="diameter", value=10.0, count=2)),
    ("2 ОТВЕРСТИЯ Ø10", dict(kind="diameter", value=10.0, count=2)),
    ("2 holes Ø10", dict(kind="diameter", value=10.0, count=2)),
    ("12 мм", dict(kind="linear", value=12.0, unit="mm")),
    ("garbage 123 ###", dict(kind="unknown", value=None, unit=None)),
    ("", dict(kind="unknown", unit="mm")),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(t,) for t, _ in CASES], "text string")
    fenced = {r["text"]: r["dimension"] for r in ocr.with_dimension(df).collect()}
    plain = {r["text"]: r["d"] for r in df.select("text", tx.parse_dimension(F.col("text")).alias("d")).collect()}
    assert fenced == plain
    return fenced


@pytest.mark.parametrize("text,want", CASES)
def test_dimension(parsed, text, want):
    got = parsed[text].asDict()
    assert {k: got[k] for k in want} == want
    assert got["raw"] == text


def test_notes(spark):
    text = "Сталь 45 ГОСТ 1050-88, гост 2590-2006 Ra 1,6 масса 0,42 кг, 3 kg"
    notes = spark.createDataFrame([(text,), ("nothing",)], "t string").select(tx.parse_notes(F.col("t")).alias("n")).collect()
    first = notes[0]["n"]
    assert first["gost_refs"] == ["ГОСТ 1050-88", "гост 2590-2006"]
    assert first["surface_finish"] == ["Ra 1,6"]
    assert first["mass"] == ["0,42 кг", "3 kg"]
    assert first["material"] == ["Сталь 45"]
    assert all(v is None for v in notes[1]["n"])


def test_enrich_keeps_given_reading(spark):
    df = spark.createDataFrame(
        [("p", "1", "R5", "unknown", "x"), ("p", "2", "R5", "unknown", None), ("p", "3", "note", "unknown", None)],
        "page_id string, block_id string, text string, kind string, parsed string",
    ).withColumns({c: F.lit(None).cast("double") for c in ("x1", "y1", "x2", "y2", "confidence")})
    rows = {r["block_id"]: r for r in ocr.enrich_ocr(df).collect()}
    assert rows["1"]["kind"] == "unknown" and rows["1"]["dimension"] is None
    assert rows["2"]["kind"] == "dimension_text" and rows["2"]["dimension"]["kind"] == "radius"
    assert rows["3"]["dimension"] is None and rows["3"]["x1"] == 0.0 and rows["3"]["confidence"] == 0.0
