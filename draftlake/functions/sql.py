"""SQL names for the text parsers, as session-scoped SQL functions (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from draftlake.functions import text as tx


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def _normal(source: str) -> str:
    glyphs = "," + tx.DIAMETER_GLYPHS + tx.DEGREE_GLYPHS + tx.MULTIPLY_GLYPHS
    plain = "." + "Ø" * len(tx.DIAMETER_GLYPHS) + "°" * len(tx.DEGREE_GLYPHS) + "x" * len(tx.MULTIPLY_GLYPHS)
    stripped = rf"regexp_replace({source}, r'(?U)^\s+|\s+$', '')"
    return rf"regexp_replace(translate({stripped}, '{glyphs}', '{plain}'), r'(?U)\s+', ' ')"


def _tolerance(rest: str) -> str:
    pick = lambda p, g: f"regexp_extract({rest}, {_quoted(p)}, {g})"
    return (
        f"CASE WHEN {rest} RLIKE {_quoted(tx.FIT_ONLY)} THEN {pick(tx.FIT_ONLY, 1)} "
        f"WHEN {rest} RLIKE {_quoted(tx.REST_PLUS_MINUS)} THEN '±' || {pick(tx.REST_PLUS_MINUS, 1)} "
        f"WHEN {rest} RLIKE {_quoted(tx.REST_SIGNED)} THEN {pick(tx.REST_SIGNED, 1)} || {pick(tx.REST_SIGNED, 2)} END"
    )


_FIELDS = "kind value unit tolerance count angle_deg pitch thread_designator raw".split()


def _reading(pattern: str, kind: str, **parts: str) -> str:
    defaults = {
        "kind": f"'{kind}'",
        "value": "CAST(NULL AS DOUBLE)",
        "unit": "'mm'",
        "tolerance": "CAST(NULL AS STRING)",
        "count": "CAST(NULL AS INT)",
        "angle_deg": "CAST(NULL AS DOUBLE)",
        "pitch": "CAST(NULL AS DOUBLE)",
        "thread_designator": "CAST(NULL AS STRING)",
        "raw": "coalesce(raw, '')",
    }
    body = ", ".join(f"'{f}', {parts.get(f, defaults[f])}" for f in _FIELDS)
    return f"WHEN {pattern} THEN named_struct({body})"


def register_sql_functions(spark: SparkSession) -> None:
    """Create ``normalize_dimension``, ``extract_tolerance``, ``looks_like_dimension`` and ``parse_dimension``."""
    g = lambda p, i: f"regexp_extract(s, {_quoted(p)}, {i})"
    num = lambda p, i: f"CAST({g(p, i)} AS DOUBLE)"
    hit = lambda p: f"s RLIKE {_quoted(p)}"
    tail = lambda p, i: f"extract_tolerance({g(p, i)})"
    readings = [
        _reading(
            hit(tx.COUNT_DIAMETER),
            "diameter",
            value=num(tx.COUNT_DIAMETER, 2),
            tolerance=tail(tx.COUNT_DIAMETER, 3),
            count=f"CAST({g(tx.COUNT_DIAMETER, 1)} AS INT)",
        ),
        _reading(hit(tx.CHAMFER), "chamfer", value=num(tx.CHAMFER, 1), angle_deg=num(tx.CHAMFER, 2)),
        _reading(hit(tx.DIAMETER), "diameter", value=num(tx.DIAMETER, 1), tolerance=tail(tx.DIAMETER, 2)),
        _reading(hit(tx.RADIUS), "radius", value=num(tx.RADIUS, 1), tolerance=tail(tx.RADIUS, 2)),
        _reading(
            hit(tx.THREAD),
            "thread",
            value=num(tx.THREAD, 1),
            tolerance=tail(tx.THREAD, 3),
            pitch=f"CAST(nullif({g(tx.THREAD, 2)}, '') AS DOUBLE)",
            thread_designator=f"'M' || {g(tx.THREAD, 1)}",
        ),
        _reading(hit(tx.PLUS_MINUS), "linear", value=num(tx.PLUS_MINUS, 1), tolerance=f"'±' || {g(tx.PLUS_MINUS, 2)}"),
        _reading(
            hit(tx.SIGNED_TOLERANCE),
            "linear",
            value=num(tx.SIGNED_TOLERANCE, 1),
            tolerance=f"{g(tx.SIGNED_TOLERANCE, 2)} || {g(tx.SIGNED_TOLERANCE, 3)}",
        ),
        _reading(hit(tx.VALUE_FIT), "linear", value=num(tx.VALUE_FIT, 1), tolerance=g(tx.VALUE_FIT, 2)),
        _reading(hit(tx.FIT_ONLY), "tolerance", unit="CAST(NULL AS STRING)", tolerance=g(tx.FIT_ONLY, 1)),
        _reading(hit(tx.LINEAR), "linear", value=num(tx.LINEAR, 1)),
        _reading("true", "unknown", unit="IF(coalesce(raw, '') = '', 'mm', NULL)"),
    ]
    hints = "[" + "".join(tx.DIMENSION_HINTS) + "]"
    for signature, returns, body in [
        ("normalize_dimension(note STRING)", "STRING", _normal("note")),
        ("extract_tolerance(rest STRING)", "STRING", _tolerance("rest")),
        ("looks_like_dimension(note STRING)", "BOOLEAN", f"coalesce(note RLIKE '{hints}', false)"),
        (
            "parse_normal_dimension(s STRING, raw STRING)",
            "STRUCT<kind: STRING, value: DOUBLE, unit: STRING, tolerance: STRING, count: INT, angle_deg: DOUBLE, "
            "pitch: DOUBLE, thread_designator: STRING, raw: STRING>",
            "CASE " + " ".join(readings) + " END",
        ),
        (
            "parse_dimension(note STRING)",
            "STRUCT<kind: STRING, value: DOUBLE, unit: STRING, tolerance: STRING, count: INT, angle_deg: DOUBLE, "
            "pitch: DOUBLE, thread_designator: STRING, raw: STRING>",
            "parse_normal_dimension(normalize_dimension(coalesce(note, '')), note)",
        ),
    ]:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {returns} RETURN {body}")
