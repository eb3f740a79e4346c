"""Columns for recognised text: normalising and parsing dimension notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
DIAMETER_GLYPHS = "ØⵄⲞ⊘⌀Ф"
DEGREE_GLYPHS = "°º˚"
MULTIPLY_GLYPHS = "x×ХхX"
DIMENSION_HINTS = ["Ø", "Ф", "R", "M", "±", "°", "x", "X", "×"]

NUMBER = r"[-+]?\d+(?:\.\d+)?"
FIT = r"[A-Za-z]{1,2}\d{1,2}"

COUNT_DIAMETER = rf"(?iu)^\s*(\d+)\s*(?:отв(?:\.|ерсти[яей])?|holes?)\s*Ø\s*({NUMBER})\s*(.*)$"
CHAMFER = rf"(?iu)^\s*({NUMBER})\s*x\s*({NUMBER})\s*°\s*$"
DIAMETER = rf"^\s*Ø\s*({NUMBER})(.*)$"
RADIUS = rf"(?iu)^\s*R\s*({NUMBER})\s*(.*)$"
THREAD = rf"(?iu)^\s*M\s*({NUMBER})(?:\s*x\s*({NUMBER}))?\s*(.*)$"
PLUS_MINUS = rf"^\s*({NUMBER})\s*±\s*({NUMBER})\s*$"
SIGNED_TOLERANCE = rf"^\s*({NUMBER})\s*([+-])\s*({NUMBER})\s*$"
VALUE_FIT = rf"^\s*({NUMBER})\s*({FIT})\s*$"
FIT_ONLY = rf"^\s*({FIT})\s*$"
LINEAR = rf"(?iu)^\s*({NUMBER})\s*(mm|мм)?\s*$"

REST_PLUS_MINUS = rf"^\s*±\s*({NUMBER})\s*$"
REST_SIGNED = rf"^\s*([+-])\s*({NUMBER})\s*$"

STANDARD_REF = r"(?iU)ГОСТ\s*\d{3,5}(?:[-/]\d{2,4})?"
ROUGHNESS = r"(?iU)R[az]\s*[\d.,]+"
MASS = r"(?iU)\b\d+(?:[.,]\d+)?\s*(?:kg|кг)\b"
MATERIAL = (
    r"(?iU)\b(?:Сталь|Чугун|Алюминий|АМг|Д16|Латунь|Бронза|Steel|Iron|Aluminum)\b"
    r"\s*[А-Яа-яA-Z0-9-]*"
)
# ---------------------------------------------------------- end of fixed values


def looks_like_dimension(text: Column) -> Column:
    return F.coalesce(text.rlike("[" + "".join(DIMENSION_HINTS) + "]"), F.lit(False))


def normalize_dim(text: Column) -> Column:
    """Canonical glyphs, dot decimals, single spaces."""
    source = "," + DIAMETER_GLYPHS + DEGREE_GLYPHS + MULTIPLY_GLYPHS
    target = "." + "Ø" * len(DIAMETER_GLYPHS) + "°" * len(DEGREE_GLYPHS) + "x" * len(MULTIPLY_GLYPHS)
    stripped = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.translate(stripped, source, target), r"(?U)\s+", " ")


def _group(text: Column, pattern: str, index: int) -> Column:
    return F.regexp_extract(text, pattern, index)


def extract_tolerance(rest: Column) -> Column:
    """Fit code, ``±x`` or signed value at the end of an expression, else null."""
    return (
        F.when(rest.rlike(FIT_ONLY), _group(rest, FIT_ONLY, 1))
        .when(rest.rlike(REST_PLUS_MINUS), F.concat(F.lit("±"), _group(rest, REST_PLUS_MINUS, 1)))
        .when(rest.rlike(REST_SIGNED), F.concat(_group(rest, REST_SIGNED, 1), _group(rest, REST_SIGNED, 2)))
    )


# One row per rule, first match wins:
# pattern, kind, group of the value, tolerance from the groups.
_RULES = [
    (COUNT_DIAMETER, "diameter", 2, lambda s: extract_tolerance(_group(s, COUNT_DIAMETER, 3))),
    (CHAMFER, "chamfer", 1, None),
    (DIAMETER, "diameter", 1, lambda s: extract_tolerance(_group(s, DIAMETER, 2))),
    (RADIUS, "radius", 1, lambda s: extract_tolerance(_group(s, RADIUS, 2))),
    (THREAD, "thread", 1, lambda s: extract_tolerance(_group(s, THREAD, 3))),
    (PLUS_MINUS, "linear", 1, lambda s: F.concat(F.lit("±"), _group(s, PLUS_MINUS, 2))),
    (
        SIGNED_TOLERANCE,
        "linear",
        1,
        lambda s: F.concat(_group(s, SIGNED_TOLERANCE, 2), _group(s, SIGNED_TOLERANCE, 3)),
    ),
    (VALUE_FIT, "linear", 1, lambda s: _group(s, VALUE_FIT, 2)),
    (FIT_ONLY, "tolerance", None, lambda s: _group(s, FIT_ONLY, 1)),
    (LINEAR, "linear", 1, None),
]


def dimension_rule(normalized: Column) -> Column:
    """Number of the first matching rule (1-based), 0 when nothing matches."""
    chosen = F.lit(0)
    for number in range(len(_RULES), 0, -1):
        chosen = F.when(normalized.rlike(_RULES[number - 1][0]), number).otherwise(chosen)
    return chosen


def dimension_fields(rule: Column, s: Column, raw: Column) -> Column:
    """The parsed struct for text ``s`` already assigned to ``rule``.

    Taking the rule as a column lets callers compute the match once and then
    evaluate only the groups of the winning pattern.
    """
    kind, value, tolerance = F.lit("unknown"), F.lit(None).cast("double"), F.lit(None).cast("string")
    for number in range(len(_RULES), 0, -1):
        pattern, name, group, tail = _RULES[number - 1]
        hit = rule == number
        kind = F.when(hit, name).otherwise(kind)
        if group is not None:
            value = F.when(hit, _group(s, pattern, group).cast("double")).otherwise(value)
        if tail is not None:
            tolerance = F.when(hit, tail(s)).otherwise(tolerance)
    blank = F.coalesce(raw, F.lit("")) == ""
    unit = F.when(blank, "mm").when(kind.isin("tolerance", "unknown"), None).otherwise("mm")
    pitch = F.nullif(_group(s, THREAD, 2), F.lit(""))
    return F.struct(
        kind.alias("kind"),
        value.alias("value"),
        unit.alias("unit"),
        tolerance.alias("tolerance"),
        F.when(rule == 1, _group(s, COUNT_DIAMETER, 1).cast("int")).alias("count"),
        F.when(rule == 2, _group(s, CHAMFER, 2).cast("double")).alias("angle_deg"),
        F.when(rule == 5, pitch.cast("double")).alias("pitch"),
        F.when(rule == 5, F.concat(F.lit("M"), _group(s, THREAD, 1))).alias("thread_designator"),
        F.coalesce(raw, F.lit("")).alias("raw"),
    )


def parse_dimension(text: Column) -> Column:
    """Structured reading of one dimension note."""
    s = normalize_dim(F.coalesce(text, F.lit("")))
    return dimension_fields(dimension_rule(s), s, text)


def _all_matches(text: Column, pattern: str) -> Column:
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    cleaned = F.array_sort(F.array_distinct(F.transform(hits, lambda h: F.regexp_replace(h, r"(?U)^\s+|\s+$", ""))))
    return F.when(F.size(cleaned) > 0, cleaned)


def parse_notes(text: Column) -> Column:
    """Standards, roughness, mass and material mentions; null where absent."""
    return F.struct(
        _all_matches(text, STANDARD_REF).alias("gost_refs"),
        _all_matches(text, ROUGHNESS).alias("surface_finish"),
        _all_matches(text, MASS).alias("mass"),
        _all_matches(text, MATERIAL).alias("material"),
    )
