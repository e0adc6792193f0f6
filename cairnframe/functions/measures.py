"""Lengths, areas and text evidence as they are written on plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOOT, INCH = 0.3048, 0.0254
# Marks of feet and inches and what they stand for; double forms first.
QUOTES = [("’’", '"'), ("''", '"'), ("″", '"'), ("”", '"'), ("’", "'"), ("′", "'")]
LENGTH_QUOTES = [("’", "'"), ("′", "'"), ("”", '"'), ("″", '"'), ("''", '"')]
UNITS = {"": 1.0, "m": 1.0, "ft": FOOT, "feet": FOOT, "mm": 0.001, "cm": 0.01, "in": INCH}
AREA_UNITS = {"": 1.0, "m2": 1.0, "m²": 1.0, "sqm": 1.0, "sqm2": 1.0, "sqft": FOOT * FOOT, "sf": FOOT * FOOT, "ft2": FOOT * FOOT, "ft²": FOOT * FOOT, "squarefeet": FOOT * FOOT}
# What a page's text says about units and scale.
TEXT_PATTERNS = {
    "ft_in": r"""\d+\s*['’′]\s*-?\s*\d+(?:\.\d+)?\s*(?:"|”|″|'')""",
    "ft_dims": r"""\d+\s*['’′]\s*-?\s*\d*\s*(?:"|”|″)?\s*[xX×]\s*\d+\s*['’′]""",
    "metric_dims": r"\b\d{1,2}[.,]\d{1,2}\s*[xX×]\s*\d{1,2}[.,]\d{1,2}\b",
    "mm_dims": r"(?m)^\s*\d{2,4}0\s*(?:mm)?\s*$",
    "sq_ft": r"(?i)\bsq\.?\s*ft\b|\bsq\.?ft\b|square\s+feet|\bsf\b",
    "sq_m": r"(?i)\bsq\.?\s*m\b|m²|\bm2\b|\bsqm\b",
    "area_table": r"(?i)total\s+area|suite\s+area|internal\s+area|interiors?\s*:|balcony\s+area|terrace",
    "scale_word": r"(?i)\bscale\b|\b1\s*:\s*\d{2,3}\b",
    "ceiling_height": r"(?i)ceiling|clear\s+height",
    "north": r"(?im)\bnorth\b|^N$",
    "watermark_url": r"(?i)www\.[a-z0-9-]+\.[a-z]+",
}


def replaced(text: Column, marks: list[tuple[str, str]]) -> Column:
    for mark, plain in marks:
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def normalized_quotes(text: Column) -> Column:
    return replaced(text, QUOTES)


def without_bearings(text: Column) -> Column:
    """Text without bearings such as 12°30'15\", which are no dimensions."""
    return F.regexp_replace(text, r"""\d+\s*°\s*\d+\s*'\s*\d+(?:\.\d+)?\s*\"""", "")


def _units(names: dict[str, float], unit: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[unit]


def _number(text: Column) -> Column:
    """A number without a sign; null if the text is none."""
    return F.when(text.rlike(r"^\d+(\.\d+)?$"), text.cast("double"))


def length_m(text: Column) -> Column:
    """Metres of a length as written: feet before a foot mark and inches after it, inches before an inch mark, or a number and its unit (none: metres). Null if it is none of these.

    Inches after feet may follow a dash, hold a fraction, as in 6 1/2, and lack their mark.
    """
    t = F.trim(replaced(text, LENGTH_QUOTES))
    feet = F.trim(F.substring_index(t, "'", 1))
    after = F.ltrim(F.regexp_replace(F.ltrim(F.substring(t, F.instr(t, "'") + 1, F.length(t))), "^-", ""))
    after = F.rtrim(F.regexp_replace(after, '"$', ""))
    part = lambda i: F.regexp_extract(after, r"^(\d+(?:\.\d+)?)\s*(?:(\d+)/(\d+))?$", i)
    inches = F.when(after == "", 0.0).when(part(1) != "", part(1).try_cast("double") + F.coalesce(F.try_divide(part(2).try_cast("double"), part(3).try_cast("double")), F.lit(0.0)))
    unit = F.lower(F.regexp_extract(t, r"^[\d.]*\s*(\D*)$", 1))
    plain = _number(F.regexp_extract(t, r"^([\d.]+)\s*\D*$", 1)) * _units(UNITS, unit)
    marked = _number(F.rtrim(F.regexp_replace(t, '"$', ""))) * INCH
    return F.when(F.contains(t, F.lit("'")), _number(feet) * FOOT + inches * INCH).when(t.endswith('"'), marked).otherwise(plain)


def area_m2(text: Column) -> Column:
    """Square metres: a number, with thousands commas or not, in square metres (or no unit) or square feet. Null if it is neither."""
    t = F.trim(F.replace(text, F.lit(","), F.lit("")))
    number = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)", 1)
    unit = F.lower(F.regexp_replace(F.substring(t, F.length(number) + 1, F.length(t)), "[ .]", ""))
    return _number(number) * _units(AREA_UNITS, unit)


def text_evidence(pages: DataFrame, text: str = "text") -> DataFrame:
    """Rows of pages (without the text) and pattern of TEXT_PATTERNS that occurs in it: count, and the first three distinct examples in order."""
    rest = [c for c in pages.columns if c != text]
    plain = pages.withColumn("plain", without_bearings(normalized_quotes(F.col(text))))
    found = F.array(*[F.struct(F.lit(k).alias("pattern"), F.regexp_extract_all("plain", F.lit(p), F.lit(0)).alias("hits")) for k, p in TEXT_PATTERNS.items()])
    each = plain.select(*rest, F.inline(F.filter(found, lambda x: F.size(x["hits"]) > 0)))
    return each.select(*rest, "pattern", F.size("hits").alias("count"), F.slice(F.array_sort(F.array_distinct("hits")), 1, 3).alias("examples"))


_FT_IN = r"""(\d+)\s*'\s*-?\s*(\d+(?:\.\d+)?)?\s*"?"""


def dimensions(spans: DataFrame, text: str = "text") -> DataFrame:
    """Sizes of rooms on spans of text, a row each: the span's other columns, unit (ft-in, m or mm), m (one or two lengths in metres) and candidate (a lone number of millimetres may be something else)."""
    rest = [c for c in spans.columns if c != text]
    plain = normalized_quotes(F.col(text))
    pair, metric = rf"{_FT_IN}\s*[xX×]?\s*{_FT_IN}", r"\b(\d{1,2}[.,]\d{1,2})\s*[xX×]\s*(\d{1,2}[.,]\d{1,2})\b"
    part = lambda m, i: F.coalesce(F.regexp_extract(m, pair, i).try_cast("double"), F.lit(0.0))
    feet = lambda m, i: F.bround(part(m, i) * FOOT + part(m, i + 1) * INCH, 4)
    metres = lambda m, i: F.replace(F.regexp_extract(m, metric, i), F.lit(","), F.lit(".")).cast("double")
    row = lambda unit, m, candidate: F.struct(F.lit(unit).alias("unit"), m.alias("m"), F.lit(candidate).alias("candidate"))
    lone = F.regexp_extract(text, r"^\s*(\d{3,5})\s*(?:[mM][mM])?\s*$", 1)
    found = F.concat(
        F.transform(F.regexp_extract_all(plain, F.lit(pair), F.lit(0)), lambda m: row("ft-in", F.array(feet(m, 1), feet(m, 3)), False)),
        F.transform(F.regexp_extract_all(plain, F.lit(metric), F.lit(0)), lambda m: row("m", F.array(metres(m, 1), metres(m, 2)), False)),
        F.transform(F.filter(F.array(lone), lambda m: m.endswith("0")), lambda m: row("mm", F.array(m.cast("double") / 1000), True)),
    )
    return spans.select(*rest, F.inline(found))


def rgb255(colour: Column, text: Column) -> Column:
    """Whole channels of 0 to 255: of "#rrggbb" in ``text``, or else of an array, whose channels are shares if none is over 1."""
    hexes = F.transform(F.array(F.lit(1), F.lit(3), F.lit(5)), lambda i: F.conv(F.substring(F.ltrim(text, F.lit("#")), i, F.lit(2)), 16, 10).cast("int"))
    shares = F.array_max(colour) <= 1.0
    return F.coalesce(F.when(text.isNotNull(), hexes), F.transform(colour, lambda c: F.when(shares, F.bround(c * 255)).otherwise(F.floor(c)).cast("int")))


def axis_class(dx: Column, dy: Column) -> Column:
    """x or y if a segment runs over five times as far that way as the other, else diag."""
    return F.when(F.abs(dx) > 5 * F.abs(dy), "x").when(F.abs(dy) > 5 * F.abs(dx), "y").otherwise("diag")


def angle_180(dx: Column, dy: Column) -> Column:
    """Direction of a line in degrees, from 0 up to 180."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))


def angle_apart(a: Column, b: Column) -> Column:
    """Degrees between the directions of two lines, 90 at most."""
    d = F.pmod(a - b, F.lit(180.0))
    return F.least(d, 180.0 - d)


def rounded(x: Column, places: int) -> Column:
    """Half to even, as reports round."""
    return F.bround(x, places)


def arc_points(cx: Column, cy: Column, r: Column, a0: Column, a1: Column, steps: Column) -> Column:
    """Points along an arc from angle a0 to a1 (degrees), steps + 1 of them."""
    return F.transform(F.sequence(F.lit(0), steps.cast("int")), lambda i: F.struct((cx + r * F.cos(F.radians(a0 + (a1 - a0) * i / steps))).alias("x"), (cy + r * F.sin(F.radians(a0 + (a1 - a0) * i / steps))).alias("y")))


def significant(x: Column, digits: int = 3) -> Column:
    """x to so many significant digits; 0 and null stay."""
    places = F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))
    return F.when((x == 0) | x.isNull(), x).otherwise(F.round(x * F.pow(F.lit(10.0), places)) / F.pow(F.lit(10.0), places))


def arc_between(cx: Column, cy: Column, r: Column, a0: Column, a1: Column, chord: Column) -> Column:
    """Points along the short way round from angle a0 to a1 (degrees), no chord longer than ``chord``."""
    turn = F.pmod(a1 - a0 + 180, F.lit(360.0)) - 180
    steps = F.greatest(F.lit(1), F.ceil(F.abs(F.radians(turn)) * r / chord))
    return arc_points(cx, cy, r, a0, a0 + turn, steps)


def offset_point(cx: Column, cy: Column, x: Column, y: Column, by: Column) -> Column:
    """A point moved away from a centre."""
    far = F.hypot(x - cx, y - cy)
    return F.struct((cx + (x - cx) * (far + by) / far).alias("x"), (cy + (y - cy) * (far + by) / far).alias("y"))


def on_circle(cx: Column, cy: Column, r: Column, x: Column, upper: Column) -> Column:
    """y of a circle's point at x, the greater one if ``upper``; null beside the circle."""
    up = F.when(F.abs(x - cx) <= r, F.sqrt(r * r - (x - cx) * (x - cx)))
    return cy + F.when(upper, up).otherwise(-up)


def align_shifts(d: Column, h1: Column, h2: Column) -> Column:
    """Shifts that bring a wall of half width h2, d off a wall of half width h1, onto its centre line or either of its faces."""
    return F.array(-d, h2 - h1 - d, h1 - h2 - d)


def mean_width(area: Column, perimeter: Column) -> Column:
    return F.try_divide(area, perimeter / 2)


def gap_kind(open_sides: Column) -> Column:
    """What a piece between walls is by its open sides."""
    return F.when(open_sides >= 2, "gap").when(open_sides == 1, "notch").otherwise("cavity")
