"""Numbers as certificates write them: Column to Column, all inside generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from certlake.registries import BANDS, MASS_UNITS

UNIT = r"(?i)\s*(MPA|N/MM2|PSI|KSI|%|PCT|KG|MT|TONS|TON|PCS|MM|CM|M|FT)\s*$"
MASS_OR_LENGTH = r"(?i)\s*(kilograms|kilogram|kgs|kg|grams|gram|g|tonnes|tonne|tons|ton|t|mt|mm|cm|m)\s*\.?$"


def plausible(value: Column, kind: str | Column) -> Column:
    """Within the band of the kind; kinds without a band are always plausible.  The kind may differ by row."""
    if isinstance(kind, str):
        return value.between(*BANDS[kind]) if kind in BANDS else value.isNotNull()
    out = F.when(F.lit(False), F.lit(None).cast("boolean"))
    for name, band in BANDS.items():
        out = out.when(kind == name, value.between(*band))
    return out.otherwise(value.isNotNull())


def suspicious(value: Column, band: tuple[float, float]) -> Column:
    return (value < band[0]) | (value > band[1])


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def parse_locale(raw: Column, kind: str | Column, locale: str = "auto") -> Column:
    """struct<value, uncertain, promoted, reading> of a number whose separators may be decimal or thousands.

    Each pattern of separators gives one or two readings; the plausible band of the kind chooses.  A text
    without any reading has the value 0 and is uncertain; null and blank texts have a certain null.
    """
    text = F.trim(raw)
    digits = F.regexp_replace(F.regexp_replace(text, UNIT, ""), r"[^0-9.,\-]", "")
    return let(digits, lambda d: let(_readings(d, locale), lambda r: _choose(text, d, r, kind)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _readings(digits: Column, locale: str) -> Column:
    """array<struct<value, name>> of the readings that are numbers."""
    dots, commas = _count(digits, "."), _count(digits, ",")
    bare, point = F.translate(digits, ".,", ""), F.replace(digits, F.lit(","), F.lit("."))
    grouped = F.regexp_like(digits, F.lit(r"^[^.,]+[.,][^.,]{3}$"))
    last_dot, last_comma = F.length(F.substring_index(digits, ".", -1)), F.length(F.substring_index(digits, ",", -1))
    none = F.lit(None).cast("struct<value:double,name:string>")
    as_read = lambda text, name: F.struct(text.try_cast("double").alias("value"), F.lit(name).alias("name"))
    single = (dots + commas) == 1
    thousands = {"comma_decimal": single & (dots == 1), "dot_decimal": single & (commas == 1)}.get(locale, F.lit(False))
    first = (
        F.when((dots == 0) & (commas == 0), as_read(digits, "digits_only"))
        .when(thousands, as_read(bare, "thousands"))
        .when(single, as_read(point, "decimal"))
        .when((dots > 0) & (commas > 0) & (last_dot < last_comma), as_read(F.replace(digits, F.lit(","), F.lit("")), "dot_decimal_with_thousands"))
        .when((dots > 0) & (commas > 0), as_read(F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit(".")), "comma_decimal_with_thousands"))
        .otherwise(as_read(bare, "thousands_grouped"))
    )
    second = F.when(single & grouped & F.lit(locale == "auto"), as_read(bare, "thousands")).otherwise(none)
    return F.filter(F.array(first, second), lambda r: r["value"].isNotNull())


def _choose(text: Column, digits: Column, readings: Column, kind: str | Column) -> Column:
    """The first plausible reading, else the first; certain if exactly one is plausible."""
    good = F.filter(readings, lambda r: plausible(r["value"], kind))
    blank = F.coalesce(text, F.lit("")) == ""
    empty = blank | (digits == "")
    three = F.regexp_like(digits, F.lit(r"^-?[0-9]+[.,][0-9]{3}$"))
    banded = F.lit(kind in BANDS) if isinstance(kind, str) else F.coalesce(kind.isin(*BANDS), F.lit(False))

    def result(chosen: Column) -> Column:
        doubt = (F.size(good) != 1) | ((chosen["name"] == "decimal") & three & banded)
        return F.struct(
            F.when(~empty, F.coalesce(chosen["value"], F.lit(0.0))).alias("value"),
            F.when(blank, False).when(empty, True).otherwise(F.coalesce(doubt, F.lit(True))).alias("uncertain"),
            (~empty & F.coalesce(chosen["name"].isin("thousands", "thousands_grouped"), F.lit(False))).alias("promoted"),
            F.when(empty, "empty").otherwise(F.coalesce(chosen["name"], F.lit("empty"))).alias("reading"),
        )

    return let(F.coalesce(F.get(good, F.lit(0)), F.get(readings, F.lit(0))), result)


def promote_float(value: Column, kind: str) -> Column:
    """struct<value, uncertain, promoted>: an implausible number of one to three decimals whose thousandfold is
    plausible was a thousands separator."""
    raised = F.round(value * 1000, 6)
    fits = (raised == F.round(raised)) & (value != F.round(value)) & plausible(raised, kind)
    return F.struct(
        F.when(plausible(value, kind), value).when(fits, raised).otherwise(value).alias("value"),
        (~plausible(value, kind) & ~fits).alias("uncertain"),
        (~plausible(value, kind) & fits).alias("promoted"),
    )


def parse_first(raw: Column) -> Column:
    """The first number of a text; the last of two kinds of separators is decimal, a lone comma with up to two
    digits after it too, and a dot always."""
    token = F.replace(F.trim(F.regexp_extract(raw, r"[-+]?[0-9][0-9,.\s]*", 0)), F.lit(" "), F.lit(""))
    dots, commas = _count(token, "."), _count(token, ",")
    comma_last = F.length(F.substring_index(token, ",", -1)) < F.length(F.substring_index(token, ".", -1))
    swapped = F.replace(F.replace(token, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    short = (commas == 1) & (F.length(F.substring_index(token, ",", -1)) <= 2)
    return (
        F.when((dots > 0) & (commas > 0) & comma_last, swapped)
        .when((dots == 0) & short, F.replace(token, F.lit(","), F.lit(".")))
        .otherwise(F.replace(token, F.lit(","), F.lit("")))
        .try_cast("double")
    )


def unit_of(raw: Column) -> Column:
    """The canonical unit at the end of a text; empty if there is none."""
    unit = F.lower(F.regexp_extract(F.trim(raw), MASS_OR_LENGTH, 1))
    names = F.create_map(*(F.lit(x) for u, (name, _) in MASS_UNITS.items() for x in (u, name)))
    return F.coalesce(F.element_at(names, unit), unit)


def parse_unit(raw: Column) -> Column:
    """struct<value, unit, kg>; kg is null for units that are not of mass."""
    scale = F.create_map(*(F.lit(x) for name, kg in {n: k for n, k in MASS_UNITS.values()}.items() for x in (name, kg)))
    value = parse_first(raw)
    return F.struct(value.alias("value"), unit_of(raw).alias("unit"), (value * F.element_at(scale, unit_of(raw))).alias("kg"))


def dimension_parts(raw: Column) -> Column:
    """array<double> of a dimension such as ``2 x 1000 mm``; null if a part has no number."""
    chunks = F.filter(F.split(F.trim(raw), r"(?i)\s*(?:x|×|\*|/|by)\s*"), lambda c: F.trim(c) != "")
    parts = F.transform(chunks, parse_first)
    return F.when((F.size(parts) > 0) & F.forall(parts, lambda p: p.isNotNull()), parts)


def dimension_signature(raw: Column, ordered: bool = True) -> Column:
    """Parts to six places, and the unit of the last part that has one, as text."""
    parts = F.transform(dimension_parts(raw), lambda p: F.round(p * 1000000).cast("long"))
    return F.concat_ws(" ", F.array_join(F.transform(parts if ordered else F.array_sort(parts), lambda p: p.cast("string")), "x"), unit_of(raw))


def parse_chemistry(raw: Column) -> Column:
    """A share in percent; null for what is no finite number."""
    value = F.regexp_replace(F.replace(raw, F.lit(","), F.lit(".")), r"[%\s]", "").try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)
