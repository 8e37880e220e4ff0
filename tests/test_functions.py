import pytest
from pyspark.sql import functions as F

from certlake.functions import labels, numeric, text
from certlake.operators import evaluate


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "raw, kind, locale, value, uncertain, promoted",
    [
        ("1.097", "yield_mpa", "auto", 1097.0, False, True), ("1.250", "tensile_mpa", "auto", 1250.0, False, True), ("1,097", "yield_mpa", "comma_decimal", 1.097, True, False),
        ("26,5%", "elongation_pct", "auto", 26.5, False, False), ("1.097", "elongation_pct", "auto", 1.097, True, False), ("n/a", "yield_mpa", "auto", None, True, False),
        ("515-750", "yield_mpa", "auto", 0.0, True, False), ("", "yield_mpa", "auto", None, False, False), (None, "yield_mpa", "auto", None, False, False),
        ("1.234,56", "yield_mpa", "auto", 1234.56, False, False), ("1.234.567", "weight", "auto", 1234567.0, False, True), ("420 MPa", "tensile_mpa", "auto", 420.0, False, False),
        ("1,097", "yield_mpa", "dot_decimal", 1097.0, False, True),
    ],
)
def test_locale_numbers(spark, raw, kind, locale, value, uncertain, promoted):
    got = one(spark, numeric.parse_locale(F.lit(raw).cast("string"), kind, locale))
    assert (got.value, got.uncertain, got.promoted) == (value, uncertain, promoted)


def test_float_promotion(spark):
    got = one(spark, numeric.promote_float(F.lit(1.097), "yield_mpa"))
    assert (got.value, got.promoted, got.uncertain) == (1097.0, True, False)
    assert one(spark, numeric.promote_float(F.lit(26.5), "elongation_pct")).value == 26.5


@pytest.mark.parametrize("a, b, same", [("07/10/2024", "07.10.2024", True), ("07/10/2024", "2024-10-07", True), ("2024-10", "2024-10-07", False), ("31/02/2024", "31/02/2024", False), ("1-2-69", "2069-02-01", True)])
def test_dates(spark, a, b, same):
    assert one(spark, evaluate.dates(F.lit(a), F.lit(b))) is same


@pytest.mark.parametrize("a, b, same", [("2195 kg", "2.195 t", True), ("2195 kg", "2195 Kgs.", True), ("2195 kg", "2195 g", False), ("5 mm", "5 mm", True), ("5 mm", "5 cm", False), ("x", "1 kg", False)])
def test_units(spark, a, b, same):
    assert one(spark, evaluate.unit(F.lit(a), F.lit(b))) is same


@pytest.mark.parametrize("a, b, same", [("AB-123", "AB123", False), ("00123", "123", False), (" AB-123 ", "AB-123", True)])
def test_identifiers_are_strict(spark, a, b, same):
    assert one(spark, evaluate.identifier(F.lit(a), F.lit(b))) is same


@pytest.mark.parametrize("a, b, same", [("2 x 1000 x 2000 mm", "2.0mm x 1000mm x 2000mm", True), ("2 x 1000 x 2000 mm", "1000 x 2 x 2000 mm", False), ("2 x 3 mm", "2 x 3 cm", False)])
def test_dimensions(spark, a, b, same):
    assert one(spark, evaluate.dimension(F.lit(a), F.lit(b))) is same


def test_chain_and_missing_values(spark):
    run = lambda g, p: one(spark, evaluate.chain(F.lit(g).cast("string"), F.lit(p).cast("string"), ["exact", "numeric"]))
    assert run(None, " ").match and not run("x", None).match
    assert (run("250", "250.5").match, run("250", "250.5").matcher) == (True, "numeric") and run("a b", "A  B").matcher == "exact"
    assert one(spark, evaluate.semantic(F.lit("MTC"), F.lit("mill test certificate"))) is True


def test_suppliers(spark):
    assert one(spark, text.normalize_supplier(F.lit("Acme Steel S.p.A"))) == one(spark, text.normalize_supplier(F.lit("ACME steel SPA")))
    assert one(spark, text.normalize_supplier(F.lit("Acme Steel S.p.A."))) == "acme steel spa ."  # the last point is no part of the form
    assert one(spark, text.normalize_exact(F.lit("Acme Steel GmbH."))) == "acme steel gmbh."
    assert one(spark, text.normalize_supplier(F.lit("ΑCME"))) == "acme"
    assert one(spark, evaluate.supplier(F.lit("Acme Steel"), F.lit("acme Steel Works"))) is False


def test_shapes_and_headers(spark):
    assert one(spark, text.normalize_header(F.lit("Rp 0,2 (MPa)"))) == "RP0.2 MPA"
    assert one(spark, text.normalize_header(F.lit("heat_no:"))) == "HEAT NO"
    assert one(spark, text.confusable_heats(F.lit("A1005"), F.lit("AI0O5"))) is True
    assert one(spark, text.confusable_heats(F.lit("H005"), F.lit("H006"))) is False
    assert one(spark, text.is_missing(F.lit(" "))) is True and one(spark, text.is_missing(F.lit("0"))) is False
    assert one(spark, text.noisy_text(F.lit("é" * 50))) is False and one(spark, text.noisy_text(F.lit("word " * 10 + "~^~"))) is True and one(spark, text.noisy_text(F.lit("ab¤¤" * 20))) is True and one(spark, text.noisy_text(F.lit("short é"))) is False


def test_labels_in_text(spark):
    found = one(spark, labels.labelled_identifiers(F.lit("Heat No: 410537, Lot: L-22 and Grade: S355J2. The order was late. Heat number 9"))).found
    assert [(e.field, e.value) for e in found] == [("heat_number", "410537"), ("lot_number", "L-22"), ("grade", "S355J2. The order was late")]
    assert one(spark, labels.labelled_identifiers(F.lit(None).cast("string"))).found == []


def test_details_days_and_substitutions(spark):
    got = one(spark, text.split_details(F.lit("NOVOFIL SG2 DIAM. 1.2 mm")))
    assert (got["product"], got["details"]) == ("NOVOFIL SG2", "DIAM. 1.2 mm")
    assert one(spark, text.normalize_day(F.lit("7.1.24"))) == "07/01/24" and one(spark, text.normalize_day(F.lit("soon"))) == "soon"
    both = one(spark, text.split_identifier_and_date(F.lit("No A-123 07/10/2024")))
    assert (both.identifier, both.date, both.conflict) == ("A-123", "07/10/2024", False)
    assert one(spark, text.single_substitution(F.lit("A105"), F.lit("AI05"))) is True
    assert one(spark, text.single_substitution(F.lit("A105"), F.lit("A106"))) is True and one(spark, text.single_substitution(F.lit("AX05"), F.lit("AY05"))) is False
    pairs = {("D105", "0105"): False, ("1G5", "165"): True, ("AG5", "A65"): False, ("B105", "8105"): True, ("B105", "6105"): False, ("A10", "A105"): False, ("A15", "B25"): False}
    for (a, b), expected in pairs.items():
        assert one(spark, text.single_substitution(F.lit(a), F.lit(b))) is expected, (a, b)
    assert one(spark, text.dimension_fragment(F.lit("rod 12,5 mm"))) == "12,5 mm" and one(spark, text.dimension_fragment(F.lit("rod"))) is None


@pytest.mark.parametrize(("code", "expected"), [("812003694", False), ("81200369O", True), ("S1200594", True), ("A1200594", False), ("LS210612G8", False), ("12G34567", True), ("G2345678", True), ("AB-12", False), ("A12S45", True), ("", False), ("XYZ", False)])
def test_suspicious_identifiers(spark, code, expected):
    assert one(spark, text.suspicious_identifier(F.lit(code))) is expected
