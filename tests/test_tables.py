"""Vectors of table shapes: labelled mechanical rows, canonical keys, overlay, alternative classifications."""

import pytest
from pyspark.sql import functions as F

from certlake.functions.text import normalize_header
from certlake.operators import tables
from certlake.registries import headers

CELL = "doc_id long, row_index long, ordinal int, label string, header string, value string"


def cells(spark, rows):
    """rows: (doc, row, label, {header: value})."""
    flat = [(d, r, i, label, h, v) for d, r, label, values in rows for i, (h, v) in enumerate(values.items())]
    return spark.createDataFrame(flat, CELL)


def test_results_go_before_requirements(spark):
    table = cells(spark, [
        (1, 0, "Yield strength Rp0.2", {"Specified": "205", "Results": "335"}), (1, 1, "Proof strength Rp1.0", {"Min": "225", "Results": "381"}),
        (1, 2, "Tensile Strength Rm", {"Specified": "515-750", "Min": "515", "Max": "750", "Results": "638"}), (1, 3, "Elongation", {"Results": "52/51"}),
        (1, 4, "Hardness HB", {"Results": "180"}), (2, 0, "Rm", {"Min": "515", "Max": "750"}), (3, 0, "Rm", {"Results": "500", "Measured": "510"}),
        (4, 0, "Rm", {"A1": "500", "A2": "510"}), (5, 0, "Re", {"Value": "300"}), (5, 1, "Rp 0.2", {"Value": "310"}), (6, 0, "Rm", {"A1": "500"}),
    ])
    got = {r.doc_id: (r.yield_mpa, r.tensile_mpa, r.elongation_pct, r.rp10_mpa, r.elongation_raw, r.uncertain) for r in tables.mechanical_properties(table).collect()}
    none = None
    assert got == {
        1: (335.0, 638.0, 52.0, 381.0, "52/51", False), 2: (none, none, none, none, none, False), 3: (none, 500.0, none, none, none, True),
        4: (none, none, none, none, none, True), 5: (310.0, none, none, none, none, True), 6: (none, 500.0, none, none, none, False),
    }


@pytest.mark.parametrize(
    ("label", "kind"),
    [("Rp0.2", "yield_rp02"), ("RP 0,2", "yield_rp02"), ("Rp1.0", "yield_rp10"), ("Re", "yield"), ("Rm", "tensile"), ("A%", "elongation"), ("Tensile yield", None), ("Impact Rm", None)],
)
def test_labels(spark, label, kind):
    assert spark.range(1).select(tables.property_kind(normalize_header(F.lit(label))).alias("k")).first().k == kind


def test_overlay_and_synthesised_rows(spark):
    found = tables.mechanical_properties(cells(spark, [(1, 0, "Rm", {"Results": "638"}), (2, 0, "Rm", {"Results": "500"}), (3, 0, "Rm", {"Min": "1"})]))
    rows = spark.createDataFrame([(1, 4, 300.0, 400.0, None, False), (1, 5, 1.0, 2.0, 3.0, False), (9, 0, 1.0, 2.0, 3.0, None)], "doc_id long, row_index long, yield_mpa double, tensile_mpa double, elongation_pct double, needs_review boolean")
    got = {(r.doc_id, r.row_index): (r.yield_mpa, r.tensile_mpa, r.synthesised) for r in tables.overlay(rows, found).collect()}
    assert got == {(1, 4): (300.0, 638.0, False), (1, 5): (1.0, 2.0, False), (2, 0): (None, 500.0, True), (9, 0): (1.0, 2.0, False)}


def test_own_tables_go_before_derived_rows(spark):
    own = cells(spark, [(1, 0, "Rm", {"Results": "1"})])
    derived = cells(spark, [(1, 0, "Rm", {"Results": "2"}), (1, 1, "Re", {"Results": "2"}), (2, 0, "Rm", {"Results": "3"}), (2, 1, "Re", {"Results": "4"}), (3, 0, "Rm", {"Results": "5"})])
    assert sorted((r.doc_id, r.value) for r in tables.table_cells(own, derived).collect()) == [(1, "1"), (2, "3"), (2, "4")]


def test_the_first_value_of_synonyms_stays(spark):
    rows = [(1, 0, 0, "Heat No", "A1"), (1, 0, 1, "Schmelze", "B2"), (1, 0, 2, "Odd", None), (2, 0, 0, "HEAT", ""), (2, 0, 1, "Melt No", "C3"), (3, 0, 0, "HEAT", "D4"), (3, 0, 1, "heat_number", "E5")]
    out = tables.canonical_cells(spark.createDataFrame(rows, "doc_id long, row_index long, ordinal int, header string, value string"), headers(spark))
    assert {(r.doc_id, r.field): (r.value, r.resolved) for r in out.collect()} == {(1, "heat_number"): ("A1", True), (1, "Odd"): (None, False), (2, "heat_number"): ("C3", True), (3, "heat_number"): ("E5", True)}


def test_alternative_classes(spark):
    rows = [(d, i, c, h, w, 1.0, 2.0, 3.0) for d, group in {1: [("E 42", "H", ""), ("W 42", "", None)], 2: [("E", "H", ""), ("W", "K", "")], 3: [("E", "H", "")], 4: [("E", "H", "1 kg"), ("W", "H", "")]}.items() for i, (c, h, w) in enumerate(group)]
    df = spark.createDataFrame(rows, "doc_id long, row_index long, classification string, heat string, weight string, yield_mpa double, tensile_mpa double, elongation_pct double")
    got = sorted((r.doc_id, r.row_index, r.standards) for r in tables.collapse_alternatives(df).collect())
    assert got == [(1, 0, "W 42"), (2, 0, ""), (2, 1, ""), (3, 0, ""), (4, 0, ""), (4, 1, "")]


def test_empty_tables(spark):
    empty = cells(spark, [(1, 0, "Rm", {"x": "1"})]).limit(0)
    assert tables.mechanical_properties(empty).count() == 0 and tables.table_cells(empty, empty).count() == 0
