"""Readings, payloads, totals and policies on small inputs with every odd case."""

import json

import pytest
from pyspark.sql import functions as F

from certlake.operators import payload, readings, totals


@pytest.mark.parametrize(
    ("field", "text", "want"),
    [
        ("heat_number", "A1 12", "A112"), ("heat_number", "A12", None), ("heat_number", "a112", None), ("item_id", "I-1", "I-1"), ("item_id", "A?1", None), ("grade", "S355J2+N", "S355J2+N"), ("grade", "SG", None),
        ("yield_strength_mpa", "355.5 ", "355.5"), ("yield_strength_mpa", "0", None), ("tensile_strength_mpa", "2001", None), ("tensile_strength_mpa", "1,5", None), ("elongation_percentage", "26 %", "26.0"),
        ("elongation_percentage", "0", "0.0"), ("elongation_percentage", "101", None), ("weight_or_length", "", None), ("weight_or_length", "12 kg", "12 kg"), ("remark", "x", None), (None, "x", None), ("grade", None, None),
    ],
)
def test_safe_values(spark, field, text, want):
    assert spark.range(1).select(readings.parsed(F.lit(field).cast("string"), F.lit(text).cast("string")).alias("v")).first().v == want


def test_scores_and_the_best_reading(spark):
    rows = [
        (1, "grade", 0, "alphanumeric", "alpha_scale2_stroke_preserve", "S355J2", 0.9, True), (1, "grade", 1, "alphanumeric", "other", "S355J2", 1.7, True), (1, "grade", 2, "generic", "generic_scale2_otsu", "?", None, None),
        (2, "grade", 1, "x", "y", None, None, None), (2, "grade", 0, "x", "y", "", -1.0, False), (3, "grade", 0, "x", "y", "S355", 0.5, True), (3, "grade", 1, "x", "y", "S235", 0.5, True),
    ]
    scored = readings.score(spark.createDataFrame(rows, "cell int, field string, ordinal int, family string, variant string, text string, confidence double, consistent boolean"))
    one = scored.where("cell = 1 AND ordinal = 0").first()
    quality = round(0.7 + 6 / 8 * 0.3, 4)
    assert one.quality_score == quality and one.total == round(0.35 + 0.2 + 0.9 * 0.15 + quality * 0.1 + 0.1 + 0.092, 4)
    top = {r.cell: (r.ordinal, r.parsed) for r in readings.best(scored, ["cell"]).collect()}
    assert top == {1: (0, "S355J2"), 2: (0, None), 3: (0, "S355")}
    assert {r.cell: (r.n_readings, r.n_values, r.agreed) for r in readings.agreement(scored, ["cell"]).collect()} == {1: (3, 1, True), 2: (2, 0, False), 3: (2, 2, False)}


def test_missing_confidence_is_not_null(spark):
    props = {"yield_strength_mpa": 250, "tensile_strength_mpa": 420.5, "elongation_percentage": "28"}
    items = [
        {"mechanical_properties": props}, {"mechanical_properties": props, "field_confidence": {"yield_strength_mpa": None, "tensile_strength_mpa": 0.8, "elongation_percentage": True}},
        {"mechanical_properties": None, "field_confidence": 3, "row_confidence": 1.01, "source_page": 0}, {}, None, {"item_id": " A ", "row_confidence": 1, "source_page": 2, "needs_review": True},
    ]
    df = spark.createDataFrame([(1, json.dumps({"items": items})), (2, "no json"), (3, None), (4, "[1]"), (5, '{"items": 3}')], "doc_id int, payload string")
    got = [(r.row_index, r.yield_strength_mpa, r.tensile_strength_mpa, r.elongation_percentage, r.item_id, r.row_confidence, r.needs_review, r.source_page) for r in payload.rows(df).orderBy("row_index").collect()]
    assert got[:2] == [(0, 250.0, 420.5, 28.0, None, None, False, None), (1, None, 420.5, None, None, None, False, None)]
    assert got[2:4] == [(2, None, None, None, None, None, False, None), (3, None, None, None, None, None, False, None)] and got[-1][4:] == ("A", 1.0, True, 2) and len(got) == 6


def test_meta_keys_are_dropped(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "source_filename": "x", "preprocessing_meta": {"p": 2}}'), (2, "[1]"), (3, None), (4, "{")], "doc_id int, payload string")
    got = {r.doc_id: r for r in payload.without_meta(df).select("doc_id", F.map_keys("extraction").alias("k"), F.try_variant_get("meta", "$.p", "int").alias("p")).collect()}
    assert (got[1].k, got[1].p) == (["a"], 2) and all((got[i].k, got[i].p) == (None, None) for i in (2, 3, 4))


def test_batch_totals_take_elements(spark):
    rows = [("OK", True, 10, "a", "x"), ("OK", None, 30, "", None), ("ERROR", True, 20, "a", "x"), ("DRY_RUN", False, None, None, "y")]
    runs = spark.createDataFrame(rows, "status string, review boolean, latency_ms long, route string, quality_class string")
    r = totals.batch_totals(runs).first()
    assert (r.total_documents, r.ok, r.errors, r.dry_run, r.review_required, r.review_rate, r.stp_rate) == (4, 2, 1, 1, 1, 0.5, 0.5)
    assert (r.mean_latency_ms, r.median_latency_ms, r.p95_latency_ms) == (20.0, 20.0, 30.0)
    assert r.route_counts == {"a": 2, "unknown": 2} and r.quality_counts == {"x": 2, "unknown": 1, "y": 1}
    empty = totals.batch_totals(runs.limit(0)).first()
    assert (empty.total_documents, empty.review_rate, empty.median_latency_ms, empty.p95_latency_ms, empty.route_counts) == (0, 0.0, 0.0, 0.0, {})


def test_field_totals_have_every_class(spark):
    rows = [("heat", True, True, False, "critical", totals.IDENTIFIER_MATCHER), ("heat", False, False, None, "critical", totals.IDENTIFIER_MATCHER), ("grade", False, True, False, "critical", "x"), ("grade", False, False, True, "standard", "x")]
    got = {r.field: r for r in totals.field_totals(spark.createDataFrame(rows, "field string, raw boolean, business boolean, review boolean, criticality string, matcher string")).collect()}
    assert (got[None].n, got[None].harmless, got[None].true_mismatches, got[None].review_needed, got[None].critical_identifier_mismatches, got[None].delta) == (4, 1, 1, 1, 1, 0.25)
    assert (got["grade"].raw_accuracy, got["grade"].business_accuracy, got["heat"].delta) == (0.0, 0.5, 0.0)


def test_settings_come_from_the_nearest_level(spark):
    fields = spark.createDataFrame([(1, "heat", "ids"), (1, "grade", None), (2, "heat", "ids")], "policy int, field string, group string")
    settings = [(1, "field", "heat", "criticality", "critical"), (1, "group", "ids", "criticality", "high"), (1, "group", "ids", "field_type", "code"), (1, "defaults", None, "field_type", "words"), (1, "field", "grade", "field_type", None), (1, "field", "grade", "odd", "1")]
    got = {(r.policy, r.field, r.name): (r.value, r.source) for r in totals.resolved_policies(fields, spark.createDataFrame(settings, "policy int, level string, subject string, name string, value string")).collect()}
    assert len(got) == 3 * len(totals.BUILT_IN)
    assert got[1, "heat", "criticality"] == ("critical", "field") and got[1, "heat", "field_type"] == ("code", "group")
    assert got[1, "grade", "field_type"] == ("words", "defaults") and got[2, "heat", "field_type"] == ("text", "built_in") and got[1, "grade", "criticality"] == ("standard", "built_in")
