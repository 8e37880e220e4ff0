"""Vectors of the evaluation report."""

import pytest
from pyspark.sql import functions as F

from certlake.operators import report


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def texts(*values):
    return F.array(*map(F.lit, values)) if values else F.lit(None).cast("array<string>")


@pytest.mark.parametrize(("status", "expected"), [(None, True), ("", True), ("verified", True), (" Verified", True), ("candidate", False), ("needs_manual", False)])
def test_only_verified_gold_counts(spark, status, expected):
    assert one(spark, report.verified(F.lit(status).cast("string"))) is expected


@pytest.mark.parametrize(
    ("gold", "pred", "expected"),
    [
        (("250",), ("251.0",), True), (("250",), ("251.5",), False), (("1", "5"), ("5", "1"), True), (("A", "b "), ("B", "a"), True), (("a",), ("a", "a"), False), (("a",), (), False),
        (("Mill  Test",), ("mill test",), True), (("1", "x"), ("x", "1"), True),
    ],
)
def test_equal_values(spark, gold, pred, expected):
    assert one(spark, report.equal_values(texts(*gold), texts(*pred))) is expected


@pytest.mark.parametrize(("word", "expected"), [("YES", True), ("manual_review", True), ("Auto_Accept", False), ("0", False), ("maybe", None), (None, None)])
def test_flags(spark, word, expected):
    assert one(spark, report.flag(F.lit(word).cast("string"))) is expected


def test_fields_come_from_plurals_then_columns_then_items(spark):
    docs = spark.createDataFrame([(1, "P1|P2", "G", "yes", None), (2, None, None, "no", " "), (3, "", "", "perhaps", "kept")], "doc_id long, heat_numbers string, grade string, review_required string, processing_decision string")
    items = spark.createDataFrame([(1, 0, "H", "x"), (2, 1, "H2", "g2"), (2, 0, "H1", None), (3, 0, None, "")], "doc_id long, row_index long, heat_number string, grade string")
    got = {(r.doc_id, r.field): r["values"] for r in report.flatten_fields(docs, items).collect()}
    assert got == {
        (1, "heat_number"): ["P1", "P2"], (1, "grade"): ["G"], (1, "review_required"): ["yes"], (1, "processing_decision"): ["needs_review"],
        (2, "heat_number"): ["H1", "H2"], (2, "grade"): ["g2"], (2, "review_required"): ["no"], (2, "processing_decision"): ["auto_accept"],
        (3, "review_required"): ["perhaps"], (3, "processing_decision"): ["kept"],
    }


def test_documents_are_counted(spark):
    fields = "doc_id long, field string, values array<string>"
    gold = spark.createDataFrame([(1, "grade", ["S195"]), (1, "heat_number", ["A"]), (1, "review_required", ["true"]), (2, "grade", ["S195"]), (3, "grade", ["S195"]), (4, "review_required", ["no"])], fields)
    pred = spark.createDataFrame([(1, "grade", ["s195"]), (1, "review_required", ["pass"]), (2, "grade", ["x"]), (4, "review_required", ["review"])], fields)
    docs = spark.createDataFrame([(1, True, False), (2, False, False), (3, True, True), (4, True, False)], "doc_id long, verified_gold boolean, prediction_missing boolean")
    rows = report.compare(docs, gold, pred)
    assert {(r.doc_id, r.field): r.reason for r in rows.where("reason IS NOT NULL").collect()} == {
        (1, "heat_number"): "missing_field", (1, "review_required"): "mismatch", (3, "grade"): "missing_prediction_file", (4, "review_required"): "fail_closed_review",
    }
    got = {r.doc_id: (r.field_hits, r.field_total, r.critical_total, r.tracing_total, r.extraction_misses, r.unsafe, r.fail_closed) for r in report.document_counts(rows).collect()}
    assert got == {1: (1, 3, 3, 1, 1, 1, 0), 2: (0, 0, 0, 0, 0, 0, 0), 3: (0, 1, 1, 0, 1, 0, 0), 4: (0, 1, 1, 0, 0, 0, 1)}
    assert [(r.field, r.samples, r.correct) for r in report.field_metrics(rows).orderBy("field").collect()] == [("grade", 2, 1), ("heat_number", 1, 0), ("review_required", 2, 0)]
    assert report.failure_examples(rows, 1).count() == 4


def test_empty_runs(spark):
    schema = "run string, field_hits long, field_total long, critical_hits long, critical_total long, compliance_correct boolean, review boolean, latency_ms double, completeness double"
    assert report.run_metrics(spark.createDataFrame([], schema), ["run"]).count() == 0
    row = report.run_metrics(spark.createDataFrame([("a", 0, 0, 0, 0, None, None, None, None)], schema), ["run"]).first()
    assert (row.field_accuracy, row.review_rate, row.straight_through_rate, row.mean_latency_ms) == (0.0, 0.0, 1.0, 0.0)
