"""Vectors of batch, review-sheet and store rules."""

import pytest
from pyspark.sql import functions as F

from certlake.operators import batch


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("pages", "quality", "blur", "density", "text", "table", "expected"),
    [
        (1, "digital_clean", 200.0, 1.0, True, True, 100.0), (2, "scan_clean", None, None, False, False, 48.0), (7, "noisy_scan", 90.0, 0.0, False, False, -10.0),
        (1, "noisy_scan", 29.0, 0.0, False, False, None), (0, "other", 10.0, 0.0, None, None, 60.0), (4, None, 10.0, 0.5, False, True, 37.5),
    ],
)
def test_scores(spark, pages, quality, blur, density, text, table, expected):
    typed = zip((pages, quality, blur, density, text, table), ("long", "string", "double", "double", "boolean", "boolean"), strict=True)
    assert one(spark, batch.document_score(*(F.lit(v).cast(t) for v, t in typed))) == expected


def test_severe_scans_can_be_let_in(spark):
    assert one(spark, batch.document_score(F.lit(1), F.lit("noisy_scan"), F.lit(10.0), F.lit(0.0), F.lit(False), F.lit(False), severe=True)) == 55.0


@pytest.mark.parametrize(("name", "key"), [("doc12", 12), ("doc007", 7), ("document", None), ("12", None), ("doc", None), (None, None)])
def test_natural_order(spark, name, key):
    assert one(spark, batch.natural_key(F.lit(name).cast("string"))) == key


@pytest.mark.parametrize(("owned", "state", "code"), [(True, "queued", 425), (True, "cancelled", 409), (True, "failed", 200), (False, "succeeded", 404), (None, "queued", 404)])
def test_answers(spark, owned, state, code):
    assert one(spark, batch.result_code(F.lit(owned).cast("boolean"), F.lit(state))) == code


def test_stored_columns(spark):
    n = lambda v: F.lit(v).cast("long")
    assert [one(spark, batch.page_count(n(a), n(b))) for a, b in ((3, 5), (-1, 5), (None, 5), (None, -2), (None, None), (0, 5))] == [3, 5, 5, 0, 0, 0]
    s = lambda v: F.lit(v).cast("string")
    assert [one(spark, batch.run_status(s(a), F.lit(b))) for a, b in (("X", True), ("", True), (None, False))] == ["X", "NEEDS_REVIEW", "COMPLETED"]
    users = spark.createDataFrame([("a@b.c",), ("d@e.f",)], "email string")
    assert [r.email for r in batch.user_by_email(users, "A@B.C").collect()] == ["a@b.c"]


def test_audits_excuse_absent_columns(spark):
    rows = spark.createDataFrame([(1, None, "H", 1.0), (1, "", None, None), (2, None, None, 1.0), (3, "x", None, 1.0)], "doc_id long, item_id string, heat_number string, yield_mpa double")
    audits = spark.createDataFrame([(1, "No item ID column here"), (2, "heat absent"), (3, None), (4, "")], "doc_id long, audit string")
    got = {r.doc_id: (r.missing, r.total, r.rate) for r in batch.missing_rate(rows, audits, ["item_id", "heat_number", "yield_mpa"]).collect()}
    assert got == {1: (2, 4, 0.5), 2: (1, 2, 0.5), 3: (1, 3, 0.3333), 4: (0, 0, 1.0)}


def test_confidences_fall_back(spark):
    fields = spark.createDataFrame([(1, "grade", 0.5), (1, "notes", 1.5), (2, "notes", 0.4), (3, "grade", None)], "doc_id long, field string, confidence double")
    docs = spark.createDataFrame([(1, 0.1, 0.2), (2, 0.1, 0.2), (3, 0.6, 0.2), (4, None, 1.2), (5, None, None)], "doc_id long, row_mean double, overall double")
    got = {r.doc_id: (r.least_critical, r["mean"]) for r in batch.confidence_summary(fields, docs, ["grade"]).collect()}
    assert got == {1: (0.5, 0.75), 2: (0.0, 0.4), 3: (0.6, 0.6), 4: (1.0, 1.0), 5: (0.0, 0.0)}


def test_review_sheets_become_gold(spark):
    rows = [(" d1 ", "ok", "", "Works ", "A| |B", None, "Yes", "no"), ("#", "ok", "x", "x", "x", "x", "x", "x"), ("d2", "pending", "x", "x", "x", "x", "x", "x"), ("d3", "VERIFIED", None, None, None, None, None, "no")]
    sheet = spark.createDataFrame(rows, "document_id string, review_status string, verified_s string, extracted_s string, verified_l string, extracted_l string, verified_is_compliant string, extracted_is_compliant string")
    got = batch.gold_record(batch.promote_reviewed(sheet, ["s", "l", "is_compliant"]), ["s"], ["l"]).orderBy("document_id").collect()
    assert [tuple(r) for r in got] == [("d1", "Works", ["A", "B"], True), ("d3", None, [], False)]


def test_children_are_replaced(spark):
    old = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "run_id long, row_index long, item string")
    fresh = spark.createDataFrame([(1, "y"), (1, "x"), (3, "z")], "run_id long, item string")
    assert sorted(map(tuple, batch.replace_children(old, fresh, "run_id", ["item"]).collect())) == [(1, 0, "x"), (1, 1, "y"), (2, 0, "b"), (3, 0, "z")]


def test_empty_inputs(spark):
    assert batch.suppressed_groups(spark.createDataFrame([], "doc_id long, ordinal long, scope string, row_index long, field string")).count() == 0
    assert batch.text_statistics(spark.createDataFrame([], "doc_id long, chars long, noisy boolean")).count() == 0


def test_unknown_keys_take_the_default(spark):
    policies = spark.createDataFrame([("A", 1), ("B", 2)], "k string, least int")
    rows = spark.createDataFrame([(1, "B"), (2, "x"), (3, None)], "doc_id long, k string")
    assert {r.doc_id: (r.policy, r.least) for r in batch.with_default(rows, policies, "k", "A").collect()} == {1: ("B", 2), 2: ("A", 1), 3: ("A", 1)}
