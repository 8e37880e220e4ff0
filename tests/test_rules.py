"""Vectors of the profile, condition, confidence and bucket rules."""

import pytest
from pyspark.sql import functions as F

from certlake.operators import confidence, profile, store


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "blur", "noise", "density", "corrupt", "raster", "expected"),
    [
        (True, 300.0, 5.0, 0.35, False, False, "digital_clean"), (False, 300.0, 5.0, 0.0, False, False, "scan_clean"), (False, 70.0, 5.0, 0.0, False, False, "noisy_scan"),
        (False, 300.0, 35.0, 0.0, False, False, "noisy_scan"), (False, 140.0, 15.0, 0.0, False, False, "noisy_scan"), (True, 300.0, 5.0, 0.01, False, False, "scan_clean"),
        (True, 300.0, 5.0, 0.35, True, True, "noisy_scan"), (True, 300.0, 5.0, 0.35, False, True, "noisy_scan"), (False, 20.0, 50.0, 0.0, False, False, "severe_scan"),
        (False, 20.0, 5.0, 0.0, False, False, "severe_scan"), (True, 20.0, 5.0, 0.35, False, False, "noisy_scan"), (True, 10.0, 5.0, 0.01, False, False, "severe_scan"),
    ],
)
def test_quality_classes(spark, text, blur, noise, density, corrupt, raster, expected):
    rows = [(text, blur, noise, density, corrupt, raster)]
    schema = "has_text boolean, blur double, noise double, text_density double, noisy_ocr boolean, full_page_raster boolean"
    got = store.route(spark.createDataFrame(rows, schema)).first()
    assert got.quality_class == expected and got.route == store.ROUTES[expected][0] and got.review_first == (expected == "severe_scan")


@pytest.mark.parametrize(
    ("blur", "noise", "expected"),
    [(200.0, 5.0, "clean"), (70.0, 30.0, "noisy_and_blurry"), (70.0, 14.0, "blurry"), (100.0, 5.0, "blurry"), (100.0, 14.0, "noisy_and_blurry"), (200.0, 14.0, "noisy"), (100.0, 25.0, "noisy")],
)
def test_conditions(spark, blur, noise, expected):
    assert one(spark, profile.condition(F.lit(blur), F.lit(noise))) == expected


def test_buckets(spark):
    assert [one(spark, store.page_bucket(F.lit(n))) for n in (0, 1, 2, 4, 5)] == ["single", "single", "short", "short", "long"]
    sizes = (200 * 1024 - 1, 200 * 1024, 1 << 20, 4 << 20, 12 << 20)
    assert [one(spark, store.size_bucket(F.lit(n))) for n in sizes] == ["xs", "s", "m", "l", "xl"]


def test_confidence_has_caps_and_a_floor(spark):
    schema = (
        "raw_pct long, score_pct long, blur double, noise double, missing_pct long, n_suspicious long, n_unresolved long, n_items long, n_reported long,"
        " table_found boolean, understood boolean, low_identifier boolean, tokens array<string>"
    )
    base = (95, 0, 300.0, 2.0, 0, 0, 0, 2, 2, False, True, False, [])
    changed = lambda **k: tuple(k.get(f.split()[0], v) for f, v in zip((x.strip() for x in schema.split(",")), base, strict=True))
    cases = [
        (changed(), 95), (changed(blur=20.0), 50), (changed(noise=30.0), 55), (changed(n_reported=3), 50), (changed(low_identifier=True), 70), (changed(n_suspicious=1), 45),
        (changed(n_unresolved=1), 92), (changed(n_items=0, n_reported=0, table_found=True), 32), (changed(raw_pct=10, blur=20.0, noise=30.0), 5), (changed(tokens=["numeric_uncertain:yield"]), 95),
    ]
    got = confidence.document_confidence(spark.createDataFrame([c for c, _ in cases], schema)).collect()
    assert [r.confidence_pct for r in got] == [expected for _, expected in cases] and got[-1].normalization_pct == 90


@pytest.mark.parametrize(
    ("token", "kind"),
    [
        ("Low_Confidence:grade", "confidence_only"), ("document_quality:noisy_scan", "soft"), ("OCR layer corrupted", "soft"), ("missing_critical_field:grade", "blocking"),
        ("row_count_inconsistent", "blocking"), ("numeric_uncertain:yield", None), ("something else", None),
    ],
)
def test_token_kinds(spark, token, kind):
    found = one(spark, confidence.classify_tokens(F.array(F.lit(token))))
    assert {k for k in ("confidence_only", "soft", "blocking") if found[k]} == ({kind} if kind else set())
