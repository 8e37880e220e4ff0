from pyspark.sql import functions as F

from certlake.operators import evaluate, resolve, select, shape, store, validate


def grade(spark, raw):
    return resolve.resolve_grades(spark.createDataFrame([(raw,)], "grade string")).first()


def test_grades(spark):
    expected = {
        "  s355 j2  ": ("resolved", "S355J2"), "API5LX65": ("resolved", "API 5L X65"), "ASTM A312 TP317L": ("resolved", "TP317L"), "NOVOFIL SG2/NOVOBRONZE SG2": ("resolved", "SG2"),
        "304/304L": ("resolved_dual", "304"), "S355": ("ambiguous", None), "": ("empty", None), None: ("empty", None), "Q9": ("unknown", None), "S355J2+N / S355JR": ("resolved_dual", "S355J2+N"),
        "MAT TP304L X": ("ambiguous", None), "S275JR+AR": ("resolved", "S275JR"), "304/X65": ("ambiguous", None),
    }
    df = spark.createDataFrame([(k,) for k in expected], "grade string")
    got = {r.grade: (r.status, r.canonical) for r in resolve.resolve_grades(df).collect()}
    assert got == expected


def rows(spark, *cells):
    return spark.createDataFrame([(1, g, True, c, y, t, e) for g, c, y, t, e in cells], "doc_id long, grade string, explicit_grade boolean, category string, yield_mpa double, tensile_mpa double, elongation_pct double")


def test_row_ladder(spark):
    df = rows(
        spark, ("S195", "PIPE", 264.0, 418.0, 34.0), ("S195", "PIPE", 100.0, 418.0, 34.0), ("S195", "PIPE", None, 418.0, 34.0), ("Q9", "PIPE", 1.0, 1.0, 1.0), ("", "PIPE", 1.0, 1.0, 1.0),
        ("TP304", "PIPE", 1.0, 1.0, 1.0), ("S355", "PIPE", 1.0, 1.0, 1.0), ("S195", "WIRE_ROPE", None, 100.0, None), ("S195", "PIPE", None, None, None), ("SRCDRW02", "PIPE", 600.0, 500.0, None),
    )
    got = [(r.outcome, r.is_compliant, round(r.confidence * 100)) for r in validate.validate_rows(df).orderBy(F.monotonically_increasing_id()).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [
        ("COMPLIANT", True, 100), ("NON_COMPLIANT", False, 100), ("COMPLIANT", True, 96), ("EXPLICIT_UNMAPPED_GRADE", None, 90), ("MISSING_CRITICAL_FIELD_GRADE", None, 80),
        ("UNSUPPORTED_SPEC_FAMILY", None, 90), ("NEEDS_REVIEW", None, 85), ("COMPLIANT", True, 82), ("NOT_VALIDATED", None, 100), ("NON_COMPLIANT", False, 96 + 4),
    ]))


def test_document_roll_up(spark):
    df = spark.createDataFrame([(1, "COMPLIANT"), (1, "NOT_VALIDATED"), (2, "NEEDS_REVIEW"), (2, "NON_COMPLIANT"), (3, "NOT_VALIDATED"), (4, "COMPLIANT"), (4, "UNRESOLVED_SPEC")], "doc_id long, outcome string")
    assert {r.doc_id: r.doc_outcome for r in validate.document_outcomes(df).collect()} == {1: "COMPLIANT", 2: "NON_COMPLIANT", 3: "NOT_VALIDATED", 4: "NEEDS_REVIEW"}


def test_first_complete_group_wins(spark):
    long = [(1, 0, "a", "yield_mpa", 470.0), (1, 1, "a", "tensile_mpa", 560.0), (1, 2, "b", "yield_mpa", 1.0), (1, 3, "a", "elongation_pct", 26.0), (1, 4, "b", "tensile_mpa", 2.0), (1, 5, "b", "elongation_pct", 3.0), (2, 0, "a", "yield_mpa", 5.0)]
    got = shape.collapse_vertical(spark.createDataFrame(long, "doc_id long, row_index long, grp string, property string, value double")).collect()
    assert [(r.doc_id, r.grp, r.yield_mpa, r.tensile_mpa, r.elongation_pct) for r in got] == [(1, "a", 470.0, 560.0, 26.0)]


def test_pinned_pages_and_greedy_packing(spark):
    pages = spark.createDataFrame([(1, p, s) for p, s in enumerate((1, 9, 5, 7))], "doc_id long, page long, score long")
    assert {r.page for r in select.pages_top_k(pages, 2).collect()} == {0, 1}
    blocks = spark.createDataFrame([(1, 0, 50), (1, 1, 70), (1, 2, 40), (2, 0, 300), (2, 1, 200)], "doc_id long, page long, size long")
    got = {(r.doc_id, r.page) for r in select.pack_greedy(blocks, "doc_id", ["page"], "size", 100, []).collect()}
    assert got == {(1, 0), (1, 2), (2, 1)}


def test_islands_and_budget(spark):
    df = spark.createDataFrame([(1, p) for p in (1, 5, 9, 30, 36, 60)], "k long, pos long")
    assert [(r.centre, r["size"]) for r in select.islands(df, ["k"], "pos", 8).orderBy("island").collect()] == [(5, 3), (33, 2), (60, 1)]
    spend = spark.createDataFrame([(1, i, 10) for i in range(5)], "k long, i long, cost long")
    assert [r.live for r in select.budget_cutoff(spend, ["k"], [F.col("i")], "cost", 20).orderBy("i").collect()] == [True, True, False, False, False]


def test_nearest_rank_takes_an_element(spark):
    df = spark.createDataFrame([(1, v) for v in (12, 11, 20, 15, 5, 18)], "k long, v long")
    assert store.nearest_rank(df, ["k"], "v", 0.95).first().value == 20 and store.nearest_rank(df, ["k"], "v", 0.5).first().value == 12


def test_candidates_and_promotion(spark):
    rows = spark.createDataFrame([(1, "heat", 1, 0, "A"), (1, "heat", 0, 1, "b"), (1, "heat", 0, 2, "B"), (1, "grade", 2, 0, "x"), (1, "grade", 2, 1, "y")], "doc_id long, field string, rank long, ordinal long, value string")
    assert {r.field: (r.value, r.conflict) for r in shape.choose_ranked(rows).collect()} == {"heat": ("b", False), "grade": (None, True)}
