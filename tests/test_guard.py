"""Identifier guard and supplier likeness against all pairs."""

import itertools
import random

from pyspark.sql import functions as F

from certlake.operators import guard, suppliers
from certlake.registries import IDENTIFIER_LOOKALIKES
from tests.conftest import TINY


def one_apart(a, b):
    places = [i for i, (x, y) in enumerate(zip(a, b)) if x != y]
    if len(a) != len(b) or len(places) != 1:
        return False
    i = places[0]
    between = 0 < i < len(a) - 1 and a[i - 1].isdigit() and a[i + 1].isdigit()
    alike = any(a[i] in g and b[i] in g and (between or "G" not in g) for g in IDENTIFIER_LOOKALIKES)
    return alike or (a[i].isdigit() and b[i].isdigit())


def test_conflicts_are_those_of_all_pairs(spark):
    draw = random.Random(6)
    groups = {}
    for g in range(120):
        base = "".join(draw.choice("0OI1LSB8G6Z2AX") for _ in range(draw.randint(1, 5)))
        groups[g] = [base] + ["".join(draw.choice("0OI16G") if draw.random() < 0.2 else c for c in base) for _ in range(draw.randint(0, 3))]
    rows = [(g, v) for g, values in groups.items() for v in values] + [(500, None), (500, ""), (501, "-- "), (501, "..")]
    got = {r.g for r in guard.conflicts(spark.createDataFrame(rows, "g int, value string"), ["g"]).collect()}
    assert got == {g for g, values in groups.items() if any(one_apart(a, b) for a, b in itertools.combinations(sorted(set(values)), 2))}
    assert 10 < len(got) < 110


def test_many_candidates_conflict_like_few(spark):
    draw = random.Random(7)
    groups = {g: ["".join(draw.choice(signs) for _ in range(draw.randint(0, 6))) for _ in range(draw.randint(1, 500))] for g, signs in enumerate(["ACDEFHJK", "0OQD", "6GX", "B8", "KMN0", "TUVWXYZ1", "AEJ4"] * 4)}
    codes = {g: sorted({*values} - {""}) for g, values in groups.items()}
    rows = spark.createDataFrame([(g, v) for g, v in codes.items() if v], "g int, codes array<string>")
    want = {g: any(one_apart(a, b) for a, b in itertools.combinations(v, 2)) for g, v in codes.items() if v}
    assert {r.g: r.c for r in rows.select("g", guard.any_conflict(F.col("codes")).alias("c")).collect()} == want
    few = guard.FEW
    try:
        guard.FEW = 1
        assert {r.g: r.c for r in rows.select("g", guard.any_conflict(F.col("codes")).alias("c")).collect()} == want
    finally:
        guard.FEW = few
    assert {True, False} == {w for g, w in want.items() if len(codes[g]) > few}


def test_rows_with_their_candidates_are_judged_without_a_shuffle(spark):
    from certlake.plans.verify import identifier_assessment

    plan = identifier_assessment(spark, TINY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Scan parquet") == 1, plan
    fields = [(1, 0, "heat_number", ["A1", " B2 ", None], [(2, "C3", "z"), (1, " C3", "y"), (0, "A1", "x"), (3, " ", "w"), (1, "9O1", "v"), (0, "901", "u")]), (2, None, "heat_number", ["901"], [(0, "9O1", "x")]), (3, 0, "heat_number", [" "], [(0, "901", "x"), (1, "9O1", "x")])]
    rows = spark.createDataFrame(fields, "doc_id int, row_index int, field string, accepted array<string>, candidates array<struct<ordinal:int,value:string,source:string>>")
    got = {(r.doc_id, r.value): (r.conflict, [(c.value, c.source) for c in r.candidates]) for r in guard.assess_gathered(rows).collect()}
    others = [("901", "u"), ("A1", "x"), ("9O1", "v"), ("C3", "y")]
    assert got == {(1, "A1"): (True, others), (1, "B2"): (True, others), (2, "901"): (False, [])}
    again = [(i, d, n, f, v) for d, n, f, values, _ in fields for i, v in enumerate(values)]
    own = spark.createDataFrame(again, "i int, doc_id int, row_index int, field string, value string").drop("i")
    read = spark.createDataFrame([(d, n, f, *c) for d, n, f, _, cs in fields for c in cs], "doc_id int, row_index int, field string, ordinal int, value string, source string")
    assert {(r.doc_id, r.value): (r.conflict, [(c.value, c.source) for c in r.candidates]) for r in guard.assess(own, read).collect()} == got


def test_assessment_lists_other_candidates_once(spark):
    accepted = spark.createDataFrame([(1, 0, "heat_number", "812003694"), (1, 1, "heat_number", " AB-12 "), (1, -1, "lot_number", "8120O3694"), (2, 0, "item_id", "8120O3694"), (2, 1, "heat_number", "")], "doc_id int, row_index int, field string, value string")
    others = spark.createDataFrame(
        [(1, 0, "heat_number", 0, "812003684", "a"), (1, 0, "heat_number", 1, "812003684", "b"), (1, 0, "heat_number", 2, "812003694", "c"), (1, 1, "heat_number", 0, "AB13", "a"), (1, 1, "heat_number", 1, None, "b"), (9, 0, "heat_number", 0, "X", "a")],
        "doc_id int, row_index int, field string, ordinal int, value string, source string",
    )
    done = guard.assess(accepted, others)
    got = {(r.doc_id, r.row_index): r for r in done.collect()}
    assert set(got) == {(1, 0), (1, 1), (1, -1)}
    assert got[1, 0].conflict and not got[1, 0].ocr_uncertain and [tuple(c) for c in got[1, 0].candidates] == [("812003684", "a", guard.CONFLICT)]
    assert got[1, 1].conflict and got[1, -1].ocr_uncertain and got[1, -1].candidates == []
    docs = spark.createDataFrame([(1, False, ["x"], "Seen."), (2, None, None, None)], "doc_id int, needs_review boolean, reasons array<string>, remarks string")
    out = {r.doc_id: r for r in guard.guarded_documents(docs, done).collect()}
    assert out[1].reasons == ["x", guard.UNCERTAIN, guard.CONFLICT] and out[1].needs_review and out[1].remarks == "Seen. " + guard.MESSAGE
    assert out[1].flagged == ["heat_number:row0", "heat_number:row1", "lot_number"]
    assert (out[2].needs_review, out[2].reasons, out[2].remarks, out[2].flagged) == (False, [], None, [])


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row, above = [0], row
        for j, y in enumerate(b):
            row.append(max(row[-1], above[j + 1], above[j] + (x == y)))
    return row[-1]


def plain_ratio(a, b):
    return 100.0 if a == b else 200.0 * lcs(a, b) / (len(a) + len(b))


def test_matches_are_those_of_all_pairs(spark):
    draw = random.Random(8)
    words = ["stahl", "werke", "acciai", "steel", "nord", "tubi", "wire", "rod", "co", "x", "mills", "gruppo"]
    master = sorted({" ".join(draw.choice(words) for _ in range(draw.randint(1, 4))) for _ in range(60)} | {"a", "ab", "zz z"})
    names = [draw.choice(master) for _ in range(80)]
    names = ["".join(c for c in n if draw.random() > 0.04) + draw.choice(["", "", "e", " S.p.A."]) for n in names] + ["", None, "a", "AB", "z zz", "nothing like it"]
    prepared = spark.createDataFrame([(n,) for n in {*names, *master}], "raw string").select("raw", suppliers.sorted_words(F.col("raw")).alias("name"))
    name_of = {r.raw: r.name for r in prepared.collect()}
    got = suppliers.best_matches(spark.createDataFrame([(n,) for n in names], "raw string"), spark.createDataFrame([(m,) for m in master], "raw string")).collect()
    assert sorted({n or "" for n in names}) == sorted(r.raw or "" for r in got if r.raw is not None or "" not in names) or len(got) == len(set(names))
    found = 0
    for r in got:
        scored = [(-plain_ratio(name_of[r.raw], name_of[m]), m) for m in master if name_of[r.raw] and name_of[m]]
        best = min(scored, default=(0.0, None))
        if -best[0] < suppliers.REVIEW:
            assert (r.match, r.score, r.band) == (None, None, "reject"), r
        else:
            found += 1
            assert r.match == best[1] and abs(r.score + best[0]) < 1e-9 and r.band == ("accept" if r.score >= 95 else "review"), (r, best)
    assert found > 40


def test_numbered_names_match_like_all_pairs(spark):
    draw = random.Random(9)
    frames = ["gmbh supplier", "tubi nord", "x", "", "mill of the far north", "ab cd"]
    numbered = lambda: " ".join(sorted(f"{draw.choice(frames)} {draw.choice(['', str(draw.randint(0, 99)), f'{draw.randint(0, 400):09d}', str(draw.randint(10**11, 10**12))])}".split()))
    master = sorted({numbered() for _ in range(120)} - {""})
    names = sorted({"".join(draw.choice("0123456789x") if draw.random() < 0.06 else c for c in draw.choice(master)) for _ in range(150)} | {numbered() for _ in range(60)})
    name_of = {r.raw: r.name for r in spark.createDataFrame([(n,) for n in {*names, *master}], "raw string").select("raw", suppliers.sorted_words(F.col("raw")).alias("name")).collect()}
    got = suppliers.best_matches(spark.createDataFrame([(n,) for n in names], "raw string"), spark.createDataFrame([(m,) for m in master], "raw string")).collect()
    assert sorted(r.raw for r in got) == names
    kinds = set()
    for r in got:
        best = min((-plain_ratio(name_of[r.raw], name_of[m]), m) for m in master) if name_of[r.raw] else (0.0, None)
        want = (best[1], -best[0]) if -best[0] >= suppliers.REVIEW else (None, None)
        assert r.match == want[0] and (r.score is None if want[1] is None else abs(r.score - want[1]) < 1e-9), (r, best)
        kinds.add((r.band, any(c.isalpha() for c in r.raw), r.raw == r.match))
    assert len(kinds) >= 7, kinds


def test_names_that_differ_in_numbers_meet_no_master_of_other_letters(spark):
    names = spark.createDataFrame([(f"{i:09d} {form} supplier",) for i in range(300) for form in ("spa", "steelworks")] + [("000000007 gmbh suplier",)], "raw string")
    master = spark.createDataFrame([(f"{i:09d} gmbh supplier",) for i in range(300)], "raw string")
    sought, known = (df.withColumnRenamed("raw", "name") for df in (names, master))
    met = suppliers._met(sought, known, suppliers.REVIEW)
    # All pairs are 180,300; only the name with like letters meets any.
    assert {r.a for r in met.collect()} == {"000000007 gmbh suplier"}
    got = {r.raw: r for r in suppliers.best_matches(names, master).collect()}
    assert len(got) == 601 and [r.raw for r in got.values() if r.match] == ["000000007 gmbh suplier"]
    assert got["000000007 gmbh suplier"].match == "000000007 gmbh supplier"


def test_pairs_fall_into_bands(spark):
    pairs = [("ACME SPA", "acme spa", "accept"), ("NORD STEEL WORKS", "Works Nord Steel", "accept"), ("NORD STEEL WORKS", "NORD STEL WORK", "review"), ("NORD STEEL", "SUD TUBI", "reject"), (None, "", "accept"), ("a", None, "reject")]
    got = suppliers.judged(spark.createDataFrame(pairs, "g string, p string, want string").withColumnsRenamed({"g": "gold", "p": "pred"}), "gold", "pred").collect()
    assert len(got) == len(pairs) and all(r.band == r.want for r in got), got
