"""Queries of the last word on documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certlake.operators import decision, reconcile
from certlake.plans.decision import DECIDED_ITEMS, LOW
from certlake.plans.registry import query
from certlake.plans.views import LINES, pick, view

BLANKS = (None, "", "V1", " V2 ")
ROW_IDS = f"SELECT doc_id, row_index, {pick('p', (None, '', 'H1', ''))} AS heat_number, " + ", ".join(f"{pick(f'{n} + {i}', BLANKS)} AS {f}" for i, (f, n) in enumerate(zip(reconcile.HEAT_SOURCES, ("s", "p", "q", "s + q", "p + s", "l", "p + q"), strict=True))) + f" FROM ({LINES}) AS x"
DOC_HEADS = f"SELECT o_orderkey AS doc_id, {pick('o_custkey', ('', None, 'H9', ''))} AS heat_number, {pick('o_orderkey', ('', 'B7', None))} AS batch_number, {pick('o_custkey', (None, 'C3', ''))} AS cast_number FROM orders"


def _first(fields: tuple[str, ...], what: str) -> str:
    return "CASE " + " ".join(f"WHEN trim(coalesce({f}, '')) <> '' THEN " + (f"'{f}'" if what == "name" else f"trim({f})") for f in fields) + " END"


def _aliased(source: str, fields: tuple[str, ...]) -> str:
    empty = "trim(coalesce(heat_number, '')) = ''"
    return f"SELECT * EXCLUDE (heat_number), CASE WHEN {empty} THEN {_first(fields, 'value')} ELSE heat_number END AS heat_number, CASE WHEN {empty} THEN {_first(fields, 'name')} END AS heat_source FROM ({source})"


ALIASED = f"""i AS ({_aliased(ROW_IDS, reconcile.HEAT_SOURCES)}), d AS ({_aliased(DOC_HEADS, ('batch_number', 'cast_number'))}),
s AS (SELECT doc_id, arg_min(heat_number, row_index) FILTER (WHERE trim(coalesce(heat_number, '')) <> '') AS row_heat, arg_min(heat_source, row_index) FILTER (WHERE heat_source IS NOT NULL) AS row_source FROM i GROUP BY doc_id),
h AS (SELECT d.doc_id, CASE WHEN trim(coalesce(heat_number, '')) = '' THEN row_heat ELSE heat_number END AS heat_number, coalesce(row_source, heat_source) AS heat_source FROM d LEFT JOIN s USING (doc_id))"""


@query(f"WITH {ALIASED} SELECT doc_id, heat_number, heat_source, heat_source IS NOT NULL AS aliased FROM h")
def aliased_heats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's heat, its own or from another identifier or its rows, and where it came from."""
    documents, _ = reconcile.aliased_documents(view(spark, sf_dir, DOC_HEADS), view(spark, sf_dir, ROW_IDS))
    return documents.select("doc_id", "heat_number", "heat_source", "aliased")


HARD_TOKENS = ("", "missing_critical_field:grade", "critical_identifier_unverified:heat", "", "header_row_conflict:grade", "validation_conflict:x", "", "conflicting_labeled_candidates:po", "ambiguous_grade", "low_confidence", "", "no_items_extracted", "")
STATES = f"""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 = 1 END AS compliant, {pick('o_custkey', ('digital_clean', 'scan_clean', 'Severe_Scan', None, 'noisy_scan', 'scan_clean'))} AS quality_class, o_orderkey % 2 = 0 AS traced, o_orderkey % 5 > 0 AS identified,
  o_custkey % 4 > 0 AS needs_review, {pick('o_custkey', ('low_confidence', '', 'low_confidence:grade', '', 'Confidence_Below_Threshold', ''))} AS t1, {pick('o_orderkey + o_custkey', HARD_TOKENS)} AS t2,
  {pick('o_custkey', ('NEEDS_REVIEW', 'COMPLETED', 'FAILED'))} AS status, {pick('o_orderkey', ('COMPLIANT', 'NEEDS_REVIEW', None))} AS outcome, {pick('o_custkey', ('review', 'reject'))} AS decision, o_custkey % 7 = 0 AS aliased FROM orders"""
IS_HARD = f"(trim(x) IN {decision.HARD} OR " + " OR ".join(f"starts_with(trim(x), '{p}')" for p in decision.HARD_PREFIXES) + ")"
DECIDED_SQL = f"""d AS (SELECT *, list_filter([t1, t2], lambda x: x <> '') AS r FROM ({STATES})),
s AS (SELECT doc_id, bool_and(grade <> '' AND weight_or_length IS NOT NULL AND yield_mpa IS NOT NULL AND tensile_mpa IS NOT NULL AND elongation_pct IS NOT NULL) AS w, bool_and(compliant AND NOT needs_review) AS f, bool_or(deviations > 0) AS o, bool_and(traced) AS t, bool_or(identified) AS i FROM ({DECIDED_ITEMS}) GROUP BY doc_id),
j AS (SELECT d.*, coalesce(lower(quality_class) = 'severe_scan', false) OR len(list_filter(r, lambda x: {IS_HARD})) > 0 AS blocked,
  coalesce((coalesce(compliant, false) OR f) AND NOT o AND (traced OR t) AND (identified OR i) AND w, false) AS material, len(list_filter(r, lambda x: NOT {LOW})) = 0 AND (len(r) > 0 OR needs_review) AS mild FROM d LEFT JOIN s USING (doc_id)),
a AS (SELECT *, NOT blocked AND material AND mild AS yes FROM j)"""


@query(f"""WITH {DECIDED_SQL} SELECT doc_id, CASE WHEN yes THEN 'AUTO_ACCEPT' ELSE status END AS status, CASE WHEN yes THEN 'COMPLIANT' ELSE outcome END AS outcome, CASE WHEN yes THEN true ELSE compliant END AS compliant, CASE WHEN yes THEN 'auto_accept' ELSE decision END AS decision,
  array_to_string(CASE WHEN blocked OR yes THEN list_filter(r, lambda x: NOT {LOW}) ELSE r END, '|') AS reasons, needs_review AND NOT yes AS needs_review,
  concat_ws('|', CASE WHEN yes AND len(list_filter(r, lambda x: {LOW})) > 0 THEN '{reconcile.EXEMPT}' END, CASE WHEN yes THEN '{reconcile.CALIBRATED}' END, CASE WHEN aliased THEN '{reconcile.ALIASED}' END, CASE WHEN yes THEN '{reconcile.RECONCILED}' END) AS tokens FROM a""")
def reconciled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's state after the last calibration, with every kind of hard token in its reasons."""
    docs = view(spark, sf_dir, STATES).withColumn("reasons", F.filter(F.array("t1", "t2"), lambda t: t != ""))
    done = reconcile.reconcile(docs, view(spark, sf_dir, DECIDED_ITEMS))
    return done.withColumn("reasons", F.array_join("reasons", "|")).withColumn("tokens", F.array_join("tokens", "|"))
