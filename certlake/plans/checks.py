"""Queries of whole-document checks, of confidences of rows and of the identifier gate, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certlake.functions import text
from certlake.operators import gate, validate
from certlake.plans.catalogue import REVIEWS, SAME, VALIDATED
from certlake.plans.registry import query
from certlake.plans.views import CERTS, HEATS, LINES, pick, view

SURE = "CASE WHEN NOT explicit_grade THEN tensile_mpa % 7 * 0.25 END"


@query(VALIDATED + f""", s AS (SELECT outcome, penalty, {SURE} AS c FROM val)
SELECT outcome, cast(round(greatest(0.05, coalesce(least(nullif(c, 0), 1), 1) - penalty / 100) * 100) AS bigint) AS confidence_pct, count(*) AS n FROM s GROUP BY ALL""")
def row_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by outcome and confidence, from what the extraction gave each row."""
    rows = validate.validate_rows(view(spark, sf_dir, CERTS).withColumn("row_confidence", F.expr(SURE).cast("double")))
    return rows.groupBy("outcome", F.round(F.col("confidence") * 100).cast("long").alias("confidence_pct")).agg(F.count("*").alias("n"))


CHECKED_ROWS = f"""SELECT doc_id, row_index, heat AS heat_number, row_index % 4 = 3 AS needs_review,
  CASE WHEN row_index % 3 = 1 THEN {pick('doc_id', ('COMPLIANT', 'NEEDS_REVIEW', 'COMPLIANT', 'NON_COMPLIANT', 'NOT_VALIDATED'))} ELSE {pick('doc_id', ('COMPLIANT', 'COMPLIANT', 'NOT_VALIDATED'))} END AS outcome
  FROM ({HEATS}) AS h WHERE doc_id % 9 > 0 OR row_index % 2 = 0"""
CHECKED_DOCS = f"""SELECT o_orderkey AS doc_id, cast(2 + o_custkey % 4 AS bigint) AS n_reported, {pick('o_orderkey', ('clean', 'Heat column is BLURRED', None, '', 'fine', 'fine', 'fine'))} AS remarks,
  {pick('o_custkey', (None, 'row 2: cannot read', 'ok', '', 'ok', 'a best Guess'))} AS audit, o_custkey % 7 = 0 AS needs_review, {pick('o_custkey', ('zz', '', 'row_count_inconsistent', ''))} AS t1 FROM orders"""
CHECKED_SQL = f"""r AS ({CHECKED_ROWS}), d AS ({CHECKED_DOCS}),
h AS (SELECT DISTINCT doc_id, regexp_replace(upper(heat_number), '[^A-Z0-9]', '', 'g') AS c FROM r WHERE heat_number <> ''),
p AS (SELECT x.doc_id, x.c AS a, y.c AS b FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.c < y.c AND length(x.c) = length(y.c)),
x AS (SELECT DISTINCT doc_id FROM p WHERE len(list_filter(range(1, length(a) + 1), lambda i: NOT (a[i] = b[i] OR {SAME}))) = 0),
s AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE heat_number <> '') AS nh, CASE WHEN bool_or(outcome = 'NON_COMPLIANT') THEN 'NON_COMPLIANT' WHEN bool_or(outcome IN ({REVIEWS})) THEN 'NEEDS_REVIEW'
    WHEN bool_or(outcome = 'COMPLIANT') THEN 'COMPLIANT' ELSE 'NOT_VALIDATED' END AS outcome FROM r GROUP BY doc_id),
j AS (
  SELECT d.*, coalesce(n, 0) AS n_items, coalesce(outcome, 'NOT_VALIDATED') AS outcome, x.doc_id IS NOT NULL AS confusable,
    coalesce(nh, 0) > 0 AND regexp_matches(lower(coalesce(remarks, '') || ' ' || coalesce(audit, '')), '{'|'.join(w.replace("'", "''") for w in validate.GUESSED)}') AS contradicted
  FROM d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN x ON d.doc_id = x.doc_id)"""


def _checked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = view(spark, sf_dir, CHECKED_DOCS).withColumn("reasons", F.filter(F.array("t1"), lambda t: t != ""))
    return validate.document_checks(docs, view(spark, sf_dir, CHECKED_ROWS))


@query(f"""WITH {CHECKED_SQL} SELECT doc_id, n_items, outcome, CASE outcome WHEN 'COMPLIANT' THEN true WHEN 'NON_COMPLIANT' THEN false END AS is_compliant, needs_review OR n_reported <> n_items OR confusable OR contradicted AS needs_review,
  array_to_string(list_sort(list_distinct(list_filter([t1, CASE WHEN n_reported <> n_items THEN '{validate.MISCOUNTED}' END, CASE WHEN confusable THEN '{validate.CONFUSABLE}' END,
    CASE WHEN contradicted THEN '{validate.CONTRADICTED}' END], lambda t: t <> ''))), '|') AS reasons FROM j""")
def checked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's outcome and tokens after the checks of whole documents."""
    docs, _ = _checked(spark, sf_dir)
    return docs.select("doc_id", F.col("n_items").cast("long").alias("n_items"), "outcome", "is_compliant", "needs_review", F.array_join("reasons", "|").alias("reasons"))


@query(f"""WITH {CHECKED_SQL} SELECT r.doc_id, row_index, CASE WHEN coalesce(contradicted, false) AND heat_number <> '' THEN NULL ELSE heat_number END AS heat_number,
  r.needs_review OR heat_number <> '' AND coalesce(confusable OR contradicted, false) AS needs_review FROM r LEFT JOIN j ON r.doc_id = j.doc_id""")
def checked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's heat and need of review after the checks of whole documents."""
    _, rows = _checked(spark, sf_dir)
    return rows.select("doc_id", "row_index", "heat_number", "needs_review")


CANDIDATES = f"""SELECT doc_id, row_index, l % 3 > 0 AS has_heat, {pick('p', ('H1', ' ', None, 'H2'))} AS heat, {pick('s', ('h9', '', 'h8'))} AS heat_no, {pick('q', ('B1', None, 'B2'))} AS batch, {pick('p + q', ('7', '', '8', '9'))} AS item,
  {pick('s + q', (None, None, '95', '79', '140'))} AS c_heat, {pick('p + l', (None, '80', None, '10'))} AS c_batch, {pick('s', (None, '85', None, '30', None))} AS c_row,
  {pick('p * 3 + s', ('', '', '', 'Heat_Number_Uncertain', '', 'low_identifier_confidence', '', 'weak_batch_number_evidence', 'item_id looks low', '', 'ambiguous pipe_id', 'low light', ''))} AS reason,
  (p + s) % 19 = 0 AS visual, {pick('q', ('', '', 'batch_number', '', 'item_id', ''))} AS unclear, {pick('p', ('digital_clean', 'noisy_scan', None, 'severe_scan', 'scan_clean'))} AS quality_class, {pick('q + l', ('', '', 'low_identifier_legibility', ''))} AS why FROM ({LINES}) AS x"""
GATED_FIELDS = ("heat_number", "batch_number", "item_id", "pipe_id")
GATED_KEYS = {"heat_number": "CASE WHEN has_heat THEN heat ELSE heat_no END", "batch_number": "batch", "item_id": "item", "pipe_id": "item"}
OWN = {"heat_number": "c_heat", "batch_number": "c_batch", "item_id": "NULL", "pipe_id": "NULL"}


def _verdict_sql(field: str) -> str:
    sure, r = f"coalesce({OWN[field]}, c_row)", "lower(reason)"
    about = lambda words: f"(contains({r}, '{field}') AND regexp_matches({r}, '{words}'))"
    return f"""CASE WHEN trim(coalesce({GATED_KEYS[field]}, '')) = '' THEN 'none' WHEN visual OR unclear = '{field}' OR {r} IN ('visual_ambiguity', 'ambiguous_identifier', '{field}_uncertain') OR {about('uncertain|ambiguous')} THEN '{gate.AMBIGUOUS}'
  WHEN {r} IN ('low_identifier_confidence', 'weak_{field}_evidence') OR {about('weak|low')} OR coalesce(cast({sure} AS double) < 80, false) THEN '{gate.LOW}'
  WHEN {sure} IS NULL AND (coalesce(quality_class IN ('noisy_scan', 'degraded_scan', 'severe_scan'), false) OR why = 'low_identifier_legibility') THEN '{gate.MISSING}' ELSE 'kept' END AS v_{field}"""


def _event_sql(field: str) -> str:
    own = "field_confidence" if field == "heat_number" else f"{field}_confidence"
    source = f"CASE WHEN {OWN[field]} IS NOT NULL THEN '{own}' WHEN c_row IS NOT NULL THEN 'row_confidence' ELSE '-' END"
    return f"CASE WHEN v_{field} NOT IN ('none', 'kept') THEN '{field}=' || ({GATED_KEYS[field]}) || ':' || v_{field} || ':' || {source} END"


@query(f"""WITH v AS (SELECT *, {', '.join(map(_verdict_sql, GATED_FIELDS))} FROM ({CANDIDATES}))
SELECT doc_id, row_index, CASE v_heat_number WHEN 'kept' THEN {GATED_KEYS['heat_number']} WHEN 'none' THEN CASE WHEN has_heat THEN heat END END AS heat_number, CASE WHEN v_heat_number IN ('none', 'kept') THEN heat_no END AS heat_no,
  CASE WHEN v_batch_number = 'kept' THEN batch END AS batch_number, CASE WHEN v_batch_number IN ('none', 'kept') THEN batch END AS batch,
  CASE WHEN v_item_id IN ('none', 'kept') AND v_pipe_id IN ('none', 'kept') THEN item END AS item_id, CASE WHEN v_pipe_id = 'kept' THEN item END AS pipe_id, concat_ws('|', {', '.join(map(_event_sql, GATED_FIELDS))}) AS events FROM v""")
def gated_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's identifiers after the gate, under all their spellings, and the events of those withheld."""
    col, rows = F.col, view(spark, sf_dir, CANDIDATES)
    share = lambda c: col(c).cast("double") / 100
    spelled = F.create_map(F.lit("heat_number"), col("heat"), F.lit("heat_no"), col("heat_no"), F.lit("batch"), col("batch"), F.lit("item_id"), col("item"))
    rows = rows.select(
        "doc_id", "row_index", F.map_filter(spelled, lambda k, _: (k != "heat_number") | col("has_heat")).alias("payload"), F.create_map(F.lit("heat_number"), share("c_heat")).alias("field_confidence"),
        F.create_map(F.lit("batch_number"), share("c_batch")).alias("direct_confidence"), share("c_row").alias("row_confidence"), F.array("reason").alias("review_reasons"), col("visual").alias("visual_ambiguity"),
        F.array("unclear").alias("ambiguous_fields"), "quality_class", F.array("why").alias("quality_reasons"),
    )
    done = gate.gate(rows, GATED_FIELDS)
    shown = F.transform("events", lambda e: F.concat(e["field"], F.lit("="), e["raw_candidate"], F.lit(":"), e["reason"], F.lit(":"), F.coalesce(e["confidence_source"], F.lit("-"))))
    return done.select("doc_id", "row_index", *(F.element_at("payload", F.lit(k)).alias(k) for k in ("heat_number", "heat_no", "batch_number", "batch", "item_id", "pipe_id")), F.array_join(shown, "|").alias("events"))


SIZES = f"SELECT DISTINCT {pick('l_partkey', ('12 mm', ' ', None, ' Ø 5 '))} AS a, {pick('l_suppkey', ('', '3 x 4 mm', None))} AS b FROM lineitem"


@query(f"SELECT a, b, nullif(array_to_string(list_filter([trim(a), trim(b)], lambda v: v <> ''), '; '), '') AS dimensions FROM ({SIZES})")
def dimension_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of dimensions as one text."""
    return view(spark, sf_dir, SIZES).withColumn("dimensions", text.dimension_text(F.array("a", "b")))
