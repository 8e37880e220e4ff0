"""Queries of the evaluation report over gold and predictions of the shape that ``operators.report`` takes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certlake.operators import report
from certlake.plans.registry import query
from certlake.plans.views import LINES, pick, view

# Orders are documents and lineitem rows their items; predictions differ from gold in some fields.
DOCS = f"""SELECT o_orderkey AS doc_id, {pick('o_orderkey', ('', 'verified', 'candidate', ' Verified ', None, 'verified', 'verified'))} AS status, o_orderkey % 10 = 3 AS prediction_missing FROM orders"""
HEAD = "CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'Supplier ' || cast(o_custkey % 50 AS string) END AS supplier_name"
GOLD = f"""SELECT o_orderkey AS doc_id, {HEAD}, 'Mill Test Certificate' AS document_type, {pick('o_custkey', ('H1|H2', '', 'h7'))} AS heat_numbers, '' AS grade,
  CASE WHEN o_orderkey % 6 = 0 THEN '250|251' ELSE '' END AS yield_strength_mpa, {pick('o_orderkey', ('true', 'no', 'needs_review', '', 'maybe'))} AS review_required, {pick('o_custkey', ('', 'needs_review', ''))} AS processing_decision FROM orders"""
PRED = f"""SELECT o_orderkey AS doc_id, {HEAD.replace('Supplier ', 'SUPPLIER  ')}, {pick('o_custkey', ('mill test  certificate', '', 'Other'))} AS document_type, {pick('o_custkey', ('h2| H1', '', '', 'H7'))} AS heat_numbers, {pick('o_custkey', ('', 'S235JR'))} AS grade,
  CASE WHEN o_orderkey % 6 = 0 THEN '251.5|250' ELSE '' END AS yield_strength_mpa, {pick('o_custkey', ('yes', 'auto_accept', '', '0'))} AS review_required, '' AS processing_decision FROM orders WHERE o_orderkey % 10 <> 3"""
ITEMS = f"""SELECT doc_id, row_index, CASE WHEN l = 6 THEN '' ELSE 'H' || cast(p % 5 AS string) END AS heat_number, {pick('s', ('S235JR', 's235jr', '', 'S355J2'))} AS grade, cast(200 + {{0}} % 7 AS double) AS yield_strength_mpa FROM ({LINES}) AS x"""
GOLD_ITEMS, PRED_ITEMS = ITEMS.format("q"), ITEMS.format("(q + p % 3)")

SPLIT = "CASE WHEN coalesce(trim({0}), '') <> '' THEN list_transform(string_split({0}, '|'), lambda x: trim(x)) END"
WORDS = {c: str(w) for c, w in (("t", report.TRUE_WORDS), ("f", report.FALSE_WORDS))}
PLAIN = "lower(trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g')))"
FLAG = f"CASE WHEN {PLAIN} IN {WORDS['t']} THEN true WHEN {PLAIN} IN {WORDS['f']} THEN false END"


def flat_sql(name: str, docs: str, items: str) -> str:
    """The fields of one side as SQL."""
    one = lambda field, text: f"SELECT doc_id, '{field}' AS field, {SPLIT.format(text)} AS vals FROM {name}_d"
    follows = f"CASE WHEN coalesce(processing_decision, '') <> '' THEN processing_decision WHEN {FLAG.format('review_required')} THEN 'needs_review' WHEN review_required <> '' THEN 'auto_accept' END"
    heads = [one(f, f) for f in ("supplier_name", "document_type", "grade", "yield_strength_mpa", "review_required")] + [one("heat_number", "heat_numbers"), one("processing_decision", follows)]
    cells = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, list(trim(cast({f} AS string)) ORDER BY row_index) AS vals FROM ({items}) WHERE trim(cast({f} AS string)) <> '' GROUP BY doc_id" for f in ("heat_number", "grade", "yield_strength_mpa"))
    return f"""{name}_d AS ({docs}), {name}_h AS (SELECT * FROM ({' UNION ALL '.join(heads)}) WHERE vals IS NOT NULL), {name}_i AS ({cells}),
{name} AS (SELECT doc_id, field, coalesce(h.vals, i.vals) AS vals FROM {name}_h h FULL JOIN {name}_i i USING (doc_id, field))"""


NUMBERS = "list_sort(list_transform({0}, lambda x: try_cast(x AS double)))"
NAMES = f"list_sort(list_transform({{0}}, lambda x: {PLAIN.format('x')}))"
SAME = f"""len(g.vals) = len(p.vals) AND CASE WHEN len(list_filter(list_concat({NUMBERS.format('g.vals')}, {NUMBERS.format('p.vals')}), lambda x: x IS NULL)) = 0
  THEN list_max(list_transform(list_zip({NUMBERS.format('g.vals')}, {NUMBERS.format('p.vals')}), lambda z: abs(z[1] - z[2]))) <= 1.0 ELSE {NAMES.format('g.vals')} = {NAMES.format('p.vals')} END"""
COMPARED = f"""{flat_sql('gold', GOLD, GOLD_ITEMS)}, {flat_sql('pred', PRED, f'SELECT * FROM ({PRED_ITEMS}) AS z WHERE doc_id % 10 <> 3')},
docs AS (SELECT doc_id, coalesce(nullif({PLAIN.format('status')}, ''), 'verified') = 'verified' AS verified, prediction_missing FROM ({DOCS})),
j AS (SELECT doc_id, field, g.vals AS gold, p.vals AS pred, verified AND g.vals IS NOT NULL AS has_gold, prediction_missing, prediction_missing OR p.vals IS NULL AS pred_missing, coalesce({SAME}, false) AS same
  FROM gold g FULL JOIN pred p USING (doc_id, field) JOIN docs USING (doc_id)),
c AS (SELECT *, CASE WHEN has_gold THEN NOT pred_missing AND same END AS correct, CASE WHEN field = 'review_required' THEN {FLAG.format('gold[1]')} END AS gr, CASE WHEN field = 'review_required' THEN {FLAG.format('pred[1]')} END AS pr FROM j),
r AS (SELECT *, CASE WHEN NOT has_gold OR correct THEN NULL WHEN NOT gr AND pr THEN 'fail_closed_review' WHEN prediction_missing THEN 'missing_prediction_file' WHEN pred_missing THEN 'missing_field' ELSE 'mismatch' END AS reason FROM c)"""


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = view(spark, sf_dir, DOCS)
    docs = docs.select("doc_id", report.verified(F.col("status")).alias("verified_gold"), "prediction_missing")
    gold = report.flatten_fields(view(spark, sf_dir, GOLD), view(spark, sf_dir, GOLD_ITEMS))
    pred = report.flatten_fields(view(spark, sf_dir, PRED), view(spark, sf_dir, PRED_ITEMS).where("doc_id % 10 <> 3"))
    return report.compare(docs, gold, pred)


@query(f"WITH {COMPARED} SELECT doc_id, field, array_to_string(gold, '|') AS gold, array_to_string(pred, '|') AS pred, has_gold, correct, pred_missing, reason FROM r")
def evaluated_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of every document, gold against prediction."""
    rows = compared(spark, sf_dir)
    return rows.select("doc_id", "field", *(F.array_join(c, "|").alias(c) for c in ("gold", "pred")), "has_gold", "correct", "pred_missing", "reason")


def _totals(name: str, fields: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{f}'" for f in fields)
    return f"count(*) FILTER (WHERE has_gold AND correct AND field IN ({listed})) AS {name}_hits, count(*) FILTER (WHERE has_gold AND field IN ({listed})) AS {name}_total"


@query(f"""WITH {COMPARED}, t AS (SELECT doc_id, {_totals('field', report.TARGETS)}, {_totals('critical', report.CRITICAL)}, {_totals('tracing', report.TRACING)}, {_totals('type', ('document_type',))}, {_totals('decision', ('processing_decision',))},
  count(*) FILTER (WHERE has_gold AND NOT correct AND field IN {report.TARGETS} AND field NOT IN {report.DECISIONS}) AS extraction_misses, count(*) FILTER (WHERE has_gold AND pred_missing AND field IN {report.CRITICAL}) AS missing_required,
  bool_or(gr) FILTER (WHERE has_gold) AS gold_review, bool_or(pr) AS review FROM r GROUP BY doc_id)
SELECT *, cast(coalesce(gold_review AND NOT review, false) AS bigint) AS unsafe, cast(coalesce(NOT gold_review AND review, false) AS bigint) AS fail_closed FROM t""")
def evaluated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits and totals of every document."""
    return report.document_counts(compared(spark, sf_dir))


@query(f"WITH {COMPARED} SELECT field, count(*) AS samples, count(*) FILTER (WHERE correct) AS correct, round(count(*) FILTER (WHERE correct) / count(*), 4) AS accuracy, count(*) FILTER (WHERE pred_missing) AS missing_predictions FROM r WHERE has_gold AND field IN {report.TARGETS} GROUP BY field")
def metrics_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.field_metrics(compared(spark, sf_dir))


@query(f"WITH {COMPARED}, n AS (SELECT reason, row_number() OVER (PARTITION BY reason ORDER BY doc_id, field) AS place, doc_id, field FROM r WHERE reason IS NOT NULL) SELECT reason, cast(place AS int) AS place, doc_id, field FROM n WHERE place <= 5")
def failure_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five failures of each kind: the report shows no more."""
    return report.failure_examples(compared(spark, sf_dir))


RUNS = """SELECT lang AS run, cast(n_chars % 9 AS bigint) AS field_hits, cast(8 AS bigint) AS field_total, cast(n_chars % 3 AS bigint) AS critical_hits, cast(CASE WHEN lang = 'es' THEN 0 ELSE 4 END AS bigint) AS critical_total,
  CASE WHEN n_chars % 5 > 0 THEN n_chars % 5 = 1 END AS compliance_correct, CASE WHEN n_chars % 7 > 0 THEN n_chars % 3 = 1 END AS review, CASE WHEN n_chars % 4 > 0 THEN cast(n_chars % 900 AS double) END AS latency_ms, cast(n_chars % 5 AS double) / 4 AS completeness FROM documents"""
RATE = "coalesce(count(*) FILTER (WHERE {0}) / nullif(count({0}), 0), 0)"


@query(f"""SELECT run, count(*) AS n, round(sum(field_hits) / greatest(sum(field_total), 1), 4) AS field_accuracy, round(sum(critical_hits) / greatest(sum(critical_total), 1), 4) AS critical_accuracy, round({RATE.format('compliance_correct')}, 4) AS compliance_accuracy,
  round({RATE.format('review')}, 4) AS review_rate, round(1 - {RATE.format('review')}, 4) AS straight_through_rate, round(coalesce(avg(latency_ms), 0), 1) AS mean_latency_ms, round(coalesce(avg(completeness), 0), 4) AS completeness FROM ({RUNS}) GROUP BY run""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.run_metrics(view(spark, sf_dir, RUNS), ["run"])
