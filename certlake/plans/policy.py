"""Queries of the review policy, the evaluation report, extra row checks and identifier risks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certlake.functions import text
from certlake.operators import policy, validate
from certlake.plans.catalogue import BLOCKS, ONLY, SOFTS
from certlake.plans.registry import counted, query
from certlake.plans.views import HEATS, LINES, pick, view

POLICY = f"""SELECT doc_id, cast(doc_id % 4 AS bigint) AS n_items, cast(CASE WHEN doc_id % 13 = 0 THEN 9 ELSE doc_id % 4 END AS bigint) AS n_reported,
  CASE WHEN doc_id % 17 = 0 THEN cast(doc_id % 4 AS bigint) ELSE 0 END AS missing_grade, CASE WHEN doc_id % 19 = 0 THEN cast(doc_id % 4 AS bigint) ELSE 0 END AS missing_yield_mpa,
  cast(0 AS bigint) AS missing_tensile_mpa, CASE WHEN doc_id % 5 = 0 THEN cast(doc_id % 4 AS bigint) ELSE 0 END AS missing_elongation_pct, doc_id % 23 <> 0 AS has_identifier,
  doc_id % 29 <> 0 AS supported, {pick('n_chars', ('digital_clean', 'noisy_scan', 'scan_clean', 'severe_scan', 'scan_clean'))} AS quality_class, CASE WHEN doc_id % 31 = 0 THEN 1 ELSE 0 END AS n_non_compliant,
  CASE WHEN doc_id % 31 = 0 THEN 0 ELSE cast(doc_id % 4 AS bigint) END AS n_compliant, n_chars % 2 = 0 AS table_found, cast(60 + n_chars % 41 AS bigint) AS confidence_pct, CASE WHEN doc_id % 37 = 0 THEN 1 ELSE 0 END AS n_row_reviews,
  {pick('n_chars', ('', 'blurry/noisy document', 'document_quality:low', 'numeric_uncertain:yield', '', 'unresolved_spec:x', 'critical_identifier_unverified', 'other', 'ocr corrupted', 'confidence_below_threshold', ''))} AS t1,
  {pick('doc_id', ('', '', 'ambiguous_grade', '', 'header_row_conflict:heat', '', ''))} AS t2 FROM documents"""
LABELS = {"missing_grade": "grade", "missing_yield_mpa": "yield_strength", "missing_tensile_mpa": "tensile_strength", "missing_elongation_pct": "elongation"}
MISSING = ", ".join(f"CASE WHEN n_items > 0 AND {c} = n_items THEN 'missing_critical_field:{n}' END" for c, n in LABELS.items())
WEAK = ", ".join(f"CASE WHEN confidence_pct < 75 AND quality_class = 'noisy_scan' AND n_items > 0 AND {c} = n_items THEN 'low_confidence:{n}' END" for c, n in LABELS.items() if n != "grade")
SOFT = f"(x IN ('blurry/noisy document') OR {SOFTS.format('x')})"
BLOCK = f"""(x IN ('quality_blocker:severe_scan', 'ambiguous_grade', 'missing_critical_identifier_group', 'no_items_extracted', 'row_count_inconsistent', 'unsupported_document_type', 'traceability_unverified', 'critical_identifier_unverified')
  OR x LIKE 'missing_critical_field:%' OR {BLOCKS.format('x')})"""
JOINED = "array_to_string(list_sort({0}), '|')"


@query(f"""WITH p AS (SELECT *, list_filter([t1, t2], lambda x: x <> '') AS toks FROM ({POLICY})),
s AS (SELECT *, list_distinct(list_filter([{MISSING}, CASE WHEN n_items > 0 AND NOT has_identifier THEN 'missing_critical_identifier_group' END, CASE WHEN NOT supported THEN 'unsupported_document_type' END,
  CASE WHEN quality_class = 'severe_scan' THEN 'quality_blocker:severe_scan' END, CASE WHEN n_non_compliant > 0 THEN 'validation_conflict:row_non_compliant' END, CASE WHEN n_items = 0 THEN 'no_items_extracted' END,
  CASE WHEN n_items = 0 AND table_found THEN 'table_found_but_no_rows' END, CASE WHEN n_reported <> n_items THEN 'row_count_inconsistent' END, {WEAK}, CASE WHEN confidence_pct < 75 THEN 'confidence_below_threshold' END,
  CASE WHEN t1 LIKE 'numeric_uncertain:%' THEN t1 WHEN t1 LIKE 'unresolved_spec:%' THEN 'unresolved_spec' WHEN t1 = 'critical_identifier_unverified' THEN t1 END, CASE WHEN t1 = 'critical_identifier_unverified' THEN 'traceability_unverified' END,
  CASE WHEN t2 <> '' THEN t2 END], lambda x: x IS NOT NULL)) AS st FROM p),
c AS (SELECT *, list_distinct(list_concat(toks, st)) AS every, n_items > 0 AND n_compliant = n_items AND n_row_reviews = 0 AS fine FROM s),
b AS (SELECT *, len(list_filter(every, lambda x: {BLOCK})) > 0 AS blocked, len(list_filter(every, lambda x: NOT {SOFT})) AS n_hard FROM c),
d AS (SELECT *, fine AND NOT blocked AND len(st) = 0 AND confidence_pct >= 90 AS bypass, fine AND NOT blocked AND len(every) > 0 AND n_hard = 0 AND confidence_pct >= 75 AS gentle FROM b)
SELECT doc_id, {JOINED.format('st')} AS structured, {JOINED.format(f'list_filter(every, lambda x: {BLOCK})')} AS blocking, {JOINED.format(f"list_filter(every, lambda x: NOT bypass AND {ONLY.format('x')})")} AS confidence_only,
  CASE WHEN blocked THEN 'review_required' WHEN bypass OR gentle THEN 'auto_accept' WHEN len(every) > 0 THEN 'review_required' ELSE 'auto_accept' END AS decision FROM d""")
def review_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's structured tokens, how they weigh, and the decision."""
    docs = view(spark, sf_dir, POLICY).withColumn("tokens", F.filter(F.array("t1", "t2"), lambda t: t != ""))
    joined = (F.array_join(F.sort_array(c), "|").alias(c) for c in ("structured", "blocking", "confidence_only"))
    return policy.review_policy(docs).select("doc_id", *joined, "decision")


EVALUATED = f"""SELECT doc_id, lang, doc_id % 3 <> 0 AS verified_gold, doc_id % 10 = 0 AS prediction_missing, cast(n_chars % 12 AS bigint) AS field_hits, cast(13 AS bigint) AS field_total,
  cast(n_chars % 6 AS bigint) AS critical_hits, cast(CASE WHEN lang = 'de' THEN 0 ELSE 7 END AS bigint) AS critical_total, CASE WHEN n_chars % 4 = 0 THEN NULL ELSE n_chars % 3 = 0 END AS review,
  cast(CASE WHEN n_chars % 50 = 0 THEN 1 ELSE 0 END AS bigint) AS unsafe, cast(n_chars % 2 AS bigint) AS unsafe_total, cast(n_chars % 5 AS bigint) AS missing_required, cast(5 AS bigint) AS required_total,
  CASE WHEN n_chars % 11 > 0 THEN cast(n_chars % 1000 AS bigint) END AS latency_ms, n_chars AS tokens_in, n_chars % 300 AS tokens_out,
  cast(n_chars % 3 AS bigint) AS document_type_hits, cast(CASE WHEN lang = 'fr' THEN 0 ELSE 3 END AS bigint) AS document_type_total, cast(doc_id % 2 AS bigint) AS processing_decision_hits, cast(1 AS bigint) AS processing_decision_total,
  cast(n_chars % 4 AS bigint) AS traceability_hits, cast(CASE WHEN n_chars % 100 = 3 THEN 1 ELSE 3 END AS bigint) AS traceability_total, cast(n_chars % 7 AS bigint) AS extraction_misses, cast(CASE WHEN n_chars % 13 = 0 THEN 1 ELSE 0 END AS bigint) AS fail_closed,
  n_chars % 17 = 0 AS schema_failure, CASE WHEN n_chars % 9 > 0 THEN cast(n_chars % 64 AS double) / 1024 END AS cost_usd, {pick('n_chars', ('digital', '', 'scan', None))} AS bucket_name FROM documents"""
GOLD = "coalesce(sum({0}) FILTER (WHERE verified_gold), 0)"


RATE = "coalesce(round({0} / nullif({1}, 0), 4), 0)"


def _accuracy_sql(name: str) -> str:
    hits, total = GOLD.format(f"{name}_hits"), GOLD.format(f"{name}_total")
    return f"CASE WHEN {total} > 0 THEN round({hits} / {total}, 4) END AS {name}_accuracy"


def _latency_sql(share: float) -> str:
    return f"round(cast(v[cast(round_even((len(v) - 1) * {share}, 0) AS bigint) + 1] AS double), 1)"


@query(f"""WITH e AS (SELECT *, NOT prediction_missing AS made, CASE WHEN coalesce(trim(bucket_name), '') = '' THEN 'unknown' ELSE bucket_name END AS bucket FROM ({EVALUATED})),
a AS (SELECT bucket, count(*) AS n_documents, count(*) FILTER (WHERE verified_gold) AS n_verified, count(*) FILTER (WHERE made) AS n_predictions,
  {', '.join(map(_accuracy_sql, ('field', 'critical', 'document_type', 'processing_decision')))},
  {RATE.format('count(*) FILTER (WHERE made AND review)', 'count(*) FILTER (WHERE made AND review IS NOT NULL)')} AS review_rate,
  count(*) FILTER (WHERE made AND NOT review) AS auto_accepts, cast({GOLD.format('unsafe')} AS bigint) AS unsafe_accepts,
  {RATE.format(GOLD.format('unsafe'), GOLD.format('unsafe_total'))} AS unsafe_rate, cast({GOLD.format('fail_closed')} AS bigint) AS fail_closed_reviews, cast({GOLD.format('extraction_misses')} AS bigint) AS extraction_misses,
  cast({GOLD.format('traceability_hits')} AS bigint) AS traceability_matches, cast(greatest(0, {GOLD.format('traceability_total')} - {GOLD.format('traceability_hits')}) AS bigint) AS traceability_misses,
  cast({GOLD.format('traceability_total')} AS bigint) AS traceability_total, {RATE.format(GOLD.format('missing_required'), GOLD.format('required_total'))} AS missing_rate,
  count(*) FILTER (WHERE made AND schema_failure) AS schema_failures, {RATE.format('count(*) FILTER (WHERE made AND schema_failure)', 'count(*) FILTER (WHERE made)')} AS schema_failure_rate,
  round(avg(latency_ms) FILTER (WHERE made), 1) AS mean_latency_ms, cast(coalesce(sum(tokens_in) FILTER (WHERE made), 0) AS bigint) AS tokens_in, cast(coalesce(sum(tokens_out) FILTER (WHERE made), 0) AS bigint) AS tokens_out,
  round(coalesce(sum(cost_usd) FILTER (WHERE made), 0), 6) AS cost_usd, coalesce(round(coalesce(sum(cost_usd) FILTER (WHERE made), 0) / nullif(count(*) FILTER (WHERE made), 0), 6), 0) AS cost_usd_per_document,
  list_sort(list(latency_ms) FILTER (WHERE made AND latency_ms IS NOT NULL)) AS v FROM e GROUP BY GROUPING SETS ((bucket), ()))
SELECT * EXCLUDE (v), {_latency_sql(0.5)} AS p50_latency_ms, {_latency_sql(0.95)} AS p95_latency_ms FROM a""")
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.evaluation_report(view(spark, sf_dir, EVALUATED), "bucket_name")


WEIGHED = f"""SELECT h.doc_id, h.row_index, h.heat, {pick('x.p', ('7', 'A1105', None))} AS item_id, {pick('x.s', ('12 kg', '1.200,5 kg', 'n/a', '', '12'))} AS weight, {pick('x.p', ('S235JR', 's355j2', 'X65', None))} AS grade,
  cast(200 + x.s * 7 % 300 AS double) AS yield_mpa, cast(400 + x.q AS double) AS tensile_mpa FROM ({HEATS}) AS h JOIN ({LINES}) AS x ON h.doc_id = x.doc_id AND h.row_index = x.row_index"""
KEY = "regexp_replace(upper(coalesce({0}, '')), '[^A-Z0-9]', '', 'g')"


@query(f"""WITH w AS (SELECT *, {KEY.format('heat')} AS h, {KEY.format('item_id')} AS i, length(regexp_replace({KEY.format('heat')}, '[^0-9]', '', 'g')) AS d FROM ({WEIGHED})),
k AS (SELECT doc_id, length(h) AS l, d FROM w WHERE h <> ''), l AS (SELECT doc_id, l, count(*) AS n FROM k GROUP BY ALL), g AS (SELECT doc_id, d, count(*) AS n FROM k GROUP BY ALL),
m AS (SELECT a.doc_id, a.l, b.d FROM (SELECT doc_id, arg_min(l, (-n, l)) AS l, sum(n) AS t FROM l GROUP BY doc_id) a JOIN (SELECT doc_id, arg_min(d, (-n, d)) AS d FROM g GROUP BY doc_id) b USING (doc_id) WHERE t >= 2),
f AS (SELECT w.*, coalesce(weight <> '' AND (NOT regexp_matches(weight, '[0-9]') OR weight LIKE '%.%' AND weight LIKE '%,%'), false) AS f1, coalesce(h <> '' AND (abs(length(h) - m.l) >= 3 OR abs(w.d - m.d) >= 3), false) AS f2,
  coalesce(weight LIKE '%.%' AND weight LIKE '%,%', false) AS f3, coalesce(upper(grade) LIKE '%S235%' AND yield_mpa > 420 OR upper(grade) LIKE '%S355%' AND yield_mpa < 250 OR upper(grade) LIKE '%X65%' AND tensile_mpa < 430, false) AS f4,
  h <> '' AND h = i AS f5 FROM w LEFT JOIN m ON w.doc_id = m.doc_id)
SELECT f1 AS malformed, f2 AS off_pattern, f4 AS odd_grade, f5 AS duplicated, cast(CASE WHEN f1 THEN 12 ELSE 0 END + CASE WHEN f2 THEN 14 ELSE 0 END + CASE WHEN f3 THEN 12 ELSE 0 END + CASE WHEN f4 THEN 16 ELSE 0 END + CASE WHEN f5 THEN 20 ELSE 0 END AS bigint) AS extra_off, count(*) AS n FROM f GROUP BY ALL""")
def extra_row_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by what the extra checks find, and what it takes off their confidence."""
    rows = view(spark, sf_dir, WEIGHED)
    found = validate.extra_checks(rows, validate.heat_patterns(rows.where("heat <> ''")))
    names = {"malformed": "malformed numeric strings", "off_pattern": "heat number format inconsistency", "odd_grade": "inconsistent grade/spec combinations", "duplicated": "suspicious_duplication:heat_and_item_id"}
    return counted(found.select(*(F.array_contains("findings", v).alias(k) for k, v in names.items()), "extra_off"), "malformed", "off_pattern", "odd_grade", "duplicated", "extra_off")


CODES = f"SELECT {pick('l_partkey', ('812003694', '81200369O', 'S1200594', 'A1200594', 'LS210612G8', '12G34567', 'G2345678', 'A12S45', 'AB-12', ''))} || CASE WHEN l_suppkey % 3 = 0 THEN cast(l_suppkey % 5 AS string) ELSE '' END AS raw FROM lineitem"


@query(f"""WITH c AS (SELECT raw, count(*) AS n, regexp_replace(upper(trim(raw)), '[^A-Z0-9]', '', 'g') AS k FROM ({CODES}) GROUP BY raw),
d AS (SELECT *, length(regexp_replace(k, '[^A-Z]', '', 'g')) AS a, length(regexp_replace(k, '[^0-9]', '', 'g')) AS d, regexp_replace(k, '^[A-Z]{{1,2}}([0-9])', '\\1') AS body FROM c)
SELECT raw, n, CASE WHEN length(k) < 3 OR a = 0 OR (regexp_full_match(k, '[A-Z]{{2,}}[A-Z0-9]*') AND a * 5 >= length(k)) THEN false
  WHEN regexp_matches(k, '^[A-Z]{{1,2}}[0-9]') AND d >= 3 AND regexp_full_match(body, '[0-9]+') THEN regexp_full_match(k, '[OILSBZG][0-9]+')
  WHEN regexp_matches(k, '^[A-Z]{{1,2}}[0-9]') AND d >= 3 THEN regexp_matches(body, '[OILSBZ]|[0-9]G[0-9]') WHEN d * 10 < length(k) * 7 THEN false ELSE regexp_matches(k, '[OILSBZ]|^G|[0-9]G[0-9]') END AS suspicious FROM d""")
def identifier_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(view(spark, sf_dir, CODES), "raw").withColumn("suspicious", text.suspicious_identifier(F.col("raw")))
