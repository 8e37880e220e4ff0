"""Queries of totals and of resolved policies, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certlake.operators import totals
from certlake.plans.registry import query
from certlake.plans.views import LINES, pick, view
from certlake.registries import values_sql

COMPARED = f"""SELECT {pick('p', ('heat_number', 'grade', 'supplier_name', 'yield', 'cast_number'))} AS field, (s + q) % 3 = 0 AS raw, (s + q) % 3 = 0 OR q % 4 = 0 AS business,
  CASE WHEN q % 7 = 0 THEN s % 2 = 0 END AS review, {pick('p', ('critical', 'standard'))} AS criticality, {pick('p', (totals.IDENTIFIER_MATCHER, 'grade_alias_match', totals.IDENTIFIER_MATCHER))} AS matcher FROM ({LINES}) AS x"""


@query(f"""WITH s AS (SELECT field, count(*) AS n, count(*) FILTER (WHERE raw) AS raw_hits, count(*) FILTER (WHERE business) AS business_hits, count(*) FILTER (WHERE NOT raw AND business) AS harmless,
  count(*) FILTER (WHERE NOT raw AND NOT business AND NOT coalesce(review, false)) AS true_mismatches, count(*) FILTER (WHERE review) AS review_needed,
  count(*) FILTER (WHERE criticality = 'critical' AND matcher = '{totals.IDENTIFIER_MATCHER}' AND NOT business) AS critical_identifier_mismatches FROM ({COMPARED}) GROUP BY GROUPING SETS ((field), ()))
SELECT *, round(raw_hits / n, 4) AS raw_accuracy, round(business_hits / n, 4) AS business_accuracy, round(round(business_hits / n, 4) - round(raw_hits / n, 4), 4) AS delta FROM s""")
def field_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, harmless differences, mismatches and reviews of each compared field and of all."""
    return totals.field_totals(view(spark, sf_dir, COMPARED))


BATCH_RUNS = f"""SELECT {pick('event_id', ('OK', 'OK', 'ERROR', 'OK', 'DRY_RUN'))} AS status, user_id % 3 = 0 AS review, CASE WHEN event_id % 9 > 0 THEN cast(event_id * 37 % 4001 AS bigint) END AS latency_ms,
  {pick('user_id', ('path_a', '', 'path_b', None))} AS route, {pick('event_id', ('digital_clean', 'noisy_scan', None))} AS quality_class FROM events"""
HISTOGRAM = "(SELECT string_agg(k || '=' || n, '|' ORDER BY k) FROM (SELECT coalesce(nullif({0}, ''), 'unknown') AS k, count(*) AS n FROM r GROUP BY ALL))"


@query(f"""WITH r AS ({BATCH_RUNS}), l AS (SELECT list_sort(list(latency_ms)) AS v FROM r WHERE latency_ms IS NOT NULL),
s AS (SELECT count(*) AS total_documents, count(*) FILTER (WHERE status = 'OK') AS ok, count(*) FILTER (WHERE status = 'ERROR') AS errors, count(*) FILTER (WHERE status = 'DRY_RUN') AS dry_run,
  count(*) FILTER (WHERE status = 'OK' AND review) AS review_required, round(avg(latency_ms), 1) AS mean_latency_ms FROM r)
SELECT s.*, review_required / ok AS review_rate, (ok - review_required) / ok AS stp_rate, round((v[(len(v) - 1) // 2 + 1] + v[len(v) // 2 + 1]) / 2, 1) AS median_latency_ms,
  round(cast(v[cast(round_even((len(v) - 1) * 0.95, 0) AS bigint) + 1] AS double), 1) AS p95_latency_ms, {HISTOGRAM.format('route')} AS route_counts, {HISTOGRAM.format('quality_class')} AS quality_counts FROM s, l""")
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one row that sums up a batch of runs."""
    done = totals.batch_totals(view(spark, sf_dir, BATCH_RUNS))
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "|")
    return done.withColumn("route_counts", text("route_counts")).withColumn("quality_counts", text("quality_counts"))


POLICY_FIELDS = "SELECT DISTINCT cast(l_suppkey % 20 AS bigint) AS policy, 'field' || cast(l_linenumber AS string) AS field, 'group' || cast(l_linenumber % 3 AS string) AS grp FROM lineitem"
POLICY_SETTINGS = f"""SELECT DISTINCT cast(l_suppkey % 20 AS bigint) AS policy, {pick('l_partkey', ('field', 'group', 'defaults', 'other'))} AS level,
  CASE cast(l_partkey % 3 AS int) WHEN 0 THEN 'field' || cast(l_linenumber AS string) WHEN 1 THEN 'group' || cast(l_linenumber % 3 AS string) END AS subject,
  {pick('l_partkey + l_suppkey', (*totals.BUILT_IN, 'unknown_name'))} AS name, {pick('l_partkey', ('true', '5', 'critical', None, 'x'))} AS value FROM lineitem WHERE l_partkey % 11 < 4"""
RESOLVED_SQL = f"""n AS (SELECT * FROM {values_sql(list(totals.BUILT_IN.items()), 'name, value')}),
f AS ({POLICY_FIELDS}), s AS (SELECT * FROM ({POLICY_SETTINGS}) WHERE value IS NOT NULL),
w AS (SELECT policy, field, grp, n.name, n.value AS built_in FROM f CROSS JOIN n),
m AS (SELECT w.policy, w.field, w.name, w.built_in, max(s.value) FILTER (WHERE s.level = 'field' AND s.subject = w.field) AS a, max(s.value) FILTER (WHERE s.level = 'group' AND s.subject = w.grp) AS b,
  max(s.value) FILTER (WHERE s.level = 'defaults') AS c FROM w LEFT JOIN s ON s.policy = w.policy AND s.name = w.name GROUP BY ALL)"""


@query(f"""WITH {RESOLVED_SQL} SELECT policy, field, name, coalesce(a, b, c, built_in) AS value, CASE WHEN a IS NOT NULL THEN 'field' WHEN b IS NOT NULL THEN 'group' WHEN c IS NOT NULL THEN 'defaults' ELSE 'built_in' END AS source FROM m""")
def resolved_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every setting of every field, with the level that it comes from."""
    return totals.resolved_policies(view(spark, sf_dir, POLICY_FIELDS).withColumnRenamed("grp", "group"), view(spark, sf_dir, POLICY_SETTINGS))
