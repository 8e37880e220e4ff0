"""Queries of batches, review sheets, stored runs and page texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certlake.operators import batch
from certlake.plans.registry import query
from certlake.plans.views import LINES, pick, view

PROFILES = f"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'file' ELSE 'doc' END || cast(doc_id AS string) AS name, cast(n_chars % 9 AS bigint) AS pages,
  {pick('n_chars', ('digital_clean', 'noisy_scan', 'scan_clean', 'odd', 'noisy_scan'))} AS quality, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE cast(n_chars % 130 AS double) END AS blur,
  cast(n_chars % 8 AS double) / 8 AS density, n_chars % 2 = 0 AS has_text, n_chars % 3 = 0 AS has_table, cast(doc_id % 40 AS bigint) AS done FROM documents"""


@query(f"""WITH p AS (SELECT *, CASE WHEN pages = 0 THEN 1 ELSE pages END AS n, coalesce(quality = 'noisy_scan' AND coalesce(blur, 0) < 30, false) AS severe FROM ({PROFILES}))
SELECT doc_id, try_cast(CASE WHEN name LIKE 'doc%' THEN substr(name, 4) END AS bigint) AS natural_key, CASE WHEN NOT severe THEN CASE WHEN n = 1 THEN 50 WHEN n = 2 THEN 30 WHEN n <= 4 THEN 10 ELSE (n - 4) * -5 END
  + CASE quality WHEN 'digital_clean' THEN 20 WHEN 'scan_clean' THEN 18 WHEN 'noisy_scan' THEN 15 ELSE 10 END + CASE WHEN has_text THEN 10 ELSE 0 END + CASE WHEN has_table THEN 15 ELSE 0 END + density * 5
  - CASE WHEN quality = 'noisy_scan' AND coalesce(blur, 0) < 100 THEN 10 ELSE 0 END END AS score, CASE WHEN done >= 30 THEN 'quota' WHEN quality = 'noisy_scan' AND blur < 30 THEN 'severe_scan' END AS skipped,
  CASE WHEN quality = 'noisy_scan' THEN 4 ELSE 8 END AS page_cap FROM p""")
def next_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document is worth to the next batch, why it is passed over, and how many of its pages are read."""
    docs, c = view(spark, sf_dir, PROFILES), F.col
    score = batch.document_score(c("pages"), c("quality"), c("blur"), c("density"), c("has_text"), c("has_table"))
    return docs.select(
        "doc_id", batch.natural_key(c("name")).alias("natural_key"), score.alias("score"), batch.skip_reason(c("quality"), c("blur"), c("done"), 30).alias("skipped"),
        batch.page_cap(c("quality"), 8, 4).alias("page_cap"),
    )


USAGE = "SELECT event_type AS run, cast(round(value * 100) AS bigint) AS tokens_in, cast(event_id % 500 AS bigint) AS tokens_out, cast(event_id % 2 AS bigint) AS new_documents, CASE WHEN event_id % 90 = 0 THEN cast(1 AS bigint) END AS rate_limits FROM events"


@query(f"""SELECT run, cast(coalesce(sum(tokens_in), 0) AS bigint) AS tokens_in, cast(coalesce(sum(tokens_out), 0) AS bigint) AS tokens_out, cast(coalesce(sum(new_documents), 0) AS bigint) AS new_documents, cast(coalesce(sum(rate_limits), 0) AS bigint) AS rate_limits,
  cast(coalesce(sum(tokens_in), 0) * 3 + coalesce(sum(tokens_out), 0) * 15 AS bigint) AS spend FROM ({USAGE}) GROUP BY run""")
def batch_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.batch_totals(view(spark, sf_dir, USAGE), ["run"])


SHEET = f"""SELECT CASE WHEN o_orderkey % 50 = 0 THEN '# remark' ELSE ' d' || cast(o_orderkey AS string) END AS document_id, {pick('o_orderkey', ('verified', ' OK ', 'pending', '', None, 'Accepted', 'rejected'))} AS review_status,
  {pick('o_custkey', ('', ' Steel Works ', None))} AS verified_supplier, 'Scanned ' || cast(o_custkey % 9 AS string) AS extracted_supplier, {pick('o_custkey', ('H1 | H2', ' ', 'H3||H4'))} AS verified_heats, {pick('o_orderkey', ('X|Y', '', None))} AS extracted_heats,
  {pick('o_custkey', ('compliant', 'No', '', 'maybe', '1'))} AS verified_is_compliant, 'fail' AS extracted_is_compliant FROM orders"""
PICKED = "coalesce(nullif(trim(coalesce(verified_{0}, '')), ''), trim(coalesce(extracted_{0}, '')))"


@query(f"""WITH k AS (SELECT trim(document_id) AS document_id, {PICKED.format('supplier')} AS supplier, {PICKED.format('heats')} AS heats, lower({PICKED.format('is_compliant')}) AS word FROM ({SHEET}) WHERE upper(trim(coalesce(review_status, ''))) IN ('VERIFIED', 'ACCEPTED', 'OK') AND trim(document_id) NOT LIKE '#%')
SELECT document_id, nullif(supplier, '') AS supplier, array_to_string(list_filter(list_transform(string_split(heats, '|'), lambda x: trim(x)), lambda x: x <> ''), '|') AS heats, CASE WHEN word IN {batch.COMPLIANT} THEN true WHEN word IN {batch.NON_COMPLIANT} THEN false END AS is_compliant FROM k""")
def promoted_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold records of accepted rows of a review sheet."""
    accepted = batch.promote_reviewed(view(spark, sf_dir, SHEET), ["supplier", "heats", "is_compliant"])
    return batch.gold_record(accepted, ["supplier"], ["heats"]).withColumn("heats", F.array_join("heats", "|"))


BUCKETED = f"SELECT doc_id, {pick('doc_id', ('', ' severe_scan', 'other', None, 'clean_scan'))} AS listed, n_chars % 3 > 0 AS has_text, n_chars AS chars FROM documents"


@query(f"""WITH b AS (SELECT CASE WHEN trim(listed) IN {batch.BUCKETS} THEN trim(listed) WHEN has_text AND chars > 500 THEN 'digital_pdf' WHEN has_text THEN 'clean_scan' ELSE 'degraded_scan' END AS bucket FROM ({BUCKETED})) SELECT bucket, count(*) AS n FROM b GROUP BY bucket""")
def inferred_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = batch.quality_bucket(F.col("listed"), F.col("has_text"), F.col("chars"))
    return view(spark, sf_dir, BUCKETED).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


STORED = f"""SELECT o_orderkey AS job_id, o_custkey AS user_id, {pick('o_orderkey', ('queued', 'processing', 'cancelled', 'failed', 'succeeded', 'succeeded'))} AS state, {pick('o_custkey', ('', None, 'PARTIAL'))} AS status, o_orderkey % 4 = 0 AS needs_review,
  CASE WHEN o_orderkey % 3 > 0 THEN cast(o_orderkey % 7 - 2 AS bigint) END AS own_pages, CASE WHEN o_orderkey % 5 > 0 THEN cast(o_orderkey % 6 - 1 AS bigint) END AS profile_pages FROM orders"""


@query(f"""SELECT job_id, CASE WHEN user_id % 3 <> 0 THEN 404 WHEN state IN ('queued', 'processing') THEN 425 WHEN state = 'cancelled' THEN 409 ELSE 200 END AS code, coalesce(nullif(status, ''), CASE WHEN needs_review THEN 'NEEDS_REVIEW' ELSE 'COMPLETED' END) AS run_status,
  CASE WHEN own_pages >= 0 THEN own_pages WHEN profile_pages >= 0 THEN profile_pages ELSE 0 END AS pages FROM ({STORED})""")
def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every job's result is answered to its requester, and the stored status and page count."""
    c = F.col
    owned = c("user_id") % 3 == 0
    return view(spark, sf_dir, STORED).select("job_id", batch.result_code(owned, c("state")).alias("code"), batch.run_status(c("status"), c("needs_review")).alias("run_status"), batch.page_count(c("own_pages"), c("profile_pages")).alias("pages"))


STORED_ITEMS = f"SELECT doc_id AS run_id, row_index, 'old' || cast(p % 9 AS string) AS item FROM ({LINES}) AS x"
FRESH = "SELECT o_orderkey AS run_id, 'new' || cast(o_custkey AS string) AS item FROM orders WHERE o_orderkey % 4 = 1 UNION ALL SELECT o_orderkey AS run_id, 'added' AS item FROM orders WHERE o_orderkey % 8 = 1"


@query(f"""WITH f AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY item) - 1 AS row_index, item FROM ({FRESH}))
SELECT run_id, row_index, item FROM ({STORED_ITEMS}) WHERE run_id NOT IN (SELECT run_id FROM f) UNION ALL SELECT run_id, row_index, item FROM f""")
def replaced_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored items after some runs have been written again."""
    return batch.replace_children(view(spark, sf_dir, STORED_ITEMS), view(spark, sf_dir, FRESH), "run_id", ["item"])


MANDATORY = ["item_id", "heat_number", "grade", "yield_mpa"]
CHECKED = f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR p % 4 = 0 THEN '' ELSE 'i' END AS item_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE {pick('s', ('H', '', 'K'))} END AS heat_number, {pick('p', ('S195', None, 'X65'))} AS grade,
  CASE WHEN q % 6 = 0 THEN NULL ELSE cast(q AS double) END AS yield_mpa FROM ({LINES}) AS x WHERE doc_id % 9 <> 0"""
AUDITS = f"SELECT o_orderkey AS doc_id, {pick('o_orderkey', ('', 'There is No Item ID column.', 'no heat number was found', None, 'Without item id; heat absent'))} AS audit FROM orders"
EXCUSES = {"item_id": "no item id|no item-id|no item identifier|no separate item id|without item id|item id absent|missing item id column|no column for item id", "heat_number": "no heat|heat absent"}
COUNTS = ", ".join(f"count(*) FILTER (WHERE trim(coalesce(cast({f} AS string), '')) = '') AS no_{f}" for f in MANDATORY)
COUNTED = {f: f"CASE WHEN {f'''regexp_matches(lower(coalesce(audit, '')), '{EXCUSES[f]}') AND no_{f} = n''' if f in EXCUSES else 'false'} THEN 0 ELSE {{0}} END" for f in MANDATORY}


@query(f"""WITH s AS (SELECT doc_id, count(*) AS n, {COUNTS} FROM ({CHECKED}) GROUP BY doc_id), t AS (SELECT doc_id, n, coalesce({' + '.join(COUNTED[f].format(f'no_{f}') for f in MANDATORY)}, 0) AS missing, coalesce({' + '.join(COUNTED[f].format('n') for f in MANDATORY)}, 0) AS total FROM ({AUDITS}) LEFT JOIN s USING (doc_id))
SELECT doc_id, missing, total, CASE WHEN n > 0 THEN round(missing / greatest(total, 1), 4) ELSE 1 END AS rate FROM t""")
def missing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of mandatory values that a document lacks; audits excuse absent columns."""
    return batch.missing_rate(view(spark, sf_dir, CHECKED), view(spark, sf_dir, AUDITS), MANDATORY)


CONFIDENCES = f"SELECT doc_id, {pick('row_index', ('heat_number', 'grade', 'supplier_name', 'notes'))} AS field, CASE WHEN p % 5 = 0 THEN NULL ELSE cast(s % 128 AS double) / 64 - 0.25 END AS confidence FROM ({LINES}) AS x WHERE doc_id % 4 <> 0"
WHOLE = "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN cast(o_orderkey % 8 AS double) / 8 END AS row_mean, CASE WHEN o_orderkey % 5 > 0 THEN cast(o_orderkey % 20 AS double) / 16 END AS overall FROM orders"


@query(f"""WITH s AS (SELECT doc_id, min(greatest(0, least(1, confidence))) FILTER (WHERE field IN ('heat_number', 'grade')) AS low, avg(greatest(0, least(1, confidence))) AS mean FROM ({CONFIDENCES}) WHERE confidence IS NOT NULL GROUP BY doc_id),
w AS (SELECT doc_id, coalesce(row_mean, CASE WHEN overall IS NOT NULL THEN greatest(0, least(1, overall)) END) AS whole FROM ({WHOLE}))
SELECT doc_id, round(coalesce(CASE WHEN mean IS NOT NULL THEN low ELSE whole END, 0), 4) AS least_critical, round(coalesce(mean, whole, 0), 4) AS mean FROM w LEFT JOIN s USING (doc_id)""")
def confidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least critical and the mean field confidence of every document."""
    return batch.confidence_summary(view(spark, sf_dir, CONFIDENCES), view(spark, sf_dir, WHOLE), ["heat_number", "grade"])


PAGE_TEXTS = f"SELECT doc_id, cast(p % 4000 AS bigint) AS chars, p % 4000 > 30 AS has_text, s % 3 = 0 AS noisy, q % 2 = 0 AS full_page_raster FROM ({LINES}) AS x"
MAJORITY = ", ".join(f"count(*) FILTER (WHERE {c}) >= greatest(1, count(*) // 2) AS {c}" for c in ("has_text", "noisy", "full_page_raster"))


@query(f"SELECT doc_id, least(1, avg(coalesce(chars, 0)) / 2000) AS density, {MAJORITY} FROM ({PAGE_TEXTS}) GROUP BY doc_id")
def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.text_statistics(view(spark, sf_dir, PAGE_TEXTS))


SUPPRESSED = f"SELECT doc_id, row_index AS ordinal, {pick('p', ('row', None, 'document'))} AS scope, CASE WHEN p % 3 < 2 THEN cast(l % 3 AS bigint) END AS row_index, {pick('s', ('heat_number', 'batch_number', 'lot_number'))} AS field FROM ({LINES}) AS x"


@query(f"""WITH f AS (SELECT doc_id, coalesce(scope, 'row') AS scope, row_index, field, min(ordinal) AS first, count(*) AS n FROM ({SUPPRESSED}) GROUP BY ALL)
SELECT doc_id, scope, row_index, string_agg(field, '|' ORDER BY first) AS fields, cast(sum(n) AS bigint) AS n FROM f GROUP BY doc_id, scope, row_index""")
def suppressed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.suppressed_groups(view(spark, sf_dir, SUPPRESSED))


BEFORE, AFTER = ("SELECT lang AS field, round(avg(n_chars % 10), 2) AS value FROM documents WHERE lang <> '{0}' GROUP BY lang".format(x) for x in ("fr", "de"))


@query(f"SELECT field, b.value AS before, a.value AS after, round(a.value - b.value, 4) AS change FROM ({BEFORE}) b FULL JOIN ({AFTER}) a USING (field)")
def metric_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics that either of two runs has, side by side."""
    return batch.metric_names(view(spark, sf_dir, BEFORE), view(spark, sf_dir, AFTER))


@query(f"""WITH p AS (SELECT coalesce(nullif(trim(quality), ''), 'unknown') AS quality, coalesce(has_text, false) AS has_text FROM ({PROFILES})) SELECT quality, has_text, count(*) AS n FROM p GROUP BY GROUPING SETS ((quality), (has_text), ())""")
def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.profile_counts(view(spark, sf_dir, PROFILES))


POLICIES = [("STRUCTURAL_STEEL", 4), ("PIPE", 4), ("WIRE_ROPE", 3)]
CATEGORIES = f"SELECT doc_id, {pick('doc_id', ('PIPE', '', None, 'WIRE_ROPE', 'OTHER'))} AS category FROM documents"


@query(f"""SELECT policy, n_mandatory, count(*) AS n FROM (SELECT CASE WHEN category IN ('PIPE', 'WIRE_ROPE') THEN category ELSE 'STRUCTURAL_STEEL' END AS policy, cast(CASE WHEN category = 'WIRE_ROPE' THEN 3 ELSE 4 END AS bigint) AS n_mandatory FROM ({CATEGORIES})) GROUP BY ALL""")
def category_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the policy of their category, or the default one."""
    policies = spark.createDataFrame(POLICIES, "category string, n_mandatory long")
    rows = batch.with_default(view(spark, sf_dir, CATEGORIES), policies, "category", "STRUCTURAL_STEEL")
    return rows.groupBy("policy", "n_mandatory").agg(F.count("*").alias("n"))
