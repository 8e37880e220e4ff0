"""Rules of batches: which documents come next, spend, gold from review sheets, stored runs and their page texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certlake.functions.text import is_missing

# What a quality class is worth, least sharpness of a usable scan, statuses and buckets that are accepted, list prices per 1,000 tokens
# in millionths of a dollar, words of a compliance flag, and hints that a column is absent.
CLASS_BONUS = {"digital_clean": 20.0, "scan_clean": 18.0, "noisy_scan": 15.0}
SEVERE_BLUR = 30.0
ACCEPTED = ("VERIFIED", "ACCEPTED", "OK")
BUCKETS = ("digital_pdf", "clean_scan", "degraded_scan", "severe_scan")
PRICES = {"tokens_in": 3000, "tokens_out": 15000}
COMPLIANT = ("1", "true", "yes", "y", "compliant", "pass")
NON_COMPLIANT = ("0", "false", "no", "n", "non_compliant", "fail")
ABSENT_HINTS = {
    "item_id": (
        "no item id", "no item-id", "no item identifier", "no separate item id", "no item id column", "without item id", "item id absent",
        "missing item id column", "no column for item id",
    ),
    "heat_number": ("no heat", "no heat no", "no heat number", "no heat column", "heat absent"),
}


def document_score(pages: Column, quality: Column, blur: Column, density: Column, has_text: Column, has_table: Column, severe: bool = False) -> Column:
    """What a document is worth to a batch; null for severe scans unless ``severe``."""
    n = F.coalesce(F.nullif(pages, F.lit(0)), F.lit(1))
    by_pages = F.when(n == 1, 50.0).when(n == 2, 30.0).when(n <= 4, 10.0).otherwise((n - 4) * -5.0)
    bonus = F.lit(10.0)
    for name, worth in CLASS_BONUS.items():
        bonus = F.when(quality == name, worth).otherwise(bonus)
    yes = lambda c, worth: F.when(c, worth).otherwise(0.0)
    noisy, sharp = quality == "noisy_scan", F.coalesce(blur, F.lit(0.0))
    total = by_pages + bonus + yes(has_text, 10.0) + yes(has_table, 15.0) + F.coalesce(density, F.lit(0.0)) * 5 - yes(noisy & (sharp < 100), 10.0)
    return total if severe else F.when(~F.coalesce(noisy & (sharp < SEVERE_BLUR), F.lit(False)), total)


def skip_reason(quality: Column, blur: Column, done: Column, quota: int) -> Column:
    """Why a batch passes a document over: its quota is used up, or the scan is severe; else null."""
    severe = (quality == "noisy_scan") & (blur < SEVERE_BLUR)
    return F.when(done >= quota, "quota").when(severe, "severe_scan")


def page_cap(quality: Column, most: int, most_noisy: int) -> Column:
    return F.when(quality == "noisy_scan", most_noisy).otherwise(most)


def natural_key(name: Column) -> Column:
    """``doc12`` as 12, for sorting before the name itself; null for other names."""
    return F.regexp_extract(name, r"^doc\s*([+-]?[0-9]+)\s*$", 1).try_cast("long")


def batch_totals(batches: DataFrame, by: list[str]) -> DataFrame:
    """Tokens, documents and rate limits of merged batches, and their spend in millionths of a dollar."""
    names = ("tokens_in", "tokens_out", "new_documents", "rate_limits")
    sums = {n: F.coalesce(F.sum(n), F.lit(0)) for n in names}
    spend = F.round((sums["tokens_in"] * PRICES["tokens_in"] + sums["tokens_out"] * PRICES["tokens_out"]) / 1000).cast("long")
    return batches.groupBy(*by).agg(*(v.alias(n) for n, v in sums.items()), spend.alias("spend"))


def promote_reviewed(sheet: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of a review sheet with an accepted status; a reviewer's ``verified_`` value goes before the ``extracted_``
    one.  Rows whose id starts with ``#`` are remarks."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    status = F.upper(text("review_status"))
    kept = sheet.where(status.isin(*ACCEPTED) & ~F.startswith(text("document_id"), F.lit("#")))
    values = [F.coalesce(F.nullif(text(f"verified_{f}"), F.lit("")), text(f"extracted_{f}")).alias(f) for f in fields]
    return kept.select(text("document_id").alias("document_id"), *values, status.alias("review_status"))


def gold_record(rows: DataFrame, texts: list[str], lists: list[str]) -> DataFrame:
    """Gold with blank texts as null, lists parted at ``|`` without blanks, and the compliance flag as true, false or null."""
    chunks = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    word = F.lower(F.trim("is_compliant"))
    flag = F.when(word.isin(*COMPLIANT), True).when(word.isin(*NON_COMPLIANT), False)
    return rows.select("document_id", *(F.nullif(F.trim(c), F.lit("")).alias(c) for c in texts), *(chunks(c).alias(c) for c in lists), flag.alias("is_compliant"))


def quality_bucket(listed: Column, has_text: Column, chars: Column) -> Column:
    """The listed bucket where it is a known one, else by the text layer."""
    inferred = F.when(has_text & (chars > 500), "digital_pdf").when(has_text, "clean_scan").otherwise("degraded_scan")
    return F.when(F.trim(listed).isin(*BUCKETS), F.trim(listed)).otherwise(inferred)


def run_status(status: Column, needs_review: Column) -> Column:
    return F.coalesce(F.nullif(status, F.lit("")), F.when(needs_review, "NEEDS_REVIEW").otherwise("COMPLETED"))


def page_count(own: Column, profile: Column) -> Column:
    """The first count that is there and not negative, else 0."""
    return F.coalesce(F.when(own >= 0, own), F.when(profile >= 0, profile), F.lit(0))


def result_code(owned: Column, status: Column) -> Column:
    """What a request for a job's result is answered: 404 for others' jobs, 425 early, 409 cancelled, 200 else."""
    return F.when(~F.coalesce(owned, F.lit(False)), 404).when(status.isin("queued", "processing"), 425).when(status == "cancelled", 409).otherwise(200)


def user_by_email(users: DataFrame, email: str) -> DataFrame:
    return users.where(F.col("email") == F.lower(F.lit(email)))


def replace_children(items: DataFrame, fresh: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Items of the runs in ``fresh`` are replaced by it, numbered from 0 in order; items of other runs stay."""
    numbered = fresh.withColumn("row_index", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long") - 1)
    return items.join(fresh.select(key).distinct(), key, "left_anti").unionByName(numbered.select(*items.columns))


def missing_rate(rows: DataFrame, audits: DataFrame, mandatory: list[str]) -> DataFrame:
    """(doc_id, missing, total, rate) of mandatory fields over all rows of each document of ``audits``.

    A column that the document's audit calls absent doesn't count, if no row has a value; without rows the rate is 1.
    """
    blank = {f: is_missing(F.col(f).cast("string")) for f in mandatory}
    sums = rows.groupBy("doc_id").agg(F.count("*").alias("n"), *(F.count_if(b).alias(f"no_{f}") for f, b in blank.items()))
    joined = audits.join(sums, "doc_id", "left")
    missing, total = F.lit(0).cast("long"), F.lit(0).cast("long")
    for f in mandatory:
        hints = F.regexp_like(F.lower(F.coalesce("audit", F.lit(""))), F.lit("|".join(ABSENT_HINTS[f]))) if f in ABSENT_HINTS else F.lit(False)
        excused = hints & (F.col(f"no_{f}") == F.col("n"))
        missing, total = missing + F.when(excused, 0).otherwise(F.col(f"no_{f}")), total + F.when(excused, 0).otherwise(F.col("n"))
    rate = F.when(F.col("n") > 0, F.round(F.col("missing") / F.greatest("total", F.lit(1)), 4)).otherwise(1.0)
    out = joined.withColumn("missing", F.coalesce(missing, F.lit(0))).withColumn("total", F.coalesce(total, F.lit(0)))
    return out.select("doc_id", "missing", "total", rate.alias("rate"))


def confidence_summary(fields: DataFrame, documents: DataFrame, critical: list[str]) -> DataFrame:
    """(doc_id, least_critical, mean) of field confidences, to four places.

    fields: (doc_id, field, confidence); a document without any takes the mean of its rows (row_mean), then its own
    (overall), for both; without those both are 0.
    """
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    sums = fields.where("confidence IS NOT NULL").groupBy("doc_id").agg(F.min(F.when(F.col("field").isin(*critical), inside)).alias("least"), F.avg(inside).alias("mean"))
    joined = documents.join(sums, "doc_id", "left")
    overall = F.when(F.col("overall").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("overall"))))
    whole = F.coalesce("row_mean", overall)
    least = F.when(F.col("mean").isNotNull(), F.col("least")).otherwise(whole)
    return joined.select("doc_id", *(F.round(F.coalesce(c, F.lit(0.0)), 4).alias(n) for c, n in ((least, "least_critical"), (F.coalesce("mean", whole), "mean"))))


def text_statistics(pages: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, density, and a flag for each boolean column of pages): a flag holds on half of the pages, rounded down,
    and on ``least``; 2,000 characters a page are a density of 1."""
    flags = [c for c, t in pages.dtypes if t == "boolean"]
    half = F.greatest(F.lit(least), F.floor(F.count("*") / 2))
    density = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg(F.coalesce("chars", F.lit(0))) / 2000))
    return pages.groupBy("doc_id").agg(density.alias("density"), *((F.count_if(F.col(c)) >= half).alias(c) for c in flags))


def suppressed_groups(events: DataFrame) -> DataFrame:
    """Suppressed identifiers by scope and row: distinct fields in the order of their first event, and their number."""
    firsts = events.withColumn("scope", F.coalesce("scope", F.lit("row"))).groupBy("doc_id", "scope", "row_index", "field").agg(F.min("ordinal").alias("at"), F.count("*").alias("n"))
    pair = F.array_sort(F.collect_list(F.struct("at", "field")))
    return firsts.groupBy("doc_id", "scope", "row_index").agg(F.array_join(F.transform(pair, lambda p: p["field"]), "|").alias("fields"), F.sum("n").alias("n"))


def metric_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every field that either run measured, with both values."""
    a, b = (df.select("field", F.col("value").alias(n)) for df, n in ((left, "before"), (right, "after")))
    return a.join(b, "field", "full").withColumn("change", F.round(F.col("after") - F.col("before"), 4))


def profile_counts(profiles: DataFrame) -> DataFrame:
    """Documents by quality class, by text layer, and over all; one pass of grouping sets (absent keys are null)."""
    quality = F.coalesce(F.nullif(F.trim("quality"), F.lit("")), F.lit("unknown"))
    rows = profiles.select(quality.alias("quality"), F.coalesce("has_text", F.lit(False)).alias("has_text"))
    return rows.groupingSets([["quality"], ["has_text"], []], "quality", "has_text").agg(F.count("*").alias("n"))


def with_default(rows: DataFrame, policies: DataFrame, key: str, default: str) -> DataFrame:
    """Rows with the columns of their key's policy; of unknown and missing keys with those of the ``default`` one.

    ``policies`` is a bounded registry, a row for each key, ``default`` among them.
    """
    known = F.broadcast(policies.select(F.col(key).alias("policy")))
    keyed = rows.join(known, rows[key] == F.col("policy"), "left").withColumn("policy", F.coalesce("policy", F.lit(default)))
    return keyed.join(F.broadcast(policies.withColumnRenamed(key, "policy")), "policy", "left")
