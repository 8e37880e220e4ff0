"""Totals of evaluations and batches in one pass, and policies resolved over their levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The matcher of identifiers whose misses are counted apart, and the built-in policy of a field.
IDENTIFIER_MATCHER = "critical_identifier_strict_match"
BUILT_IN = {
    "field_type": "text", "criticality": "standard", "matcher_chain": "normalized_exact_match", "empty_both_match": "true", "numeric_abs_tolerance": "1.0",
    "numeric_rel_tolerance": "0.01", "supplier_fuzzy_threshold_accept": "95", "supplier_fuzzy_threshold_review": "90", "dimension_order_insensitive": "false",
    "allow_incomplete_dates": "false", "canonical_units": "",
}


def _rate(hits: Column, of: Column) -> Column:
    return F.when(of > 0, F.round(hits / of, 4)).otherwise(0.0)


def field_totals(results: DataFrame) -> DataFrame:
    """Counts of compared fields, for each field and over all (null field), by grouping sets of one scan.

    results: (field, raw, business, review, criticality, matcher).  Harmless ones match only when normalised; true
    mismatches match neither way and don't go to review; delta is what normalising adds to the accuracy.
    """
    raw, business, review = (F.coalesce(c, F.lit(False)) for c in ("raw", "business", "review"))
    sums = results.groupingSets([["field"], []], "field").agg(
        F.count("*").alias("n"), F.count_if(raw).alias("raw_hits"), F.count_if(business).alias("business_hits"), F.count_if(~raw & business).alias("harmless"),
        F.count_if(~raw & ~business & ~review).alias("true_mismatches"), F.count_if(review).alias("review_needed"),
        F.count_if((F.col("criticality") == "critical") & (F.col("matcher") == IDENTIFIER_MATCHER) & ~business).alias("critical_identifier_mismatches"),
    )
    out = sums.withColumn("raw_accuracy", _rate(F.col("raw_hits"), F.col("n"))).withColumn("business_accuracy", _rate(F.col("business_hits"), F.col("n")))
    return out.withColumn("delta", F.round(F.col("business_accuracy") - F.col("raw_accuracy"), 4))


def batch_totals(runs: DataFrame) -> DataFrame:
    """One row of a batch: counts by status, rates of review and straight-through documents among the finished ones,
    mean, median and 95th percentile of latencies, and histograms of routes and quality classes as maps.

    runs: (status, review, latency_ms, route, quality_class); missing routes and classes are ``unknown``.  Percentiles
    come from the counts of distinct latencies, so that no group of runs is collected.
    """
    ok = F.col("status") == "OK"
    n_ok, n_review = F.count_if(ok), F.count_if(ok & F.coalesce("review", F.lit(False)))
    share = lambda x: F.coalesce(x / F.nullif(F.col("ok"), F.lit(0)), F.lit(0.0))
    base = runs.agg(
        F.count("*").alias("total_documents"), n_ok.alias("ok"), F.count_if(F.col("status") == "ERROR").alias("errors"), F.count_if(F.col("status") == "DRY_RUN").alias("dry_run"),
        n_review.alias("review_required"), F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 1).alias("mean_latency_ms"),
    )
    base = base.withColumn("review_rate", share(F.col("review_required"))).withColumn("stp_rate", share(F.col("ok") - F.col("review_required")))
    counts = runs.where("latency_ms IS NOT NULL").groupBy("latency_ms").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, 0)))
    ends = upto.withColumn("all", F.sum("n").over(Window.partitionBy()))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("latency_ms")))
    middle = (F.col("all") - 1) / 2
    ranks = ends.agg(at(F.floor(middle)).alias("low"), at(F.ceil(middle)).alias("high"), at(F.rint((F.col("all") - 1) * 0.95)).alias("p95"))
    ranks = ranks.select(F.round(F.coalesce((F.col("low") + F.col("high")) / 2, F.lit(0.0)), 1).alias("median_latency_ms"), F.round(F.coalesce(F.col("p95").cast("double"), F.lit(0.0)), 1).alias("p95_latency_ms"))
    named = runs.select(*(F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("unknown")).alias(c) for c in ("route", "quality_class")))
    cells = named.groupingSets([["route"], ["quality_class"]], "route", "quality_class").agg(F.count("*").alias("n"))
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(c, "n")))))
    histograms = cells.agg(entries("route").alias("route_counts"), entries("quality_class").alias("quality_counts"))
    # Three tables of one row each.
    keyed = [df.withColumn("one", F.lit(1)) for df in (base, ranks, histograms)]
    return keyed[0].join(keyed[1], "one").join(keyed[2], "one").drop("one")


def resolved_policies(fields: DataFrame, settings: DataFrame) -> DataFrame:
    """(policy, field, name, value, source) of every setting of every field: the field's own, else its group's, else the
    policy's defaults, else the built-in one.

    fields: (policy, field, group); settings: (policy, level, subject, name, value) with levels ``field``, ``group`` and
    ``defaults``, of which the last has no subject.  Unknown names are ignored, and null values don't count.
    """
    names = F.explode(F.array(*map(F.lit, BUILT_IN)))
    wanted = fields.select("policy", "field", "group", names.alias("name"))
    known = settings.where(F.col("value").isNotNull() & F.col("name").isin(*BUILT_IN))
    out = wanted
    for level, subject in (("field", "field"), ("group", "group"), ("defaults", None)):
        rows = known.where(F.col("level") == level)
        keys = ["policy", "name", *([subject] if subject else [])]
        rows = rows.withColumnRenamed("subject", subject) if subject else rows
        rows = rows.groupBy(*keys).agg(F.max("value").alias(level + "_value"))
        out = out.join(rows, keys, "left")
    built_in = F.element_at(F.create_map(*(F.lit(x) for pair in BUILT_IN.items() for x in pair)), F.col("name"))
    levels = [F.col(f"{level}_value") for level in ("field", "group", "defaults")]
    source = F.when(levels[0].isNotNull(), "field").when(levels[1].isNotNull(), "group").when(levels[2].isNotNull(), "defaults").otherwise("built_in")
    return out.select("policy", "field", "name", F.coalesce(*levels, built_in).alias("value"), source.alias("source"))
