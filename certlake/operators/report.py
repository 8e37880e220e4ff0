"""The evaluation report: fields of gold and predictions in one shape, compared, counted by document, field and run.

A field is (doc_id, field, values), values an array of texts; a missing field has no row or no values.  Gold and
predictions are joined once, on (doc_id, field), and all counts are aggregates over that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certlake.functions.text import is_missing, plain

# Compared fields, those that are critical, those for tracing, and those about decisions.
TARGETS = (
    "supplier_name", "document_type", "certificate_date", "item_id", "heat_number", "grade", "weight_or_length", "yield_strength_mpa",
    "tensile_strength_mpa", "elongation_percentage", "compliance_outcome", "review_required", "review_reasons",
)
CRITICAL = ("heat_number", "grade", "yield_strength_mpa", "tensile_strength_mpa", "elongation_percentage", "compliance_outcome", "review_required")
TRACING = ("heat_number", "batch_number", "lot_number", "cast_number")
DECISIONS = ("review_required", "review_reasons", "processing_decision", "compliance_outcome")
TRUE_WORDS = ("true", "yes", "y", "1", "review", "needs_review", "manual_review")
FALSE_WORDS = ("false", "no", "n", "0", "auto_accept", "accepted", "pass")
TOLERANCE = 1.0


def flag(value: Column, true: tuple[str, ...] = TRUE_WORDS, false: tuple[str, ...] = FALSE_WORDS) -> Column:
    """True, false, or null for other words."""
    return F.when(plain(value).isin(*true), True).when(plain(value).isin(*false), False)


def verified(status: Column) -> Column:
    """Gold without a status counts as verified; candidates never do."""
    return F.coalesce(F.nullif(plain(status), F.lit("")), F.lit("verified")) == "verified"


def parts(value: Column) -> Column:
    """The values of a text, which ``|`` parts; null for a missing one."""
    return F.when(~is_missing(value), F.transform(F.split(value, r"\|"), lambda x: F.trim(x)))


def flatten_fields(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, field, values) of documents and their item rows.

    A field that both sides can have is taken from the document's plural column, then from its own column, then
    from the items in row order.  A missing processing decision follows from the review flag.
    """
    listed = [c for c in items.columns if c not in ("doc_id", "row_index")]
    own = [c for c in documents.columns if c != "doc_id" and not (c.endswith("s") and c[:-1] in listed)]
    if "processing_decision" in own and "review_required" in own:
        follows = F.when(flag(F.col("review_required")), "needs_review").when(~is_missing(F.col("review_required")), "auto_accept")
        documents = documents.withColumn("processing_decision", F.when(is_missing(F.col("processing_decision")), follows).otherwise(F.col("processing_decision")))
    plural = lambda c: parts(F.col(f"{c}s")) if f"{c}s" in documents.columns else F.lit(None).cast("array<string>")
    heads = [F.struct(F.lit(c).alias("field"), F.coalesce(plural(c), parts(F.col(c))).alias("values")) for c in own]
    heads += [F.struct(F.lit(c).alias("field"), plural(c).alias("values")) for c in listed if c not in own and f"{c}s" in documents.columns]
    from_head = documents.select("doc_id", F.explode(F.array(*heads)).alias("f")).select("doc_id", "f.*").where("values IS NOT NULL")
    cell = F.struct(F.col("row_index"), F.trim("value").alias("v"))
    texts = items.select("doc_id", "row_index", *(F.col(c).cast("string").alias(c) for c in listed))
    long = texts.unpivot(["doc_id", "row_index"], listed, "field", "value").where(~is_missing(F.col("value")))
    from_items = long.groupBy("doc_id", "field").agg(F.transform(F.array_sort(F.collect_list(cell)), lambda s: s["v"]).alias("items"))
    joined = from_head.join(from_items, ["doc_id", "field"], "full")
    return joined.select("doc_id", "field", F.coalesce("values", "items").alias("values"))


def equal_values(gold: Column, pred: Column, tolerance: float = TOLERANCE) -> Column:
    """As many values on both sides; sorted numbers within the tolerance if all are numbers, else equal texts in any order."""
    numbers = [F.array_sort(F.transform(v, lambda x: x.try_cast("double"))) for v in (gold, pred)]
    numeric = F.forall(numbers[0], lambda x: x.isNotNull()) & F.forall(numbers[1], lambda x: x.isNotNull())
    near = F.forall(F.zip_with(*numbers, lambda a, b: F.abs(a - b) <= tolerance), lambda x: x)
    words = [F.array_sort(F.filter(F.transform(v, plain), lambda x: x != "")) for v in (gold, pred)]
    return F.coalesce((F.size(gold) == F.size(pred)) & F.when(numeric, near).otherwise(words[0] == words[1]), F.lit(False))


def compare(documents: DataFrame, gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """A row for each document and field that either side has: has_gold, correct, pred_missing, reason.

    documents: (doc_id, verified_gold, prediction_missing).  Gold of documents that aren't verified counts for
    nothing; ``reason`` says why a field of gold isn't correct, and is null otherwise.
    """
    both = gold.withColumnRenamed("values", "gold").join(predictions.withColumnRenamed("values", "pred"), ["doc_id", "field"], "full").join(documents, "doc_id")
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    rows = both.withColumn("has_gold", F.col("verified_gold") & some("gold")).withColumn("pred_missing", F.col("prediction_missing") | ~some("pred"))
    rows = rows.withColumn("correct", F.when(F.col("has_gold"), ~F.col("pred_missing") & equal_values(F.col("gold"), F.col("pred"))))
    review = (F.col("field") == "review_required") & ~flag(F.get("gold", F.lit(0))) & flag(F.get("pred", F.lit(0)))
    reason = F.when(F.coalesce(review, F.lit(False)), "fail_closed_review").when(F.col("prediction_missing"), "missing_prediction_file").when(F.col("pred_missing"), "missing_field")
    return rows.withColumn("reason", F.when(F.col("has_gold") & ~F.col("correct"), reason.otherwise("mismatch")))


def document_counts(fields: DataFrame) -> DataFrame:
    """The hits and totals of each document over the rows of ``compare``."""
    hit, gold = F.coalesce("correct", F.lit(False)), F.col("has_gold")
    of = lambda names: gold & F.col("field").isin(*names)
    cells = []
    for name, names in {"field": TARGETS, "critical": CRITICAL, "tracing": TRACING, "type": ("document_type",), "decision": ("processing_decision",)}.items():
        cells += [F.count_if(of(names) & hit).alias(f"{name}_hits"), F.count_if(of(names)).alias(f"{name}_total")]
    missed = of(TARGETS) & ~hit & ~F.col("field").isin(*DECISIONS)
    review = lambda side: F.max(F.when(F.col("field") == "review_required", flag(F.get(side, F.lit(0)))))
    counted = fields.groupBy("doc_id").agg(
        *cells, F.count_if(missed).alias("extraction_misses"), F.count_if(of(CRITICAL) & F.col("pred_missing")).alias("missing_required"),
        F.max(F.when(F.col("has_gold") & (F.col("field") == "review_required"), flag(F.get("gold", F.lit(0))))).alias("gold_review"),
        review("pred").alias("review"),
    )
    unsafe, closed = F.col("gold_review") & ~F.col("review"), ~F.col("gold_review") & F.col("review")
    return counted.withColumn("unsafe", F.coalesce(unsafe, F.lit(False)).cast("long")).withColumn("fail_closed", F.coalesce(closed, F.lit(False)).cast("long"))


def field_metrics(fields: DataFrame) -> DataFrame:
    """(field, samples, correct, accuracy, missing_predictions) over verified gold."""
    rows = fields.where("has_gold").where(F.col("field").isin(*TARGETS))
    hits, n = F.count_if("correct"), F.count("*")
    return rows.groupBy("field").agg(n.alias("samples"), hits.alias("correct"), F.round(hits / n, 4).alias("accuracy"), F.count_if("pred_missing").alias("missing_predictions"))


def failure_examples(fields: DataFrame, first: int = 5) -> DataFrame:
    """The first failures of each reason, by document and field."""
    place = F.row_number().over(Window.partitionBy("reason").orderBy("doc_id", "field"))
    return fields.where("reason IS NOT NULL").withColumn("place", place).where(F.col("place") <= first).select("reason", "place", "doc_id", "field")


def run_metrics(documents: DataFrame, by: list[str]) -> DataFrame:
    """Accuracies, review rate and straight-through rate, mean latency and completeness of runs.

    documents: hits and totals, compliance_correct, review, latency_ms and completeness; nulls leave a mean.
    """
    share = lambda hits, total: F.round(F.sum(hits) / F.greatest(F.sum(total), F.lit(1)), 4)
    rate = lambda c: F.coalesce(F.count_if(c) / F.nullif(F.count(c), F.lit(0)), F.lit(0.0))
    review = rate(F.col("review"))
    return documents.groupBy(*by).agg(
        F.count("*").alias("n"), share("field_hits", "field_total").alias("field_accuracy"), share("critical_hits", "critical_total").alias("critical_accuracy"),
        F.round(rate(F.col("compliance_correct")), 4).alias("compliance_accuracy"), F.round(review, 4).alias("review_rate"), F.round(1 - review, 4).alias("straight_through_rate"),
        F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 1).alias("mean_latency_ms"), F.round(F.coalesce(F.avg("completeness"), F.lit(0.0)), 4).alias("completeness"),
    )
