"""Page and document profiles: scores, conditions, variants, budgets and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Page variants that a condition selects, and the order of preference for the primary one.
SELECTED = {
    "clean": ("full_gray", "contrast"),
    "noisy": ("denoised", "adaptive_binary", "contrast"),
    "blurry": ("sharpened", "contrast"),
    "noisy_and_blurry": ("denoised", "adaptive_binary", "contrast", "sharpened"),
}
SUPPORT, FALLBACK = ("adaptive_binary", "full_gray"), ("contrast", "full_gray", "denoised", "adaptive_binary", "sharpened")
PRIMARY = {
    "clean": ("contrast", "full_gray", "denoised", "adaptive_binary", "sharpened"),
    "noisy": ("denoised", "adaptive_binary", "contrast", "full_gray", "sharpened"),
    "blurry": ("sharpened", "contrast", "denoised", "full_gray", "adaptive_binary"),
    "noisy_and_blurry": ("sharpened", "contrast", "denoised", "full_gray", "adaptive_binary"),
}


def page_score(index: Column, has_table: Column, blur: Column, variants: Column) -> Column:
    """First page 100, table 80, sharpness up to 20, 10 for variants, two off for each page before."""
    return F.when(index == 0, 100).otherwise(0) + F.when(has_table, 80).otherwise(0) + F.least(blur / 10, F.lit(20.0)) + F.when(variants > 0, 10).otherwise(0) - 2 * index


def blur_severity(blur: Column) -> Column:
    return F.when(blur < 80, "high").when(blur < 150, "moderate").otherwise("low")


def noise_severity(noise: Column) -> Column:
    return F.when(noise >= 25, "high").when(noise >= 14, "moderate").otherwise("low")


def condition(blur: Column, noise: Column) -> Column:
    """Of high severities first, then of moderate ones; on one level noise and blur together are both."""
    out, b, n = F.when(F.lit(False), ""), blur_severity(blur), noise_severity(noise)
    for level in ("high", "moderate"):
        out = out.when((b == level) & (n == level), "noisy_and_blurry").when(n == level, "noisy").when(b == level, "blurry")
    return out.otherwise("clean")


def _by_state(lists: dict[str, tuple[str, ...]], state: Column) -> Column:
    return F.element_at(F.create_map(*(x for c, v in lists.items() for x in (F.lit(c), F.array(*map(F.lit, v))))), state)


def selected_variants(state: Column, available: Column, table_crop: Column) -> Column:
    """The available variants that a condition selects, the table crop where there is one, and support variants."""
    crop = F.when(table_crop, F.array(F.lit("table_crop"))).otherwise(F.array().cast("array<string>"))
    chosen = F.array_intersect(F.concat(_by_state(SELECTED, state), crop, F.array(*map(F.lit, SUPPORT))), available)
    return F.when(F.size(chosen) > 0, chosen).otherwise(F.array_intersect(F.array(*map(F.lit, FALLBACK)), available))


def primary_variant(state: Column, selected: Column) -> Column:
    """The first variant of the condition's preference that is selected."""
    return F.get(F.array_intersect(_by_state(PRIMARY, state), selected), F.lit(0))


def request_bytes(size: Column, prefix: int = 22) -> Column:
    """Bytes of a block once it is encoded as base64 with its prefix and envelope."""
    return F.floor((size * 4 + 2) / 3) + prefix + 160


def spend_usd_millionths(tokens_in: Column, tokens_out: Column, in_per_million: float = 0.16, out_per_million: float = 0.48) -> Column:
    """Spend at list prices, in whole millionths of a dollar."""
    return F.round(tokens_in * in_per_million + tokens_out * out_per_million).cast("long")


def worst_pages(pages: DataFrame, first: int = 2) -> DataFrame:
    """(doc_id, blur, noise, table): the worst of a document's first pages."""
    return pages.where(F.col("page") < first).groupBy("doc_id").agg(F.min("blur").alias("blur"), F.max("noise").alias("noise"), F.bool_or("has_table").alias("has_table"))


def dominant(pages: DataFrame, column: str, order: tuple[str, ...]) -> DataFrame:
    """(doc_id, value): the commonest value; on a tie the first of a fixed order."""
    counts = pages.groupBy("doc_id", column).agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return counts.groupBy("doc_id").agg(F.max_by(F.col(column), F.struct("n", -place)).alias(column))


def identifier_gate(value: Column, confidence: Column, degraded: Column, least: float = 0.8) -> Column:
    """struct<value, event>: an identifier of low confidence is withheld; on degraded scans also one without."""
    event = F.when(confidence < least, "low_confidence").when(confidence.isNull() & degraded, "missing_confidence")
    present = F.coalesce(F.trim(value) != "", F.lit(False))
    return F.struct(F.when(event.isNull(), value).alias("value"), F.when(present, event).alias("event"))


def suspicious_share(rows: DataFrame, share: int = 35, least: int = 2) -> DataFrame:
    """(doc_id, n_rows, n_suspicious, token): documents with too many doubtful rows get a review token."""
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("needs_review")).alias("n_suspicious"))
    return counts.withColumn("token", F.when((F.col("n_rows") >= least) & (F.col("n_suspicious") * 100 >= F.col("n_rows") * share), "suspicious_rows"))
