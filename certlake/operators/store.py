"""Queries against the store: newest runs, states, upserts, set differences, manifests and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from certlake.registries import REVIEW_OUTCOMES


def newest(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The ``n`` newest rows of each key; Spark keeps only that many of a group in each task."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return df.withColumn("__n", rank).where(F.col("__n") <= n).drop("__n")


def latest_state(df: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """The last state of each job, and its number of events; combined before the shuffle."""
    return df.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias("state"), F.count("*").alias("n_events"))


def upsert(df: DataFrame, owner: str, content: str, key: str) -> DataFrame:
    """One row for each owner and content hash, with the smallest key."""
    return df.groupBy(owner, F.sha2(F.col(content).cast("binary"), 256).alias("sha")).agg(F.min(key).alias(key), F.count("*").alias("n_uploads"))


def missing_and_extra(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Keys that only one side has."""
    return expected.subtract(present).select(F.lit("missing").alias("side"), "*").unionByName(present.subtract(expected).select(F.lit("extra").alias("side"), "*"))


def page_bucket(pages: Column) -> Column:
    return F.when(pages <= 1, "single").when(pages <= 4, "short").otherwise("long")


def size_bucket(size: Column) -> Column:
    """Bytes: below 200 KB, 1, 4 and 12 MB, and larger."""
    kb = 1024
    return F.when(size < 200 * kb, "xs").when(size < kb**2, "s").when(size < 4 * kb**2, "m").when(size < 12 * kb**2, "l").otherwise("xl")


def manifest(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Documents (doc_id, source, pages, bytes) with their buckets and what was found of them; documents without
    findings stay."""
    out = documents.join(found, "doc_id", "left")
    return out.select("doc_id", "source", page_bucket(F.col("pages")).alias("page_bucket"), size_bucket(F.col("bytes")).alias("size_bucket"), "quality")


def nearest_rank(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """(by, n, value): the value at index round-half-even(q * (n - 1)) of each group's sorted values.

    Counts of distinct values are summed in order, so that a group of any number of rows is never collected.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*by).orderBy(value)
    summed = counts.withColumn("upto", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    at = F.bround(F.lit(q) * (F.col("n") - 1)).cast("long")
    return summed.where(F.col("upto") > at).groupBy(*by).agg(F.max("n").alias("n"), F.min(value).alias("value"))


def review_decisions(rows: DataFrame, least: int = 80, share: int = 35) -> DataFrame:
    """(doc_id, decision): blocked by an outcome, by confidence, by too many doubtful rows, or accepted."""
    percent = F.round(F.col("confidence") * 100).cast("long")
    docs = rows.groupBy("doc_id").agg(
        F.bool_or((F.col("outcome") == "NON_COMPLIANT") | F.col("outcome").isin(*REVIEW_OUTCOMES)).alias("blocked"),
        F.min(percent).alias("least"), F.count_if(percent <= 82).alias("doubtful"), F.count("*").alias("n"),
    )
    decision = F.when(F.col("blocked"), "review_blocking").when(F.col("least") < least, "review_confidence").when((F.col("n") >= 2) & (F.col("doubtful") * 100 >= F.col("n") * share), "review_suspicious").otherwise("auto_accept")
    return docs.select("doc_id", decision.alias("decision"))


# The route of each quality class, and what runs on it.
ROUTES = {
    "digital_clean": ("path_a_digital_pdf", "native_multimodal"),
    "scan_clean": ("path_b_clean_scan", "rendered_multimodal"),
    "noisy_scan": ("path_c_noisy_scan", "preprocessed_multimodal"),
    "severe_scan": ("path_d_severe_scan", "preprocessed_multimodal"),
}


def route(profiles: DataFrame) -> DataFrame:
    """Adds quality_class, route, runtime_route and review_first from blur, noise, text_density, has_text,
    noisy_ocr and full_page_raster."""
    blur, noise = F.col("blur"), F.col("noise")
    dense, corrupt, raster = F.col("has_text") & (F.col("text_density") >= 0.02), F.col("noisy_ocr"), F.col("full_page_raster")
    blurry, noisy, sparse = blur < 80, noise >= 25, F.col("text_density") < 0.02
    quality = (
        F.when(corrupt & raster, "noisy_scan")
        .when(dense & ~blurry & ~noisy, F.when(corrupt | raster, "noisy_scan").otherwise("digital_clean"))
        .when(blurry & noisy, F.when((blur < 25) | (noise >= 45), "severe_scan").otherwise("noisy_scan"))
        .when(blurry, F.when((blur < 25) & sparse, "severe_scan").otherwise("noisy_scan"))
        .when(noisy, F.when((noise >= 45) & sparse, "severe_scan").otherwise("noisy_scan"))
        .when((blur < 150) & (noise >= 14), "noisy_scan")
        .when(dense, "noisy_scan")
        .otherwise("scan_clean")
    )
    of = lambda i: F.element_at(F.create_map(*(F.lit(x) for c, r in ROUTES.items() for x in (c, r[i]))), F.col("quality_class"))
    out = profiles.withColumn("quality_class", quality).withColumn("route", of(0)).withColumn("runtime_route", of(1))
    return out.withColumn("review_first", F.col("quality_class") == "severe_scan")


def trace(rows: DataFrame, documents: DataFrame, row_only: list[str], shared: list[str], least: int = 80) -> tuple[DataFrame, DataFrame]:
    """(rows, documents) with their traceability, from identifier columns and their confidences (``<name>_pct``).

    An identifier is verified if it is present with a confidence of ``least``.  A row's ``shared`` identifier that
    isn't takes the document's.  A row with any verified identifier is VERIFIED; otherwise its identifiers are
    withheld, and an outcome of COMPLIANT becomes NEEDS_REVIEW.  A document's ``row_only`` identifier is that of
    its rows, if all have it verified and alike.  A compliant document without a verified identifier needs review.
    """
    sure = lambda name: F.coalesce((F.trim(name) != "") & (F.col(f"{name}_pct") >= least), F.lit(False))
    heads = documents.select("doc_id", *(F.when(sure(n), F.col(n)).alias(f"__{n}") for n in shared), *(F.when(sure(n), F.col(f"{n}_pct")).alias(f"__{n}_pct") for n in shared))
    out = rows.join(heads, "doc_id", "left")
    for n in (*row_only, *shared):
        value, pct = F.when(sure(n), F.col(n)), F.when(sure(n), F.col(f"{n}_pct"))
        if n in shared:
            value, pct = F.coalesce(value, F.col(f"__{n}")), F.when(sure(n), F.col(f"{n}_pct")).otherwise(F.col(f"__{n}_pct"))
        out = out.withColumn(f"__v_{n}", value).withColumn(f"__p_{n}", pct)
    names = [*row_only, *shared]
    verified = F.coalesce(*(F.col(f"__v_{n}") for n in names)).isNotNull()
    out = out.withColumn("status", F.when(verified, "VERIFIED").otherwise("UNVERIFIED"))
    least_of = F.array_min(F.array_compact(F.array(*(F.col(f"__p_{n}") for n in names))))
    out = out.withColumn("traceability_pct", F.coalesce(least_of, F.lit(0)).cast("long")).withColumn("downgraded", (F.col("outcome") == "COMPLIANT") & ~verified)
    out = out.withColumn("outcome", F.when(F.col("downgraded"), "NEEDS_REVIEW").otherwise(F.col("outcome")))
    firm = [F.when(F.bool_and(F.col(f"__v_{n}").isNotNull()) & (F.min(f"__v_{n}") == F.max(f"__v_{n}")), F.min(f"__v_{n}")).alias(n) for n in row_only]
    sums = out.groupBy("doc_id").agg(
        *firm,
        *(F.min(f"__p_{n}").alias(f"__p_{n}") for n in row_only),
        F.count_if(F.col("downgraded")).alias("n_downgraded"),
        F.bool_or(F.col("outcome") == "NON_COMPLIANT").alias("__bad"),
        F.bool_or(F.col("outcome").isin(*REVIEW_OUTCOMES)).alias("__open"),
        F.bool_or(F.col("outcome") == "COMPLIANT").alias("__good"),
    )
    docs = sums.join(heads, "doc_id", "left")
    known = F.coalesce(*(F.col(n) for n in row_only), *(F.col(f"__{n}") for n in shared)).isNotNull()
    scores = F.array_compact(F.array(*(F.when(F.col(n).isNotNull(), F.col(f"__p_{n}")) for n in row_only), *(F.col(f"__{n}_pct") for n in shared)))
    rolled = F.when(F.col("__bad"), "NON_COMPLIANT").when(F.col("__open"), "NEEDS_REVIEW").when(F.col("__good"), F.when(known, "COMPLIANT").otherwise("NEEDS_REVIEW")).otherwise("NOT_VALIDATED")
    docs = docs.select(
        "doc_id", F.when(known, "VERIFIED").otherwise("UNVERIFIED").alias("status"), *row_only, F.coalesce(F.array_min(scores), F.lit(0)).cast("long").alias("traceability_pct"), rolled.alias("outcome"), "n_downgraded",
    )
    cells = [F.col(f"__v_{n}").alias(n) for n in names]
    return out.select(*(c for c in rows.columns if c not in (*names, *(f"{n}_pct" for n in names), "outcome")), *cells, "status", "traceability_pct", "outcome", "downgraded"), docs
