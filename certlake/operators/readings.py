"""Readings of table cells: the safe value of a field, the score of a reading, and the best reading of each cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields by kind, the quality of each way to prepare a picture, and the weights of a score.
NUMERIC = ("yield_strength_mpa", "tensile_strength_mpa", "elongation_percentage")
ALPHANUMERIC = ("heat_number", "item_id", "grade", "weight_or_length")
VARIANTS = {
    ("alphanumeric", "alpha_scale2_stroke_preserve"): 0.92, ("alphanumeric", "alpha_scale3_line_suppressed"): 0.88,
    ("alphanumeric", "alpha_scale2_moderate_threshold"): 0.80, ("numeric", "numeric_scale2_local_threshold"): 0.90,
    ("numeric", "numeric_scale3_local_threshold"): 0.95, ("numeric", "numeric_scale3_line_suppressed"): 0.86, ("generic", "generic_scale2_otsu"): 0.75,
}
OTHER_VARIANT = 0.5
WEIGHTS = {"parsed": 0.35, "fits": 0.20, "confidence": 0.15, "quality": 0.10, "geometry": 0.10, "variant": 0.10}
# Least letters and allowed signs of codes, and the largest strength and percentage.
CODES = {"heat_number": (4, r"^[A-Z0-9\-./]+$"), "item_id": (3, r"^[A-Z0-9\-./]+$"), "grade": (3, r"^[A-Z0-9+.\-/]+$")}
LARGEST = {"yield_strength_mpa": 2000.0, "tensile_strength_mpa": 2000.0, "elongation_percentage": 100.0}


def parsed(field: Column, text: Column) -> Column:
    """The value of a reading that is safe to take, as text; null where its field's shape or range forbids it.

    Strengths are above zero, percentages may be zero; weights stay as they are, and other fields have none.
    """
    bare = F.replace(text, F.lit(" "), F.lit(""))
    number = F.trim(F.replace(text, F.lit("%"), F.lit("")))
    digits = lambda x: F.regexp_like(x, F.lit(r"^\d+(?:\.\d+)?$"))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, (least, shape) in CODES.items():
        out = out.when(field == name, F.when((F.length(bare) >= least) & F.regexp_like(bare, F.lit(shape)), bare))
    for name, most in LARGEST.items():
        t = number if name == "elongation_percentage" else F.trim(text)
        value = t.try_cast("double")
        good = digits(t) & (value <= most) & ((value >= 0) if name == "elongation_percentage" else (value > 0))
        out = out.when(field == name, F.when(good, value.cast("string")))
    return out.when(field == "weight_or_length", F.nullif(text, F.lit("")))


def _share(text: Column, allowed: str) -> Column:
    """The share of a text's signs that a pattern of one sign allows."""
    return F.length(F.regexp_replace(text, f"[^{allowed}]", "")) / F.greatest(F.length(text), F.lit(1))


def _places(x: Column) -> Column:
    """Four places, by the value that the double holds, not by its shortest text."""
    return F.floor(x * 10000 + 0.5) / 10000


def score(readings: DataFrame) -> DataFrame:
    """``readings`` with the value ``parsed``, six part scores and ``total``, each of four places.

    readings: (field, family, variant, text, confidence, consistent); the confidence is cut to 0 to 1, and none is 0.
    """
    t = F.trim(F.coalesce("text", F.lit("")))
    df = readings.withColumn("parsed", parsed(F.col("field"), F.coalesce("text", F.lit(""))))
    fits = (
        F.when(F.col("parsed").isNotNull(), 1.0).when(t == "", 0.0).when(F.col("field").isin(*NUMERIC), _share(t, r"\d.,%"))
        .when(F.col("field").isin(*ALPHANUMERIC), _share(t, r"\p{L}\p{N}\-./% ")).otherwise(0.5)
    )
    quality = F.when(t == "", 0.0).otherwise(_places(_share(t, r"\p{L}\p{N}") * 0.7 + F.least(F.lit(1.0), F.length(t) / 8.0) * 0.3))
    variant = F.lit(OTHER_VARIANT)
    for (family, name), value in VARIANTS.items():
        variant = F.when((F.col("family") == family) & (F.col("variant") == name), value).otherwise(variant)
    parts = {
        "parsed": F.col("parsed").isNotNull().cast("double"), "fits": fits, "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))),
        "quality": quality, "geometry": F.coalesce("consistent", F.lit(False)).cast("double"), "variant": variant,
    }
    df = df.withColumns({f"{name}_score": part for name, part in parts.items()})
    total = sum((F.col(f"{name}_score") * w for name, w in WEIGHTS.items()), F.lit(0.0))
    return df.withColumn("total", _places(total)).withColumns({f"{name}_score": _places(F.col(f"{name}_score")) for name in parts})


def agreement(scored: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, n_readings, n_values, agreed): how many readings and different safe values a cell has, and whether two
    readings or more agree on one value and none differs."""
    sums = scored.groupBy(*cell).agg(F.count("*").alias("n_readings"), F.count_distinct("parsed").alias("n_values"), F.count("parsed").alias("n_safe"))
    return sums.select(*cell, "n_readings", "n_values", ((F.col("n_values") == 1) & (F.col("n_safe") > 1)).alias("agreed"))


def best(scored: DataFrame, cell: list[str], order: str = "ordinal") -> DataFrame:
    """One reading for each cell: the highest total, of equal ones the first in order."""
    others = [c for c in scored.columns if c not in cell]
    top = scored.groupBy(*cell).agg(F.max_by(F.struct(*others), F.struct("total", -F.col(order))).alias("r"))
    return top.select(*cell, "r.*")
