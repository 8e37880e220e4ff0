"""Raw payloads of model calls: parsed once as variants, and projected to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys around an extraction that are no part of it, and the confidence below which a property is dropped.
META_KEYS = ("preprocessing_meta", "source_filename")
LEAST_CONFIDENCE = 0.8
PROPERTIES = ("yield_strength_mpa", "tensile_strength_mpa", "elongation_percentage")
TEXTS = ("item_id", "heat_number", "batch_number", "lot_number", "product_name", "grade", "weight_or_length", "dimensions")
NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def _at(value: Column, path: str) -> Column:
    """A part of a variant; null only where the key is missing."""
    return F.try_variant_get(value, f"$.{path}", "variant")


def _is_number(value: Column) -> Column:
    return F.coalesce(F.regexp_like(F.schema_of_variant(value), F.lit(NUMBER)), F.lit(False))


def field_confidence(item: Column, field: str) -> Column:
    """A missing confidence is 1; null, and whatever isn't a number, is 0."""
    held = _at(item, f"field_confidence.{field}")
    return F.when(held.isNull(), 1.0).when(_is_number(held), F.try_variant_get(held, "$", "double")).otherwise(0.0)


def without_meta(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """``payloads`` with ``extraction``, a map of the payload's keys but for those around it, and ``meta``, its
    preprocessing notes where these are an object.  Texts that are no JSON object have neither."""
    whole = F.try_parse_json(column)
    is_object = F.coalesce(F.schema_of_variant(whole).startswith("OBJECT"), F.lit(False))
    keys = F.when(is_object, whole).cast("map<string,variant>")
    meta = _at(whole, "preprocessing_meta")
    kept = F.map_filter(keys, lambda k, v: ~k.isin(*META_KEYS))
    return payloads.withColumn("extraction", kept).withColumn("meta", F.when(F.coalesce(F.schema_of_variant(meta).startswith("OBJECT"), F.lit(False)), meta))


def rows(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(key columns, row_index, texts, properties, row_confidence, needs_review, source_page): a row for each item.

    A property of which the confidence is too low is null.  A row's confidence counts from 0 to 1; pages are whole
    numbers from 1.  The payload is parsed once, and so is each item.
    """
    keys = [c for c in payloads.columns if c != column]
    items = F.try_variant_get(F.try_parse_json(column), "$.items", "array<variant>")
    each = payloads.select(*keys, F.posexplode(items).alias("row_index", "item"))
    item, gated = F.col("item"), {}
    for name in PROPERTIES:
        value = F.try_variant_get(item, f"$.mechanical_properties.{name}", "double")
        gated[name] = F.when(field_confidence(item, name) >= LEAST_CONFIDENCE, value)
    held = _at(item, "row_confidence")
    sure = F.when(_is_number(held), F.try_variant_get(held, "$", "double"))
    page = F.try_variant_get(item, "$.source_page", "int")
    return each.select(
        *keys, "row_index", *(F.nullif(F.trim(F.try_variant_get(item, f"$.{f}", "string")), F.lit("")).alias(f) for f in TEXTS),
        *(v.alias(f) for f, v in gated.items()), F.when(sure.between(0.0, 1.0), sure).alias("row_confidence"),
        F.coalesce(F.try_variant_get(item, "$.needs_review", "boolean"), F.lit(False)).alias("needs_review"), F.when(page >= 1, page).alias("source_page"),
    )
