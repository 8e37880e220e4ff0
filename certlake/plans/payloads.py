"""Queries of cell readings and raw payloads, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certlake.operators import payload, readings
from certlake.plans.registry import query
from certlake.plans.views import LINES, exploded, pick, union_sql, view

FIELDS = (*readings.NUMERIC, *readings.ALPHANUMERIC, "remark")
TEXTS = ("A1 12", "S355J2", "355", "355.5 ", "12%", "101", "0", "3O5", "", None, "H-12/3", "12 kg", "x", "1.2.3", "Ä Ö?")
READING_ROWS = f"SELECT doc_id, row_index, {pick('p', FIELDS)} AS field, p, s, q FROM ({LINES}) AS x"
KEYS = ["doc_id", "row_index", "field"]
WAYS = (("alphanumeric", "alpha_scale2_stroke_preserve"), ("numeric", "numeric_scale3_local_threshold"), ("generic", "other"), ("numeric", "numeric_scale2_local_threshold"))
READING_VARIANTS = [
    {
        "ordinal": str(k), "family": f"'{family}'", "variant": f"'{name}'", "text": pick(f"x.s * 3 + x.q + {k * 4}", TEXTS), "consistent": f"(x.q + {k}) % 3 > 0",
        "confidence": f"CASE WHEN (x.p + {k}) % 5 = 0 THEN NULL ELSE cast((x.s * 7 + {k}) % 120 AS double) / 100 END",
    }
    for k, (family, name) in enumerate(WAYS)
]
BARE, NUMBER = "replace(coalesce(text, ''), ' ', '')", "trim(replace(coalesce(text, ''), '%', ''))"
SIGNS = "length(regexp_replace(t, '[^{0}]', '', 'g')) / cast(greatest(length(t), 1) AS double)"
SAFE = f"""CASE field WHEN 'heat_number' THEN CASE WHEN length({BARE}) >= 4 AND regexp_matches({BARE}, '^[A-Z0-9./-]+$') THEN {BARE} END
  WHEN 'item_id' THEN CASE WHEN length({BARE}) >= 3 AND regexp_matches({BARE}, '^[A-Z0-9./-]+$') THEN {BARE} END
  WHEN 'grade' THEN CASE WHEN length({BARE}) >= 3 AND regexp_matches({BARE}, '^[A-Z0-9+./-]+$') THEN {BARE} END
  WHEN 'elongation_percentage' THEN CASE WHEN regexp_matches({NUMBER}, '^[0-9]+([.][0-9]+)?$') AND try_cast({NUMBER} AS double) <= 100 THEN cast(try_cast({NUMBER} AS double) AS varchar) END
  WHEN 'weight_or_length' THEN nullif(text, '') WHEN 'remark' THEN NULL
  ELSE CASE WHEN regexp_matches(trim(text), '^[0-9]+([.][0-9]+)?$') AND try_cast(trim(text) AS double) > 0 AND try_cast(trim(text) AS double) <= 2000 THEN cast(try_cast(trim(text) AS double) AS varchar) END END"""
WAY = "CASE " + " ".join(f"WHEN family = '{f}' AND variant = '{n}' THEN {v}" for (f, n), v in readings.VARIANTS.items()) + f" ELSE {readings.OTHER_VARIANT} END"
SCORED = f"""r AS (SELECT *, trim(coalesce(text, '')) AS t, {SAFE} AS parsed FROM ({union_sql(f'({READING_ROWS})', KEYS, READING_VARIANTS)})),
f AS (SELECT *, CASE WHEN parsed IS NOT NULL THEN 1.0 WHEN t = '' THEN 0.0 WHEN field IN {readings.NUMERIC} THEN {SIGNS.format('0-9.,%')} WHEN field IN {readings.ALPHANUMERIC} THEN {SIGNS.format(chr(92) + 'p{L}' + chr(92) + 'p{N}./% -')} ELSE 0.5 END AS fits,
  CASE WHEN t = '' THEN 0.0 ELSE floor(({SIGNS.format(chr(92) + 'p{L}' + chr(92) + 'p{N}')} * 0.7 + least(1.0, length(t) / cast(8 AS double)) * 0.3) * 10000 + 0.5) / 10000 END AS quality, greatest(0.0, least(1.0, coalesce(confidence, 0.0))) AS sure FROM r),
s AS (SELECT *, floor((cast(0 AS double) + cast(CASE WHEN parsed IS NOT NULL THEN 1 ELSE 0 END AS double) * cast(0.35 AS double) + cast(fits AS double) * cast(0.2 AS double) + cast(sure AS double) * cast(0.15 AS double) + cast(quality AS double) * cast(0.1 AS double) + cast(CASE WHEN consistent THEN 1 ELSE 0 END AS double) * cast(0.1 AS double) + cast({WAY} AS double) * cast(0.1 AS double)) * 10000 + 0.5) / 10000 AS total FROM f),
b AS (SELECT doc_id, row_index, field, arg_max({{'ordinal': ordinal, 'variant': variant, 'parsed': parsed, 'total': total}}, (total, -ordinal)) AS v, count(*) AS n_readings, count(DISTINCT parsed) AS n_values, count(DISTINCT parsed) = 1 AND count(parsed) > 1 AS agreed FROM s GROUP BY ALL)"""


@query(f"WITH {SCORED} SELECT doc_id, row_index, field, cast(v.ordinal AS int) AS ordinal, v.variant AS variant, v.parsed AS parsed, cast(round(v.total * 10000) AS bigint) AS total, n_readings, n_values, agreed FROM b")
def best_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of four readings of every cell, and whether readings agree."""
    scored = readings.score(exploded(view(spark, sf_dir, READING_ROWS), KEYS, READING_VARIANTS))
    top = readings.best(scored, KEYS).select(*KEYS, F.col("ordinal").cast("int").alias("ordinal"), "variant", "parsed", F.round(F.col("total") * 10000).cast("long").alias("total"))
    return top.join(readings.agreement(scored, KEYS), KEYS)


NUMBERS = ('0.9', '0.79', 'null', '"0.9"', 'true', '1')
ITEM_SQL = f"""'{{"item_id": "' || cast(p AS string) || '", "grade": ' || {pick('s', ('"S355J2"', 'null', '" "', '"SG2 "'))} || ', "mechanical_properties": {{"yield_strength_mpa": ' || cast(200 + s AS string) || ', "tensile_strength_mpa": ' || {pick('p', ('null', '510.5', '480'))}
  || ', "elongation_percentage": ' || cast(q AS string) || '}}' || {pick('q', ('', ', "field_confidence": null'))} || CASE WHEN q % 2 = 0 THEN ', "field_confidence": {{"yield_strength_mpa": ' || {pick('s', NUMBERS)} || {pick('p', ('', ', "elongation_percentage": 0.5', ', "tensile_strength_mpa": 0.8'))} || '}}' ELSE '' END
  || ', "row_confidence": ' || {pick('p + s', ('0.5', '1.5', 'null', '"x"', '1', '0'))} || ', "needs_review": ' || {pick('q', ('true', 'false', 'null'))} || ', "source_page": ' || {pick('l', ('1', '0', 'null', '12'))} || '}}'""".replace("{{", "{").replace("}}", "}")
PAYLOADS = f"""SELECT doc_id, row_index AS call, '{{"items": [' || {ITEM_SQL} || ', {{}}], "preprocessing_meta": ' || {pick('p', ('{"pages": 2}', 'null', '[1]'))} || ', "source_filename": "a.pdf"' || {pick('s', ('', ', "supplier_name": "X"', ', "supplier_name": null'))} || '}}' AS payload FROM ({LINES}) AS x""".replace("{{", "{").replace("}}", "}")
NUMERIC_TYPE = "json_type(i, '{0}') IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')"


def _property(name: str) -> str:
    at = f"$.field_confidence.{name}"
    sure = f"CASE WHEN json_type(i, '{at}') IS NULL THEN 1.0 WHEN {NUMERIC_TYPE.format(at)} THEN cast(json_extract_string(i, '{at}') AS double) ELSE 0.0 END"
    return f"CASE WHEN {sure} >= {payload.LEAST_CONFIDENCE} THEN try_cast(json_extract_string(i, '$.mechanical_properties.{name}') AS double) END AS {name}"


@query(f"""WITH e AS (SELECT doc_id, call, unnest(from_json(json_extract(payload, '$.items'), '["json"]')) AS i, generate_subscripts(from_json(json_extract(payload, '$.items'), '["json"]'), 1) AS k FROM ({PAYLOADS})),
r AS (SELECT doc_id, call, cast(k - 1 AS int) AS row_index, nullif(trim(json_extract_string(i, '$.item_id')), '') AS item_id, nullif(trim(json_extract_string(i, '$.grade')), '') AS grade, {', '.join(map(_property, payload.PROPERTIES))},
  CASE WHEN {NUMERIC_TYPE.format('$.row_confidence')} THEN cast(json_extract_string(i, '$.row_confidence') AS double) END AS rc, coalesce(cast(json_extract_string(i, '$.needs_review') AS boolean), false) AS needs_review, try_cast(json_extract_string(i, '$.source_page') AS int) AS sp FROM e)
SELECT doc_id, call, row_index, item_id, grade, {', '.join(payload.PROPERTIES)}, CASE WHEN rc BETWEEN 0 AND 1 THEN rc END AS row_confidence, needs_review, CASE WHEN sp >= 1 THEN sp END AS source_page FROM r""")
def payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of raw payloads, with properties of low confidence dropped."""
    found = payload.rows(view(spark, sf_dir, PAYLOADS))
    return found.select("doc_id", "call", "row_index", "item_id", "grade", *payload.PROPERTIES, "row_confidence", "needs_review", "source_page")


@query(f"""SELECT doc_id, call, array_to_string(list_sort(list_filter(json_keys(payload), lambda k: k NOT IN {payload.META_KEYS})), '|') AS keys, CASE WHEN json_type(payload, '$.preprocessing_meta') = 'OBJECT' THEN cast(json_extract_string(payload, '$.preprocessing_meta.pages') AS int) END AS pages FROM ({PAYLOADS})""")
def payload_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of payloads without the keys around the extraction, and their preprocessing notes."""
    done = payload.without_meta(view(spark, sf_dir, PAYLOADS))
    return done.select("doc_id", "call", F.array_join(F.array_sort(F.map_keys("extraction")), "|").alias("keys"), F.try_variant_get("meta", "$.pages", "int").alias("pages"))
