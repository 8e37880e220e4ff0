"""The gate of critical identifiers: which candidates of a payload are sure enough to stay.

A field's confidence is the first that is given of its entry in ``field_confidence``, its own ``<field>_confidence``, and
the row's.  Candidates that are ambiguous, of low confidence, or without one on a degraded scan are withheld: the field
and all its other spellings become null, and an event keeps what was there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certlake.functions.numeric import let

# Other spellings of identifier fields, scans on which a confidence must be given, and the least one.
ALIASES = {
    "heat_number": ("heat_number", "heat_no", "heat no", "heat"),
    "batch_number": ("batch_number", "batch_no", "batch n", "batch n°", "batch"),
    "lot_number": ("lot_number", "lot_no", "lot", "lotto", "n lotto"),
    "colata_number": ("colata_number", "colata", "colata/batch", "n colata", "colata n°"),
    "cast_number": ("cast_number", "cast_no", "cast"),
    "charge_number": ("charge_number", "charge_no", "charge"),
    "coil_number": ("coil_number", "coil_no", "coil"),
    "item_id": ("item_id", "pipe_id", "pipe_coil_id"),
    "pipe_id": ("pipe_id", "item_id", "pipe_coil_id"),
    "certificate_number": ("certificate_number", "certificate_no", "cert_number", "cert_no", "certificate", "cert", "certificato"),
    "order_number": ("order_number", "order_no", "purchase_order", "po_number", "po_no", "po", "order", "ordine"),
}
DEGRADED = ("noisy_scan", "degraded_scan", "severe_scan")
ILLEGIBLE = "low_identifier_legibility"
LEAST = 0.8
AMBIGUOUS, LOW, MISSING = "visual_ambiguity", "low_identifier_confidence", "missing_identifier_confidence"


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def candidate(payload: Column, field: str) -> Column:
    """The value of the first spelling of a field that a payload has, be it null."""
    there = F.filter(_strings(ALIASES.get(field, (field,))), lambda k: F.map_contains_key(payload, k))
    return F.element_at(payload, F.get(there, F.lit(0)))


def confidence_of(field: str) -> Column:
    """struct<value, source>: a field's confidence within 0 to 1, and where it was given; null if nowhere."""
    given = [(F.element_at("field_confidence", F.lit(field)), "field_confidence"), (F.element_at("direct_confidence", F.lit(field)), f"{field}_confidence"), (F.col("row_confidence"), "row_confidence")]
    held = lambda v: F.greatest(F.lit(0.0), F.least(v, F.lit(1.0)))
    return F.coalesce(*(F.when(v.isNotNull(), F.struct(held(v).alias("value"), F.lit(source).alias("source"))) for v, source in given))


def issue(field: str, confidence: Column, needed: Column) -> Column:
    """Why a field's candidate is withheld; null where it stays."""
    reasons = F.transform(F.coalesce("review_reasons", F.array().cast("array<string>")), F.lower)

    def tells(exact: tuple[str, ...], words: str) -> Column:
        return F.exists(reasons, lambda r: F.coalesce(r.isin(*exact) | (F.contains(r, F.lit(field)) & F.regexp_like(r, F.lit(words))), F.lit(False)))

    seen = F.coalesce("visual_ambiguity", F.lit(False)) | F.coalesce(F.array_contains("ambiguous_fields", F.lit(field)), F.lit(False))
    ambiguous = seen | tells(("visual_ambiguity", "ambiguous_identifier", f"{field}_uncertain"), "uncertain|ambiguous")
    weak = tells(("low_identifier_confidence", f"weak_{field}_evidence"), "weak|low")
    return F.when(ambiguous, AMBIGUOUS).when(weak | F.coalesce(confidence < LEAST, F.lit(False)), LOW).when(confidence.isNull() & needed, MISSING)


def gate(payloads: DataFrame, fields: tuple[str, ...] = tuple(ALIASES)) -> DataFrame:
    """``payloads`` with the gated ``payload`` and ``events``, in the order of ``fields``.

    payloads: (payload map<string,string>, field_confidence and direct_confidence map<string,double>, row_confidence,
    review_reasons, visual_ambiguity, ambiguous_fields, quality_class, quality_reasons); null columns say nothing.  Blank
    candidates are left as they are, and so is what no field spells.  An accepted candidate stands under the field's name.
    """
    needed = F.coalesce(F.col("quality_class").isin(*DEGRADED), F.lit(False)) | F.coalesce(F.array_contains("quality_reasons", F.lit(ILLEGIBLE)), F.lit(False))

    def verdict(field: str) -> Column:
        return let(confidence_of(field), lambda c: F.struct(
            F.lit(field).alias("field"), candidate(F.col("payload"), field).alias("raw_candidate"), issue(field, c["value"], needed).alias("reason"),
            c["value"].alias("confidence"), c["source"].alias("confidence_source"), _strings(ALIASES.get(field, (field,))).alias("keys"),
        ))

    def applied(state: Column, v: Column) -> Column:
        withheld = F.filter(v["keys"], lambda k: (k == v["field"]) | F.map_contains_key(state, k))
        keys = F.when(v["reason"].isNull(), F.array(v["field"])).otherwise(withheld)
        written = F.map_from_arrays(keys, F.transform(keys, lambda k: F.when(v["reason"].isNull(), v["raw_candidate"])))
        return F.map_concat(F.map_filter(state, lambda k, _: ~F.array_contains(keys, k)), written)

    found = F.filter(F.array(*map(verdict, fields)), lambda v: F.coalesce(F.trim(v["raw_candidate"]) != "", F.lit(False)))
    done = payloads.withColumn("verdicts", found).withColumn("payload", F.aggregate("verdicts", F.col("payload"), applied))
    held = F.filter("verdicts", lambda v: v["reason"].isNotNull())
    return done.withColumn("events", F.transform(held, lambda v: v.dropFields("keys"))).drop("verdicts")
