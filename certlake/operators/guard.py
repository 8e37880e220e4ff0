"""Verification of traceability identifiers: codes that a scan may have misread, and candidates one sign apart.

Many candidates of a field are compared without pairs: each code is spelled once for every place, with that place masked,
and codes with the same spelling differ there alone.  So the work grows with the letters of the codes, however many
candidates a field has.  All candidates of a field stand in one row, so that nothing is shuffled to judge them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certlake.functions.numeric import let
from certlake.functions.text import canonical_identifier, is_missing, single_substitution, suspicious_identifier
from certlake.registries import IDENTIFIER_LOOKALIKES

# Fields under guard, tokens, and the remark for users.
GUARDED = ("heat_number", "batch_number", "lot_number", "colata_number", "cast_number", "charge_number", "coil_number", "traceability_identifier_value")
UNCERTAIN, CONFLICT = "traceability_identifier_ocr_uncertain", "traceability_identifier_conflict"
MESSAGE = "Traceability identifier contains visually ambiguous OCR characters and requires human verification."
KEY = ["doc_id", "row_index", "field"]
# So many codes are compared by pairs.
FEW = 64


def _masked(codes: Column) -> Column:
    """Every code spelled with each of its places masked, once for each kind of sign that may be confused there."""

    def at(code: Column, i: Column) -> Column:
        sign = lambda k: F.substr(code, k, F.lit(1))
        digit = lambda c: F.regexp_like(c, F.lit("^[0-9]$"))
        between = (i > 1) & digit(sign(i - 1)) & digit(sign(i + 1))
        kinds = [F.when(digit(sign(i)), "digit")]
        kinds += [F.when(F.contains(F.lit(group), sign(i)) & (between if "G" in group else F.lit(True)), group) for group in IDENTIFIER_LOOKALIKES]
        spelled = F.concat(F.substr(code, F.lit(1), i - 1), F.lit("*"), F.substr(code, i + 1), F.lit("*"))
        return F.transform(F.filter(F.array(*kinds), lambda k: k.isNotNull()), lambda k: F.concat(spelled, k))

    return F.flatten(F.transform(codes, lambda c: F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: at(c, i)))))


def any_conflict(codes: Column) -> Column:
    """Whether two of an array of different codes are one confusable sign apart; none is empty."""
    near = lambda a, b: (F.length(a) == F.length(b)) & (a < b) & (F.levenshtein(a, b, 1) == 1)
    pairs = F.exists(codes, lambda a: F.exists(codes, lambda b: F.when(near(a, b), single_substitution(a, b)).otherwise(False)))
    return F.when(F.size(codes) < 2, False).when(F.size(codes) <= FEW, pairs).otherwise(let(_masked(codes), lambda m: F.size(F.array_distinct(m)) < F.size(m)))


def conflicts(candidates: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """(key, conflict) of the groups of ``candidates`` that hold two codes one confusable sign apart."""
    codes = candidates.select(*key, canonical_identifier(F.trim(value)).alias("code")).where("code <> ''").groupBy(*key).agg(F.collect_set("code").alias("codes"))
    return codes.withColumn("conflict", any_conflict(F.col("codes"))).where("conflict").drop("codes")


def gathered(identifiers: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, row_index, field, accepted, candidates): both as arrays, one row for each key."""
    once = candidates.where(~is_missing(F.col("value"))).groupBy(*KEY, F.trim("value").alias("value")).agg(F.min_by("source", "ordinal").alias("source"), F.min("ordinal").alias("ordinal"))
    cell = F.struct("ordinal", "value", "source")
    own = identifiers.where(~is_missing(F.col("value"))).select(*KEY, F.col("value").alias("own"))
    both = own.unionByName(once.select(*KEY, cell.alias("cell")), allowMissingColumns=True)
    return both.groupBy(*KEY).agg(F.collect_list("own").alias("accepted"), F.collect_list("cell").alias("candidates"))


def assess_gathered(fields: DataFrame) -> DataFrame:
    """(doc_id, row_index, field, value, ocr_uncertain, conflict, candidates) of fields with all that was read for them.

    fields: (doc_id, row_index, field, accepted array<string>, candidates array<struct<ordinal, value, source>>), each
    key once.  A flagged field lists its other candidates, each value once, in order, with their sources and a reason;
    the accepted value isn't among them.
    """
    c, whole = F.col, F.col("doc_id").isNotNull() & F.col("row_index").isNotNull()
    filled = F.filter("candidates", lambda x: whole & ~is_missing(x["value"]))
    others = F.transform(filled, lambda x: F.struct(x["ordinal"].alias("ordinal"), F.trim(x["value"]).alias("value"), x["source"].alias("source")))
    own = F.transform(F.filter("accepted", lambda v: ~is_missing(v)), lambda v: F.trim(v))
    df = fields.where(c("field").isin(*GUARDED)).select(*KEY, own.alias("own"), others.alias("others"))
    codes = F.filter(F.array_distinct(F.transform(F.concat("own", c("others.value")), canonical_identifier)), lambda code: code != "")
    df = df.withColumn("conflict", whole & let(codes, any_conflict))
    # A key without an accepted value ends here.
    df = df.withColumn("value", F.explode("own")).withColumn("ocr_uncertain", suspicious_identifier(c("value")))
    reason = F.when(c("conflict"), CONFLICT).otherwise(UNCERTAIN)

    def once(kept: Column) -> Column:
        values = kept["value"]
        first = F.filter(kept, lambda x, i: F.array_position(values, x["value"]) == i + 1)
        return F.when(F.size(F.array_distinct(values)) == F.size(values), kept).otherwise(first)

    kept = F.transform(F.filter("others", lambda x: F.exists("own", lambda v: v != x["value"])), lambda x: F.struct(x["ordinal"].isNull().alias("none"), x["ordinal"].alias("ordinal"), x["value"].alias("value"), x["source"].alias("source")))
    listed = F.transform(let(F.array_sort(kept), once), lambda x: F.struct(x["value"].alias("value"), x["source"].alias("source"), reason.alias("reason")))
    empty = F.array().cast("array<struct<value:string,source:string,reason:string>>")
    return df.select(*KEY, "value", "ocr_uncertain", "conflict", F.when(c("conflict") | c("ocr_uncertain"), listed).otherwise(empty).alias("candidates"))


def assess(identifiers: DataFrame, candidates: DataFrame) -> DataFrame:
    """``assess_gathered`` of identifiers, (doc_id, row_index, field, value), the row -1 for the document's own, and of
    candidates, (doc_id, row_index, field, ordinal, value, source)."""
    return assess_gathered(gathered(identifiers, candidates))


def guarded_documents(documents: DataFrame, assessed: DataFrame) -> DataFrame:
    """``documents`` (doc_id, needs_review, reasons, remarks) with the guard's tokens, review and remark, and the flagged
    fields: a row's with its number."""
    name = F.when(F.col("row_index") >= 0, F.concat_ws(":row", "field", "row_index")).otherwise(F.col("field"))
    flag = F.col("conflict") | F.col("ocr_uncertain")
    sums = assessed.groupBy("doc_id").agg(F.bool_or("ocr_uncertain").alias("u"), F.bool_or("conflict").alias("c"), F.array_sort(F.collect_set(F.when(flag, name))).alias("flagged"))
    df = documents.join(sums, "doc_id", "left")
    tokens = F.filter(F.array(F.when(F.col("u"), UNCERTAIN), F.when(F.col("c"), CONFLICT)), lambda t: t.isNotNull())
    hit, remarks = F.size(tokens) > 0, F.trim(F.coalesce("remarks", F.lit("")))
    said = F.when(F.contains(remarks, F.lit(MESSAGE)), remarks).otherwise(F.trim(F.concat_ws(" ", F.nullif(remarks, F.lit("")), F.lit(MESSAGE))))
    return df.select(
        "doc_id", (F.coalesce("needs_review", F.lit(False)) | hit).alias("needs_review"), F.array_distinct(F.concat(F.coalesce("reasons", F.array().cast("array<string>")), tokens)).alias("reasons"),
        F.when(hit, said).otherwise(F.col("remarks")).alias("remarks"), F.coalesce("flagged", F.array().cast("array<string>")).alias("flagged"),
    )
