"""Row shapes: unpivot, collapse, propagation, promotion and ranked candidates.  Documents are keys, row order is
an explicit column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROPERTIES = ("yield_mpa", "tensile_mpa", "elongation_pct")


def unpivot_properties(rows: DataFrame, ids: list[str]) -> DataFrame:
    """A row for each property that has a value."""
    return rows.unpivot(ids, list(PROPERTIES), "property", "value").where("value IS NOT NULL")


def collapse_vertical(long: DataFrame) -> DataFrame:
    """Rows of one property each become one row for each document: of the first group (by row order) that has
    all three properties; other groups are dropped."""
    first = [F.min_by(F.when(F.col("property") == p, F.col("value")), F.when((F.col("property") == p) & F.col("value").isNotNull(), F.col("row_index"))).alias(p) for p in PROPERTIES]
    groups = long.groupBy("doc_id", "grp").agg(*first, F.min("row_index").alias("at"))
    full = groups.where(" AND ".join(f"{p} IS NOT NULL" for p in PROPERTIES))
    best = full.groupBy("doc_id").agg(F.min_by(F.struct("grp", *PROPERTIES), F.struct("at", "grp")).alias("g"))
    return best.select("doc_id", "g.*")


def propagate_header(rows: DataFrame, headers: DataFrame, column: str, resolves: str) -> DataFrame:
    """Missing row values take the document's header value where it resolves; rows whose own value resolves to
    another are marked as conflicts.  Both sides carry ``key`` and ``canonical``."""
    own, head = F.col(column), F.col("header_value")
    joined = rows.join(headers.select("doc_id", F.col("value").alias("header_value"), F.col(resolves).alias("header_resolves")), "doc_id", "left")
    missing = F.coalesce(F.trim(own), F.lit("")) == ""
    filled = F.when(missing & F.col("header_resolves").isNotNull(), head).otherwise(own)
    conflict = ~missing & F.col(resolves).isNotNull() & F.col("header_resolves").isNotNull() & (F.col(resolves) != F.col("header_resolves"))
    return joined.withColumn("filled", filled).withColumn("conflict", F.coalesce(conflict, F.lit(False)))


def promote_unique(rows: DataFrame, column: str) -> DataFrame:
    """The single distinct value of a document's rows, else null."""
    present = F.when(F.trim(column) != "", F.col(column))
    return rows.groupBy("doc_id").agg(F.when(F.min(present) == F.max(present), F.min(present)).alias("promoted"), F.count_distinct(present).alias("n_values"))


def choose_ranked(candidates: DataFrame) -> DataFrame:
    """For each document and field the candidate of the best source; if the best source holds several different
    values the choice is null and the field is in conflict.  (doc_id, field, rank, ordinal, value)"""
    best = candidates.groupBy("doc_id", "field", "rank").agg(F.min_by("value", "ordinal").alias("value"), F.count_distinct(F.lower("value")).alias("n"))
    out = best.groupBy("doc_id", "field").agg(F.min_by(F.struct("rank", "value", "n"), "rank").alias("b"))
    return out.select("doc_id", "field", F.col("b.rank").alias("rank"), F.when(F.col("b.n") == 1, F.col("b.value")).alias("value"), (F.col("b.n") > 1).alias("conflict"))


def inverted_index(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(doc_id, value, n_rows, fields): where each value of a document stands."""
    long = rows.select("doc_id", "row_index", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("c")).select("doc_id", "row_index", "c.*")
    return long.where("trim(value) <> ''").groupBy("doc_id", "value").agg(F.count_distinct("row_index").alias("n_rows"), F.array_join(F.sort_array(F.collect_set("field")), "|").alias("fields"))


def sequential_ids(rows: DataFrame, column: str = "item_id") -> DataFrame:
    """Missing and placeholder ids become the row's position from 1."""
    blank = F.coalesce(F.lower(F.trim(column)), F.lit("")).isin("", "-", "n/a", "none", "null", "unknown")
    return rows.withColumn(column, F.when(blank, (F.col("row_index") + 1).cast("string")).otherwise(F.col(column)))


def heat_alias(aliases: list[str]) -> Column:
    """The first present value of a list of columns that can stand for the heat number."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in aliases))


def backfill_single(rows: DataFrame, headers: DataFrame, fields: list[str]) -> DataFrame:
    """Documents of exactly one row take missing fields from their header (doc_id, fields)."""
    lone = rows.groupBy("doc_id").agg(F.count("*").alias("__rows")).where("__rows = 1").select("doc_id")
    head = headers.join(lone, "doc_id", "left_semi").select("doc_id", *(F.col(f).alias(f"__{f}") for f in fields))
    out = rows.join(head, "doc_id", "left")
    return out.select(*(F.coalesce(F.when(F.trim(c) != "", F.col(c)), F.col(f"__{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns))


def resolve_date(dates: DataFrame, priorities: dict[str, int]) -> DataFrame:
    """(doc_id, value): the labelled date of the best priority, the first on a tie; labels without one are left
    out."""
    rank = F.element_at(F.create_map(*(F.lit(x) for p in priorities.items() for x in p)), F.lower(F.trim("label")))
    return dates.withColumn("__rank", rank).where("__rank IS NOT NULL").groupBy("doc_id").agg(F.min_by("value", F.struct("__rank", "ordinal")).alias("value"))


def document_summary(rows: DataFrame) -> DataFrame:
    """(doc_id, rows, missing values, reasons): one line for each document."""
    missing = [F.count_if(F.col(p).isNull()).alias(f"missing_{p}") for p in PROPERTIES]
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"), *missing, F.array_join(F.sort_array(F.collect_set("outcome")), "|").alias("outcomes"))
