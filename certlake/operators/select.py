"""Selection under budgets: pinned top-k, balanced samples, islands, cut-offs and greedy packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pages_top_k(pages: DataFrame, cap: int, key: str = "doc_id", index: str = "page", score: str = "score") -> DataFrame:
    """The ``cap`` best pages of each document, its first page always among them."""
    order = Window.partitionBy(key).orderBy((F.col(index) == 0).desc(), F.col(score).desc(), F.col(index))
    return pages.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= cap).drop("__n")


def round_robin(df: DataFrame, stratum: list[str], order: list[Column], turn: list[Column], limit: int) -> DataFrame:
    """Takes the strata in turn, each in its own order, until ``limit`` rows are picked; adds ``pick`` from 1.

    No stratum gives more than ``limit`` rows, so after the per-stratum cut only strata x limit rows are ranked.
    """
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*stratum).orderBy(*order))).where(F.col("__n") <= limit)
    picked = ranked.orderBy("__n", *turn).limit(limit)
    return picked.withColumn("pick", F.row_number().over(Window.orderBy("__n", *turn))).drop("__n")


def islands(df: DataFrame, key: list[str], position: str, gap: int) -> DataFrame:
    """Groups of positions with steps of at most ``gap``: key, island from 1, mean position (truncated), size."""
    order = Window.partitionBy(*key).orderBy(position)
    step = F.col(position) - F.lag(position).over(order)
    marked = df.withColumn("__new", F.when(step.isNull() | (step > gap), 1).otherwise(0))
    grouped = marked.withColumn("island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*key, "island").agg(F.floor(F.sum(position) / F.count("*")).cast("long").alias("centre"), F.count("*").alias("size"))


def bands(df: DataFrame, key: list[str], boundary: str, least: int) -> DataFrame:
    """Intervals between consecutive boundaries that are ``least`` wide at least, numbered from 0."""
    nxt = F.lead(boundary).over(Window.partitionBy(*key).orderBy(boundary))
    wide = df.select(*key, F.col(boundary).alias("low"), nxt.alias("high")).where((F.col("high") - F.col("low")) >= least)
    return wide.withColumn("band", F.row_number().over(Window.partitionBy(*key).orderBy("low", "high")) - 1)


def budget_cutoff(df: DataFrame, key: list[str], order: list[Column], cost: str, budget: float) -> DataFrame:
    """Marks rows before which the spend has reached the budget as not ``live``."""
    before = F.sum(cost).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("spent_before", F.coalesce(before, F.lit(0))).withColumn("live", F.col("spent_before") < budget)


def pack_greedy(blocks: DataFrame, key: str, order: list[str], size: str, budget: int, keep: list[str]) -> DataFrame:
    """In order, each block that still fits is taken and others are passed over; if none fits, the smallest one.

    State depends on what was taken, so it is a fold over the ordered blocks of one document.
    """
    block = F.struct(*order, F.col(size).alias("__size"), *[c for c in keep if c not in order])
    packed = blocks.groupBy(key).agg(F.array_sort(F.collect_list(block)).alias("b"))
    taken = F.expr(f"aggregate(b, (cast(0 AS bigint), filter(b, x -> false)), (s, x) -> if(s.col1 + x.__size <= {budget}, (s.col1 + x.__size, array_append(s.col2, x)), s), s -> s.col2)")
    smallest = F.expr("slice(array_sort(b, (l, r) -> CASE WHEN l.__size < r.__size THEN -1 WHEN l.__size > r.__size THEN 1 ELSE 0 END), 1, 1)")
    return packed.select(key, F.explode(F.when(F.size(taken) > 0, taken).otherwise(smallest)).alias("t")).select(key, *(F.col(f"t.{c}").alias(c) for c in dict.fromkeys([*order, *keep])), F.col("t.__size").alias(size))
