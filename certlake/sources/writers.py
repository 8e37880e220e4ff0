"""Sinks: CSV with fixed columns, JSON lines and a small Markdown report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str], quote_all: bool = False) -> None:
    """The columns in their order; absent columns and nulls are empty, arrays are joined by a bar."""
    kinds = dict(df.dtypes)
    cell = lambda c: F.lit("") if c not in kinds else F.array_join(c, "|") if kinds[c].startswith("array") else F.col(c).cast("string")
    df.select(*(F.coalesce(cell(c), F.lit("")).alias(c) for c in columns)).write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A table of aggregated rows; a report has at most ``most`` rows."""
    rows = df.limit(most).collect()
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in rows]) + "\n"
