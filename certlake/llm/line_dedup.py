"""Line dedup by site-relative frequency.

For each host, the pages that contain a line are divided by all pages of the host; lines above a boilerplate
ratio are dropped from every page of that host.  Equal texts of one host count as one page, so that a page that
was copied often doesn't become boilerplate of itself.  Lines are compared without the blanks at their ends;
blank lines are kept and never counted.

A null host is the host of the empty name.  Null texts have no lines and stay null; a text of which every line
is dropped becomes the empty text.  Repeated rows and rows with null ids are treated like all others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certlake.llm.common import materialize, spare

BLANKS = " \t\r"


@dataclass(frozen=True)
class LineConfig:
    """Lines on more than ``ratio`` of a host's pages, and on ``min_pages`` at least, are boilerplate.  Up to
    ``broadcast_lines`` of them, over all hosts, are broadcast; more are joined by host."""

    ratio: float = 0.1
    min_pages: int = 5
    broadcast_lines: int = 500_000


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(BLANKS)))


def boilerplate(docs: DataFrame, host: str = "source", config: LineConfig = LineConfig()) -> DataFrame:
    """(host, lines): each host's boilerplate lines as hashes.

    A page holds few lines, so at most lines-per-page / ratio lines of a host pass: the array stays short however
    many pages a host has.
    """
    pages = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.xxhash64("text", F.length("text")).alias("page"), "text")
    total = pages.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("pages"))
    lines = pages.select("host", "page", F.explode(F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""), _key))).alias("line"))
    on = lines.groupBy("host", "line", "page").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("*").alias("on")).where(F.col("on") >= config.min_pages)
    return on.join(total, "host").where(F.col("on") > F.col("pages") * F.lit(config.ratio)).groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def drop_boilerplate(docs: DataFrame, host: str = "source", config: LineConfig = LineConfig()) -> DataFrame:
    """``docs`` without boilerplate lines in ``text``, with ``n_lines_dropped``; ``n_chars``, where there is one,
    is the new length.  Other columns stay."""
    found = materialize(boilerplate(docs, host, config), "boilerplate")
    size = found.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    at, drop, lines, kept = (spare(docs.columns, name) for name in ("host_name", "drop", "lines", "kept"))
    found = found.select(F.col("host").alias(at), F.col("lines").alias(drop))
    # Beyond the bound a merge join, in which Spark splits the partitions of hot hosts.
    found = F.broadcast(found) if size <= config.broadcast_lines else found.hint("merge")
    stays = F.filter(lines, lambda x: (F.btrim(x, F.lit(BLANKS)) == "") | ~F.array_contains(drop, _key(x)))
    out = docs.withColumn(at, F.coalesce(F.col(host).cast("string"), F.lit(""))).join(found, at, "left")
    out = out.withColumn(lines, F.split("text", "\n")).withColumn(kept, F.when(F.col(drop).isNull(), F.col(lines)).otherwise(stays))
    dropped = F.coalesce(F.size(lines) - F.size(kept), F.lit(0)).cast("long")
    text = F.when(dropped > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    names = [c for c in docs.columns if c != "n_lines_dropped"]
    cells = {"text": text.alias("text")}
    if "n_chars" in names:
        n_chars = F.when(dropped > 0, F.length(text)).otherwise(F.col("n_chars"))
        cells["n_chars"] = n_chars.cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*(cells.get(c, F.col(f"`{c}`")) for c in names), dropped.alias("n_lines_dropped"))


# The same in DuckDB's SQL, over the table that {docs} names.
LINES_SQL = """
line_pages AS (SELECT DISTINCT coalesce(source, '') AS host, text FROM {docs} WHERE text IS NOT NULL),
line_hosts AS (SELECT host, count(*) AS pages FROM line_pages GROUP BY host),
line_seen AS (
  SELECT host, line, count(*) AS n FROM (
    SELECT DISTINCT host, text, trim(line, chr(32) || chr(9) || chr(13)) AS line
    FROM (SELECT host, text, unnest(string_split(text, chr(10))) AS line FROM line_pages)
  ) WHERE line <> '' GROUP BY host, line),
line_bad AS (SELECT host, line FROM line_seen JOIN line_hosts USING (host) WHERE n >= 5 AND n > pages * cast(0.1 AS double)),
line_all AS (
  SELECT doc_id, coalesce(source, '') AS host, unnest(string_split(text, chr(10))) AS line,
    unnest(range(len(string_split(text, chr(10))))) AS place
  FROM {docs}),
line_kept AS (
  SELECT a.doc_id, count(*) FILTER (WHERE b.line IS NOT NULL) AS dropped,
    coalesce(string_agg(a.line, chr(10) ORDER BY a.place) FILTER (WHERE b.line IS NULL), '') AS text
  FROM line_all a LEFT JOIN line_bad b ON a.host = b.host AND trim(a.line, chr(32) || chr(9) || chr(13)) = b.line
  GROUP BY a.doc_id)
"""

ORACLE = f"""
WITH {LINES_SQL.format(docs="documents")}
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text, d.lang, d.source,
  CASE WHEN k.dropped > 0 THEN cast(length(k.text) AS bigint) ELSE d.n_chars END AS n_chars,
  cast(coalesce(k.dropped, 0) AS bigint) AS n_lines_dropped
FROM documents d LEFT JOIN line_kept k ON d.doc_id = k.doc_id
"""
