"""Certificate-shaped inputs, derived from the given tables by arithmetic that Spark and DuckDB share.

Each text is valid in both SQL dialects and has no randomness, so a query and its SQL counterpart read the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRADES = ("S235JR", "s355 j2", "S355", "304/304L", "TP316L", "ASTM A312 TP317L", "S195T", "API5LX65", "Q999", "", "NOVOFIL SG2/NOVOBRONZE SG2", "S355J2+N / S355JR", "321", "S275JR+AR", "MAT TP304L X", "SRC-DRW02")


def pick(number: str, values: tuple[str | None, ...]) -> str:
    """SQL for the value at ``number`` modulo the length."""
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"CASE cast(({number}) % {len(values)} AS int) " + " ".join(f"WHEN {i} THEN {cell(v)}" for i, v in enumerate(values)) + " END"


ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
LINES = f"""SELECT l_orderkey AS doc_id, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) - 1 AS bigint) AS row_index,
  l_partkey AS p, l_suppkey AS s, l_linenumber AS l, cast(l_quantity AS bigint) AS q FROM lineitem"""

CERTS = f"""SELECT l_orderkey AS doc_id, {pick('l_partkey', GRADES)} AS grade, l_partkey % 3 = 0 AS explicit_grade,
  CASE WHEN l_suppkey % 11 = 0 THEN 'WIRE_ROPE' WHEN l_suppkey % 5 = 0 THEN 'PIPE' ELSE 'STRUCTURAL_STEEL' END AS category,
  CASE WHEN l_linenumber = 7 OR l_linenumber = 2 AND l_partkey % 7 = 0 THEN NULL ELSE cast(60 + (l_suppkey * 7 + l_partkey) % 700 AS double) END AS yield_mpa,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE cast(340 + (l_partkey * 3 + l_suppkey) % 1600 AS double) END AS tensile_mpa,
  CASE WHEN l_linenumber = 7 OR l_linenumber = 3 THEN NULL ELSE cast((l_partkey + l_linenumber) % 40 AS double) END AS elongation_pct FROM lineitem"""

NUMBERS = """SELECT CASE cast((l_linenumber + l_partkey) % 12 AS int)
  WHEN 0 THEN cast(cast(l_quantity AS bigint) AS string) || '.' || lpad(cast(l_partkey % 1000 AS string), 3, '0')
  WHEN 1 THEN cast(cast(l_quantity AS bigint) AS string) || ',' || lpad(cast(l_partkey % 1000 AS string), 3, '0')
  WHEN 2 THEN cast(cast(l_quantity AS bigint) AS string) || ',5%'
  WHEN 3 THEN '1.' || lpad(cast(cast(l_quantity AS bigint) AS string), 3, '0') || ',56'
  WHEN 4 THEN '1,' || lpad(cast(cast(l_quantity AS bigint) AS string), 3, '0') || '.56 MPa'
  WHEN 5 THEN '515-750' WHEN 6 THEN cast(cast(l_quantity * 10 AS bigint) AS string) || ' N/mm2' WHEN 7 THEN 'n/a' WHEN 8 THEN '' WHEN 9 THEN NULL
  WHEN 10 THEN '1.234.' || lpad(cast(cast(l_quantity AS bigint) AS string), 3, '0') ELSE ' ' || cast(l_partkey % 2000 AS string) || ' ' END AS raw FROM lineitem"""

UNITS = f"SELECT cast(cast(l_quantity AS bigint) AS string) || {pick('l_partkey', (' kg', ' Kgs.', 't', ' g', ' tons', ' mm', '', ' m', ',5 t', ',195 kg'))} AS raw FROM lineitem"

DATES = """SELECT CASE cast(o_orderkey % 6 AS int)
  WHEN 0 THEN cast(cast(o_orderdate AS date) AS string)
  WHEN 1 THEN lpad(cast(day(o_orderdate) AS string), 2, '0') || '/' || lpad(cast(month(o_orderdate) AS string), 2, '0') || '/' || cast(year(o_orderdate) AS string)
  WHEN 2 THEN cast(day(o_orderdate) AS string) || '.' || cast(month(o_orderdate) AS string) || '.' || cast(year(o_orderdate) AS string)
  WHEN 3 THEN cast(day(o_orderdate) AS string) || '-' || cast(month(o_orderdate) AS string) || '-' || lpad(cast(year(o_orderdate) % 100 AS string), 2, '0')
  WHEN 4 THEN '31/02/' || cast(year(o_orderdate) AS string) ELSE cast(year(o_orderdate) AS string) || '-10' END AS raw FROM orders"""

HEATS = f"""SELECT doc_id, row_index, CASE WHEN l = 6 THEN '' ELSE {pick('l', ('A', 'H', ''))} || {pick('p', ('1', 'I', '0', 'O', '8', 'B', '5'))} || cast(100 + s % 3 AS string) || CASE WHEN q % 4 = 0 THEN 'S' ELSE '5' END END AS heat FROM ({LINES}) AS x"""


TABLES = ("lineitem", "orders", "part", "supplier", "documents", "events", "labels", "conversations", "pages", "customer")
READS = re.compile(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b")
LITERAL = re.compile(r"('(?:[^']|'')*')")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a shared SQL text over the tables that it reads; names inside literals are left alone."""
    names: set[str] = set()

    def bind(match: re.Match) -> str:
        names.add(match[2])
        return f"{match[1]} {{{match[2]}}}"

    pieces = LITERAL.split(sql)
    literal = lambda piece: piece.replace("{", "{{").replace("}", "}}")
    bound = "".join(literal(piece) if i % 2 else READS.sub(bind, piece) for i, piece in enumerate(pieces))
    return spark.sql(bound, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def cells(variants: list[dict[str, str]]) -> Column:
    """A row's (named x) variants, a SQL text for each column, as an array."""
    return F.array(*(F.struct(*(F.expr(sql).alias(name) for name, sql in v.items())) for v in variants))


def exploded(df: DataFrame, keys: list[str], variants: list[dict[str, str]]) -> DataFrame:
    """For each row of ``df`` (named x) one row for each variant; one scan serves all."""
    return df.alias("x").select(*keys, F.explode(cells(variants)).alias("cell")).select(*keys, "cell.*")


def union_sql(source: str, keys: list[str], variants: list[dict[str, str]]) -> str:
    """The same as one SQL text, a branch for each variant."""
    branch = lambda v: f"SELECT {', '.join(f'x.{k}' for k in keys)}, {', '.join(f'{sql} AS {name}' for name, sql in v.items())} FROM {source} AS x"
    return " UNION ALL ".join(map(branch, variants))
