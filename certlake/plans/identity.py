"""Queries of labelled identity fields, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certlake.functions import labels, text
from certlake.operators import identity
from certlake.plans.registry import query
from certlake.plans.views import LINES, pick, view
from certlake.registries import values_sql

TOKEN = text.TOKEN.replace("'", "''")
DATE = text.DATE_SHAPE


def looks(x: str) -> str:
    """SQL for whether a token looks like an identifier."""
    key = f"regexp_replace(upper({x}), '[^A-Z0-9]', '', 'g')"
    return f"(NOT regexp_matches(trim({x}), '{DATE}') AND NOT contains(trim({x}), ' ') AND regexp_matches({x}, '[0-9]') AND length({key}) >= 3)"


def header(x: str) -> str:
    """SQL for a label in the form of registered headers."""
    plain = f"regexp_replace(regexp_replace(replace(upper({x}), ',', '.'), '[/:;|_-]+', ' ', 'g'), '[^A-Z0-9_.% \\t\\n\\r]+', '', 'g')"
    return f"trim(regexp_replace({plain}, '\\s+', ' ', 'g'))"


EDGES = "' :;#.-/' || chr(9) || chr(10) || chr(13)"


def labelled_sql(source: str) -> str:
    """CTEs from (doc_id, t) to ``entry`` (doc_id, position, field, label, value, conflict)."""
    return f"""src AS ({source}),
tok AS (SELECT doc_id, regexp_extract_all(t, '{TOKEN}') AS w, string_split_regex(t, '{TOKEN}') AS g FROM src WHERE t IS NOT NULL),
place AS (SELECT doc_id, w, g, unnest(range(1, len(w) + 1)) AS i FROM tok),
cand AS (
  SELECT *, array_to_string(list_transform(range(0, k), lambda x: w[i + x] || CASE WHEN x < k - 1 THEN g[i + x + 1] ELSE '' END), '') AS label
  FROM place CROSS JOIN (VALUES (1), (2), (3), (4)) AS widths(k) WHERE i + k - 1 <= len(w)),
hit AS (
  SELECT c.*, field, t.header AS n FROM cand c
  JOIN {values_sql(sorted(labels.FIELD_OF.items()), 'header, field')} ON t.header = {header('c.label')}),
fit AS (
  SELECT * FROM hit WHERE NOT (k = 1 AND i < len(w) AND upper(w[i + 1]) IN {labels.FOLLOWERS}) AND (
    n NOT IN {labels.DELIMITED} OR regexp_matches(CASE WHEN i + k > len(w) THEN substr(g[i + k], 1, 8) ELSE g[i + k] END, '[:#=]')
    OR field IN {labels.IDENTIFIERS} AND i + k <= len(w) AND {looks('w[i + k]')})),
best AS (
  SELECT doc_id, i, any_value(w) AS w, any_value(g) AS g, i + max(k) - 1 AS e, arg_max(field, k) AS field, arg_max(label, k) AS label
  FROM fit GROUP BY doc_id, i),
lists AS (
  SELECT doc_id, any_value(w) AS w, any_value(g) AS g, list([{{'i': i, 'e': e, 'f': field, 'l': label}}] ORDER BY i) AS b FROM best GROUP BY doc_id),
kept AS (
  SELECT doc_id, w, g, list_reduce(b, lambda a, x: CASE WHEN x[1].i > a[len(a)].e THEN list_concat(a, x) ELSE a END) AS k FROM lists),
span AS (
  SELECT doc_id, w, g, unnest(k) AS s, unnest(list_concat(list_transform(k[2:], lambda z: z.i), [cast(len(w) + 1 AS bigint)])) AS nxt FROM kept),
raw AS (
  SELECT doc_id, cast(s.i - 1 AS int) AS position, s.f AS field, trim(s.l) AS label,
    trim(g[s.e + 1] || array_to_string(list_transform(range(s.e + 1, nxt), lambda j: w[j] || g[j + 1]), ''), {EDGES}) AS raw
  FROM span),
part AS (
  SELECT *, list_filter(regexp_extract_all(raw, '{TOKEN}'), lambda d: regexp_matches(d, '{DATE}')) AS days,
    list_filter(regexp_extract_all(raw, '{TOKEN}'), lambda d: {looks('d')})[1] AS code, trim(regexp_extract(raw, '^\\S+'), ' ,;') AS word,
    CASE field WHEN 'order_number' THEN 'order_date' WHEN 'certificate_number' THEN 'certificate_date' END AS beside
  FROM raw),
entries AS (
  SELECT doc_id, position, 0 AS own, field, label, CASE WHEN field IN ('order_date', 'certificate_date') THEN CASE WHEN len(days) = 1 THEN days[1] END
    WHEN field IN {labels.IDENTIFIERS} THEN coalesce(code, CASE WHEN {looks('word')} THEN word END) ELSE nullif(trim(raw, ' ,;'), '') END AS value
  FROM part WHERE raw <> ''
  UNION ALL SELECT doc_id, position, 1, beside, label, CASE WHEN len(days) = 1 THEN days[1] END FROM part WHERE beside IS NOT NULL),
once AS (SELECT * FROM entries WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, field, lower(value) ORDER BY position, own) = 1),
torn AS (SELECT DISTINCT doc_id, beside AS field FROM part WHERE len(days) > 1 AND beside IS NOT NULL),
entry AS (
  SELECT o.doc_id, position, own, o.field, label, value, count(*) OVER (PARTITION BY o.doc_id, o.field) > 1 OR t.field IS NOT NULL AS conflict
  FROM once o LEFT JOIN torn t ON o.doc_id = t.doc_id AND o.field = t.field)"""


LABEL_STARTS = ("Heat No: H", "batch B", "Lot: L", "Order No. O", "Grade: S355J2 Heat: ", "Certificate N° C", "PO: P", "N. Colata ")
TURNS = f"""SELECT conv_id * 1000 + turn AS doc_id, {pick('conv_id + turn', LABEL_STARTS)} || cast(100 + conv_id AS string) || '. ' || text AS t FROM conversations"""


def _entries(df: DataFrame) -> DataFrame:
    """(doc_id, position, field, label, value, conflict) of (doc_id, t)."""
    found = df.select("doc_id", labels.labelled_identifiers(F.col("t")).alias("x")).select("doc_id", "x.conflicts", F.explode("x.found").alias("e"))
    return found.select("doc_id", "e.position", "e.field", "e.label", "e.value", F.array_contains("conflicts", F.col("e.field")).alias("conflict"))


@query(f"WITH {labelled_sql(TURNS)} SELECT doc_id, position, field, label, value, conflict FROM entry")
def labeled_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled identity fields of every conversation turn, behind lines that carry labels."""
    return _entries(view(spark, sf_dir, TURNS))


@query(f"WITH {labelled_sql(TURNS)} SELECT doc_id, field, CASE WHEN NOT bool_or(conflict) THEN min(value) END AS value, bool_or(conflict) AS conflict FROM entry GROUP BY doc_id, field")
def labeled_identifier_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value for each labelled field of every turn; null, and a conflict, where labels give several."""
    found = _entries(view(spark, sf_dir, TURNS)).groupBy("doc_id", "field")
    return found.agg(F.when(~F.bool_or("conflict"), F.min("value")).alias("value"), F.bool_or("conflict").alias("conflict"))


SEGMENTS = ("Heat No: ", "Batch N° ", "COLATA/BATCH: ", "Cert No. ", "PO: ", "Order No 45-", "Charge: ", "Heat ", "Lot No ", "CAST NO: ", "Quality ", "Product: WIRE ")
TAILS = (" / 25/06/2024 ", ", ", " ", " - 1.2.2024 2.2.2024 ", "; ", " 07.10.2024. ")
HEADER_TEXTS = f"""SELECT o_orderkey AS doc_id, {pick('o_orderkey', SEGMENTS)} || cast(1000 + o_custkey % 50 AS string) || {pick('o_custkey', TAILS)}
  || {pick('o_custkey + o_orderkey', SEGMENTS)} || cast(1000 + o_orderkey % 70 AS string) || {pick('o_orderkey + 3', TAILS)}
  || {pick('o_custkey', ('Grade: S355J2', '', 'Standard: EN 10025 / EN 10204', 'DIAM: 0.8 mm', 'no label here'))} AS t,
  {pick('o_custkey', ('', '1007', None, ''))} AS heat_number, {pick('o_orderkey', (None, '', 'B-77', ''))} AS batch_number, CASE WHEN o_custkey % 7 = 0 THEN 'C-9' END AS cast_number,
  CASE WHEN o_orderkey % 3 = 0 THEN 'ORD-1' END AS order_number, {pick('o_orderkey', ('WIRE ROD', 'Heat: 4711 Batch: B123', None))} AS product_name FROM orders"""
SHOWN = ("heat_number", "batch_number", "lot_number", "colata_number", "cast_number", "charge_number", "certificate_number", "certificate_date", "order_number", "order_date", "product_name", "grade", "dimensions", "standards")
GIVEN = ("heat_number", "batch_number", "cast_number", "order_number", "product_name")


def _fill_sql() -> str:
    """Each field's place and value, then which fields are filled, those of lower priority after those above."""
    first = ", ".join(f"min(position * 2 + own) FILTER (WHERE field = '{f}' AND NOT conflict) AS p_{f}, min(value) FILTER (WHERE field = '{f}' AND NOT conflict) AS v_{f}" for f in SHOWN)
    clash = ", ".join(f"bool_or(field = '{f}' AND conflict) AS c_{f}" for f in SHOWN)
    given = ", ".join(f"CASE WHEN NOT coalesce(c_{f}, t_{f}, false) THEN {f} END AS g_{f}" if f in GIVEN else f"cast(NULL AS varchar) AS g_{f}" for f in SHOWN)
    out = f"""f AS (SELECT doc_id, {first}, {clash} FROM entry GROUP BY doc_id),
y AS (SELECT doc_id, {', '.join(f"bool_or(field = '{f}') AS t_{f}" for f in SHOWN)} FROM torn GROUP BY doc_id),
l AS (SELECT doc_id, count(DISTINCT field) >= 2 AS combined FROM ({{combined}}) GROUP BY doc_id),
s0 AS (SELECT h.doc_id, {given}, f.* EXCLUDE (doc_id), {', '.join(f'coalesce(c_{f}, false) OR coalesce(t_{f}, false) AS x_{f}' for f in SHOWN)}, coalesce(combined, false) AS combined
  FROM ({HEADER_TEXTS}) h LEFT JOIN f USING (doc_id) LEFT JOIN y USING (doc_id) LEFT JOIN l USING (doc_id))"""
    for k, field in enumerate(SHOWN):
        above = labels.TRACEABILITY[: labels.TRACEABILITY.index(field)] if field in labels.TRACEABILITY else ()
        stops = "".join(f" AND NOT (trim(coalesce(g_{g}, '')) <> '' AND trim(g_{g}) <> v_{field}) AND NOT (f_{g} AND p_{g} < p_{field} AND v_{g} <> v_{field})" for g in above)
        free = f"(trim(coalesce(g_{field}, '')) = ''{' OR combined' if field == 'product_name' else ''})"
        out += f",\ns{k + 1} AS (SELECT *, coalesce(v_{field} IS NOT NULL AND {free}{stops}, false) AS f_{field} FROM s{k})"
    return out


FILLED = _fill_sql()
LINE = "SELECT doc_id, product_name AS t FROM ({0})".format(HEADER_TEXTS)


@query(
    f"""WITH {labelled_sql(HEADER_TEXTS)}, line AS (WITH {labelled_sql(LINE)} SELECT doc_id, field FROM entry WHERE NOT conflict), {FILLED.format(combined='SELECT * FROM line')}
SELECT doc_id, {', '.join(f"CASE WHEN f_{f} THEN v_{f} ELSE g_{f} END AS {f}" for f in SHOWN)}, concat_ws('|', {', '.join(f"CASE WHEN f_{f} THEN '{f}' END" for f in sorted(SHOWN))}) AS filled,
  concat_ws('|', {', '.join(f"CASE WHEN x_{f} THEN 'conflicting_labeled_candidates:{f}' END" for f in sorted(SHOWN))}) AS conflicts FROM s{len(SHOWN)}"""
)
def labeled_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose empty identity fields are filled from the labels of their header line."""
    rows = view(spark, sf_dir, HEADER_TEXTS)
    payload = F.map_from_arrays(F.array(*map(F.lit, GIVEN)), F.array(*GIVEN))
    combined = F.when(labels.is_combined_line(F.col("product_name")), F.array(F.lit("product_name"))).otherwise(F.array().cast("array<string>"))
    done = rows.select("doc_id", "t", payload.alias("payload"), combined.alias("combined")).withColumn("x", labels.labelled_identifiers(F.col("t")))
    done = done.select("doc_id", labels.fill_labelled(F.col("payload"), F.col("x"), F.col("combined")).alias("r"))
    conflicts = F.filter("r.tokens", lambda t: t.startswith("conflicting_labeled_candidates:"))
    return done.select("doc_id", *(F.element_at("r.payload", F.lit(f)).alias(f) for f in SHOWN), F.array_join(F.array_sort("r.filled"), "|").alias("filled"), F.array_join(F.array_sort(conflicts), "|").alias("conflicts"))


CODES = ("", "M21", "12 mm", None, "7", "EN 10204")
PRODUCTS = ("WELDWIRE SG2 / BRONZEWIRE SG2", "EN ISO 14341-A", "", None, "STEEL WIRE ROD - DIAM 5.5 mm", "Heat: 4711 Batch: B123", "S355J2", "Ø 12 mm", "PLATE S235JR 20 kg")
MIXED_GRADES = ("SG2", "M21 / C1", "", None, "EN 10255", "HOT ROLLED PLATE S355J2", "12 mm", "S355J2", "EN ISO 14341-A / SG2", "G46 / S235JR", "Heat: 1 B: 2 Lot: L100")
LIST_TEXTS = ("EN ISO 14341-A, M21", "", None, "EN 10025-2|en 10025-2|C1")
IDENTITY_ROWS = f"""SELECT doc_id, row_index, {pick('p', CODES)} AS item_id, {pick('s', PRODUCTS)} AS product_name, {pick('q', (None, 'spool'))} AS product_details,
  {pick('p + s', MIXED_GRADES)} AS grade, {pick('q', (None, '', '16 mm', None, ''))} AS dimensions, {pick('l', LIST_TEXTS)} AS listed, {pick('s', ('Cert', 'PO', 'Heat', 'Diameter', 'Kalite', 'Norm', '_x', 'Colour'))} AS extra_key,
  {pick('p', ('X-9', '', '0.80 mm', 'H9001', None))} AS extra_value, {pick('q', ('H1', '', None))} AS heat_number FROM ({LINES}) AS x"""
HEADERS_OF = f"""SELECT o_orderkey AS doc_id, {pick('o_custkey', ('STEEL WORKS', 'WIRE ROD COMPANY', None))} AS supplier_name, {pick('o_orderkey', ('WIRE ROD COMPANY', 'Product: COIL ROD Grade: S355J2', '', None, '12 mm', 'GALVANISED COIL S275JR'))} AS product_name,
  {pick('o_custkey', ('S355J2', '', 'M21', 'EN 10255 / EN 1', 'ROUND BAR 316L', None, 'Grade: S195'))} AS header_grade, {pick('o_orderkey', (None, '3 mm', 'DIAM: 4 mm Heat: H77'))} AS size,
  {pick('o_custkey', (None, 'EN 10025-2 / M21', ''))} AS standards, {pick('o_orderkey', ('H55', None, 'Heat: 4711 Batch: B123'))} AS header_heat_number, {pick('o_custkey', ('PO-1', ''))} AS "PO No" FROM orders"""


def _identity_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = view(spark, sf_dir, IDENTITY_ROWS)
    rows = rows.select(
        "doc_id", "row_index", "item_id", "product_name", "product_details", "grade", "dimensions", F.array("listed").alias("standards"),
        F.lit(None).cast("array<string>").alias("classifications"), F.create_map("extra_key", "extra_value").alias("extras"), "heat_number",
    )
    heads = view(spark, sf_dir, HEADERS_OF.replace('"PO No"', "`PO No`"))
    keys = [c for c in heads.columns if c != "doc_id"]
    return rows, heads.select("doc_id", F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.col(f"`{k}`") for k in keys))).alias("metadata"))


@query()
def identity_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with product, grade, standards, dimensions and identifiers kept apart, and the moves; the rules are
    tested by worked examples."""
    rows, documents = _identity_inputs(spark, sf_dir)
    done = identity.identity_mapping(rows, documents, identity.judged_texts(rows, documents))
    joined = {c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), "|") for c in ("standards", "classifications", "tokens")}
    return done.withColumns(joined)
