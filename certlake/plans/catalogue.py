"""All queries of the engine by name, and their SQL counterparts.

Queries read whole tables.  Scalar rules run on each distinct input text, with its number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certlake.functions import numeric, text
from certlake.operators import confidence, evaluate, profile, resolve, select, shape, store, validate
from certlake.plans.registry import ORACLES, QUERIES, counted, query
from certlake.plans.views import CERTS, DATES, HEATS, LINES, NUMBERS, UNITS, pick, view
from certlake.registries import ELEMENT_ROWS, GRADES, HEADER_ROWS, HEAT_LOOKALIKES, REVIEW_OUTCOMES, SPECS, alias_key, elements, headers, values_sql
from certlake.streaming import jobs

# --- Scalar rules


@query(f"""WITH r AS (SELECT raw, count(*) AS n FROM ({NUMBERS}) GROUP BY raw),
d AS (SELECT raw, n, trim(raw) AS t, regexp_replace(regexp_replace(trim(raw), '\\s*(MPA|N/MM2|PSI|KSI|%|PCT|KG|MT|TONS|TON|PCS|MM|CM|M|FT)\\s*$', '', 'i'), '[^0-9.,-]', '', 'g') AS d FROM r),
c AS (SELECT *, length(d) - length(replace(d, '.', '')) AS dots, length(d) - length(replace(d, ',', '')) AS commas, replace(replace(d, '.', ''), ',', '') AS bare FROM d),
p AS (SELECT *, CASE WHEN dots = 0 AND commas = 0 THEN 'digits_only' WHEN dots + commas = 1 THEN 'decimal' WHEN dots > 0 AND commas > 0 AND strpos(reverse(d), '.') < strpos(reverse(d), ',') THEN 'dot_decimal_with_thousands'
   WHEN dots > 0 AND commas > 0 THEN 'comma_decimal_with_thousands' ELSE 'thousands_grouped' END AS k FROM c),
v AS (SELECT *, CASE k WHEN 'digits_only' THEN try_cast(d AS double) WHEN 'decimal' THEN try_cast(replace(d, ',', '.') AS double) WHEN 'dot_decimal_with_thousands' THEN try_cast(replace(d, ',', '') AS double)
   WHEN 'comma_decimal_with_thousands' THEN try_cast(replace(replace(d, '.', ''), ',', '.') AS double) ELSE try_cast(bare AS double) END AS v1,
   CASE WHEN k = 'decimal' AND regexp_full_match(d, '[^.,]+[.,][^.,]{{3}}') THEN try_cast(bare AS double) END AS v2 FROM p),
g AS (SELECT *, v1 IS NOT NULL AND v1 BETWEEN 80 AND 1500 AS g1, v2 IS NOT NULL AND v2 BETWEEN 80 AND 1500 AS g2, coalesce(t, '') = '' AS blank, coalesce(t, '') = '' OR d = '' AS empty FROM v),
o AS (SELECT *, CASE WHEN g1 THEN v1 WHEN g2 THEN v2 ELSE coalesce(v1, v2) END AS value, CASE WHEN g1 THEN k WHEN g2 THEN 'thousands' WHEN v1 IS NOT NULL THEN k WHEN v2 IS NOT NULL THEN 'thousands' END AS name FROM g)
SELECT raw, n, CASE WHEN NOT empty THEN coalesce(value, cast(0 AS double)) END AS value,
  CASE WHEN blank THEN false WHEN empty THEN true ELSE g1 = g2 OR name = 'decimal' AND regexp_full_match(d, '-?[0-9]+[.,][0-9]{{3}}') OR name IS NULL END AS uncertain,
  NOT empty AND coalesce(name IN ('thousands', 'thousands_grouped'), false) AS promoted, CASE WHEN empty THEN 'empty' ELSE coalesce(name, 'empty') END AS reading FROM o""")
def numeric_parse_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(view(spark, sf_dir, NUMBERS), "raw").withColumn("p", numeric.parse_locale(F.col("raw"), "yield_mpa")).select("raw", "n", "p.*")


FIRST_NUMBER = """r AS (SELECT raw, count(*) AS n FROM ({view}) GROUP BY raw),
k AS (SELECT raw, n, replace(trim(regexp_extract(raw, '[-+]?[0-9][0-9,.\\s]*')), ' ', '') AS k FROM r),
x AS (SELECT raw, n, try_cast(CASE WHEN k LIKE '%.%' AND k LIKE '%,%' AND strpos(reverse(k), ',') < strpos(reverse(k), '.') THEN replace(replace(k, '.', ''), ',', '.')
   WHEN k NOT LIKE '%.%' AND length(k) - length(replace(k, ',', '')) = 1 AND strpos(reverse(k), ',') <= 3 THEN replace(k, ',', '.') ELSE replace(k, ',', '') END AS double) AS value FROM k)"""


@query(f"WITH {FIRST_NUMBER.format(view=NUMBERS)} SELECT raw, n, value FROM x")
def numeric_parse_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(view(spark, sf_dir, NUMBERS), "raw").withColumn("value", numeric.parse_first(F.col("raw")))


@query(f"""WITH {FIRST_NUMBER.format(view=UNITS)},
u AS (SELECT *, lower(regexp_extract(trim(raw), '\\s*(kilograms|kilogram|kgs|kg|grams|gram|g|tonnes|tonne|tons|ton|t|mt|mm|cm|m)\\s*\\.?$', 1, 'i')) AS u FROM x),
c AS (SELECT *, CASE WHEN u IN ('kg', 'kgs', 'kilogram', 'kilograms') THEN 'kg' WHEN u IN ('g', 'gram', 'grams') THEN 'g' WHEN u IN ('t', 'ton', 'tons', 'tonne', 'tonnes', 'mt') THEN 't' ELSE u END AS unit FROM u)
SELECT raw, n, value, unit, CASE unit WHEN 'kg' THEN value WHEN 'g' THEN value * cast(0.001 AS double) WHEN 't' THEN value * 1000 END AS kg FROM c""")
def unit_to_kg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(view(spark, sf_dir, UNITS), "raw").withColumn("u", numeric.parse_unit(F.col("raw"))).select("raw", "n", "u.*")


@query(f"""WITH r AS (SELECT raw, count(*) AS n FROM ({DATES}) GROUP BY raw)
SELECT raw, n, strftime(CASE WHEN regexp_full_match(raw, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN try_cast(raw AS date)
  WHEN regexp_full_match(raw, '[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-]([0-9]{{4}}|[0-9]{{2}})') THEN try_cast(
    (CASE WHEN length(regexp_extract(raw, '[0-9]+$')) = 4 THEN regexp_extract(raw, '[0-9]+$') WHEN cast(regexp_extract(raw, '[0-9]+$') AS int) < 70 THEN '20' || regexp_extract(raw, '[0-9]+$') ELSE '19' || regexp_extract(raw, '[0-9]+$') END)
    || '-' || lpad(regexp_extract(raw, '^[0-9]+[./-]([0-9]+)', 1), 2, '0') || '-' || lpad(regexp_extract(raw, '^[0-9]+'), 2, '0') AS date) END, '%Y-%m-%d') AS iso FROM r""")
def date_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(view(spark, sf_dir, DATES), "raw").withColumn("iso", text.parse_date(F.col("raw")))


SIZES = f"SELECT cast(p_size AS string) || {pick('p_partkey', (' x ', 'mm x ', '×', ' by '))} || cast(p_size * 3 AS string) || {pick('p_partkey', (' mm', 'mm', '', ' cm'))} AS raw FROM part"


@query(f"""WITH r AS (SELECT raw, count(*) AS n FROM ({SIZES}) GROUP BY raw),
c AS (SELECT raw, n, list_filter(regexp_split_to_array(trim(raw), '\\s*(?:x|×|\\*|/|by)\\s*'), lambda x: trim(x) <> '') AS c FROM r)
SELECT raw, n, array_to_string(list_transform(c, lambda x: cast(cast(regexp_extract(x, '[0-9]+') AS bigint) * 1000000 AS string)), 'x') || ' ' || lower(regexp_extract(raw, '(mm|cm|m)$', 1)) AS signature FROM c""")
def dimension_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(view(spark, sf_dir, SIZES), "raw").withColumn("signature", numeric.dimension_signature(F.col("raw")))


@query(f"""SELECT category, count(*) AS n, cast(count(*) FILTER (WHERE yield_mpa < 80 OR yield_mpa > 1500) AS bigint) AS odd_yield,
cast(count(*) FILTER (WHERE tensile_mpa < 120 OR tensile_mpa > 1800) AS bigint) AS odd_tensile, cast(count(*) FILTER (WHERE elongation_pct < 1 OR elongation_pct > 80) AS bigint) AS odd_elongation FROM ({CERTS}) GROUP BY category""")
def suspicious_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = [F.count_if(numeric.suspicious(F.col(k), numeric.BANDS[k])).alias(f"odd_{k.split('_')[0]}") for k in shape.PROPERTIES]
    return view(spark, sf_dir, CERTS).groupBy("category").agg(F.count("*").alias("n"), *odd)


SHAPES = f"SELECT {pick('l_partkey', ('07/10/2024', 'AB-12', 'HEAT', '12 34', '2024-10-07', 'X9', '7.10', 'C' , '', 'LS210612G8'))} || CASE WHEN l_linenumber = 1 THEN cast(l_suppkey % 7 AS string) ELSE '' END AS raw FROM lineitem"


@query(f"""WITH r AS (SELECT raw, count(*) AS n FROM ({SHAPES}) GROUP BY raw),
s AS (SELECT *, regexp_full_match(trim(raw), '([0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{2,4}}|[0-9]{{4}}[./-][0-9]{{1,2}}[./-][0-9]{{1,2}}|[0-9]{{1,2}}[./-][0-9]{{1,2}})') AS is_date, regexp_replace(upper(trim(raw)), '[^A-Z0-9]', '', 'g') AS k FROM r)
SELECT raw, n, is_date, NOT is_date AND trim(raw) NOT LIKE '% %' AND regexp_matches(k, '[0-9]') AND length(k) >= 3 AS is_identifier FROM s""")
def identifier_shape_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    return counted(view(spark, sf_dir, SHAPES), "raw").withColumn("is_date", text.looks_like_date(raw)).withColumn("is_identifier", text.looks_like_identifier(raw))


NAMES = f"SELECT s_suppkey, s_name, s_name || {pick('s_suppkey', (' S.p.A.', ' GmbH', ' Ltd.', ' s.r.l', ', Inc.', ' Co', ''))} AS raw FROM supplier"


@query(f"""WITH r AS (SELECT s_suppkey, trim(raw) AS t FROM ({NAMES})),
n AS (SELECT s_suppkey, lower(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\bs\\.?\\s*p\\.?\\s*a\\.?\\b', ' spa ', 'gi'), '\\bs\\.?\\s*r\\.?\\s*l\\.?\\b', ' srl ', 'gi'), '\\bltd\\.?\\b', ' ltd ', 'gi'), '\\binc\\.?\\b', ' inc ', 'gi'), '\\bcorp\\.?\\b', ' corp ', 'gi'), '\\bgmbh\\b', ' gmbh ', 'gi'), '\\bco\\.?\\b', ' co ', 'gi'),
  '[^\\w\\s./+-]', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM r) SELECT s_suppkey, name FROM n""")
def supplier_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, NAMES).select("s_suppkey", text.normalize_supplier(F.col("raw")).alias("name"))


@query(f"""SELECT header, field, sum(n) AS n FROM (SELECT upper(regexp_replace(trim(regexp_replace(raw, '[/:;|_-]+', ' ', 'g')), '\\s+', ' ', 'g')) AS header, count(*) AS n FROM (SELECT {pick('p_partkey', ('heat_no', 'Grade:', ' yield  strength', 'A%', 'Rm', 'colour', 'Date/of/issue', 'CAST-NO'))} AS raw FROM part) GROUP BY 1)
LEFT JOIN {values_sql(HEADER_ROWS, 'h, field')} ON h = header GROUP BY header, field""".replace("sum(n) AS n", "cast(sum(n) AS bigint) AS n"))
def header_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, f"SELECT {pick('p_partkey', ('heat_no', 'Grade:', ' yield  strength', 'A%', 'Rm', 'colour', 'Date/of/issue', 'CAST-NO'))} AS raw FROM part")
    named = counted(raw, "raw").withColumn("header", text.normalize_header(F.col("raw"))).groupBy("header").agg(F.sum("n").alias("n"))
    return named.join(F.broadcast(headers(spark)), "header", "left").select("header", "field", "n")


@query("""WITH t AS (SELECT lang, regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS t FROM documents)
SELECT lang, count(*) AS n, cast(count(*) FILTER (WHERE length(t) >= 40 AND (length(regexp_replace(t, '[^\\p{L}\\p{N}\\s\\p{Z}.,\\-/():]', '', 'g')) * 100 < length(t) * 92
  OR length(regexp_replace(t, '[^¦|\\\\_~\\[\\]{}<>^]', '', 'g')) * 100 > length(t) * 2 OR contains(t, chr(65533)))) AS bigint) AS noisy FROM t GROUP BY lang""")
def noisy_text_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(text.noisy_text(F.col("text"))).alias("noisy"))


# --- Grades, specifications and rows

ALIASES = [(k, c, g, i) for i, (k, (c, g)) in enumerate({alias_key(a): (c, g) for c, g, names in GRADES for a in (c, *names)}.items())]
RESOLVED = f"""reg AS (SELECT * FROM {values_sql(ALIASES, 'k, canonical, grp, ord')}),
raws AS (SELECT DISTINCT grade AS raw FROM ({CERTS})),
norm AS (SELECT raw, trim(regexp_replace(regexp_replace(regexp_replace(upper(trim(raw)), '[_;:|]+', ' ', 'g'), '-+', '-', 'g'), '\\s+', ' ', 'g')) AS t FROM raws),
toks AS (SELECT raw, unnest(list_filter(list_transform(regexp_split_to_array(t, '[/,]'), lambda x: trim(x)), lambda x: x <> '')) AS tok, generate_subscripts(list_filter(list_transform(regexp_split_to_array(t, '[/,]'), lambda x: trim(x)), lambda x: x <> ''), 1) AS pos FROM norm),
ways AS (SELECT raw, pos, tok, unnest([tok, regexp_replace(tok, '\\+(N|M|AR|QT|Q)\\b', '', 'i'), regexp_replace(tok, '^(?:ASTM\\s+)?A[0-9]{{3}}\\s+', '', 'i'), regexp_replace(regexp_replace(tok, '^(?:ASTM\\s+)?A[0-9]{{3}}\\s+', '', 'i'), '\\+(N|M|AR|QT|Q)\\b', '', 'i')]) AS w, unnest([1, 2, 3, 4]) AS way FROM toks),
exact AS (SELECT raw, pos, min_by(canonical, way) AS canonical, min_by(grp, way) AS grp FROM ways JOIN reg ON regexp_replace(upper(trim(w)), '[\\s_-]+', '', 'g') = k GROUP BY raw, pos),
inside AS (SELECT t.raw, t.pos, r.canonical, r.grp, r.ord FROM toks t JOIN reg r ON contains(regexp_replace(upper(trim(t.tok)), '[\\s_-]+', '', 'g'), r.k) AND length(r.k) >= 3 WHERE NOT EXISTS (SELECT 1 FROM exact e WHERE e.raw = t.raw AND e.pos = t.pos)),
hits AS (SELECT raw, pos, 0 AS ord, canonical, grp FROM exact UNION ALL SELECT raw, pos, ord, canonical, grp FROM inside),
firsts AS (SELECT raw, canonical, min(pos * 10000 + ord) AS place FROM hits GROUP BY raw, canonical),
agg AS (SELECT h.raw, count(DISTINCT h.canonical) AS nc, count(DISTINCT h.grp) AS ng FROM hits h GROUP BY h.raw),
cands AS (SELECT raw, list(canonical ORDER BY place) AS cands FROM firsts GROUP BY raw),
shapes AS (SELECT raws.raw, count(tok) AS n, min(regexp_replace(upper(trim(tok)), '[\\s_-]+', '', 'g')) AS only FROM raws LEFT JOIN toks ON raws.raw = toks.raw GROUP BY raws.raw),
resolved AS (SELECT s.raw AS grade, CASE WHEN s.n = 0 THEN 'empty' WHEN s.n = 1 AND s.only = 'S355' THEN 'ambiguous' WHEN a.nc IS NULL THEN 'unknown' WHEN a.nc = 1 THEN 'resolved' WHEN a.ng = 1 THEN 'resolved_dual' ELSE 'ambiguous' END AS status,
  CASE WHEN s.n = 1 AND s.only = 'S355' THEN ['S355JR', 'S355J2'] ELSE coalesce(c.cands, []) END AS cands FROM shapes s LEFT JOIN agg a ON s.raw = a.raw LEFT JOIN cands c ON s.raw = c.raw),
spec AS (SELECT * FROM {values_sql(SPECS, 'spec, min_yield, min_tensile, max_tensile, min_elongation')}),
pairs AS (SELECT grade, unnest(cands) AS cand, generate_subscripts(cands, 1) AS pos FROM resolved WHERE status LIKE 'resolved%'),
specs AS (SELECT r.grade, r.status, r.cands, x.spec, s.min_yield, s.min_tensile, s.max_tensile, s.min_elongation,
  CASE WHEN r.status = 'empty' THEN 'empty' WHEN r.status = 'unknown' THEN 'unknown_grade' WHEN r.status = 'ambiguous' THEN 'ambiguous_grade' WHEN x.spec IS NOT NULL THEN 'resolved' ELSE 'unsupported_spec_family' END AS spec_status
  FROM resolved r LEFT JOIN (SELECT grade, min_by(cand, pos) AS spec FROM pairs WHERE cand IN (SELECT spec FROM spec) GROUP BY grade) x ON r.grade = x.grade LEFT JOIN spec s ON s.spec = x.spec)"""


@query(f"WITH {RESOLVED} SELECT grade, status, array_to_string(cands, '|') AS candidates, CASE WHEN status LIKE 'resolved%' THEN cands[1] END AS canonical FROM resolved")
def grade_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_grades(view(spark, sf_dir, CERTS)).withColumn("candidates", F.array_join("candidates", "|"))


@query(f"WITH {RESOLVED} SELECT grade, spec_status, spec, min_yield, min_tensile, max_tensile, min_elongation FROM specs")
def spec_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_specs(resolve.resolve_grades(view(spark, sf_dir, CERTS))).select("grade", "spec_status", "spec", "min_yield", "min_tensile", "max_tensile", "min_elongation")


VALIDATED = f"""WITH {RESOLVED},
b AS (SELECT c.*, s.spec_status, s.spec, s.cands, c.yield_mpa IS NULL AND c.tensile_mpa IS NULL AND c.elongation_pct IS NULL AS nothing,
  coalesce(c.yield_mpa < s.min_yield, false) OR coalesce(c.tensile_mpa < s.min_tensile, false) OR coalesce(c.tensile_mpa > s.max_tensile, false) OR coalesce(s.min_elongation > 0 AND c.elongation_pct < s.min_elongation, false)
  OR coalesce(s.spec = 'SRCDRW02' AND c.yield_mpa > 700, false) OR coalesce(s.spec = 'SRCDRW02' AND c.tensile_mpa < c.yield_mpa, false) AS breached,
  CASE WHEN c.yield_mpa < 80 OR c.yield_mpa > 1500 THEN 18 ELSE 0 END + CASE WHEN c.tensile_mpa < 120 OR c.tensile_mpa > 1800 THEN 18 ELSE 0 END + CASE WHEN c.elongation_pct < 1 OR c.elongation_pct > 80 THEN 18 ELSE 0 END
  + CASE WHEN c.yield_mpa IS NULL THEN 4 ELSE 0 END + CASE WHEN c.tensile_mpa IS NULL THEN 4 ELSE 0 END + CASE WHEN c.elongation_pct IS NULL AND s.min_elongation > 0 THEN 4 ELSE 0 END AS pen
  FROM ({CERTS}) c LEFT JOIN specs s ON c.grade = s.grade),
val AS (SELECT *, CASE WHEN nothing THEN 'NOT_VALIDATED' WHEN category = 'WIRE_ROPE' THEN 'COMPLIANT' WHEN spec_status = 'empty' THEN 'MISSING_CRITICAL_FIELD_GRADE'
  WHEN spec_status = 'unknown_grade' THEN CASE WHEN explicit_grade THEN 'EXPLICIT_UNMAPPED_GRADE' ELSE 'NEEDS_REVIEW' END WHEN spec_status = 'ambiguous_grade' THEN 'NEEDS_REVIEW'
  WHEN spec_status = 'unsupported_spec_family' THEN 'UNSUPPORTED_SPEC_FAMILY' WHEN breached THEN 'NON_COMPLIANT' ELSE 'COMPLIANT' END AS outcome,
  CASE WHEN nothing THEN 0 WHEN category = 'WIRE_ROPE' THEN CASE WHEN tensile_mpa IS NULL THEN 4 WHEN tensile_mpa < 1200 OR tensile_mpa > 2500 THEN 18 ELSE 0 END
  WHEN spec_status = 'empty' THEN 20 WHEN spec_status = 'unknown_grade' THEN CASE WHEN explicit_grade THEN 10 ELSE 20 END WHEN spec_status = 'ambiguous_grade' THEN 15 WHEN spec_status = 'unsupported_spec_family' THEN 10 ELSE pen END AS penalty FROM b)"""


@query(VALIDATED + " SELECT coalesce(CASE WHEN spec_status IN ('resolved', 'unsupported_spec_family') THEN cands[1] END, '-') AS family, outcome, count(*) AS n FROM val GROUP BY ALL")
def row_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by grade family and outcome."""
    rows = validate.validate_rows(view(spark, sf_dir, CERTS))
    return rows.groupBy(F.coalesce("canonical", F.lit("-")).alias("family"), "outcome").agg(F.count("*").alias("n"))


@query(VALIDATED + " SELECT outcome, cast(greatest(5, 100 - penalty) AS bigint) AS confidence_pct, count(*) AS n FROM val GROUP BY ALL")
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validate.validate_rows(view(spark, sf_dir, CERTS))
    return rows.groupBy("outcome", F.round(F.col("confidence") * 100).cast("long").alias("confidence_pct")).agg(F.count("*").alias("n"))


REVIEWS = ", ".join(f"'{o}'" for o in REVIEW_OUTCOMES)


@query(VALIDATED + f""" SELECT doc_id, CASE WHEN bool_or(outcome = 'NON_COMPLIANT') THEN 'NON_COMPLIANT' WHEN bool_or(outcome IN ({REVIEWS})) THEN 'NEEDS_REVIEW' WHEN bool_or(outcome = 'COMPLIANT') THEN 'COMPLIANT' ELSE 'NOT_VALIDATED' END AS doc_outcome, count(*) AS n_rows FROM val GROUP BY doc_id""")
def document_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.document_outcomes(validate.validate_rows(view(spark, sf_dir, CERTS)))


@query(VALIDATED + f""", d AS (SELECT doc_id, bool_or(outcome = 'NON_COMPLIANT' OR outcome IN ({REVIEWS})) AS blocked, min(100 - penalty) AS least, cast(count(*) FILTER (WHERE penalty >= 18) AS bigint) AS doubtful, count(*) AS n FROM val GROUP BY doc_id)
SELECT CASE WHEN blocked THEN 'review_blocking' WHEN least < 80 THEN 'review_confidence' WHEN n >= 2 AND doubtful * 100 >= n * 35 THEN 'review_suspicious' ELSE 'auto_accept' END AS decision, count(*) AS n_docs FROM d GROUP BY 1""")
def review_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(store.review_decisions(validate.validate_rows(view(spark, sf_dir, CERTS))), "decision").withColumnRenamed("n", "n_docs")


@query(f"""WITH h AS (SELECT doc_id, regexp_replace(upper(heat), '[^A-Z0-9]', '', 'g') AS c FROM ({HEATS}) WHERE heat <> ''), x AS (SELECT doc_id, length(c) AS l, length(regexp_replace(c, '[^0-9]', '', 'g')) AS d FROM h),
l AS (SELECT doc_id, l, count(*) AS n FROM x GROUP BY ALL), d AS (SELECT doc_id, d, count(*) AS n FROM x GROUP BY ALL)
SELECT a.doc_id, cast(a.l AS bigint) AS length, cast(b.d AS bigint) AS digits FROM (SELECT doc_id, arg_min(l, (-n, l)) AS l, sum(n) AS t FROM l GROUP BY doc_id) a JOIN (SELECT doc_id, arg_min(d, (-n, d)) AS d FROM d GROUP BY doc_id) b USING (doc_id) WHERE t >= 2""")
def heat_pattern_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.heat_patterns(view(spark, sf_dir, HEATS))


SAME = " OR ".join(f"contains('{g}', a[i]) AND contains('{g}', b[i])" for g in HEAT_LOOKALIKES)


@query(f"""WITH h AS (SELECT DISTINCT doc_id, regexp_replace(upper(heat), '[^A-Z0-9]', '', 'g') AS c FROM ({HEATS}) WHERE heat <> ''),
p AS (SELECT x.doc_id, x.c AS a, y.c AS b FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.c < y.c AND length(x.c) = length(y.c))
SELECT doc_id, a AS heat, b AS other FROM p WHERE len(list_filter(range(1, length(a) + 1), lambda i: NOT (a[i] = b[i] OR {SAME}))) = 0""")
def confusable_heats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document's heat numbers that a scan may confuse."""
    heats = view(spark, sf_dir, HEATS).where("heat <> ''").select("doc_id", text.canonical_identifier(F.col("heat")).alias("heat")).distinct()
    return validate.confusable_pairs(heats)


# --- Row shapes

LONG = f"SELECT doc_id, row_index, cast(s % 3 AS bigint) AS grp, {pick('row_index', shape.PROPERTIES)} AS property, cast(100 + (p * 7 + q) % 500 AS double) AS value FROM ({LINES}) AS x"


@query(f"""WITH l AS (SELECT * FROM ({LONG})), g AS (SELECT doc_id, grp, min(row_index) AS place, {', '.join(f"min_by(value, row_index) FILTER (WHERE property = '{p}') AS {p}" for p in shape.PROPERTIES)} FROM l GROUP BY doc_id, grp),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place, grp) AS n FROM g WHERE {' AND '.join(f'{p} IS NOT NULL' for p in shape.PROPERTIES)}) SELECT doc_id, grp, {', '.join(shape.PROPERTIES)} FROM r WHERE n = 1""")
def vertical_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.collapse_vertical(view(spark, sf_dir, LONG))


@query(f"SELECT property, count(*) AS n, sum(cast(value AS bigint))::bigint AS total FROM (UNPIVOT (SELECT doc_id, yield_mpa, tensile_mpa, elongation_pct FROM ({CERTS})) ON yield_mpa, tensile_mpa, elongation_pct INTO NAME property VALUE value) GROUP BY property")
def mechanical_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.unpivot_properties(view(spark, sf_dir, CERTS), ["doc_id"]).groupBy("property").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("total"))


@query(f"""WITH r AS (SELECT doc_id, trim(heat) AS h FROM ({HEATS})) SELECT doc_id, CASE WHEN count(DISTINCT h) FILTER (WHERE h <> '') = 1 THEN min(h) FILTER (WHERE h <> '') END AS promoted, count(DISTINCT h) FILTER (WHERE h <> '') AS n_values FROM r GROUP BY doc_id""")
def promote_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.promote_unique(view(spark, sf_dir, HEATS), "heat")


CANDIDATES = f"""SELECT doc_id, CASE WHEN l % 2 = 0 THEN 'heat_number' ELSE 'grade' END AS field, cast(s % 4 AS bigint) AS rank, row_index AS ordinal, {pick('p', ('A1', 'a1', 'B2', 'C3'))} AS value FROM ({LINES}) AS x"""


@query(f"""WITH c AS (SELECT * FROM ({CANDIDATES})), b AS (SELECT doc_id, field, rank, min_by(value, ordinal) AS value, count(DISTINCT lower(value)) AS n FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY rank) AS k FROM b)
SELECT doc_id, field, rank, CASE WHEN n = 1 THEN value END AS value, n > 1 AS conflict FROM r WHERE k = 1""")
def candidate_rank_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.choose_ranked(view(spark, sf_dir, CANDIDATES))


@query(f"""WITH r AS (SELECT h.doc_id, h.row_index, h.heat, g.value AS grade FROM ({HEATS}) h JOIN ({CANDIDATES}) g ON h.doc_id = g.doc_id AND h.row_index = g.ordinal), l AS (SELECT doc_id, row_index, 'heat' AS field, heat AS value FROM r UNION ALL SELECT doc_id, row_index, 'grade', grade FROM r)
SELECT doc_id, value, count(DISTINCT row_index) AS n_rows, string_agg(DISTINCT field, '|' ORDER BY field) AS fields FROM l WHERE trim(value) <> '' GROUP BY doc_id, value""")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = view(spark, sf_dir, CANDIDATES).select("doc_id", F.col("ordinal").alias("row_index"), F.col("value").alias("grade"))
    return shape.inverted_index(view(spark, sf_dir, HEATS).join(values, ["doc_id", "row_index"]), ["heat", "grade"])


HEADS = f"SELECT o_orderkey AS doc_id, {pick('o_custkey', ('G1', 'G2', '', 'odd'))} AS value FROM orders"
FILLED = f"SELECT l_orderkey AS doc_id, {pick('l_partkey', ('G1', '', 'G2', 'other'))} AS grade FROM lineitem"


@query(f"""WITH r AS (SELECT f.*, h.value AS head, h.doc_id IS NOT NULL AS has FROM ({FILLED}) f LEFT JOIN ({HEADS}) h ON f.doc_id = h.doc_id)
SELECT CASE WHEN trim(coalesce(grade, '')) = '' AND head LIKE 'G%' THEN head ELSE grade END AS filled, coalesce(trim(grade) <> '' AND grade LIKE 'G%' AND head LIKE 'G%' AND grade <> head, false) AS conflict, count(*) AS n FROM r GROUP BY ALL""")
def header_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = lambda c: F.when(F.col(c).startswith("G"), F.col(c)).alias("canonical")
    rows, heads = view(spark, sf_dir, FILLED).select("*", known("grade")), view(spark, sf_dir, HEADS).select("*", known("value"))
    return counted(shape.propagate_header(rows, heads, "grade", "canonical"), "filled", "conflict")


# --- Selection

PAGES = "SELECT conv_id AS doc_id, turn AS page, cast((length(text) % 97) + CASE WHEN turn % 3 = 0 THEN 80 ELSE 0 END AS bigint) AS score, cast(length(text) AS bigint) AS size FROM conversations"


@query(f"SELECT doc_id, page, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN page = 0 THEN 0 ELSE 1 END, score DESC, page) AS n FROM ({PAGES})) WHERE n <= 3")
def page_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.pages_top_k(view(spark, sf_dir, PAGES), 3).select("doc_id", "page", "score")


STRATA = "SELECT doc_id, lang, CASE WHEN n_chars < 1000 THEN 'single' WHEN n_chars < 4000 THEN 'short' ELSE 'long' END AS bucket FROM documents"


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang, bucket ORDER BY doc_id) AS k FROM ({STRATA})) SELECT cast(row_number() OVER (ORDER BY k, lang, CASE bucket WHEN 'single' THEN 0 WHEN 'short' THEN 1 ELSE 2 END) AS bigint) AS pick, doc_id, lang, bucket FROM r QUALIFY pick <= 60""")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty documents, from each language and length in turn; a report of fixed size."""
    order = F.when(F.col("bucket") == "single", 0).when(F.col("bucket") == "short", 1).otherwise(2)
    return select.round_robin(view(spark, sf_dir, STRATA), ["lang", "bucket"], [F.col("doc_id")], [F.col("lang"), order], 60).withColumn("pick", F.col("pick").cast("long"))


TICKS = "SELECT DISTINCT user_id, cast(event_id % 5000 AS bigint) AS pos FROM events"


@query(f"""WITH d AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 40 THEN 0 ELSE 1 END AS f FROM ({TICKS}) WINDOW w AS (PARTITION BY user_id ORDER BY pos)), g AS (SELECT *, cast(sum(f) OVER (PARTITION BY user_id ORDER BY pos) AS bigint) AS island FROM d)
SELECT user_id, island, cast(floor(sum(pos) / count(*)) AS bigint) AS centre, count(*) AS size FROM g GROUP BY user_id, island""")
def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.islands(view(spark, sf_dir, TICKS), ["user_id"], "pos", 40)


@query(f"""WITH d AS (SELECT user_id, pos AS low, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) AS high FROM ({TICKS})) SELECT user_id, low, high, cast(row_number() OVER (PARTITION BY user_id ORDER BY low, high) - 1 AS bigint) AS band FROM d WHERE high - low >= 8""")
def band_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.bands(view(spark, sf_dir, TICKS), ["user_id"], "pos", 8).withColumn("band", F.col("band").cast("long"))


COSTS = "SELECT o_custkey, o_orderkey, cast(round(o_totalprice) AS bigint) AS cost FROM orders"


@query(f"""WITH b AS (SELECT *, coalesce(cast(sum(cost) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bigint), 0) AS spent_before FROM ({COSTS})) SELECT *, spent_before < 500000 AS live FROM b""")
def budget_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders up to a spend of 500,000."""
    return select.budget_cutoff(view(spark, sf_dir, COSTS), ["o_custkey"], [F.col("o_orderkey")], "cost", 500_000)


@query(f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, size, score) AS k FROM ({PAGES})),
f AS (SELECT doc_id, k, page, size, score, size <= 600 AS taken, CASE WHEN size <= 600 THEN size ELSE 0 END AS used FROM o WHERE k = 1 UNION ALL
  SELECT o.doc_id, o.k, o.page, o.size, o.score, f.used + o.size <= 600, CASE WHEN f.used + o.size <= 600 THEN f.used + o.size ELSE f.used END FROM f JOIN o ON o.doc_id = f.doc_id AND o.k = f.k + 1),
r AS (SELECT *, bool_or(taken) OVER (PARTITION BY doc_id) AS fits, row_number() OVER (PARTITION BY doc_id ORDER BY size, k) AS by_size FROM f)
SELECT doc_id, page, score, size FROM r WHERE taken OR NOT fits AND by_size = 1""")
def evidence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy packing of a conversation's turns into 600 characters."""
    return select.pack_greedy(view(spark, sf_dir, PAGES), "doc_id", ["page"], "size", 600, ["score"])


# --- Evaluation

EVAL = f"""SELECT doc_id, lang, 'quality' AS field, CASE WHEN doc_id % 5 = 0 THEN 'YES' ELSE {pick('doc_id', ('yes', 'no', 'true', ' Y '))} END AS gold, {pick('n_chars', ('yes', '1', 'false', 'No', ''))} AS pred FROM documents"""
YES, NO = ("yes", "y", "true", "1"), ("no", "n", "false", "0")
MATCHED = f"""m AS (SELECT *, lower(trim(gold)) AS g, lower(trim(pred)) AS p FROM ({EVAL})), k AS (SELECT *, CASE WHEN g IN {YES} THEN 'yes' WHEN g IN {NO} THEN 'no' ELSE g END AS gb, CASE WHEN p IN {YES} THEN 'yes' WHEN p IN {NO} THEN 'no' ELSE p END AS pb FROM m),
x AS (SELECT *, gold = pred AS raw, CASE WHEN p = '' THEN false ELSE gb = pb END AS match, CASE WHEN p = '' THEN 'one_missing' WHEN g = p THEN 'exact' ELSE 'semantic' END AS matcher FROM k)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, EVAL).withColumn("m", evaluate.chain(F.col("gold"), F.col("pred"), ["exact", "semantic"]))
    return rows.select("doc_id", "lang", "field", (F.col("gold") == F.col("pred")).alias("raw"), "m.match", "m.matcher", F.lit(True).alias("critical"))


@query(f"WITH {MATCHED} SELECT matcher, match, count(*) AS n FROM x GROUP BY ALL")
def eval_field_matchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(_results(spark, sf_dir), "matcher", "match")


@query(f"WITH {MATCHED} SELECT lang, count(*) AS n, cast(count(*) FILTER (WHERE raw) AS bigint) AS raw_hits, cast(count(*) FILTER (WHERE match) AS bigint) AS hits, cast(count(*) FILTER (WHERE NOT raw AND match) AS bigint) AS harmless, cast(count(*) FILTER (WHERE NOT match) AS bigint) AS critical_misses FROM x GROUP BY GROUPING SETS ((lang), ())")
def eval_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by language, and over all (null)."""
    results = _results(spark, sf_dir)
    return evaluate.metrics(results, ["lang"]).unionByName(evaluate.metrics(results, []).withColumn("lang", F.lit(None).cast("string")))


@query("""SELECT event_type, count(*) AS n, list_sort(list(cast(value * 100 AS bigint)))[1 + cast(round_even(0.95::double * (count(*) - 1), 0) AS bigint)] AS p95 FROM events GROUP BY event_type""")
def latency_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile by nearest rank, from counts of distinct values: no group is collected."""
    cents = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.round(F.col("value") * 100).cast("long").alias("v"))
    return store.nearest_rank(cents, ["event_type"], "v", 0.95).select("event_type", "n", F.col("value").alias("p95"))


# --- Store

RUNS = "SELECT user_id, event_id, event_type, ts FROM events"


@query(f"SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM ({RUNS})) WHERE n <= 5")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's five newest runs."""
    return store.newest(view(spark, sf_dir, RUNS), "user_id", ["ts", "event_id"], 5).select("user_id", "event_id", "event_type")


@query(f"SELECT user_id, max_by(event_type, (ts, event_id)) AS state, count(*) AS n_events FROM ({RUNS}) GROUP BY user_id")
def job_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest_state(view(spark, sf_dir, RUNS), "user_id", "event_type", ["ts", "event_id"])


@query("SELECT source, sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS n_uploads FROM documents GROUP BY source, sha256(text)")
def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored document for each owner and content, the first that came."""
    return store.upsert(spark.read.parquet(f"{sf_dir}/documents.parquet"), "source", "text", "doc_id")


@query("SELECT cast(date_trunc('hour', ts) AS timestamp) AS hour, event_type, count(*) AS n, cast(sum(cast(value * 100 AS bigint)) AS bigint) AS cents FROM events GROUP BY ALL".replace("cast(value * 100 AS bigint)", "cast(round(value * 100) AS bigint)").replace("cast(date_trunc('hour', ts) AS timestamp)", "strftime(ts, '%Y-%m-%d %H')"))
def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


@query("""SELECT 'missing' AS side, doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'extra', doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)""")
def missing_extra_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, known = (spark.read.parquet(f"{sf_dir}/{t}.parquet").select("doc_id") for t in ("documents", "labels"))
    return store.missing_and_extra(docs, known)


@query("""WITH d AS (SELECT doc_id, source, n_chars // 2000 + 1 AS pages, n_chars * 1024 AS bytes FROM documents)
SELECT d.doc_id, d.source, CASE WHEN pages <= 1 THEN 'single' WHEN pages <= 4 THEN 'short' ELSE 'long' END AS page_bucket,
  CASE WHEN bytes < 204800 THEN 'xs' WHEN bytes < 1048576 THEN 's' WHEN bytes < 4194304 THEN 'm' WHEN bytes < 12582912 THEN 'l' ELSE 'xl' END AS size_bucket, l.quality
FROM d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def manifest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, known = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    sized = docs.select("doc_id", "source", (F.floor(F.col("n_chars") / 2000) + 1).alias("pages"), (F.col("n_chars") * 1024).alias("bytes"))
    return store.manifest(sized, known.select("doc_id", "quality"))


# --- Texts and streams


@query("""SELECT conv_id, turn, array_to_string(list_transform(string_split(text, chr(10)), lambda l: array_to_string(list_filter(string_split(l, '. '), lambda s: NOT regexp_matches(s, 'token|(^|[^a-z])the([^a-z]|$)', 'i')), '. ')), chr(10)) AS text FROM conversations""")
def remarks_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that a pattern suppresses go; lines stay."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select("conv_id", "turn", text.drop_sentences(F.col("text"), r"(?i)token|(^|[^a-z])the([^a-z]|$)").alias("text"))


TOKENS = f"SELECT p_partkey, {pick('p_partkey', ('EN 10025-2 / A5', 'EN ISO 15614|a5; A5', 'ASTM A312, G46', 'DIN 1.4301 ; din 1.4301', ''))} AS raw FROM part"


@query(f"""WITH t AS (SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(raw, '[/,;|]'), lambda x: trim(x)), lambda x: x <> '') AS t FROM ({TOKENS})),
d AS (SELECT p_partkey, list_filter(t, lambda x, i: list_position(list_transform(t, lambda y: lower(y)), lower(x)) = i) AS t FROM t)
SELECT p_partkey, array_to_string(list_filter(t, lambda x: regexp_matches(x, '\\b(EN\\s*ISO|EN\\s+[0-9]{{4,}}|AWS|ASTM|ISO|DIN|BS)\\b', 'i')), '|') AS standards, array_to_string(list_filter(t, lambda x: NOT regexp_matches(x, '\\b(EN\\s*ISO|EN\\s+[0-9]{{4,}}|AWS|ASTM|ISO|DIN|BS)\\b', 'i')), '|') AS classifications FROM d""")
def split_standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TOKENS).withColumn("s", text.split_standards(F.col("raw"))).select("p_partkey", F.array_join("s.standards", "|").alias("standards"), F.array_join("s.classifications", "|").alias("classifications"))


REPAIRS = f"SELECT {pick('p_partkey', ('I2,S', 'O 4.5', 'l0', 'abc', '12,345', 'Z9'))} AS raw, p_partkey % 10 >= 3 AS sure FROM part"


@query(f"""WITH r AS (SELECT raw, sure, count(*) AS n FROM ({REPAIRS}) GROUP BY ALL), s AS (SELECT *, replace(raw, ' ', '') AS a FROM r), c AS (SELECT *, CASE WHEN a LIKE '%.%' THEN a ELSE replace(a, ',', '.') END AS b FROM s), t AS (SELECT *, translate(b, 'OoIlSs', '001155') AS t FROM c)
SELECT raw, sure, n, CASE WHEN sure AND regexp_full_match(t, '[0-9.]+') THEN t ELSE b END AS repaired FROM t""")
def ocr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(view(spark, sf_dir, REPAIRS), "raw", "sure").withColumn("repaired", text.repair_number(F.col("raw"), F.col("sure")))


QUALITY = """SELECT doc_id, cast(n_chars % 170 AS double) AS blur, cast(n_chars % 53 AS double) AS noise, n_chars % 4 <> 0 AS has_text,
  CASE WHEN n_chars % 3 = 0 THEN cast(0.01 AS double) ELSE cast(0.3 AS double) END AS text_density, n_chars % 7 = 0 AS noisy_ocr, n_chars % 5 = 0 AS full_page_raster FROM documents"""


@query(f"""WITH q AS (SELECT *, has_text AND text_density >= cast(0.02 AS double) AS dense, text_density < cast(0.02 AS double) AS sparse FROM ({QUALITY})),
c AS (SELECT CASE WHEN noisy_ocr AND full_page_raster THEN 'noisy_scan'
  WHEN dense AND blur >= 80 AND noise < 25 AND (noisy_ocr OR full_page_raster) THEN 'noisy_scan' WHEN dense AND blur >= 80 AND noise < 25 THEN 'digital_clean'
  WHEN blur < 80 AND noise >= 25 AND (blur < 25 OR noise >= 45) THEN 'severe_scan' WHEN blur < 80 AND noise >= 25 THEN 'noisy_scan'
  WHEN blur < 80 AND blur < 25 AND sparse OR blur >= 80 AND noise >= 45 AND sparse THEN 'severe_scan'
  WHEN blur < 80 OR noise >= 25 OR (blur < 150 AND noise >= 14) OR dense THEN 'noisy_scan' ELSE 'scan_clean' END AS quality_class FROM q)
SELECT quality_class, CASE quality_class WHEN 'digital_clean' THEN 'path_a_digital_pdf' WHEN 'scan_clean' THEN 'path_b_clean_scan' WHEN 'noisy_scan' THEN 'path_c_noisy_scan' ELSE 'path_d_severe_scan' END AS route,
  CASE quality_class WHEN 'digital_clean' THEN 'native_multimodal' WHEN 'scan_clean' THEN 'rendered_multimodal' ELSE 'preprocessed_multimodal' END AS runtime_route, quality_class = 'severe_scan' AS review_first, count(*) AS n FROM c GROUP BY ALL""")
def quality_class_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(store.route(view(spark, sf_dir, QUALITY)), "quality_class", "route", "runtime_route", "review_first")


@query(f"""WITH d AS (SELECT d.doc_id, lang, d.n_chars % 97 AS score FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS k FROM d)
SELECT cast(row_number() OVER (ORDER BY k, lang) AS bigint) AS pick, doc_id, lang, score FROM r QUALIFY pick <= 40""")
def score_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty next documents without labels, from each language in turn, best score first."""
    docs, known = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rest = docs.select("doc_id", "lang", (F.col("n_chars") % 97).alias("score")).join(known.select("doc_id"), "doc_id", "left_anti")
    return select.round_robin(rest, ["lang"], [F.desc("score"), F.col("doc_id")], [F.col("lang")], 40).withColumn("pick", F.col("pick").cast("long"))


OUTCOME = pick("l", ("COMPLIANT", "COMPLIANT", "COMPLIANT", "NON_COMPLIANT", "NEEDS_REVIEW", "COMPLIANT", "COMPLIANT"))
IDENTIFIERS = f"""SELECT doc_id, row_index, {pick('p', ('H1', 'H1', None, 'H1'))} AS heat, cast(60 + (s * 7 + q) % 41 AS bigint) AS heat_pct,
  {pick('s', ('', None, 'B2'))} AS batch, CASE WHEN q % 2 = 0 THEN cast(70 + s % 30 AS bigint) END AS batch_pct, {OUTCOME} AS outcome FROM ({LINES}) AS x"""
HEADINGS = f"SELECT o_orderkey AS doc_id, {pick('o_custkey', ('B9', '', None))} AS batch, cast(75 + o_custkey % 20 AS bigint) AS batch_pct FROM orders"
TRACED = f"""WITH h AS (SELECT doc_id, CASE WHEN trim(batch) <> '' AND batch_pct >= 80 THEN batch END AS b, CASE WHEN trim(batch) <> '' AND batch_pct >= 80 THEN batch_pct END AS bp FROM ({HEADINGS})),
r AS (SELECT i.doc_id, row_index, outcome, CASE WHEN trim(heat) <> '' AND heat_pct >= 80 THEN heat END AS vh, CASE WHEN trim(heat) <> '' AND heat_pct >= 80 THEN heat_pct END AS ph,
  CASE WHEN trim(batch) <> '' AND batch_pct >= 80 THEN batch ELSE b END AS vb, CASE WHEN trim(batch) <> '' AND batch_pct >= 80 THEN batch_pct ELSE bp END AS pb, b, bp FROM ({IDENTIFIERS}) i LEFT JOIN h ON i.doc_id = h.doc_id),
t AS (SELECT *, vh IS NOT NULL OR vb IS NOT NULL AS ok, CASE WHEN outcome = 'COMPLIANT' AND vh IS NULL AND vb IS NULL THEN 'NEEDS_REVIEW' ELSE outcome END AS now FROM r)"""


@query(f"""{TRACED} SELECT doc_id, CASE WHEN known THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS status, heat, cast(coalesce(least(hp, bp), 0) AS bigint) AS traceability_pct,
  CASE WHEN bad THEN 'NON_COMPLIANT' WHEN open THEN 'NEEDS_REVIEW' WHEN good AND known THEN 'COMPLIANT' WHEN good THEN 'NEEDS_REVIEW' ELSE 'NOT_VALIDATED' END AS outcome, n_downgraded
FROM (SELECT *, heat IS NOT NULL OR b IS NOT NULL AS known, CASE WHEN heat IS NOT NULL THEN ph END AS hp FROM (
  SELECT doc_id, CASE WHEN bool_and(vh IS NOT NULL) AND count(DISTINCT vh) = 1 THEN min(vh) END AS heat, min(ph) AS ph, min(b) AS b, min(bp) AS bp, count(*) FILTER (WHERE now <> outcome) AS n_downgraded,
    bool_or(now = 'NON_COMPLIANT') AS bad, bool_or(now = 'NEEDS_REVIEW') AS open, bool_or(now = 'COMPLIANT') AS good FROM t GROUP BY doc_id))""")
def traceability_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's verified identifiers, and its outcome once rows without any are downgraded."""
    _, docs = store.trace(view(spark, sf_dir, IDENTIFIERS), view(spark, sf_dir, HEADINGS), ["heat"], ["batch"])
    return docs


@query(f"""{TRACED} SELECT doc_id, row_index, vh AS heat, vb AS batch, CASE WHEN ok THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS status, cast(coalesce(least(ph, pb), 0) AS bigint) AS traceability_pct, now AS outcome, now <> outcome AS downgraded FROM t""")
def traceability_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's verified identifiers, its own or else its document's."""
    rows, _ = store.trace(view(spark, sf_dir, IDENTIFIERS), view(spark, sf_dir, HEADINGS), ["heat"], ["batch"])
    return rows


CHEMISTRY = f"SELECT p_partkey % 200 AS item, p_partkey AS ordinal, {pick('p_partkey', ('Carbon', 'si', 'Mn ', 'Chromium', 'Ni.', ' gold ', 'P', 'copper', 'al', 'VANADIUM'))} AS name, {pick('p_size', ('0,12 %', '1.5', 'n/a', '.3', ''))} AS raw FROM part"


@query(f"""WITH r AS (SELECT item, ordinal, trim(name) AS name, regexp_replace(upper(name), '[^A-Z0-9]', '', 'g') AS k, try_cast(replace(replace(replace(raw, '%', ''), ' ', ''), ',', '.') AS double) AS v FROM ({CHEMISTRY})),
m AS (SELECT item, coalesce(symbol, r.name) AS symbol, arg_max(v, ordinal) AS v FROM r LEFT JOIN {values_sql(ELEMENT_ROWS, 'name, symbol')} ON k = t.name WHERE v IS NOT NULL GROUP BY ALL)
SELECT item, string_agg(symbol || '=' || cast(cast(round(v * 1000) AS bigint) AS string), ',' ORDER BY symbol || '=') AS composition FROM m GROUP BY item""")
def chemical_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element values of each item, in thousandths; the last value of an element counts, and other names stay."""
    rows = view(spark, sf_dir, CHEMISTRY).withColumn("k", text.canonical_identifier(F.col("name"))).withColumn("v", numeric.parse_chemistry(F.col("raw"))).where("v IS NOT NULL")
    named = rows.join(F.broadcast(elements(spark)).withColumnRenamed("name", "k"), "k", "left").withColumn("symbol", F.coalesce("symbol", F.trim("name")))
    best = named.groupBy("item", "symbol").agg(F.max_by("v", "ordinal").alias("v"))
    pair = F.concat_ws("=", "symbol", F.round(F.col("v") * 1000).cast("long").cast("string"))
    return best.groupBy("item").agg(F.array_join(F.sort_array(F.collect_list(pair)), ",").alias("composition"))


@query("""WITH e AS (SELECT user_id AS job_id, CASE WHEN event_id % 97 = 0 THEN 'succeeded' ELSE event_type END AS status, ts, event_id FROM events)
SELECT job_id, coalesce(arg_min(status, (ts, event_id)) FILTER (WHERE status IN ('succeeded', 'failed', 'cancelled')), arg_max(status, (ts, event_id))) AS status, count(*) AS n_events FROM e GROUP BY job_id""")
def stream_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job states from the events as a stream of files, read once until it is used up."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = jobs.event_stream(spark, f"{sf_dir}/events.parquet*", schema)
    states = jobs.job_states(events.select(F.col("user_id").alias("job_id"), F.when(F.col("event_id") % 97 == 0, "succeeded").otherwise(F.col("event_type")).alias("status"), "ts", "event_id"))
    return jobs.drain(states, "job_id")


# --- Confidence, dates and summaries

DOCS = f"""SELECT doc_id, n_chars, cast(n_chars % 101 AS bigint) AS raw_pct, cast(90 AS bigint) AS score_pct, cast(n_chars % 200 AS double) AS blur, cast(n_chars % 40 AS double) AS noise, cast(n_chars % 99 AS bigint) AS missing_pct,
  cast(doc_id % 5 AS bigint) AS n_suspicious, cast(doc_id % 7 AS bigint) AS n_items, cast(CASE WHEN doc_id % 11 = 0 THEN 0 ELSE doc_id % 7 END AS bigint) AS n_reported, cast(n_chars % 3 AS bigint) AS n_unresolved,
  n_chars % 2 = 0 AS table_found, doc_id % 4 <> 0 AS understood, doc_id % 9 = 0 AS low_identifier,
  {pick('doc_id', ('numeric_uncertain:yield', 'header_row_conflict:heat', 'low_confidence:grade', 'document_quality:ocr', 'other', 'Confidence  below', 'unresolved_spec'))} AS t1,
  {pick('n_chars', ('numeric_promoted_thousands:rm', '', 'header_row_conflict:2', 'confidence_below_threshold', 'OCR text corrupted', 'validation_conflict:x'))} AS t2 FROM documents"""
TOKEN = "CASE WHEN {0} LIKE 'numeric_uncertain:%' THEN 10 WHEN {0} LIKE 'numeric_promoted_thousands:%' THEN 5 WHEN {0} LIKE 'header_row_conflict:%' THEN 8 ELSE 0 END"


@query(f"""WITH d AS (SELECT *, CASE WHEN raw_pct <> 0 THEN raw_pct ELSE score_pct END AS st, greatest(n_items, 1) AS n FROM ({DOCS})),
c AS (SELECT *, st - CASE WHEN n_items = 0 THEN 18 ELSE 0 END - CASE WHEN blur < 30 THEN 15 WHEN blur < 80 THEN 8 WHEN blur < 150 AND missing_pct < 40 THEN 4 WHEN blur < 150 THEN 8 ELSE 0 END
  - CASE WHEN noise >= 25 THEN 12 WHEN noise >= 14 THEN 6 ELSE 0 END - CASE WHEN n_reported <> n_items THEN 10 ELSE 0 END - CASE WHEN missing_pct >= 80 THEN 12 WHEN missing_pct >= 50 THEN 6 ELSE 0 END
  - least(24, 7 * n_suspicious) - least(8, 3 * n_unresolved) AS adjusted,
  least(CASE WHEN blur < 30 THEN 50 WHEN blur < 80 THEN 70 WHEN blur < 150 AND missing_pct >= 40 THEN 70 ELSE 100 END, CASE WHEN noise >= 25 THEN 55 WHEN noise >= 14 THEN 75 ELSE 100 END,
    CASE WHEN table_found AND n_reported = 0 THEN 32 ELSE 100 END, CASE WHEN n_reported <> n_items THEN 50 ELSE 100 END, CASE WHEN low_identifier THEN 70 ELSE 100 END,
    CASE WHEN missing_pct >= 80 THEN 50 WHEN missing_pct >= 50 THEN 70 ELSE 100 END, CASE WHEN n_suspicious > 0 THEN 45 ELSE 100 END, CASE WHEN understood AND n_items = 0 THEN 35 ELSE 100 END) AS cap FROM d)
SELECT doc_id, cast(greatest(5, least(100, adjusted, cap)) AS bigint) AS confidence_pct, cast(greatest(5, least(100, st)) AS bigint) AS extraction_pct,
  cast(greatest(5, 100 - least(45, {TOKEN.format('t1')} + {TOKEN.format('t2')})) AS bigint) AS normalization_pct,
  cast(greatest(5, least(100, (n - n_unresolved) * 100 // n)) AS bigint) AS spec_resolution_pct, cast(greatest(5, (4 * n - n_suspicious) * 25 // n) AS bigint) AS validation_pct FROM c""")
def document_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = view(spark, sf_dir, DOCS).withColumn("tokens", F.filter(F.array("t1", "t2"), lambda t: t != ""))
    return confidence.document_confidence(docs).select("doc_id", "confidence_pct", "extraction_pct", "normalization_pct", "spec_resolution_pct", "validation_pct")


ONLY = "(lower(trim({0})) IN ('confidence falls below threshold', 'confidence_below_threshold', 'low_confidence', 'overall_decision_confidence_below_threshold') OR lower(trim({0})) LIKE 'low_confidence:%')"
SOFTS = "({0} LIKE 'document_quality:%' OR (lower({0}) LIKE '%ocr%' AND lower({0}) LIKE '%corrupt%'))"
BLOCKS = "({0} IN ('unresolved_spec') OR {0} LIKE 'header_row_conflict:%' OR {0} LIKE 'validation_conflict:%')"


@query(f"""WITH t AS (SELECT DISTINCT doc_id, unnest([t1, t2]) AS t FROM ({DOCS})) SELECT CASE WHEN {ONLY.format('t')} THEN 'confidence_only' WHEN {SOFTS.format('t')} THEN 'soft' WHEN {BLOCKS.format('t')} THEN 'blocking' END AS kind, count(*) AS n FROM t WHERE t <> '' GROUP BY 1 HAVING kind IS NOT NULL""")
def reason_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = view(spark, sf_dir, DOCS).select(confidence.classify_tokens(F.filter(F.array("t1", "t2"), lambda t: t != "")).alias("k"))
    sizes = kinds.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.size(f"k.{k}").cast("long").alias("n")) for k in ("confidence_only", "soft", "blocking")))).alias("s"))
    return sizes.groupBy("s.kind").agg(F.sum("s.n").alias("n")).where("n > 0")


HOLDS = {
    "critical_fields_present": "missing_pct < 90", "traceability_verified": "NOT low_identifier", "row_alignment_verified": "n_reported = n_items", "validation_passed": "n_suspicious < 3",
    "document_quality_acceptable": "blur >= 25", "no_blocking_reasons": f"NOT ({BLOCKS.format('t1')} OR {BLOCKS.format('t2')})", "confidence_acceptable": "raw_pct >= 30", "supported_document_type": "understood",
}


@query(f"""SELECT doc_id, concat_ws('|', {', '.join(f"CASE WHEN NOT ({c}) THEN '{n}' END" for n, c in HOLDS.items())}) AS missing,
CASE WHEN {' AND '.join(f'({c})' for c in HOLDS.values())} THEN 'auto_accept' ELSE 'review_required' END AS decision FROM ({DOCS})""")
def auto_accept_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    criteria = {n: F.expr(c) for n, c in HOLDS.items()}
    criteria["no_blocking_reasons"] = F.size(F.filter(F.array("t1", "t2"), confidence.is_blocking)) == 0
    return confidence.auto_accept(view(spark, sf_dir, DOCS), criteria).select("doc_id", F.array_join("missing_evidence", "|").alias("missing"), "decision")


LABELLED = f"SELECT doc_id, row_index AS ordinal, {pick('p', ('Date of issue', 'inspection date', ' DATE', 'print date'))} AS label, cast(2000 + s % 20 AS string) || '-01-0' || cast(1 + l AS string) AS value FROM ({LINES}) AS x"


@query(f"""SELECT doc_id, min_by(value, (k, ordinal)) AS value FROM (SELECT *, CASE lower(trim(label)) WHEN 'date of issue' THEN 0 WHEN 'date' THEN 1 WHEN 'inspection date' THEN 2 END AS k FROM ({LABELLED})) WHERE k IS NOT NULL GROUP BY doc_id""")
def certificate_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's labelled date of the best label."""
    return shape.resolve_date(view(spark, sf_dir, LABELLED), {"date of issue": 0, "date": 1, "inspection date": 2})


ITEMS = f"SELECT doc_id, row_index, {pick('p', ('7', '', 'N/A', None))} AS item_id, {pick('s', ('', 'B1', None))} AS batch, {pick('q', ('', 'C9', 'C8'))} AS charge FROM ({LINES}) AS x"


@query(f"""SELECT doc_id, row_index, CASE WHEN coalesce(lower(trim(item_id)), '') IN ('', '-', 'n/a', 'none', 'null', 'unknown') THEN cast(row_index + 1 AS string) ELSE item_id END AS item_id, coalesce(nullif(trim(batch), ''), nullif(trim(charge), '')) AS heat FROM ({ITEMS})""")
def item_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shape.sequential_ids(view(spark, sf_dir, ITEMS))
    return rows.select("doc_id", "row_index", "item_id", shape.heat_alias(["batch", "charge"]).alias("heat"))


HEADER = f"SELECT o_orderkey AS doc_id, {pick('o_custkey', ('H9', ''))} AS batch FROM orders"


@query(f"""WITH r AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM ({ITEMS})) SELECT r.doc_id, row_index, CASE WHEN trim(coalesce(r.batch, '')) = '' AND n = 1 THEN coalesce(h.batch, r.batch) ELSE r.batch END AS batch FROM r LEFT JOIN ({HEADER}) h ON r.doc_id = h.doc_id""")
def backfill_single_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.backfill_single(view(spark, sf_dir, ITEMS), view(spark, sf_dir, HEADER), ["batch"]).select("doc_id", "row_index", "batch")


@query(VALIDATED + """ SELECT doc_id, count(*) AS n_rows, count(*) FILTER (WHERE yield_mpa IS NULL) AS missing_yield_mpa, count(*) FILTER (WHERE tensile_mpa IS NULL) AS missing_tensile_mpa, count(*) FILTER (WHERE elongation_pct IS NULL) AS missing_elongation_pct, string_agg(DISTINCT outcome, '|' ORDER BY outcome) AS outcomes FROM val GROUP BY doc_id""")
def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.document_summary(validate.validate_rows(view(spark, sf_dir, CERTS)))


FILES = f"SELECT page_id, lower(url) AS name, {pick('page_id', ('S355 - DIAM 5', 'WIRE 12 mm spool', 'ROD', 'No 12345 07/10/2024', '1/2/24 and 3/2/24'))} AS raw FROM pages"


@query(f"""SELECT page_id, CASE WHEN regexp_matches(name, 'blog') THEN 'blog' WHEN regexp_matches(name, '^https') THEN 'secure' WHEN regexp_matches(name, 'www') THEN 'www' ELSE 'unknown' END AS hint,
{pick('page_id', ('S355', 'WIRE', 'ROD', 'No 12345 07/10/2024', '1/2/24 and 3/2/24'))} AS product, {pick('page_id', (None, None, None, '12345', None))} AS identifier, {pick('page_id', (None, None, None, '07/10/2024', None))} AS day, page_id % 5 = 4 AS conflict FROM ({FILES})""".replace("WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN '12345'", "WHEN 0 THEN 'S355' WHEN 3 THEN '12345'"))
def supplier_hint_and_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of ordered hints in a name, a product without its details, and an identifier beside a date."""
    rows = view(spark, sf_dir, FILES).withColumn("s", text.split_identifier_and_date(F.col("raw")))
    hint = text.first_match(F.col("name"), [("blog", "blog"), ("^https", "secure"), ("www", "www")])
    return rows.select("page_id", hint.alias("hint"), text.split_details(F.col("raw"))["product"].alias("product"), "s.identifier", F.col("s.date").alias("day"), "s.conflict")


# --- Profiles, lists and batches

SCANS = """SELECT conv_id AS doc_id, turn AS page, cast(length(text) % 160 AS double) AS blur, cast(length(text) % 30 AS double) AS noise, turn % 2 = 0 AS has_table, cast(length(text) AS bigint) AS size FROM conversations"""
STATE = """CASE WHEN blur < 80 AND noise >= 25 THEN 'noisy_and_blurry' WHEN noise >= 25 THEN 'noisy' WHEN blur < 80 THEN 'blurry'
  WHEN blur < 150 AND noise >= 14 THEN 'noisy_and_blurry' WHEN noise >= 14 THEN 'noisy' WHEN blur < 150 THEN 'blurry' ELSE 'clean' END"""
CHOSEN = "CASE state WHEN 'clean' THEN 'full_gray|contrast' WHEN 'noisy' THEN 'denoised|contrast' WHEN 'blurry' THEN 'contrast' ELSE 'denoised|contrast' END || CASE WHEN has_table THEN '|table_crop' ELSE '' END || CASE WHEN state = 'clean' THEN '' ELSE '|full_gray' END"


@query(f"""WITH s AS (SELECT *, {STATE} AS state FROM ({SCANS})) SELECT doc_id, page, cast(round((CASE WHEN page = 0 THEN 100 ELSE 0 END + CASE WHEN has_table THEN 80 ELSE 0 END + least(blur / 10, 20) + 10 - 2 * page) * 10) AS bigint) AS score_tenths, state,
{CHOSEN} AS selected, CASE state WHEN 'noisy' THEN 'denoised' ELSE 'contrast' END AS variant, cast(floor((size * 4 + 2) / 3.0) AS bigint) + 182 AS bytes FROM s""")
def page_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's score, condition, variants (of four that are available) and encoded size."""
    score = profile.page_score(F.col("page"), F.col("has_table"), F.col("blur"), F.lit(1))
    pages = view(spark, sf_dir, SCANS).withColumn("state", profile.condition(F.col("blur"), F.col("noise")))
    available = F.array(*map(F.lit, ("contrast", "denoised", "full_gray", "table_crop")))
    pages = pages.withColumn("selected", profile.selected_variants(F.col("state"), available, F.col("has_table"))).withColumn("variant", profile.primary_variant(F.col("state"), F.col("selected")))
    return pages.select("doc_id", "page", F.round(score * 10).cast("long").alias("score_tenths"), "state", F.array_join("selected", "|").alias("selected"), "variant", profile.request_bytes(F.col("size")).cast("long").alias("bytes"))


CONDITIONS = ("clean", "noisy", "blurry", "noisy_and_blurry")


@query(f"""WITH s AS (SELECT *, {STATE} AS state FROM ({SCANS})), w AS (SELECT doc_id, min(blur) AS blur, max(noise) AS noise, bool_or(has_table) AS has_table FROM s WHERE page < 2 GROUP BY doc_id),
c AS (SELECT doc_id, state, count(*) AS n FROM s GROUP BY ALL), d AS (SELECT doc_id, arg_max(state, (n, -list_position({list(CONDITIONS)}, state))) AS state FROM c GROUP BY doc_id) SELECT d.doc_id, blur, noise, has_table, state FROM d LEFT JOIN w ON d.doc_id = w.doc_id""")
def document_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst of the first pages, and the commonest condition of all."""
    pages = view(spark, sf_dir, SCANS).withColumn("state", profile.condition(F.col("blur"), F.col("noise")))
    return profile.dominant(pages, "state", CONDITIONS).join(profile.worst_pages(pages), "doc_id", "left").select("doc_id", "blur", "noise", "has_table", "state")


GATED = f"SELECT {pick('p', ('H1', '', 'H2', None))} AS heat, CASE cast(s % 4 AS int) WHEN 0 THEN NULL ELSE cast(s % 100 AS double) / 100 END AS sure, q % 2 = 0 AS degraded FROM ({LINES}) AS x"


@query(f"""SELECT CASE WHEN sure < cast(0.8 AS double) OR sure IS NULL AND degraded THEN NULL ELSE heat END AS value, CASE WHEN trim(heat) <> '' THEN CASE WHEN sure < cast(0.8 AS double) THEN 'low_confidence' WHEN sure IS NULL AND degraded THEN 'missing_confidence' END END AS event, count(*) AS n FROM ({GATED}) GROUP BY ALL""")
def identifier_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(view(spark, sf_dir, GATED).select(profile.identifier_gate(F.col("heat"), F.col("sure"), F.col("degraded")).alias("g")).select("g.*"), "value", "event")


@query(f"""WITH c AS (SELECT doc_id, count(*) AS n_rows, count(*) FILTER (WHERE p % 3 = 0) AS n_suspicious FROM ({LINES}) GROUP BY doc_id) SELECT *, CASE WHEN n_rows >= 2 AND n_suspicious * 100 >= n_rows * 35 THEN 'suspicious_rows' END AS token FROM c""")
def suspicious_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.suspicious_share(view(spark, sf_dir, LINES).withColumn("needs_review", F.col("p") % 3 == 0))


@query(f"""SELECT doc_id, cast(round(n_in * cast(0.16 AS double) + n_out * cast(0.48 AS double)) AS bigint) AS usd_millionths FROM (SELECT doc_id, n_chars * 3 AS n_in, n_chars % 1000 AS n_out FROM documents)""")
def estimated_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", profile.spend_usd_millionths(F.col("n_chars") * 3, F.col("n_chars") % 1000).alias("usd_millionths"))


PAIRS = f"SELECT p_partkey, {pick('p_partkey', ('S355', 'NOVOFIL SG2', 's195', '', 'X65'))} AS gold, {pick('p_size', ('s355', 'SG2', 'S195T', 'L450', ''))} AS pred, {pick('p_partkey', ('1|2', 'a|b', '3', ''))} AS gold_list, {pick('p_size', ('2|1', '1|2', 'B|a', '3.5'))} AS pred_list, p_partkey % 3 = 0 AS gold_review, p_size % 2 = 0 AS pred_review FROM part"
EVAL_ALIASES = {"SG2": ("NOVOFIL SG2", "NOVOBRONZE SG2"), "S195": ("S195T",), "API 5L X65": ("X65", "L450")}
FAMILY = "CASE " + " ".join(f"WHEN {{0}} IN ({', '.join(repr(n.lower()) for n in (c, *a))}) THEN '{c}'" for c, a in EVAL_ALIASES.items()) + " ELSE {0} END"


@query(f"""WITH p AS (SELECT *, lower(trim(gold)) AS g, lower(trim(pred)) AS q, string_split(gold_list, '|') AS gl, string_split(pred_list, '|') AS pl FROM ({PAIRS})),
n AS (SELECT *, list_sort(list_transform(gl, lambda x: try_cast(x AS double))) AS gn, list_sort(list_transform(pl, lambda x: try_cast(x AS double))) AS pn FROM p)
SELECT g <> '' AND q <> '' AND ({FAMILY.format('g')}) = ({FAMILY.format('q')}) AS grade_match, list_transform(gl, lambda x: lower(trim(x))) = list_transform(pl, lambda x: lower(trim(x))) AS by_place,
len(gl) = len(pl) AND CASE WHEN len(list_filter(gn, lambda x: x IS NULL)) + len(list_filter(pn, lambda x: x IS NULL)) = 0 THEN len(list_filter(list_zip(gn, pn), lambda z: abs(z[1] - z[2]) > 1)) = 0
  ELSE list_sort(list_transform(gl, lambda x: lower(trim(x)))) = list_sort(list_transform(pl, lambda x: lower(trim(x)))) END AS sorted_match,
gold_review AND NOT pred_review AS unsafe, NOT gold_review AND pred_review AS fail_closed, count(*) AS n FROM n GROUP BY ALL""")
def eval_lists_and_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades by alias sets, lists by place and in order, and review flags."""
    rows = view(spark, sf_dir, PAIRS).withColumn("gl", F.split("gold_list", r"\|")).withColumn("pl", F.split("pred_list", r"\|"))
    gold, pred, gl, pl = (F.col(c) for c in ("gold", "pred", "gl", "pl"))
    flags = evaluate.review_flags(F.col("gold_review"), F.col("pred_review"))
    out = rows.select(evaluate.grade_alias(gold, pred, EVAL_ALIASES).alias("grade_match"), evaluate.lists_by_place(gl, pl).alias("by_place"), evaluate.lists_sorted(gl, pl).alias("sorted_match"), flags.alias("f"))
    return counted(out.select("grade_match", "by_place", "sorted_match", "f.unsafe", "f.fail_closed"), "grade_match", "by_place", "sorted_match", "unsafe", "fail_closed")


BATCH = f"SELECT {pick('event_id', ('ok', 'ok', 'error', 'ok', 'dry'))} AS status, {pick('user_id', ('digital', '', 'scan'))} AS bucket, event_id % 3 = 0 AS review, cast(round(value * 10) AS bigint) AS latency_ms FROM events"


@query(f"""SELECT bucket, count(*) AS n, count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) FILTER (WHERE status = 'error') AS n_error, count(*) FILTER (WHERE status = 'ok' AND review) AS n_review,
cast(sum(latency_ms) FILTER (WHERE status = 'ok') AS bigint) AS latency_sum, max(latency_ms) FILTER (WHERE status = 'ok') AS latency_max FROM (SELECT *, CASE WHEN trim(bucket) <> '' THEN bucket ELSE 'unknown' END AS bucket FROM (SELECT status, bucket AS b, review, latency_ms FROM ({BATCH})) AS y(status, bucket, review, latency_ms)) GROUP BY GROUPING SETS ((bucket), ())""".replace("SELECT *, CASE WHEN trim(bucket) <> '' THEN bucket ELSE 'unknown' END AS bucket", "SELECT status, review, latency_ms, CASE WHEN trim(bucket) <> '' THEN bucket ELSE 'unknown' END AS bucket"))
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.batch_summary(view(spark, sf_dir, BATCH))
