"""Gold against predictions: matchers as Column rules, chains, and grouped metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certlake.functions.numeric import dimension_signature, parse_first, parse_unit, unit_of
from certlake.functions.text import normalize_exact, normalize_supplier, parse_date, token_overlap

# Synonym buckets; the first bucket that holds a value wins.
BUCKETS: dict[str, tuple[str, ...]] = {
    "yes": ("yes", "y", "true", "1"),
    "no": ("no", "n", "false", "0"),
    "review": ("review", "needs_review", "manual_review"),
    "auto_accept": ("auto_accept", "accepted", "pass"),
    "compliant": ("compliant", "ok", "conform", "conforming"),
    "non_compliant": ("non_compliant", "fail", "nonconforming", "non conforming"),
    "mill test certificate": ("mill test certificate", "mtc", "mill certificate", "test certificate"),
    "certificate of analysis": ("certificate of analysis", "coa", "cert of analysis"),
    "cif": ("cif", "cost insurance freight"),
    "fob": ("fob", "free on board"),
    "exw": ("exw", "ex works"),
}


def bucket(value: Column) -> Column:
    text = normalize_exact(value)
    out = F.when(text == "", F.lit(None).cast("string"))
    for name, words in BUCKETS.items():
        out = out.when(text.isin(*words), name)
    return out.otherwise(text)


def _near(a: Column, b: Column, absolute: float, relative: float) -> Column:
    gap = F.abs(a - b)
    return (gap <= absolute) | (gap / F.greatest(F.abs(a), F.lit(1e-9)) <= relative)


def exact(gold: Column, pred: Column) -> Column:
    return normalize_exact(gold) == normalize_exact(pred)


def semantic(gold: Column, pred: Column) -> Column:
    return F.coalesce(bucket(gold) == bucket(pred), F.lit(False))


def numeric(gold: Column, pred: Column, absolute: float = 1.0, relative: float = 0.0) -> Column:
    """Within tolerance; values with units are left to the unit rule."""
    plain = (unit_of(gold) == "") & (unit_of(pred) == "")
    return F.coalesce(plain & _near(parse_first(gold), parse_first(pred), absolute, relative), F.lit(False))


def unit(gold: Column, pred: Column, absolute: float = 0.001, relative: float = 0.0) -> Column:
    """Equal in kilograms, else near in one unit."""
    a, b = parse_unit(gold), parse_unit(pred)
    mass = a["kg"].isNotNull() & b["kg"].isNotNull()
    return F.coalesce(F.when(mass, _near(a["kg"], b["kg"], absolute, relative)).otherwise((a["unit"] == b["unit"]) & _near(a["value"], b["value"], absolute, relative)), F.lit(False))


def dates(gold: Column, pred: Column) -> Column:
    return F.coalesce(parse_date(gold) == parse_date(pred), F.lit(False))


def supplier(gold: Column, pred: Column, least: float = 95.0) -> Column:
    return token_overlap(normalize_supplier(gold), normalize_supplier(pred)) >= least


def identifier(gold: Column, pred: Column) -> Column:
    return F.trim(F.coalesce(gold, F.lit(""))) == F.trim(F.coalesce(pred, F.lit("")))


def dimension(gold: Column, pred: Column) -> Column:
    return F.coalesce(dimension_signature(gold) == dimension_signature(pred), F.lit(False))


MATCHERS = {"exact": exact, "semantic": semantic, "numeric": numeric, "unit": unit, "date": dates, "supplier": supplier, "identifier": identifier, "dimension": dimension}


def chain(gold: Column, pred: Column, names: list[str]) -> Column:
    """struct<match, matcher>: the first matcher of the chain that accepts, else the last one's refusal.  Two
    missing values agree, one missing value does not."""
    gone = [F.coalesce(F.trim(c), F.lit("")) == "" for c in (gold, pred)]
    rules = F.when(gone[0] & gone[1], F.struct(F.lit(True).alias("match"), F.lit("both_missing").alias("matcher"))).when(gone[0] | gone[1], F.struct(F.lit(False).alias("match"), F.lit("one_missing").alias("matcher")))
    for name in names:
        rules = rules.when(MATCHERS[name](gold, pred), F.struct(F.lit(True).alias("match"), F.lit(name).alias("matcher")))
    return rules.otherwise(F.struct(F.lit(False).alias("match"), F.lit(names[-1]).alias("matcher")))


def metrics(results: DataFrame, by: list[str]) -> DataFrame:
    """Counts and hits of compared fields (raw, match, critical) by group."""
    yes = lambda c: F.count_if(c)
    return results.groupBy(*by).agg(
        F.count("*").alias("n"), yes(F.col("raw")).alias("raw_hits"), yes(F.col("match")).alias("hits"),
        yes(~F.col("raw") & F.col("match")).alias("harmless"), yes(~F.col("match") & F.col("critical")).alias("critical_misses"),
    )


def alias_sets(value: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    """The value and, where it is a canonical grade or an alias, all names of that grade."""
    text = normalize_exact(value)
    known = F.lit(None).cast("array<string>")
    for canonical, names in aliases.items():
        family = sorted({canonical.lower(), *(n.lower() for n in names)})
        known = F.when(text.isin(*family), F.array(*map(F.lit, family))).otherwise(known)
    return F.array_distinct(F.concat(F.array(text), F.coalesce(known, F.array().cast("array<string>"))))


def grade_alias(gold: Column, pred: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    a, b = normalize_exact(gold), normalize_exact(pred)
    return (a != "") & (b != "") & F.arrays_overlap(alias_sets(gold, aliases), alias_sets(pred, aliases))


def safe_decision(gold: Column, pred: Column) -> Column:
    """A gold review must never be accepted automatically; otherwise the texts decide."""
    return F.coalesce(~((bucket(gold) == "review") & (bucket(pred) == "auto_accept")) & exact(gold, pred), F.lit(False))


def lists_by_place(gold: Column, pred: Column, matcher=exact) -> Column:
    """Equal length and every pair accepted, place by place."""
    return F.coalesce((F.size(gold) == F.size(pred)) & F.forall(F.zip_with(gold, pred, matcher), lambda x: x), F.lit(False))


def lists_sorted(gold: Column, pred: Column, tolerance: float = 1.0) -> Column:
    """Equal length; numbers in order within the tolerance if all are numbers, else normalised texts in order."""
    numbers = [F.array_sort(F.transform(v, lambda x: x.try_cast("double"))) for v in (gold, pred)]
    numeric_ = F.forall(numbers[0], lambda x: x.isNotNull()) & F.forall(numbers[1], lambda x: x.isNotNull())
    near = F.forall(F.zip_with(*numbers, lambda a, b: F.abs(a - b) <= tolerance), lambda x: x)
    same = F.array_sort(F.transform(gold, normalize_exact)) == F.array_sort(F.transform(pred, normalize_exact))
    return F.coalesce((F.size(gold) == F.size(pred)) & F.when(numeric_, near).otherwise(same), F.lit(False))


def review_flags(gold_review: Column, pred_review: Column) -> Column:
    """struct<unsafe, fail_closed>: a missed review, and one too many."""
    return F.struct((gold_review & ~pred_review).alias("unsafe"), (~gold_review & pred_review).alias("fail_closed"))


def batch_summary(runs: DataFrame) -> DataFrame:
    """Counts by status and review, latencies over finished runs, by bucket and over all (null bucket), in one pass."""
    ok = F.col("status") == "ok"
    named = runs.withColumn("bucket", F.coalesce(F.when(F.trim("bucket") != "", F.col("bucket")), F.lit("unknown")))
    return named.groupingSets([["bucket"], []], "bucket").agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.count_if(F.col("status") == "error").alias("n_error"), F.count_if(ok & F.col("review")).alias("n_review"),
        F.sum(F.when(ok, F.col("latency_ms"))).alias("latency_sum"), F.max(F.when(ok, F.col("latency_ms"))).alias("latency_max"),
    )
