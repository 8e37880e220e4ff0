"""Supplier names by likeness: the indel ratio of their sorted words, and matches against a master list.

The ratio of two names is twice the length of their longest common subsequence by their lengths together.  Names that
are likely enough share one of their rarest two-letter pieces, and so do their letters alone, so a name meets only those
of the master that do, and never all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certlake.functions.numeric import let
from certlake.functions.text import normalize_supplier

# Per cents from which a name is accepted, and from which it goes to review.
ACCEPT, REVIEW = 95.0, 90.0
Q = 2


def sorted_words(text: Column) -> Column:
    """The words of a normalised name in order, one blank between them."""
    words = F.filter(F.split(normalize_supplier(text), r"\s+"), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def common_length(a: Column, b: Column) -> Column:
    """The length of the longest common subsequence, a row of the table after another."""
    empty = lambda s: F.array_repeat(F.lit(0), F.length(s) + 1)

    def row(above: Column, x: Column, letters: Column) -> Column:
        # The longest so far stands last; each place takes the better of left, above, and above-left plus a match.
        def place(done: Column, j: Column) -> Column:
            diagonal = F.get(above, j) + F.when(F.get(letters, j) == x, 1).otherwise(0)
            return F.array_append(done, F.greatest(F.element_at(done, -1), F.get(above, j + 1), diagonal))

        return F.aggregate(F.sequence(F.lit(0), F.size(letters) - 1), F.array(F.lit(0)), place)

    split = lambda s: F.split(s, "")
    table = let(split(b), lambda letters: F.aggregate(split(a), empty(b), lambda above, x: row(above, x, letters)))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(F.element_at(table, -1))


def ratio(a: Column, b: Column) -> Column:
    """The likeness of two prepared names, 0 to 100; two empty names are alike."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).when(a == b, 100.0).otherwise(200.0 * common_length(a, b) / total)


def band(score: Column) -> Column:
    return F.when(score >= ACCEPT, "accept").when(score >= REVIEW, "review").otherwise("reject")


def judged(pairs: DataFrame, gold: str, pred: str) -> DataFrame:
    """``pairs`` with ``score`` and ``band``; equal pairs of names are judged once."""
    names = pairs.select(F.col(gold).alias("g"), F.col(pred).alias("p")).distinct()
    a, b = sorted_words(F.coalesce("g", F.lit(""))), sorted_words(F.coalesce("p", F.lit("")))
    scored = names.withColumn("a", a).withColumn("b", b).select("g", "p", ratio(F.col("a"), F.col("b")).alias("score")).withColumn("band", band(F.col("score")))
    return pairs.join(scored, pairs[gold].eqNullSafe(scored["g"]) & pairs[pred].eqNullSafe(scored["p"]), "left").drop("g", "p")


def _pieces(names: DataFrame) -> DataFrame:
    """(name, most, piece): the pieces of each name, numbered where they repeat, with signs for its ends."""
    padded = F.concat(F.lit("^"), F.col("name"), F.lit("$"))
    each = names.select("name", "most", F.posexplode(F.transform(F.sequence(F.lit(1), F.length(padded) - Q + 1), lambda i: F.substr(padded, i, F.lit(Q)))).alias("at", "piece"))
    nth = F.row_number().over(Window.partitionBy("name", "most", "piece").orderBy("at"))
    return each.select("name", "most", F.concat_ws("#", "piece", nth.cast("string")).alias("piece"))


def _rarest(sought: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the names of both sides, (name, most), as many of their rarest pieces as a partner within ``most`` changes
    can't lack altogether."""
    theirs = _pieces(known)
    counts = theirs.groupBy("piece").agg(F.count("*").alias("n"))

    def rarest(pieces: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("name", "most").orderBy(F.coalesce("n", F.lit(0)), "piece"))
        return pieces.join(counts, "piece", "left").withColumn("rank", rank).where(F.col("rank") <= Q * F.col("most") + 1).select("name", "most", "piece")

    return rarest(_pieces(sought)), rarest(theirs)


def _renamed(df: DataFrame, side: str) -> DataFrame:
    return df.withColumnsRenamed({"name": side, "most": f"{side}_most"})


def _within() -> Column:
    """Whether ``a`` and ``b`` may be within ``most`` changes; replacing a sign counts once here, so none is lost."""
    return (F.abs(F.length("a") - F.length("b")) <= F.col("most")) & (F.expr("levenshtein(a, b, most)") >= 0)


def _alike(sought: DataFrame, known: DataFrame) -> DataFrame:
    """(a, a_most, b, b_most): the names of both sides, (name, most), that are within the fewer of their changes."""
    a, b = _rarest(sought, known)
    met = _renamed(a, "a").join(_renamed(b, "b"), "piece").withColumn("most", F.least("a_most", "b_most"))
    pairs = met.where(_within()).select("a", "a_most", "b", "b_most", "most").distinct()
    return pairs.where(F.length("a") + F.length("b") - 2 * common_length(F.col("a"), F.col("b")) <= F.col("most")).drop("most")


def _met(sought: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(a, b): all likely pairs, and others; repeated.

    Names that share most of their letters and differ in numbers have no rare pieces.  Changes of a name are at least
    those of its letters and of its digits, so letters are compared first, and names meet only where theirs are alike:
    by a key of the letters, or by the keys 1 and 2 where too few letters are left to have a piece in common.
    """
    most = F.floor(F.length("name") * 2 * (100.0 - least) / least).cast("int")  # insertions and deletions from any likely partner
    mine, theirs = (df.select("name", most.alias("most")) for df in (sought, known))
    letters = lambda name: F.regexp_replace(name, "[0-9]", "")
    tight = lambda df: df.withColumn("letters", letters("name")).withColumn("tight", F.length("letters") >= Q * F.col("most"))
    lone = [tight(df).where("tight").select(F.col("letters").alias("name"), "most").distinct() for df in (mine, theirs)]
    alike = _alike(*lone).select(F.col("a").alias("letters"), F.col("a_most").alias("most"), F.concat_ws("#", "b", "b_most").alias("key"), F.lit(True).alias("tight"))
    a, b = map(tight, _rarest(mine, theirs))
    own = F.concat_ws("#", "letters", "most")
    a_keys = F.when(F.col("tight"), F.array(F.lit("2"))).otherwise(F.array(F.lit("1")))
    b_keys = F.when(F.col("tight"), F.array(own, F.lit("1"))).otherwise(F.array(F.lit("1"), F.lit("2")))
    left = a.join(alike, ["letters", "most", "tight"]).select("name", "most", "piece", "key").unionByName(a.select("name", "most", "piece", F.explode(a_keys).alias("key")))
    right = b.select("name", "most", "piece", F.explode(b_keys).alias("key"))
    near = F.least(F.length("a"), F.length("b")) * 2 * 100.0 >= (F.length("a") + F.length("b")) * least
    met = _renamed(left, "a").join(_renamed(right, "b"), ["key", "piece"]).withColumn("most", F.least("a_most", "b_most"))
    return met.where(near & _within()).select("a", "b")


def best_matches(names: DataFrame, master: DataFrame, least: float = REVIEW) -> DataFrame:
    """(raw, match, score, band): for each distinct name the likest of the master from ``least`` on, ties to the
    smaller; null and ``reject`` where there is none.  Empty names match nothing.

    Raw names that are one when prepared are sought once, and those that the master has are not compared with others.
    """
    left = names.select(F.col("raw"), sorted_words(F.col("raw")).alias("name")).distinct()
    right = master.select(F.col("raw").alias("match"), sorted_words(F.col("raw")).alias("name")).distinct()
    sought, known = (df.select("name").distinct().where("name <> ''") for df in (left, right))
    equal = sought.join(known, "name", "left_semi").select(F.col("name").alias("a"), F.col("name").alias("b"), F.lit(100.0).alias("score"))
    # A fixed number of parts: few bytes of pairs may be much work, and would be put together in one task.
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = _met(sought.join(known, "name", "left_anti"), known, least).repartition(parts, "a", "b").distinct()
    scored = met.withColumn("score", ratio(F.col("a"), F.col("b"))).where(F.col("score") >= least).unionByName(equal)
    named = scored.join(right.select(F.col("name").alias("b"), "match"), "b")
    best = named.groupBy("a").agg(F.min_by(F.struct("match", "score"), F.struct(-F.col("score"), "match")).alias("v"))
    out = left.join(best.withColumnRenamed("a", "name"), "name", "left")
    return out.select("raw", F.col("v.match").alias("match"), F.col("v.score").alias("score"), band(F.coalesce("v.score", F.lit(0.0))).alias("band"))
