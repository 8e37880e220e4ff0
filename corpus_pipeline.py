"""The training-data pipeline: five stages over ``documents``, each with one operator of the library.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  ``run`` writes the result
of each stage as Parquet in the shared folder and reads it back for the next.

1. toxicity: documents that the classifier rejects go.  Rows with a null text have no words and get its answer.
2. quality: documents that the classifier rejects go.
3. lines: boilerplate lines of each source are dropped; no document goes.
4. near_copies: one row of each class of near copies stays, that of the smallest id; of rows with one id, or
   none, that are copies one stays.
5. packing: the pieces of all documents and their places in sequences.

Both classifiers learn from rows of ``labels`` that name a document of the stage's input, but not from every
fifth by its id's hash, so that decisions on those can be held against their labels.  SQL can express
neither the classifiers nor the packing, so there is no SQL for the whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certlake.llm import line_dedup, ngram_join, packing, quality, toxicity
from certlake.llm.common import fold, materialize, spare
from certlake.llm.queries import table, word_bpe

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def learnt_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    config, column = toxicity.ToxicityConfig(), spare(docs.columns, "score")
    model = toxicity.train(docs, learnt_from(spark, sf_dir), config)
    return toxicity.score(docs, model, column).where(F.col(column) < config.threshold).drop(column)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    config, column = quality.QualityConfig(), spare(docs.columns, "score")
    model = quality.train(docs, learnt_from(spark, sf_dir), config)
    return quality.score(docs, model, column).where(F.col(column) >= config.threshold).drop(column)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(docs).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are compared by number, so that rows of equal or of no id go on their own.  Where every id names one
    row it is the number; otherwise rows are sorted by id and numbered in that order, those without an id last."""
    row = spare(docs.columns, "row")
    repeats = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").limit(1).count() > 0
    if repeats:
        ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
        numbered = materialize(ordered.withColumn(row, F.monotonically_increasing_id()), "numbered")
    else:
        numbered = docs.withColumn(row, F.col("doc_id").cast("long"))
    classes = ngram_join.join(numbered.select(F.col(row).alias("doc_id"), "text"))
    gone = classes.where(~F.col("kept")).select(F.col("doc_id").alias(row))
    return numbered.join(gone, row, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, word_bpe())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("quality", drop_poor), ("lines", drop_lines), ("near_copies", drop_near_copies), ("packing", pack),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
