"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certlake.llm import bloom_lm, bpe, cap_join, fim, line_dedup, ngram_join, packing, quality, resampling, style_tree, suffix_dedup, topk, toxicity
from certlake.llm.common import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component at cosine 0.9."""
    return cap_join.join(table(spark, sf_dir, "embeddings"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for every fiftieth."""
    return topk.search(table(spark, sf_dir, "embeddings"))


def op3_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return style_tree.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learnt from labels of folds 1 to 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    config = quality.QualityConfig()
    scored = quality.score(docs, quality.train(docs, labels, config), "score")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= config.threshold).cast("int").alias("predicted"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines."""
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near copies, and its number of links."""
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op7_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, learnt from all folds but 2 of 7."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(False))
    scored = bloom_lm.train_and_score(docs.withColumn("training", ~held_out), "training")
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def word_bpe() -> str:
    """The published vocabulary that encoding and packing use by default."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_bpe())


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    return bpe.digest_table(table(spark, sf_dir, "documents"), word_bpe())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, learnt from labels of folds 1 to 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    config = toxicity.ToxicityConfig()
    scored = toxicity.score(docs, toxicity.train(docs, labels, config), "score")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= config.threshold).cast("int").alias("predicted"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut for filling in its middle, and restored, as digests."""
    return fim.digest_table(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards ``benchmark``, and the ranks of the drawn twentieth."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated passages of 200 bytes, as digests."""
    return suffix_dedup.digest_table(table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_cap_join, op2_topk, op3_style_tree, op4_quality_classifier, op5_line_dedup, op6_ngram_join, op7_bloom_lm, op8_packing, op9_bpe, op10_toxicity,
    op11_fim, op12_resampling, op13_suffix_dedup,
)
QUERIES = {f.__name__: f for f in OPERATORS}
ORACLES: dict[str, str] = {"op2_topk": topk.ORACLE, "op5_line_dedup": line_dedup.ORACLE, "op11_fim": fim.ORACLE}
