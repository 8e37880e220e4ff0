"""Sources: file listings, JSON lines, CSV with required columns, one JSON object per file, and merged runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def discover(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """(document_id, filename, abs_path, size_bytes, sha256): the files below ``root``.  The id is the first 16
    hex digits of the content's hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    sha = F.sha2("content", 256)
    return files.select(F.substring(sha, 1, 16).alias("document_id"), F.substring_index("path", "/", -1).alias("filename"), F.col("path").alias("abs_path"), F.col("length").alias("size_bytes"), sha.alias("sha256"))


def upload_check(files: DataFrame, most_bytes: int = 20_000_000) -> DataFrame:
    """binaryFile rows with ``problem``: null for an acceptable PDF."""
    head = F.substring("content", 1, 5).cast("string")
    return files.withColumn("problem", F.when(~F.lower("path").endswith(".pdf"), "extension").when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "size").when(head != "%PDF-", "magic"))


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def csv_table(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV with a header; its byte-order mark is dropped, and missing columns are an error."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*(c.lstrip("\ufeff") for c in df.columns))
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, value variant): one JSON object per file, named by it; the value is null where it isn't an object."""
    files = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("doc_id"), F.col("value").alias("raw"))
    value = F.try_parse_json(F.regexp_replace("raw", "^\ufeff", ""))
    return files.select("doc_id", F.when(F.schema_of_variant(value).startswith("OBJECT"), value).alias("value"))


def extracted_ids(spark: SparkSession, path: str) -> DataFrame:
    """The distinct names of the JSON files of all runs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("doc_id")).distinct()


def merge_runs(runs: list[DataFrame], key: str = "doc_id") -> DataFrame:
    """Rows of several runs; a key in more than one row is an error."""
    out = runs[0]
    for other in runs[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    if twice := [r[0] for r in out.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()]:
        raise ValueError(f"repeated {key}: {twice}")
    return out


def unwrap_prediction(df: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """Fields of a variant, flat or below ``extraction``; the nested value wins.  ``fields`` become text columns."""
    get = lambda path: F.try_variant_get(column, path, "string")
    return df.select("*", *(F.coalesce(get(f"$.extraction.{f}"), get(f"$.{f}")).alias(f) for f in fields))
