"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset and all runs on this machine, as in
    local tests, a temporary folder is taken; on a cluster that would spread the data over its hosts.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="certlake-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` to a table in the shared folder, with the writer's ``options``, and reads it back.

    The copy cuts the lineage: a lost executor costs a reread of the table and no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/certlake/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spare(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def bounded_sample(df: DataFrame, key: str, bound: int, seed: int = 11) -> DataFrame:
    """At most ``bound`` rows of ``df``, chosen by a hash of ``key``; all rows if there are no more.

    The hash threshold leaves about nine tenths of the bound, and a limit holds the bound itself.
    """
    rows = df.count()
    if rows <= bound:
        return df
    share = int(0.9 * bound / rows * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) < share).limit(bound)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges``: (node, component), component the smallest node.

    Each round sends every node's smallest known label over its edges, and then follows the label's own
    label (pointer jumping), so that chains shrink by halves.  A round is two joins on the edge keys; labels
    are written to the shared folder after each, and only a row count reaches the driver.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = materialize(both.union(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).where("node <> other").distinct(), "edges")
    labels = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        # A label may name a node whose own label is smaller by now: take that.
        jump = step.alias("s").join(labels.select(F.col("node").alias("component"), F.col("component").alias("further")), "component", "left")
        new = materialize(jump.select("node", "was", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        changed = new.where("was <> component").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
