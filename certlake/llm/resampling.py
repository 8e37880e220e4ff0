"""Target-distribution importance resampling on hashed n-gram features.

1. Identical texts are collapsed by grouping the full text, with their number as ``copies``.
2. Each text's features, the runs of one to ``grams`` words, are hashed once into ``buckets``; a text keeps the bucket
   of each feature, two bytes each.
3. The corpus counts of the buckets are the texts' counts times their copies, combined within each task before the
   shuffle.  Target counts are made the same way.  A bucket's gain is the floored, scaled logarithm of the ratio of
   both smoothed shares.
4. A text's weight, the sum of the gains of its features, is computed once and joined back to its rows by the text's
   sha256.  Only then comes the noise of each row, from its key.
5. All rows are sorted once, over the cluster; a rank is the place in its partition plus the rows before that.

The driver holds ``buckets`` counts and a number for each sorted partition; the rows never meet in one task.

Null and empty texts have no features, and a weight of 0.  A null key is the empty string in the hash and comes last
among equal scores.  Rows that repeat a key and a text have equal scores and consecutive ranks.  Very long texts are
hashed whole.  Columns other than the key and the text take no part.  An empty target or corpus has zero counts; a
table without rows gives none.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certlake.llm.common import materialize
from certlake.llm.words import LOWER, in_rounds

WORD = np.zeros(256, dtype=bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
POLYNOMIAL = 0xEDB88320  # fixed value: of the crc32 that zlib and SQL engines compute
LONG = 48  # bytes from which a word's runs are hashed one by one


@dataclass(frozen=True)
class ResampleConfig:
    """``percent`` of the rows with ``min_words`` words or more are drawn.  ``task_features``: features that a counting
    task meets at least, so that its counts, a row for each bucket, are few beside them."""

    grams: int = 3
    buckets: int = 10_000
    min_words: int = 20
    percent: int = 5
    task_features: int = 4_000_000
    seed: int = 42


def _table() -> np.ndarray:
    """The crc of each byte, by the polynomial's rule."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(POLYNOMIAL), out >> 1).astype(np.uint32)
    return out


CRC = _table()


def features(texts: list[bytes], config: ResampleConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of every feature, text by text, and for each text its words and its features.

    A run's crc goes on from that of the run without its last word, so every byte is taken once for each length.
    """
    buf = LOWER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    edge = np.flatnonzero(np.diff(WORD[buf].view(np.int8), prepend=0))
    first, last = edge[::2], edge[1::2]
    words = np.diff(np.searchsorted(first, ends), prepend=0)
    text_of = np.repeat(np.arange(len(texts)), words)
    size = last - first
    large = np.flatnonzero(size > LONG)
    state = np.full(len(first), 0xFFFFFFFF, dtype=np.uint32)
    crcs, owners, orders = [], [], []
    for k in range(config.grams):
        starts = np.arange(max(0, len(first) - k))
        starts = starts[text_of[starts] == text_of[starts + k]]
        run = state[starts]
        if k:
            run = CRC[(run ^ np.uint32(32)) & np.uint32(255)] ^ (run >> np.uint32(8))
        at, length = first[starts + k], size[starts + k]
        order = np.argsort(-length, kind="stable")
        order = order[length[order] <= LONG]
        deep = np.searchsorted(-length[order], -np.arange(LONG), side="left")  # of runs with more than so many bytes
        for step, n in enumerate(deep.tolist()):
            if not n:
                break
            some = order[:n]
            x = run[some]
            run[some] = CRC[(x ^ buf[at[some] + step]) & np.uint32(255)] ^ (x >> np.uint32(8))
        if len(large):
            for i in np.flatnonzero(length > LONG).tolist():
                run[i] = zlib.crc32(buf[at[i] : at[i] + length[i]].tobytes(), int(run[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        state = np.zeros(len(first), dtype=np.uint32)
        state[starts] = run
        crcs.append(run ^ np.uint32(0xFFFFFFFF))
        owners.append(text_of[starts])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(crcs)[order] % np.uint32(config.buckets)).astype(np.uint32), words, np.bincount(owner, minlength=len(texts))


HASHED = "digest binary, copies long, n_words long, n_features long, buckets binary"


def collapse(docs: DataFrame) -> DataFrame:
    """(text, copies): each distinct text with the number of its rows."""
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))


def _digest(text: str | Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def hashed(texts: DataFrame, config: ResampleConfig = ResampleConfig()) -> DataFrame:
    """(digest, copies, n_words, n_features, buckets) of each row of (text, copies); ``buckets`` holds two bytes for
    each feature, or four where there are more than 65,536 buckets."""
    kind = np.dtype("<u2") if config.buckets <= 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in in_rounds(batch.column(2).to_pylist()):
                here, words, counts = features(texts, config)
                here = here.astype(kind)
                ends = np.cumsum(counts)
                cells = [here[e - c : e].tobytes() for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                same = [batch.column(k).slice(at, len(texts)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(words.astype(np.int64)), pa.array(counts.astype(np.int64)), pa.array(cells, pa.binary())], names=["digest", "copies", "n_words", "n_features", "buckets"])
                at += len(texts)

    return texts.select(_digest("text").alias("digest"), "copies", F.col("text").cast("binary").alias("text")).mapInArrow(run, HASHED)


def bucket_counts(texts: DataFrame, config: ResampleConfig) -> np.ndarray:
    """How many features of ``texts`` (hashed) fall into each bucket: a row for each bucket that a task has met,
    summed, and at most ``buckets`` sums to the driver."""
    kind = np.dtype("<u2") if config.buckets <= 1 << 16 else np.dtype("<u4")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(config.buckets, dtype=np.int64)
        for batch in batches:
            for copies, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                here = np.frombuffer(cell.as_buffer(), dtype=kind)
                np.add.at(total, here, copies) if len(here) < 200 else np.add(total, np.bincount(here, minlength=config.buckets) * copies, out=total)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    out = np.zeros(config.buckets, dtype=np.int64)
    tasks = 1 + texts.agg(F.coalesce(F.sum("n_features"), F.lit(0))).first()[0] // config.task_features
    for bucket, n in texts.select("copies", "buckets").coalesce(tasks).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The floored thousandfold logarithm of the ratio of smoothed shares of each bucket."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(((b + 1.0) * (s + n)) / ((a + 1.0) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighed(texts: DataFrame, gain: np.ndarray, config: ResampleConfig) -> DataFrame:
    """(digest, n_words, n_features, weight) of hashed ``texts``; the gains are ``buckets`` numbers."""
    kind = np.dtype("<u2") if config.buckets <= 1 << 16 else np.dtype("<u4")
    held = texts.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(held.value[np.frombuffer(cell.as_buffer(), dtype=kind)].sum()) for cell in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], names=["digest", "n_words", "n_features", "weight"])

    return texts.select("digest", "n_words", "n_features", "buckets").mapInArrow(weigh, "digest binary, n_words long, n_features long, weight long")


def noise(key: Column, config: ResampleConfig) -> Column:
    """The floored thousandfold Gumbel noise of a row, from the hash of its key."""
    digest = F.sha2(F.concat(F.lit(f"{config.seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("long")


def score(docs: DataFrame, target: DataFrame, key: str = "doc_id", config: ResampleConfig = ResampleConfig()) -> DataFrame:
    """(key, n_words, n_features, weight, score) for every row of ``docs``, whose ``text`` is drawn towards that of
    ``target``."""
    texts = materialize(hashed(collapse(docs), config), "hashed")
    gain = gains(bucket_counts(texts, config), bucket_counts(materialize(hashed(collapse(target), config), "target"), config))
    rows = docs.select(F.col(f"`{key}`").alias("key"), _digest(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest"))
    # A merge join, in which Spark splits the partitions of texts with many copies.
    joined = rows.hint("merge").join(weighed(texts, gain, config), "digest")
    return joined.select(F.col("key").alias(key), "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("key"), config)).alias("score"))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", config: ResampleConfig = ResampleConfig()) -> DataFrame:
    """(key, n_features, weight, score, rank): ``rank`` counts the drawn rows from the highest score on, and is null
    for all others."""
    scored = materialize(score(docs, target, key, config).withColumn("long_enough", F.col("n_words") >= config.min_words), "scored")
    drawn = config.percent * scored.where("long_enough").count() // 100
    order = [F.desc("long_enough"), F.desc("score"), F.asc_nulls_last(f"`{key}`"), F.desc("weight"), F.desc("n_features")]
    placed = materialize(scored.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("place", 33)
    before, starts = 0, []
    for at, n in sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        starts.append((at, before))
        before += n
    offsets = F.broadcast(scored.sparkSession.createDataFrame(starts, "part long, before long"))
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.withColumn("part", part).join(offsets, "part")
    return ranked.select(key, "n_features", "weight", "score", F.when(F.col("long_enough") & (rank <= drawn), rank).alias("rank"))


def selected(docs: DataFrame, target: DataFrame, key: str = "doc_id", config: ResampleConfig = ResampleConfig()) -> DataFrame:
    """The drawn rows of ``docs``, whole; ``key`` must name a row."""
    kept = resample(docs, target, key, config).where("rank is not null").select(key)
    return docs.join(kept, key, "left_semi")
