"""Sum-of-squares packing of tokenised documents into sequences of a fixed length.

Every document becomes ids and an end id; only documents longer than a sequence are cut.  The pieces are dealt
at random into shards of about ``shard_rows`` rows, and each shard is packed on its own, longest piece first:
a piece goes into the open sequence for which the squared counts of open sequences per residual gap become
smallest, and a new sequence is opened only where no gap is wide enough.  A shard wastes about one sequence,
so the loss is a fixed small share at any size, and no task or group grows with the table.

Null and empty texts have only the end id.  Repeated rows and null ids are pieces like any others.  A table
without rows gives no sequences.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from certlake.llm.bpe import encoder_of, hold
from certlake.llm.common import materialize, spare

PIECE = "struct<piece int, start long, length long, ids_crc32 long, ids array<long>>"


@dataclass(frozen=True)
class PackingConfig:
    """``shard_rows``: pieces packed together in one task; ``end_id`` closes each document."""

    capacity: int = 2048
    end_id: int = 0
    shard_rows: int = 3072


def pieces_of(ids: np.ndarray, capacity: int, end_id: int, with_ids: bool) -> list[dict]:
    """The pieces of one document: its ids and the end id, cut every ``capacity``."""
    ids = np.append(ids, end_id).astype("<u4")
    cuts = range(0, len(ids), capacity)
    return [{"piece": k, "start": s, "length": len(part), "ids_crc32": zlib.crc32(part.tobytes()), "ids": part.tolist() if with_ids else None} for k, s in enumerate(cuts) for part in [ids[s : s + capacity]]]


def cut_table(docs: DataFrame, vocabulary: str, config: PackingConfig = PackingConfig(), with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    held = hold(docs.sparkSession, vocabulary)

    @F.pandas_udf(f"array<{PIECE}>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([pieces_of(ids, config.capacity, config.end_id, with_ids) for ids in encoder_of(held).encode_all(texts)], dtype=object)

    names = ["piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    return docs.select("doc_id", F.explode(cut("text")).alias("p")).select("doc_id", *(F.col(f"p.{n}").alias(n) for n in names))


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece of one shard."""
    open_at = np.zeros(capacity + 1, dtype=np.int64)  # open sequences by residual gap
    members: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, opened = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        gaps = open_at[size:capacity]
        # Taking a gap g for g - size changes the sum of squares by 2 * (n[g - size] - n[g]) + 2; filling one by 1 - 2 * n[size].
        change = 2 * (open_at[: capacity - size] - gaps) + 2
        if len(change):
            change[0] = 1 - 2 * open_at[size]
            change[gaps == 0] = np.iinfo(np.int64).max
        left = int(change.argmin()) if len(change) else 0
        if len(change) and gaps[left]:
            at = members[left + size].pop()
            open_at[left + size] -= 1
        else:
            at, opened, left = opened, opened + 1, capacity - size
        sequence[i], offset[i] = at, capacity - left - size
        if left:
            members[left].append(at)
            open_at[left] += 1
    return sequence, offset


def pack(pieces: DataFrame, config: PackingConfig = PackingConfig()) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``length`` must lie between 1 and the capacity.  Other columns
    stay, but for those named like the new ones, which are replaced.

    The rows are first written to the shared folder, so that the random deal is the same in every attempt of a
    task.
    """
    pieces = pieces.drop("sequence_id", "offset")
    of = spare(pieces.columns, "shard")
    rows = materialize(pieces, "pieces")
    shards = max(1, -(-rows.count() // config.shard_rows))
    dealt = rows.withColumn(of, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def shard(table: pa.Table) -> pa.Table:
        sequence, offset = place(table["length"].to_numpy(), config.capacity)
        first = table[of][0].as_py() << 32 if table.num_rows else 0
        return table.drop_columns([of]).append_column("sequence_id", pa.array(first + sequence)).append_column("offset", pa.array(offset))

    placed = StructType([*rows.schema, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return dealt.groupBy(of).applyInArrow(shard, placed)


def pack_documents(docs: DataFrame, vocabulary: str, config: PackingConfig = PackingConfig(), with_ids: bool = False) -> DataFrame:
    """Every document's pieces and their places."""
    return pack(cut_table(docs, vocabulary, config, with_ids), config)


def sequences(packed: DataFrame) -> DataFrame:
    """One row for each sequence: its pieces in order, with ids where ``packed`` has them."""
    fields = [c for c in ("offset", "doc_id", "piece", "start", "length", "ids") if c in packed.columns]
    grouped = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("pieces"), F.sum("length").alias("n_tokens"))
    return grouped.withColumn("ids", F.flatten("pieces.ids")) if "ids" in fields else grouped
