"""Exact top-k by inner product: an aggregation of sorted lists without random access.

Components become whole numbers, floor(scale * x).  The candidates stay where they are, in blocks; in a block every
dimension has lists sorted by value, from either end.  A query reads all lists from the end that serves the sign of its
component, and the deeper the larger the component is, a round at a time.  What it read gives each candidate a lower and
an upper bound of the score: an unread entry gives no more than the last one read of its list, and all unread entries
of a candidate take no more from it than the product of the lengths of what is unread of it and of the query.
Candidates whose upper bound is below the query's bar, the k-th best score of the blocks before, or, as long as there
is none, below the k-th lower bound, can't qualify.  Reading stops when few others are left, and their final scores are
resolved.  Each task gives every query its k best, and the k best of these are the answer.

A task's blocks grow from a short one, as queries have no bar there.  A query begins each block at the depth that
served in the block before, so that it mostly reads once.  Queries that begin alike read together, in steps of bounded
size: their components are banded by size, and a step gathers the fronts of a band's lists and adds them up by
candidate.  Every query meets every candidate's lists, so work grows as queries x candidates, and with vectors of no
structure no exact bound can save that; what is saved are the ends of the lists.

Queries are the rows whose ``vec_id`` is divisible by ``every``; they are broadcast in chunks of bounded size, and
each chunk is one pass over the candidates.  Null vectors and vectors that hold null or non-finite components take
no part, nor do rows without an id or vectors of no dimension; queries meet candidates of equal dimension only.
An id is one query: where its rows differ the smallest vector asks, and none of its rows is a candidate for it.
Other rows that repeat an id are candidates each.  Ties go to the smaller vec_id.  Other columns take no part.  An
empty table gives an empty result.  A vector whose squared length in whole numbers reaches 2**62 is an error that names
its id: below that no score leaves 64 bits, and beyond it scores would be wrong in silence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from certlake.llm.common import materialize


@dataclass(frozen=True)
class TopkConfig:
    """``rounds``: how deep the lists are read before bounds are compared, as shares of a list whose component is
    of the query's mean size; the last reads all.  ``few``: the share of a block that may be left when reading
    stops.  ``query_bytes`` bounds the queries of a chunk."""

    k: int = 5
    every: int = 50
    scale: int = 256
    block: int = 4096
    rounds: tuple[float, ...] = (0.5, 0.65, 0.85, 1.2, float("inf"))
    few: float = 1 / 16
    query_bytes: int = 16 << 20


def whole_numbers(vectors: DataFrame, config: TopkConfig = TopkConfig()) -> DataFrame:
    """(vec_id, q): the vectors that take part, in whole numbers."""
    x = F.col("embedding")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & (F.size(x) > 0)
    square = F.aggregate(x, F.lit(0.0), lambda sum, v: sum + F.pow(F.floor(v.cast("double") * config.scale).cast("double"), F.lit(2.0)))
    too_long = F.raise_error(F.concat(F.lit("vector too long for scores of 64 bits: vec_id "), F.col("vec_id").cast("string"))).cast("array<bigint>")
    q = F.when(square < float(1 << 62), F.transform(x, lambda v: F.floor(v.cast("double") * config.scale).cast("long"))).otherwise(too_long)
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"))


BAND = 8  # components of a query that are near in size, and read equally deep
FIRST = 256  # candidates of a task's first block
TOGETHER = 1 << 14  # cells of queries x candidates that read in one step
RESOLVED = 1 << 20  # components that are resolved in one step


def best_of(k: int, which: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, ...]:
    """(which, ids, scores, rank from 0): each query's k best."""
    order = np.lexsort((ids, -scores, which))
    which = which[order]
    rank = np.arange(len(which)) - np.searchsorted(which, which)
    return tuple(x[rank < k] for x in (which, ids[order], scores[order], rank))


class Lists:
    """A block of candidates with two lists for each dimension: from its largest value for positive components of
    queries, and from its smallest for negative ones.  Both hold what a component of size one gains, and fall."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        columns = np.ascontiguousarray(values.T)
        order = np.argsort(columns, axis=1, kind="stable")
        rising = np.take_along_axis(columns, order, axis=1).astype(np.float64)
        self.order, self.sorted = np.concatenate([order[:, ::-1], order]), np.concatenate([rising[:, ::-1], -rising])
        self.square = (values.astype(np.float64) ** 2).sum(axis=1)
        self.largest = np.abs(values).max(axis=0, initial=0).astype(np.float64)
        self.read = 0  # entries that queries have read, and components resolved

    def search(self, query: np.ndarray, own: int, bar: float, config: TopkConfig) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, of those whose scores reach ``bar``."""
        return self.search_all(query[None], np.array([own]), np.array([bar]), np.zeros(1, np.int64), config)[1:3]

    def search_all(self, queries: np.ndarray, owns: np.ndarray, bars: np.ndarray, begins: np.ndarray, config: TopkConfig) -> tuple[np.ndarray, ...]:
        """``best_of`` all queries, of those whose scores reach their ``bars``.

        A query leaves out the rounds before its place in ``begins``, which gets the place to begin at in a like block.
        """
        found, together = [(np.zeros(0, np.int64),) * 3], max(1, TOGETHER // len(self.ids))
        for begin in np.unique(was := begins.copy()):
            those = np.flatnonzero(was == begin)
            for i in range(0, len(those), together):
                open_ = those[i : i + together]
                for place in range(begin, len(config.rounds)):
                    left, read = self._left(queries[open_], owns[open_], bars[open_], config.rounds[place], config.k)
                    count, few = left.sum(axis=1), max(4 * config.k, config.few * len(self.ids))
                    ready = (count <= few) | (place + 1 == len(config.rounds))
                    begins[open_] = np.maximum(0, place - (count <= few / 4))
                    asks, whom = np.nonzero(left[ready])
                    which = open_[ready][asks]
                    self.read += read * ready.sum() + len(whom) * queries.shape[1]
                    found.append(best_of(config.k, which, self.ids[whom], self._scores(queries, which, whom))[:3])
                    open_ = open_[~ready]
                    if not len(open_):
                        break
        return best_of(config.k, *(np.concatenate(x) for x in zip(*found, strict=True)))

    def _scores(self, queries: np.ndarray, which: np.ndarray, whom: np.ndarray) -> np.ndarray:
        """The scores of pairs of a query and a candidate."""
        step = max(1, RESOLVED // queries.shape[1])
        parts = [slice(i, i + step) for i in range(0, len(whom), step)]
        return np.concatenate([np.zeros(0, np.int64), *(np.einsum("ij,ij->i", queries[which[p]], self.values[whom[p]]) for p in parts)])

    def _left(self, queries: np.ndarray, owns: np.ndarray, bars: np.ndarray, share: float, k: int) -> tuple[np.ndarray, int]:
        """(who can still be among the k best of each query, entries that each has read)."""
        n, m = len(self.ids), len(queries)
        dims = np.argsort(-np.abs(queries), axis=1, kind="stable")
        signed = np.take_along_axis(queries, dims, axis=1)
        size, lists = np.abs(signed).astype(np.float64), np.where(signed > 0, dims, dims + queries.shape[1])
        rounding = 8 * (queries.shape[1] + 2) * np.finfo(float).eps
        slack = rounding * (np.abs(queries) @ self.largest)[:, None]
        places = (np.arange(m) * n)[:, None, None]
        square, barless = (size**2).sum(axis=1), bool((bars == -np.inf).any())
        upper, unread, mine, theirs, read = np.zeros(m * n), np.zeros(m * n), np.repeat(square, n), np.tile(self.square, m), 0
        for i in range(0, size.shape[1], BAND):
            band, each = lists[:, i : i + BAND], size[:, i : i + BAND]
            if not each.any():
                break
            depth = min(n, math.ceil(min(1.0, share * each.mean() / size.mean()) * n))
            read += depth * each.shape[1]
            entries, gains = self.order[band, :depth], self.sorted[band, :depth]
            entries += places
            entries, last = entries.ravel(), gains[:, :, -1].copy()
            most = np.repeat((last * each).sum(axis=1), n)
            if barless:
                unread += most - np.bincount(entries, np.repeat(last * each, depth), m * n)
                mine -= np.bincount(entries, np.repeat(each**2, depth), m * n)
                theirs -= np.bincount(entries, (gains**2).ravel(), m * n)
            # An unread entry gives no more than the last one read; one that was read gives so much more than that.
            gains -= last[:, :, None]
            gains *= each[:, :, None]
            upper += most + np.bincount(entries, gains.ravel(), m * n)
        upper, others = upper.reshape(m, n), self.ids != owns[:, None]
        left = others & (upper >= bars[:, None] - slack)
        if barless and n > k:
            mine, theirs = np.maximum(mine, 0) + rounding * np.repeat(square, n), np.maximum(theirs, 0) + rounding * np.tile(self.square, m)
            lower = np.where(others, upper - (unread + np.sqrt(mine * theirs)).reshape(m, n), -np.inf)
            left &= upper >= np.partition(lower, n - k, axis=1)[:, n - k, None] - slack
        return left, read


FOUND = "query_id long, vec_id long, score long"


def _vectors(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    mine = batch.filter(pa.array(batch["dim"].to_numpy() == dim))
    return mine["vec_id"].to_numpy(), mine["q"].flatten().to_numpy().reshape(-1, dim)


def _pass(rows: DataFrame, queries: pa.Table, config: TopkConfig) -> DataFrame:
    """Each query's k best of each task."""
    asking = {}
    for dim in sorted(set(queries["dim"].to_pylist())):
        some = queries.filter(pa.array(queries["dim"].to_numpy() == dim)).combine_chunks()
        asking[dim] = (some["vec_id"].to_numpy(), some["q"].combine_chunks().flatten().to_numpy().reshape(-1, dim))
    held = rows.sparkSession.sparkContext.broadcast(asking)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = config.k
        waiting, met = {dim: [] for dim in held.value}, dict.fromkeys(held.value, 0)
        # Of each query: the k best ids and scores so far, how many there are, and the round to begin with.
        state = {dim: (np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64), np.zeros(len(ids), np.int64), np.full(len(ids), max(0, len(config.rounds) - 2))) for dim, (ids, _) in held.value.items()}

        def meet(dim: int, last: bool) -> None:
            """Blocks grow from a short one, which gives every query a bar; what fills no block waits for more."""
            ids, values = (np.concatenate(x) for x in zip(*waiting[dim], strict=True))
            (owns, queries), (best, scores, count, begins) = held.value[dim], state[dim]
            start = 0
            while start < len(ids) and (last or start + min(config.block, max(FIRST, met[dim])) <= len(ids)):
                size = min(config.block, max(FIRST, met[dim]), len(ids) - start)
                lists = Lists(ids[start : start + size], values[start : start + size])
                bars = np.where(count == k, scores[:, k - 1].astype(np.float64), -np.inf)
                found = lists.search_all(queries, owns, bars, begins, config)
                had, rank = np.nonzero(np.arange(k) < count[:, None])
                which, i, s, r = best_of(k, *(np.concatenate(x) for x in zip((had, best[had, rank], scores[had, rank]), found[:3], strict=True)))
                best[which, r], scores[which, r] = i, s
                count[:] = np.bincount(which, minlength=len(owns))
                start, met[dim] = start + size, met[dim] + size
            waiting[dim] = [(ids[start:], values[start:])] if start < len(ids) else []

        for batch in batches:
            for dim in held.value:
                ids, values = _vectors(batch, dim)
                if len(ids):
                    waiting[dim].append((ids, values))
                if sum(len(w[0]) for w in waiting[dim]) >= config.block:
                    meet(dim, last=False)
        for dim, (asks, _) in held.value.items():
            if waiting[dim]:
                meet(dim, last=True)
            best, scores, count, _ = state[dim]
            which, rank = np.nonzero(np.arange(config.k) < count[:, None])
            if len(which):
                cells = (asks[which], best[which, rank], scores[which, rank])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], names=["query_id", "vec_id", "score"])

    found = materialize(rows.mapInArrow(search, FOUND), "found")
    held.destroy()
    return found


def search(vectors: DataFrame, config: TopkConfig = TopkConfig()) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best."""
    rows = materialize(whole_numbers(vectors, config).withColumn("dim", F.size("q")), "whole")
    queries = rows.where(F.col("vec_id") % config.every == 0).groupBy("vec_id").agg(F.min("q").alias("q")).withColumn("dim", F.size("q"))
    size = queries.agg(F.coalesce(F.sum(8 * (F.col("dim") + 2)), F.lit(0))).first()[0]
    chunks = max(1, -(-2 * size // config.query_bytes) if size > config.query_bytes else 1)
    queries = materialize(queries.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks))), "queries")
    found = None
    for chunk in range(chunks):
        some = _pass(rows, queries.where(F.col("chunk") == chunk).select("vec_id", "q", "dim").toArrow(), config)
        found = some if found is None else found.unionByName(some)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= config.k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: cast(floor(cast(x AS DOUBLE) * 256) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
