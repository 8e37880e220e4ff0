"""Near-duplicate embeddings: a join on spherical-cap filters.

1. Equal vectors form one class and are carried once with their number.
2. Each vector is turned at random and cut in parts; a filter takes one code word of each part, a random unit
   vector, and its score is the sum of the inner products.  The filters above a threshold are listed without a
   look at the others: words that can't reach it with the best partners are left out, then the rest is joined part
   by part.  ``codes`` independent turns make the recall even.
3. Vectors meet in the buckets of their filters; buckets of one vector are dropped, and of buckets with the same
   members only the first stays.  Pairs are verified by cosine in double precision, in blocks of bounded size, and
   a pair counts in the first filter both share.
4. A bucket returns a row for each vector: its links, and the smallest class it reaches.  Links are summed and
   classes closed to components.

The number of code words follows the table, so a bucket holds few unrelated vectors at any size.

``vec_id`` names a vector: rows that repeat an id are that vector again, and where they differ the smallest
counts.  Vectors that are null, zero, of no dimension or hold null or non-finite components link with nothing,
and so do rows without an id, whose component is null; vectors link only with vectors of equal dimension.  Other
columns take no part.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from certlake.llm.common import components, materialize


LEAST_DIM = 32  # shorter vectors get zeros behind, so that a turn spreads them over both halves


@dataclass(frozen=True)
class CapConfig:
    """Pairs of cosine ``similarity`` or more are links.  The threshold is set so that a pair at the similarity
    shares ``shared`` filters of each code on average, and the number of code words so that a bucket holds about
    ``load`` unrelated vectors, where a vector has ``expected`` filters.  ``block`` bounds the vectors of one
    block."""

    similarity: float = 0.9
    codes: int = 32
    parts: int = 3
    shared: float = 0.8
    load: float = 0.05
    expected: int = 100
    block: int = 1024
    small: int = 32
    seed: int = 17


@dataclass
class Code:
    """One random turn and the words of its parts."""

    turn: np.ndarray
    words: list[np.ndarray]

    def decode(self, unit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters above the threshold."""
        turned, at, scores = unit @ self.turn, 0, []
        for words in self.words:
            scores.append(turned[:, at : at + words.shape[1]] @ words.T)
            at += words.shape[1]
        best = np.stack([s.max(axis=1) for s in scores])
        row, found, score = np.arange(len(unit)), np.zeros(len(unit), dtype=np.int64), np.zeros(len(unit))
        for part, each in enumerate(scores):
            # The part's words that reach the threshold with the best of all others, listed row by row.
            of, word = np.nonzero(each >= (threshold - best.sum(axis=0) + best[part])[:, None])
            value, sizes = each[of, word], np.bincount(of, minlength=len(unit))
            first = np.cumsum(sizes) - sizes
            times = sizes[row]
            left = np.repeat(np.arange(len(row)), times)
            right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + first[row][left]
            total = score[left] + value[right]
            reach = np.flatnonzero(total >= (threshold - best[part + 1 :].sum(axis=0))[row][left])
            left, right = left[reach], right[reach]
            row, found, score = row[left], found[left] * len(self.words[part]) + word[right], total[reach]
        return row, found


def make_codes(dim: int, words: int, config: CapConfig) -> list[Code]:
    out = []
    for k in range(config.codes):
        draw = np.random.default_rng((config.seed, dim, words, k))
        turn, _ = np.linalg.qr(draw.normal(size=(dim, dim)))
        sizes = np.diff(np.linspace(0, dim, config.parts + 1).astype(int))
        each = [draw.normal(size=(words, d)) for d in sizes]
        out.append(Code(turn, [w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12) for w in each]))
    return out


def calibrate(dim: int, words: int, config: CapConfig) -> float:
    """The largest threshold at which drawn pairs of the wanted cosine share ``shared`` filters of a code."""
    draw = np.random.default_rng((config.seed, dim, words))
    x = draw.normal(size=(300, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = draw.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    y = config.similarity * x + np.sqrt(1 - config.similarity**2) * z
    codes, space = make_codes(dim, words, config)[:4], words**config.parts
    low, high = 0.0, float(np.sqrt(config.parts))
    for _ in range(12):
        threshold, shared = (low + high) / 2, 0
        for code in codes:
            pairs = [r * space + f for r, f in (code.decode(x, threshold), code.decode(y, threshold))]
            shared += len(np.intersect1d(*pairs))
        low, high = (threshold, high) if shared >= config.shared * len(x) * len(codes) else (low, threshold)
    return low


def _plain(vector: Column) -> Column:
    """The vector, or null where it takes no part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(sound & F.exists(vector, lambda x: x != 0), vector)


def _unit(plain: np.ndarray) -> np.ndarray:
    """Vectors of length one; by the largest component first, so that no square leaves the range of doubles."""
    unit = plain / np.abs(plain).max(axis=1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def _filters(classes: DataFrame, dim: int, threshold: float, words: int, config: CapConfig) -> DataFrame:
    """(rep, filters): each class with its filters in ascending order."""
    space = words**config.parts

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = make_codes(max(dim, LEAST_DIM), words, config)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                unit = _unit(part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
                unit = np.pad(unit, ((0, 0), (0, max(0, LEAST_DIM - dim))))
                got = [(r, f + k * space) for k, code in enumerate(codes) for r, f in [code.decode(unit, threshold)]]
                row, found = (np.concatenate(x) for x in zip(*got, strict=True))
                order = np.lexsort((found, row))
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(unit)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[order]))], names=["rep", "filters"])

    return classes.select("rep", "vector").mapInArrow(decode, "rep long, filters array<long>")


def _first_shared(filters: np.ndarray, a: np.ndarray, b: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Whether ``here`` is the smallest filter that rows a and b share; rows are padded with negative numbers."""
    out = np.zeros(len(a), dtype=bool)
    for at in range(0, len(a), 20_000):
        some = slice(at, at + 20_000)
        both = np.sort(np.concatenate([filters[a[some]], filters[b[some]]], axis=1), axis=1)
        twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] >= 0)
        out[some] = both[np.arange(len(both)), twice.argmax(axis=1)] == here[some]
    return out


def _met_before(filters: np.ndarray, left: np.ndarray, right: np.ndarray, here: int) -> np.ndarray | None:
    """Which of left x right share a filter below ``here``; None if all do."""
    rows = np.concatenate([left, right])
    flat = filters[rows]
    earlier, at = np.unique(flat[(flat >= 0) & (flat < here)], return_inverse=True)
    if not len(earlier):
        return np.zeros((len(left), len(right)), dtype=bool)
    if np.bincount(at).max() == len(rows):
        return None
    row = np.nonzero((flat >= 0) & (flat < here))[0]
    shared = np.zeros((len(left), len(right)), dtype=np.float32)
    for start in range(0, len(earlier), 4096):
        cells = np.zeros((len(rows), min(4096, len(earlier) - start)), dtype=np.float32)
        some = (at >= start) & (at < start + 4096)
        cells[row[some], at[some] - start] = 1
        shared += cells[: len(left)] @ cells[len(left) :].T
    return shared > 0


def _verify(table: pa.Table, dim: int, config: CapConfig) -> pa.Table:
    """Links and smallest reached class of each row of a task, bucket by bucket."""
    table = table.take(pa.array(np.lexsort(tuple(table[c].to_numpy() for c in ("rep", "right", "left", "filter")))))
    rep, copies, bucket, left, right, block, members = (table[c].to_numpy() for c in ("rep", "copies", "filter", "left", "right", "block", "members"))
    plain = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    unit = _unit(plain)
    lists = table["filters"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    filters = np.full((len(rep), sizes.max(initial=1)), -1, dtype=np.int64)
    filters[np.arange(filters.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    links, low = np.zeros(len(rep), dtype=np.int64), rep.copy()

    def count(a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        while len(a):
            before = low.copy()
            np.minimum.at(low, a, before[b])
            np.minimum.at(low, b, low[a])
            if (low == before).all():
                return

    few = np.flatnonzero(members <= config.small)
    pairs = []
    for apart in range(1, config.small):
        a, b = few[:-apart], few[apart:]
        same = bucket[a] == bucket[b]
        a, b = a[same], b[same]
        if not len(a):
            break
        for at in range(0, len(a), 100_000):
            x, y = a[at : at + 100_000], b[at : at + 100_000]
            near = (unit[x] * unit[y]).sum(axis=1) >= config.similarity
            pairs.append((x[near], y[near]))
    if pairs:
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        first = _first_shared(filters, a, b, bucket[a])
        count(a[first], b[first])
    many = np.flatnonzero(members > config.small)
    for group in np.split(many, np.flatnonzero((np.diff(bucket[many]) != 0) | (np.diff(left[many]) != 0) | (np.diff(right[many]) != 0)) + 1) if len(many) else []:
        i, j = group[block[group] == left[group[0]]], group[block[group] == right[group[0]]]
        if not len(i) or not len(j):
            continue
        met = _met_before(filters, i, j, bucket[group[0]])
        if met is None:
            continue
        near = (unit[i] @ unit[j].T >= config.similarity) & ~met
        a, b = np.nonzero(near)
        a, b = i[a], j[b]
        if left[group[0]] == right[group[0]]:
            a, b = a[a < b], b[a < b]
        count(a, b)
    some = links > 0
    return pa.table({"rep": pa.array(rep[some]), "links": pa.array(links[some]), "low": pa.array(low[some])})


def _links(classes: DataFrame, dim: int, config: CapConfig) -> DataFrame:
    """(rep, links, low) of the classes of one dimension."""
    words = max(8, int(np.ceil((classes.count() * config.expected / (config.codes * config.load)) ** (1 / config.parts))))
    threshold = calibrate(max(dim, LEAST_DIM), words, config)
    filtered = materialize(_filters(classes, dim, threshold, words, config), "filters", compression="zstd")
    listed = filtered.select("rep", F.explode("filters").alias("filter"))
    counts = listed.groupBy("filter").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("rep")).alias("who"), F.min("rep").alias("least")).where("members > 1")
    first = counts.groupBy("members", "who", "least").agg(F.min("filter").alias("filter")).select("filter", "members")
    met = materialize(listed.join(first.hint("merge"), "filter").select("rep", "filter", "members"), "met", compression="zstd")
    lists = met.groupBy("rep").agg(F.sort_array(F.collect_list("filter")).alias("filters"))
    rows = classes.select("rep", "copies", "vector").join(lists.hint("merge"), "rep")
    placed = met.withColumn("blocks", F.when(F.col("members") <= config.small, 1).otherwise(F.ceil(F.col("members") / F.lit(config.block))).cast("long"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other")).drop("other", "blocks")
    tasks = max(1, -(-met.count() // (4 * config.block)))
    task = F.pmod(F.xxhash64("filter", "left", "right"), F.lit(tasks))
    return placed.join(rows.hint("merge"), "rep").withColumn("task", task).groupBy("task").applyInArrow(lambda table: _verify(table, dim, config), "rep long, links long, low long")


def join(vectors: DataFrame, config: CapConfig = CapConfig()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding)."""
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), _plain(F.col("embedding")).alias("vector")).where("vec_id is not null")
    repeats = ids.groupBy("vec_id").agg(F.count("*").alias("rows")).where("rows > 1 and vec_id is not null").limit(1).count() > 0
    if repeats:
        rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    keyed = rows.select("vec_id", "vector", F.xxhash64("vector").alias("k1"), F.hash("vector", F.size("vector")).alias("k2"), F.size("vector").alias("dim"))
    classes = materialize(keyed.where("vector is not null").groupBy("k1", "k2", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("vector").alias("vector")), "vectors")
    dims = [r.dim for r in classes.groupBy("dim").agg(F.count("*").alias("n")).where("n > 1").collect()]
    linked = classes.select("rep", F.lit(0).cast("long").alias("links"), F.col("rep").alias("low")).limit(0)
    for dim in sorted(dims):
        linked = linked.unionByName(_links(classes.where(F.col("dim") == dim), dim, config))
    linked = materialize(linked, "linked")
    reached = components(linked.where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))).select(F.col("node").alias("rep"), "component")
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    result = classes.select("k1", "k2", "dim", "rep", "copies").join(links, "rep", "left").join(reached, "rep", "left")
    result = materialize(result.select("k1", "k2", "dim", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "result")
    out = keyed.drop("vector").join(result, ["k1", "k2", "dim"], "left").select("vec_id", "n_links", "component_id")
    if repeats:
        out = ids.join(out, "vec_id")
    nameless = ids.where("vec_id is null").select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nameless).select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
