"""Near-duplicate documents: a MinHash-banded join on sets of word n-grams.

Texts are lower-cased and split at white space; a document is the set of its runs of ``words`` words.

1. Documents with equal sets form one class, so copies are carried once with their number.
2. Each class has ``bands`` hashes of ``rows`` minima each, numbers chosen for a target recall at the
   threshold.  Classes are shuffled on band hashes; only hashes of two classes or more go on, and of buckets with
   the same members only one.
3. A bucket gives no pairs: its members are compared by sketches of their minima, a byte each, and a member gets
   one edge, to the smallest that it reaches over likely pairs.  So texts that share a band by chance chain no
   clusters.  A bucket of more than ``dense`` members gives a star instead.  Edges that touch make a cluster.
4. Clusters are dealt in blocks of bounded size, and every two blocks of a cluster meet in one task, which counts
   shared n-grams of whole sets.  A task returns a row for each class: its links, and the smallest class that it
   reaches.
5. Links are summed and reached classes closed to components; every document gets its class's result.

``doc_id`` names a document: rows that repeat an id are that document again, and where their texts differ the
smallest counts.  Null and empty texts, texts without words and rows without an id link with nothing and are
kept; a null id has a null class.  Very long texts are sets like others.  Other columns take no part.  An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certlake.llm.common import components, materialize
from certlake.llm.words import in_rounds, mix, shingle_sets


@dataclass(frozen=True)
class JoinConfig:
    """Pairs of ``similarity`` (a fraction, as two whole numbers) or more are links.  A pair at the threshold
    shares a band with probability ``recall`` at least.  Pairs whose sketches agree on a share ``slack`` standard
    errors below the similarity are likely ones.  ``block`` and ``block_grams`` bound the classes of one block and
    their n-grams together."""

    words: int = 5
    similarity: tuple[int, int] = (4, 5)
    rows: int = 5
    recall: float = 0.99999
    slack: float = 5.0
    small: int = 32
    dense: int = 512
    block: int = 512
    block_grams: int = 500_000
    seed: int = 29

    @property
    def bands(self) -> int:
        """The fewest bands that reach the recall."""
        share = (self.similarity[0] / self.similarity[1]) ** self.rows
        return int(np.ceil(np.log(1 - self.recall) / np.log(1 - share)))

    @property
    def likely(self) -> int:
        """The fewest equal places of two sketches."""
        share, places = self.similarity[0] / self.similarity[1], self.bands * self.rows
        return int(np.floor(share * places - self.slack * np.sqrt(share * (1 - share) * places)))


def _minima(values: np.ndarray, starts: np.ndarray, config: JoinConfig) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes and sketches of non-empty sets laid out one after another: a row for each set."""
    draw = np.random.default_rng(config.seed)
    keys = draw.integers(1, 1 << 32, (config.bands * config.rows, 2), dtype=np.uint64).astype(np.uint32)
    short = (values >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(starts), config.bands), dtype=np.uint64)
    sketch = np.zeros((config.bands * config.rows, len(starts)), dtype=np.uint8)
    for band in range(config.bands):
        total = np.full(len(starts), band + 1, dtype=np.uint64)
        for row in range(band * config.rows, (band + 1) * config.rows):
            flip, times = keys[row]
            turned = (short ^ flip) * (times | np.uint32(1))
            turned ^= turned >> np.uint32(15)
            least = np.minimum.reduceat(turned * np.uint32(0x2C1B3C6D), starts)
            sketch[row] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
            total = mix(total ^ least.astype(np.uint64))
        out[:, band] = total
    return out, np.ascontiguousarray(sketch.T)


OTHER = 0xD6E8FEB86659FD93  # tells the second naming hash from the first
SIGNED = "doc_id long, k1 long, k2 long, n int, bands array<long>, sketch binary"


def signatures(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """(doc_id, k1, k2, n, bands, sketch): 128 bits that name the set, its size, band hashes and a byte of each
    minimum; both are empty for no set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in in_rounds(batch.column(1).to_pylist()):
                values, sizes = shingle_sets(texts, config.words)
                full = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[full]
                k = np.zeros((2, len(texts)), dtype=np.uint64)
                if len(full):
                    k[0, full], k[1, full] = np.add.reduceat(mix(values + np.uint64(1)), starts), np.add.reduceat(mix(values ^ np.uint64(OTHER)), starts)
                bands, sketch = _minima(values, starts, config) if len(full) else (np.zeros((0, config.bands), dtype=np.uint64), [])
                sketches = [b""] * len(texts)
                for i, x in zip(full, sketch, strict=True):
                    sketches[i] = x.tobytes()
                offsets = np.zeros(len(texts) + 1, dtype=np.int32)
                offsets[1:] = np.cumsum(np.where(sizes > 0, config.bands, 0))
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.view(np.int64).ravel()))
                cells = [batch.column(0).slice(at, len(texts)), *(pa.array(x.view(np.int64)) for x in k), pa.array(sizes.astype(np.int32)), listed, pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "k1", "k2", "n", "bands", "sketch"])
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").cast("binary").alias("text")).mapInArrow(sign, SIGNED)


def _clusters(classes: DataFrame, config: JoinConfig) -> DataFrame:
    """(rep, cluster) of the classes that may link with another: edges within buckets, then components."""
    banded = classes.select("rep", F.explode("bands").alias("band"))
    who = F.xxhash64("rep")
    buckets = banded.groupBy("band").agg(F.min("rep").alias("centre"), F.count("*").alias("members"), F.bit_xor(who).alias("x"), F.sum(F.shiftright(who, 16)).alias("y")).where("members > 1")
    shared = buckets.groupBy("centre", "members", "x", "y").agg(F.min("band").alias("band")).select("band", "centre", "members")
    met = materialize(banded.join(shared.hint("merge"), "band"), "met")
    star = met.where((F.col("members") > config.dense) & (F.col("rep") != F.col("centre"))).select(F.col("rep").alias("a"), F.col("centre").alias("b"))
    few = met.where(F.col("members") <= config.dense)
    tasks = max(1, few.count() // 8192)
    bundled = few.withColumn("task", F.pmod(F.xxhash64("band"), F.lit(tasks))).join(classes.select("rep", "sketch").hint("merge"), "rep")
    likely = bundled.select("task", "band", "rep", "sketch").groupBy("task").applyInArrow(lambda table: _likely(table, config), "a long, b long")
    return components(star.unionByName(likely).distinct()).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))


def _likely(table: pa.Table, config: JoinConfig) -> pa.Table:
    """(a, b): each class with the smallest that it reaches over likely pairs of its bucket."""
    rep, band = table["rep"].to_numpy(), table["band"].to_numpy()
    order = np.lexsort((rep, band))
    rep, band = rep[order], band[order]
    sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(rep), -1)[order]
    cuts = np.flatnonzero(np.diff(band, prepend=band[:1] - 1) != 0)
    members = np.repeat(np.diff(np.append(cuts, len(band))), np.diff(np.append(cuts, len(band))))
    pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    few = np.flatnonzero(members <= config.small)
    for apart in range(1, config.small):
        a, b = few[:-apart], few[apart:]
        same = band[a] == band[b]
        a, b = a[same], b[same]
        for at in range(0, len(a), 100_000):
            x, y = a[at : at + 100_000], b[at : at + 100_000]
            near = (sketch[x] == sketch[y]).sum(axis=1) >= config.likely
            pairs.append((x[near], y[near]))
    for start in cuts[members[cuts] > config.small].tolist():
        here = slice(start, start + int(members[start]))
        equal = np.zeros((members[start], members[start]), dtype=np.int16)
        for column in sketch[here].T:
            equal += column[:, None] == column[None, :]
        x, y = np.nonzero(np.triu(equal >= config.likely, 1))
        pairs.append((x + start, y + start))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    low = _lowest(len(rep), a, b, rep)
    moved = low != rep
    return pa.table({"a": pa.array(rep[moved], pa.int64()), "b": pa.array(low[moved], pa.int64())})


def _pairs_within(values: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, config: JoinConfig) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (of ``left`` x ``right`` sets) that are similar enough.  Sets lie one after another."""
    n = len(sizes)
    of = np.repeat(np.arange(n), sizes)
    _, at, seen = np.unique(values, return_inverse=True, return_counts=True)
    common = seen[at] > 1
    of, at = of[common], at[common]
    places, at = np.unique(at, return_inverse=True)
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    shared = np.zeros((n, n), dtype=np.float32)
    width = 4096
    bounds = np.searchsorted(at, np.arange(0, len(places) + width, width))
    for k in range(len(bounds) - 1):
        cells = np.zeros((n, width), dtype=np.float32)
        some = slice(bounds[k], bounds[k + 1])
        cells[of[some], at[some] - k * width] = 1
        rows = np.unique(of[some])
        shared[np.ix_(rows, rows)] += cells[rows] @ cells[rows].T
    shared = shared[np.ix_(left, right)].astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None, :] - shared
    a, b = np.nonzero(shared * config.similarity[1] >= union * config.similarity[0])
    return left[a], right[b]


def _lowest(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each of ``n`` nodes reaches over the pairs (a, b)."""
    low = ids.copy()
    while len(a):
        before = low.copy()
        np.minimum.at(low, a, before[b])
        np.minimum.at(low, b, low[a])
        if (low == before).all():
            break
    return low


LINKED = "rep long, links long, low long"


def _links(members: DataFrame, config: JoinConfig) -> DataFrame:
    """Links and smallest reached class of each class, from (rep, copies, cluster, task, left, right, text)."""

    def join(table: pa.Table) -> pa.Table:
        cluster = table["cluster"].to_numpy()
        order = np.lexsort((table["rep"].to_numpy(), cluster))
        table = table.take(pa.array(order))
        rep, copies, block = (table[c].to_numpy() for c in ("rep", "copies", "block"))
        rest = {c: table[c].to_numpy() for c in ("cluster", "left", "right")}
        out: list[list[np.ndarray]] = [[], [], []]
        ends = np.flatnonzero(np.append(np.diff(rest["cluster"]) != 0, True)) + 1
        start = 0
        for end in ends.tolist():
            here = slice(start, end)
            parts = [shingle_sets(texts, config.words) for texts in in_rounds(table["text"].slice(start, end - start).to_pylist())]
            values, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            i, j = rest["left"][start], rest["right"][start]
            left, right = np.flatnonzero(block[here] == i), np.flatnonzero(block[here] == j)
            a, b = _pairs_within(values, sizes, left, right, config)
            if i == j:
                a, b = a[a < b], b[a < b]
            n = end - start
            links = np.bincount(a, weights=copies[here][b], minlength=n) + np.bincount(b, weights=copies[here][a], minlength=n)
            low = _lowest(n, a, b, rep[here])
            some = links > 0
            for to, x in zip(out, (rep[here], links.astype(np.int64), low), strict=True):
                to.append(x[some])
            start = end
        return pa.table({n: pa.array(np.concatenate(x) if x else [], type=pa.int64()) for n, x in zip(("rep", "links", "low"), out, strict=True)})

    return members.groupBy("task").applyInArrow(join, LINKED)


def join(docs: DataFrame, config: JoinConfig = JoinConfig()) -> DataFrame:
    """(doc_id, class_id, n_links, kept) for every row of ``docs``.

    ``class_id`` is the smallest doc_id that links lead to, ``n_links`` the number of other documents that are
    similar enough, and ``kept`` says that the document is its class's own.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    repeats = ids.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 and doc_id is not null").limit(1).count() > 0
    if repeats:
        texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    signed = materialize(signatures(texts, config), "signed")
    found = _classes(texts, signed, config)
    alone = signed.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    found = signed.where("n > 0").select("doc_id", "k1", "k2", "n").join(found, ["k1", "k2", "n"]).select("doc_id", "class_id", "n_links").unionByName(alone)
    if repeats:
        found = ids.join(found, "doc_id")
    nameless = ids.where("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def _classes(texts: DataFrame, signed: DataFrame, config: JoinConfig) -> DataFrame:
    """(k1, k2, n, class_id, n_links) of each distinct set."""
    classes = materialize(signed.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    clusters = materialize(_clusters(classes, config).join(classes.select("rep", "copies", "n"), "rep"), "clusters")
    sizes = clusters.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / F.lit(config.block)), F.ceil(F.sum("n") / F.lit(config.block_grams))).cast("long").alias("blocks"))
    placed = clusters.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    total, grams = clusters.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bundles = max(1, total // config.block, grams // config.block_grams)
    members = placed.hint("merge").join(texts.select(F.col("doc_id").alias("rep"), F.lower("text").cast("binary").alias("text")), "rep")
    meets = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    paired = members.withColumn("other", meets).withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))
    # Small clusters share a task; the blocks of a large one have a task for each pair.
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(bundles))).otherwise(F.lit(bundles) + F.pmod(F.xxhash64("cluster", "left", "right"), F.lit(1 << 60)))
    linked = materialize(_links(paired.withColumn("task", task).select("rep", "copies", "cluster", "block", "left", "right", "task", "text"), config), "linked")
    reached = components(linked.where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))).select(F.col("node").alias("rep"), "component")
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    result = classes.select("k1", "k2", "n", "rep", "copies").join(links, "rep", "left").join(reached, "rep", "left")
    return materialize(result.select("k1", "k2", "n", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "result")
