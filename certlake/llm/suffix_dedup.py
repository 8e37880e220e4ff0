"""Removal of passages that occur more than once, byte by byte, with suffix arrays.

Every byte that lies in a string of ``length`` bytes which also starts anywhere else, in this text or another, goes.
Strings are judged on the input, so all occurrences of a passage go, the first one too.

1. Each window of ``length`` bytes chooses one of its ``gram``-byte strings, by a hash, the leftmost of the smallest.
   Equal windows choose equal strings at equal places, so they can only meet under one of them.  Windows in a row that
   choose the same string are one fragment, so a text has a fragment for every few dozen bytes.
2. Fragments whose chosen string occurs once in the whole corpus are done with: their windows are unique.  Of the rest,
   fragments with equal bytes are one, with their number; that is combined before the shuffle.
3. Fragments that chose the same string form a group.  A group's fragments are laid one after another and their suffix
   array is built by grouping (``suffix_groups``).  In it equal windows are neighbours; of a run of equal windows, which
   are compared byte by byte, all are repeated if the run stands for two places or more.  A group of a single fragment
   that stands for several places needs no array: each of its windows occurs as often.
4. A group of more than ``kinds`` different fragments (a string that stands in ever new surroundings) is split
   further: its windows are dealt by 128 bits of their whole content and counted, combined before the shuffle.
5. Repeated windows go back to all fragments with their bytes, and from there to the rows.

Texts are shuffled by row number, twice.  No group, row or text set meets in one task beyond ``kinds`` fragments of at
most ``2 * length`` bytes.  Where the key names each row, it is the row's number; otherwise rows are numbered in a
table.

Null texts are empty texts; these and texts of fewer than ``length`` bytes keep all.  Rows that repeat a text (of
``length`` bytes or more) lose all of it, whatever their keys.  Very long texts take part whole.  The columns
``kept``, ``spans``, ``n_bytes`` and ``n_removed`` replace columns of these names; all others stay.  A table without
rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certlake.llm.common import materialize, spare
from certlake.llm.suffix_groups import _layout, emit, lyndon_groups
from certlake.llm.words import _powers, in_rounds, mix


@dataclass(frozen=True)
class RepeatConfig:
    """``length``: bytes of a string whose repetition counts; ``gram``: bytes of the strings that windows choose;
    ``kinds``: different fragments of a group up to which it has a suffix array; ``batch`` and ``task``: bytes of the
    strings sorted side by side, and of those in one task."""

    length: int = 200
    gram: int = 80
    kinds: int = 16
    batch: int = 1_000_000
    task: int = 6_000_000


def _sums(buf: np.ndarray, letters: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(letters[buf] * up[: len(buf)], out=out[1:])
    return out


_DRAW = np.random.default_rng(13)
LETTERS = [_DRAW.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1) for _ in range(2)]


def _hashes(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the strings from ``first`` up to ``last``, the same wherever they stand."""
    _, down = _powers(len(sums))
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    return np.minimum(keys[: len(keys) - (width - span)], keys[width - span :]) if width > span else keys


def fragments_of(texts: list[bytes], config: RepeatConfig) -> tuple[np.ndarray, ...]:
    """(chosen, content, text, at, windows) of every fragment: two hashes, the text's place in the list, the first
    window's place in the text and the number of windows."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    long_enough = np.flatnonzero(sizes >= config.length)
    none = np.zeros(0, dtype=np.int64)
    if not len(long_enough):
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    buf = np.frombuffer(b"".join(texts[i] for i in long_enough), dtype=np.uint8)
    ends = np.cumsum(sizes[long_enough])
    starts = ends - sizes[long_enough]
    sums, n = _sums(buf, LETTERS[0]), len(buf)
    _, down = _powers(n + 1)
    grams = mix((sums[config.gram :] - sums[: n + 1 - config.gram]) * down[: n + 1 - config.gram])
    keys = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    chosen = (_least(keys, config.length - config.gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.ones(len(chosen), dtype=bool)
    for e in ends[:-1].tolist():
        inside[e - config.length + 1 : e] = False
    new = np.ones(len(chosen), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    closes = np.ones(len(chosen), dtype=bool)
    closes[:-1] = new[1:] | ~inside[1:]
    last = np.flatnonzero(closes & inside)
    of = np.searchsorted(ends, first, side="right")
    return grams[chosen[first]], _hashes(sums, first, last + config.length), long_enough[of], first - starts[of], last - first + 1


FRAGMENT = "chosen long, content long, row long, at int, windows int"


def fragments(rows: DataFrame, config: RepeatConfig) -> DataFrame:
    """The fragments of all (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, at = batch.column(0).to_numpy(), 0
            for texts in in_rounds(batch.column(1).to_pylist()):
                chosen, content, of, place, windows = fragments_of(texts, config)
                cells = [chosen.view(np.int64), content.view(np.int64), numbers[at : at + len(texts)][of], place.astype(np.int32), windows.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells], names=["chosen", "content", "row", "at", "windows"])
                at += len(texts)

    return rows.select("row", F.col("text").cast("binary")).mapInArrow(run, FRAGMENT)


def _with_bytes(rows: DataFrame, wanted: DataFrame, config: RepeatConfig) -> DataFrame:
    """``wanted`` fragments (chosen, content, n, many, row, at, windows) with their bytes: a row's are looked up in its
    text, so no list is longer than the text."""
    listed = wanted.groupBy("row").agg(F.collect_list(F.struct("chosen", "content", "n", "many", "windows", "at")).alias("list"))
    part = F.substring(F.col("text").cast("binary"), F.col("f.at") + 1, F.col("f.windows") + (config.length - 1))
    met = rows.hint("merge").join(listed, "row").select(F.explode("list").alias("f"), "text")
    return met.select("f.chosen", "f.content", "f.n", "f.many", "f.windows", part.alias("bytes"))


REPEATED = "chosen long, content long, first int, last int"


def _runs(keys: list[np.ndarray]) -> np.ndarray:
    """Where a new combination of ``keys`` begins."""
    return np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))) if len(keys[0]) else np.zeros(0, dtype=np.int64)


def repeated_windows(groups: list[list[int]], parts: list[bytes], windows: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(part, first, last): ranges of the windows of each part that are repeated within its group."""
    text, starts, ends = _layout([np.frombuffer(b"".join(parts[i] for i in group), dtype=np.uint8) for group in groups])
    order = emit(*lyndon_groups(text, starts, ends), starts, ends)
    members = np.array([i for group in groups for i in group], dtype=np.int64)
    sizes = np.array([len(parts[i]) for i in members], dtype=np.int64)
    heads = np.cumsum(sizes) - sizes + 2 * np.repeat(np.arange(len(groups)), [len(g) for g in groups]) + 1
    part_of = np.full(len(text), -1, dtype=np.int64)
    at = np.repeat(heads, windows[members]) + np.arange(windows[members].sum()) - np.repeat(np.cumsum(windows[members]) - windows[members], windows[members])
    part_of[at] = np.repeat(np.arange(len(members)), windows[members])
    sorted_windows = order[part_of[order] >= 0]
    string = np.searchsorted(ends, sorted_windows, side="right")
    bytes_of = np.lib.stride_tricks.sliding_window_view((text - 2).astype(np.uint8), length)
    same = np.zeros(len(sorted_windows), dtype=bool)
    for k in range(1, len(sorted_windows), 4096):
        a, b = sorted_windows[k - 1 : k + 4095], sorted_windows[k : k + 4096]
        same[k : k + 4096] = (bytes_of[a[: len(b)]] == bytes_of[b]).all(axis=1)
    same[1:] &= string[1:] == string[:-1]
    run = np.cumsum(~same) - 1
    places = np.bincount(run, weights=n[members[part_of[sorted_windows]]], minlength=1)
    found = np.sort(sorted_windows[places[run] >= 2])
    part = part_of[found]
    offset = found - heads[part]
    cuts = _runs([part, offset - np.arange(len(offset))])
    stops = np.append(cuts[1:], len(part)) - 1 if len(cuts) else cuts
    return members[part[cuts]], offset[cuts], offset[stops]


def _by_arrays(few: DataFrame, config: RepeatConfig) -> DataFrame:
    """Repeated windows of groups of up to ``kinds`` fragments."""

    def search(table: pa.Table) -> pa.Table:
        chosen = table["chosen"].to_numpy()
        order = np.argsort(chosen, kind="stable")
        table, chosen = table.take(pa.array(order)), chosen[order]
        windows, n, content, parts = (table["windows"].to_numpy(), table["n"].to_numpy(), table["content"].to_numpy(), table["bytes"].to_pylist())
        cuts = _runs([chosen])
        groups = [list(range(a, b)) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(chosen)], strict=True)]
        sized = sorted((sum(len(parts[i]) for i in g), g[0], g) for g in groups)
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        held, total = [], 0
        for size, _, group in [*sized, (config.batch, 0, None)]:
            if held and total + size > config.batch:
                for to, x in zip(out, repeated_windows(held, parts, windows, n, config.length), strict=True):
                    to.append(x)
                held, total = [], 0
            held, total = [*held, group] if total == 0 else held + [group], total + size
        part, first, last = (np.concatenate(x) for x in out)
        return pa.table({"chosen": pa.array(chosen[part]), "content": pa.array(content[part]), "first": pa.array(first.astype(np.int32)), "last": pa.array(last.astype(np.int32))})

    tasks = 1 + (few.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0] // config.task)
    dealt = few.select("chosen", "content", "n", "windows", "bytes", F.pmod(F.xxhash64("chosen"), F.lit(tasks)).alias("task"))
    return dealt.groupBy("task").applyInArrow(search, REPEATED)


WINDOW = "a long, b long, chosen long, content long, n long, place int"


def _by_windows(many: DataFrame, config: RepeatConfig) -> DataFrame:
    """Repeated windows of groups of more fragments: windows are counted by 128 bits of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                chosen, content, n, windows = (part.column(k).to_numpy() for k in range(4))
                parts = part.column(4).to_pylist()
                sizes = np.array([len(p) for p in parts], dtype=np.int64)
                buf = np.frombuffer(b"".join(parts), dtype=np.uint8)
                inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
                at = np.repeat(np.cumsum(sizes) - sizes, windows) + inside
                a, b = (_hashes(_sums(buf, letters), at, at + config.length) for letters in LETTERS)
                cells = [a.view(np.int64), b.view(np.int64), *(np.repeat(x, windows) for x in (chosen, content, n)), inside.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells], names=["a", "b", "chosen", "content", "n", "place"])

    seen = materialize(many.select("chosen", "content", "n", "windows", "bytes").mapInArrow(run, WINDOW), "windows")
    twice = materialize(seen.groupBy("a", "b").agg(F.sum("n").alias("times")).where("times > 1").select("a", "b"), "twice")
    back = seen.select("a", "b", "chosen", "content", "place").hint("merge").join(twice, ["a", "b"])
    return back.select("chosen", "content", F.col("place").alias("first"), F.col("place").alias("last"))


def repeats(rows: DataFrame, config: RepeatConfig = RepeatConfig()) -> DataFrame:
    """(row, ranges): for each (row, text) with repeated windows, their ranges as (first, last) places."""
    all_fragments = materialize(fragments(rows, config), "fragments")
    # Counts are tables of their own: joined to one, Spark can split the partition of a string that stands everywhere.
    shared = materialize(all_fragments.groupBy("chosen").agg(F.count("*").alias("times")).where("times > 1").select("chosen"), "shared")
    met = materialize(all_fragments.hint("merge").join(shared, "chosen"), "met")
    one = F.min(F.struct("row", "at", "windows")).alias("one")
    distinct = materialize(met.groupBy("chosen", "content").agg(F.count("*").alias("n"), one).select("chosen", "content", "n", "one.*"), "distinct")
    kinds = materialize(distinct.groupBy("chosen").agg(F.count("*").alias("kinds")), "kinds")
    grouped = distinct.hint("merge").join(kinds, "chosen")
    alone = grouped.where("kinds = 1 AND n > 1").select("chosen", "content", F.lit(0).alias("first"), (F.col("windows") - 1).alias("last"))
    wanted = grouped.where("kinds > 1").withColumn("many", F.col("kinds") > config.kinds)
    parts = materialize(_with_bytes(rows, wanted, config), "parts")
    found = materialize(alone.unionByName(_by_arrays(parts.where("NOT many"), config)).unionByName(_by_windows(parts.where("many"), config)), "repeated")
    placed = met.select("chosen", "content", "row", "at").hint("merge").join(found, ["chosen", "content"])
    return placed.groupBy("row").agg(F.collect_list(F.struct((F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last")).alias("last"))).alias("ranges"))


LEFT = "struct<kept: binary, spans: array<struct<start: long, end: long>>, n_removed: long>"


def remove(docs: DataFrame, key: str = "doc_id", config: RepeatConfig = RepeatConfig()) -> DataFrame:
    """``docs`` with ``kept`` (the remaining bytes of ``text``), ``spans`` (the removed runs, as places of bytes),
    ``n_bytes`` and ``n_removed``."""
    row = spare(docs.columns, "row")
    repeated = docs.groupBy(F.col(f"`{key}`").alias("key")).agg(F.count("*").alias("rows")).where("rows > 1 OR key IS NULL").limit(1).count() > 0
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered") if repeated else docs.withColumn(row, F.col(f"`{key}`").cast("long"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = repeats(numbered.select(F.col(row).alias("row"), text.alias("text")), config)

    @F.pandas_udf(LEFT)
    def left(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        out = []
        for text, listed in zip(texts, ranges, strict=True):
            if text is None:
                out.append((None, None, None))
                continue
            spans: list[list[int]] = []
            for first, end in sorted((r["first"], r["last"] + config.length) for r in listed):
                if spans and first <= spans[-1][1]:
                    spans[-1][1] = max(end, spans[-1][1])
                else:
                    spans.append([first, end])
            edges = [0, *(x for span in spans for x in span), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((kept, [{"start": a, "end": b} for a, b in spans], len(text) - len(kept)))
        return pd.DataFrame(out, columns=["kept", "spans", "n_removed"]).astype({"n_removed": "Int64"})

    ranges, done, new = spare(docs.columns, "ranges"), spare(docs.columns, "left"), ["kept", "spans", "n_bytes", "n_removed"]
    joined = numbered.hint("merge").join(found.select(F.col("row").alias(row), F.col("ranges").alias(ranges)), row, "left")
    # Only texts with repeats go to Python.
    cut = left(F.when(F.col(ranges).isNotNull(), text.cast("binary")), F.col(ranges))
    whole = text.cast("binary")
    return joined.withColumn(done, cut).select(
        *(F.col(f"`{c}`") for c in docs.columns if c.lower() not in new),
        F.coalesce(F.col(f"{done}.kept"), whole).alias("kept"),
        F.coalesce(F.col(f"{done}.spans"), F.array().cast("array<struct<start: long, end: long>>")).alias("spans"),
        F.octet_length(whole).cast("long").alias("n_bytes"),
        F.coalesce(F.col(f"{done}.n_removed"), F.lit(0)).cast("long").alias("n_removed"),
    )


def digest_table(docs: DataFrame, config: RepeatConfig = RepeatConfig()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    done = remove(docs.select("doc_id", "text"), "doc_id", config)
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
