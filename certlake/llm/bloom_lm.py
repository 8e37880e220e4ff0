"""Language-model scores from a log-frequency Bloom filter.

Training counts words and word pairs of all training texts, those seen once included.  Counts are quantised on a
logarithmic scale, and an n-gram of level q is put q times into a Bloom filter, once for each level up to its own.
A lookup probes levels one after another until one is missing, which gives the quantised count back.  The model's
probability of a word mixes the pair's share of its first word with the add-one share of the word:

    p(w | h) = m * low(hw) / high(h) + (1 - m) * (low(w) + 1) / (N + V + 1)

``low`` and ``high`` are the least and the largest count of a level, so that the next words' shares sum to one at
most, but for false positives of the filter.  m depends on how often h occurs and on whether the pairs just before
were known; it is fitted by expectation maximisation over all training tokens, each left out of its own counts.
The tokens are first summed by levels, a table whose size depends on the number of levels alone.

Counts move as sorted hash arrays, cut in slices by hash; their number follows the corpus, so a slice stays as
large as it is.  Every slice builds its own segment of the filter.  Filter and word counts of together at most
``broadcast_bytes`` are broadcast to the workers.  Beyond that the segments stay where they are: texts are dealt in
parts, each part sends the keys of its distinct n-grams to their slices once, and the levels come back to the part.
Both ways give the same numbers.

Lower-case A-Z; tokens are runs of bytes other than white space (0x20, 0x09-0x0D), then one end for each text.
Null and empty texts are the one end.  Repeated rows and rows with a null id are texts like any others.  Texts are
read whole.  Columns named like results are replaced; other columns stay, but for ``text``.  Without training texts
every count is 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from certlake.llm.common import materialize, spare
from certlake.llm.words import in_rounds, mix, word_hashes

END = np.uint64(0x5851F42D4C957F2D)
PAIR = np.uint64(0xA0761D6478BD642F)
LOW = np.uint64(0xFFFF)
STATES = 36
LEVELS = 128
ROUND = 500_000  # bytes of levels looked at together
RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


@dataclass(frozen=True)
class LmConfig:
    """``base`` of the logarithmic scale; ``bits`` and ``probes`` of the filter for each entry; the bound of what
    is broadcast; ``slice_bytes`` of training text make a slice, ``part_bytes`` of text a part."""

    base: float = 1.5
    bits: int = 8
    probes: int = 4
    broadcast_bytes: int = 16 << 20
    slice_bytes: int = 16 << 20
    part_bytes: int = 12 << 20


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word key, pair key, tokens of each text): the pair of a token is that of the token before it and itself;
    an end stands before each text.  Words are even, pairs odd.  A pair has 48 bits above its mark."""
    words, counts = [], []
    for some in in_rounds(texts):
        w, n = word_hashes(some, lower=True)
        words.append(np.insert(w, np.cumsum(n), END))
        counts.append(n + 1)
    words, counts = np.concatenate([np.zeros(0, np.uint64), *words]), np.concatenate([np.zeros(0, np.int64), *counts])
    before = np.concatenate([[END], words[:-1]])
    pairs = mix(before * PAIR + words)
    return words & ~np.uint64(1), pairs & ~LOW | np.uint64(1), counts


def level(counts: np.ndarray, base: float) -> np.ndarray:
    """1 + floor(log_base(count))."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(base) + 1e-9).astype(np.int64)


def level_ranges(base: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest whole number of each level; 0 for level 0, and that of the level below for one
    without any."""
    low, high = np.zeros(LEVELS), np.zeros(LEVELS)
    for q in range(1, LEVELS):
        a, b = np.ceil(base ** (q - 1) - 1e-9), np.ceil(base**q - 1e-9) - 1
        low[q], high[q] = (a, b) if b >= a else (low[q - 1], high[q - 1])
    return low, high


# Sorted keys of one slice travel as the gaps between them, in as many bytes as the widest gap needs.


def slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


def _start(at: int, slices: int) -> int:
    """The least key of a slice."""
    return -(-(at << 32) // slices) << 32


def pack_keys(keys: np.ndarray, start: int, pairs: bool) -> bytes:
    """Pairs go without their 16 lowest bits, which are all the same."""
    shift = 16 if pairs else 0
    gaps = np.diff(keys >> np.uint64(shift), prepend=np.uint64(start >> shift))
    width = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(data: bytes, start: int, pairs: bool) -> np.ndarray:
    shift = 16 if pairs else 0
    width = data[0]
    cells = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    wide = np.zeros((len(cells), 8), np.uint8)
    wide[:, :width] = cells
    keys = np.cumsum(wide.view("<u8").ravel().astype(np.uint64), dtype=np.uint64) + np.uint64(start >> shift)
    return keys << np.uint64(shift) | np.uint64(1) if pairs else keys


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte for each count; those of 255 and more follow in full."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u8").tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, count=n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=n).astype(np.int64)
    return out


def _by_slice(words: np.ndarray, pairs: np.ndarray, slices: int) -> list[tuple[int, slice, slice]]:
    """The slices that sorted words and pairs fall into, with the places of both."""
    found = np.unique(np.concatenate([slice_of(words, slices), slice_of(pairs, slices)]))
    w, p = (np.searchsorted(slice_of(x, slices), np.append(found, slices)) for x in (words, pairs))
    return [(int(s), slice(int(w[i]), int(w[i + 1])), slice(int(p[i]), int(p[i + 1]))) for i, s in enumerate(found)]


def _packed(words: np.ndarray, pairs: np.ndarray, slices: int) -> list[tuple[int, bytes, bytes]]:
    return [(s, pack_keys(words[w], _start(s, slices), False), pack_keys(pairs[p], _start(s, slices), True)) for s, w, p in _by_slice(words, pairs, slices)]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.zeros(len(key), dtype=np.int64)
    np.add.at(n, place, np.concatenate(counts))
    return key, n


COUNTED = "slice int, words binary, word_counts binary, n_words long, n_tokens long, size long, segment binary"


def _count(texts: DataFrame, slices: int, config: LmConfig) -> DataFrame:
    """By slices of the keys' range: the words of all texts with their counts, and the segment of words and pairs
    with its size in bits."""
    names = ("words", "pairs", "word_counts", "pair_counts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            words, pairs, _ = tokens(held)
            (words, n), (pairs, m) = (np.unique(x, return_counts=True) for x in (words, pairs))
            places = _by_slice(words, pairs, slices)
            cells = [pa.array([x[k] for x in _packed(words, pairs, slices)], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))]
            cells += [pa.array([pack_counts(n[w]) for _, w, _ in places], pa.binary()), pa.array([pack_counts(m[p]) for _, _, p in places], pa.binary())]
            return pa.RecordBatch.from_arrays(cells, names=["slice", *names])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(text)
                size += len(text)
                if size >= config.part_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def add(table: pa.Table) -> pa.Table:
        at = table["slice"][0].as_py()
        start = _start(at, slices)
        words, pairs = ([unpack_keys(x, start, kind) for x in table[c].to_pylist()] for c, kind in (("words", False), ("pairs", True)))
        counts = ([unpack_counts(x, len(k)) for x, k in zip(table[c].to_pylist(), of, strict=True)] for c, of in (("word_counts", words), ("pair_counts", pairs)))
        (words, n), (pairs, m) = (_summed(k, c) for k, c in zip((words, pairs), counts, strict=True))
        q = level(np.concatenate([n, m]), config.base)
        size = max(64, int(q.sum()) * config.bits)
        row = (at, pack_keys(words, start, False), pack_counts(n), len(n), int(n.sum()), size, segment_of(np.concatenate([words, pairs]), q, size, config.probes))
        types = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table({c.split()[0]: pa.array([x], t) for c, x, t in zip(COUNTED.split(", "), row, types, strict=True)})

    return texts.mapInArrow(count, f"slice int, {', '.join(f'{n} binary' for n in names)}").groupBy("slice").applyInArrow(add, COUNTED)


def _hashes(keys: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix(keys + np.uint64((1 + q * int(PAIR)) & 0xFFFFFFFFFFFFFFFF))
    return a, (a >> np.uint64(32)) | np.uint64(1)


def _place(a: np.ndarray, b: np.ndarray, probe: int, size: np.ndarray | np.uint64) -> np.ndarray:
    """Bit places in a segment of ``size`` bits."""
    return ((a + np.uint64(probe) * b) & np.uint64(0xFFFFFFFF)) * size >> np.uint64(32)


def segment_of(keys: np.ndarray, q: np.ndarray, size: int, probes: int) -> bytes:
    """The filter segment of the keys of one slice, each put in for every level up to its own."""
    bits = np.zeros(size, dtype=bool)
    for at in range(1, int(q.max(initial=0)) + 1):
        a, b = _hashes(keys[q >= at], at)
        for probe in range(probes):
            bits[_place(a, b, probe, np.uint64(size))] = True
    return np.packbits(bits).tobytes()


def levels_in(keys: np.ndarray, bits: np.ndarray, start: np.ndarray | int, size: np.ndarray | int, probes: int) -> np.ndarray:
    """Levels of ``keys``, probed until one is missing; each key's segment begins at bit ``start`` of ``bits``."""
    start, size = np.broadcast_to(start, len(keys)), np.broadcast_to(size, len(keys)).astype(np.uint64)
    found, alive, q = np.zeros(len(keys), dtype=np.uint8), np.flatnonzero(size > 0), 1
    while len(alive) and q < LEVELS:
        a, b = _hashes(keys[alive], q)
        for probe in range(probes):
            at = start[alive] + _place(a, b, probe, size[alive]).astype(np.int64)
            there = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            alive, a, b = alive[there], a[there], b[there]
        found[alive] = q
        q += 1
    return found


@dataclass
class Held:
    """All segments one after another, and all words with their counts, in the order of their keys."""

    bits: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    counts: np.ndarray
    probes: int

    def look(self, words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Levels of distinct words and pairs, and the exact counts of the words."""
        q = []
        for keys in (words, pairs):
            at = slice_of(keys, len(self.sizes))
            q.append(levels_in(keys, self.bits, self.starts[at], self.sizes[at], self.probes))
        return *q, exact(words, self.words, self.counts)


def exact(found: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of ``found`` among ``words``, which are sorted."""
    if not len(words):
        return np.zeros(len(found), dtype=np.int64)
    at = np.minimum(np.searchsorted(words, found), len(words) - 1)
    return np.where(words[at] == found, counts[at], 0)


@dataclass
class Counts:
    """What training texts hold: the table of slices, and its totals."""

    config: LmConfig
    slices: int
    n_tokens: int
    n_words: int
    n_bytes: int
    table: DataFrame

    @property
    def size(self) -> int:
        return self.n_tokens + self.n_words + 1

    def held(self) -> Held:
        """The whole filter with the word counts, for a broadcast; ``n_bytes`` bounds it."""
        sizes, segments, words, counts = np.zeros(self.slices, dtype=np.int64), [b""] * self.slices, [], []
        for r in sorted(self.table.toLocalIterator(), key=lambda r: r.slice):
            sizes[r.slice], segments[r.slice] = r.size, bytes(r.segment)
            words.append(unpack_keys(bytes(r.words), _start(r.slice, self.slices), False))
            counts.append(unpack_counts(bytes(r.word_counts), len(words[-1])))
        starts = 8 * np.cumsum([0, *map(len, segments)])[:-1]
        none = [np.zeros(0, np.uint64)]
        return Held(np.frombuffer(b"".join(segments), np.uint8), starts, sizes, np.concatenate(none + words), np.concatenate([np.zeros(0, np.int64), *counts]), self.config.probes)


def raw_text() -> Column:
    return F.coalesce(F.col("text"), F.lit("")).cast("binary")


def count(texts: DataFrame, config: LmConfig = LmConfig()) -> Counts:
    """Counts all of ``texts`` (text) and builds the filter's segments, where they lie."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-size // config.slice_bytes))
    table = materialize(_count(texts.select(raw_text().alias("text")), slices, config), "counted")
    totals = table.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "n_words", "size"))).first()
    return Counts(config, slices, totals[0], totals[1], totals[2] // 8 + 16 * totals[1], table)


def measure(texts: list[bytes], look: Callable, size: int) -> tuple[list[np.ndarray], list[bytes]]:
    """([n_tokens, n_known, base score], levels of the word and the pair of each token in turn) of each text;
    ``look`` gives the levels of sorted distinct words and pairs, and the words' counts."""
    words, pairs, counts = tokens(texts)
    (words, of_word), (pairs, of_pair) = (np.unique(x, return_inverse=True) for x in (words, pairs))
    q_words, q_pairs, n = look(words, pairs)
    first = np.cumsum(counts) - counts
    base = np.add.reduceat(np.log10((n + 1.0) / size)[of_word], first)
    q = np.stack([q_words[of_word], q_pairs[of_pair]], axis=1)
    return [counts, np.add.reduceat((n > 0).astype(np.int64)[of_word], first), base], [x.tobytes() for x in np.split(q, first[1:])]


def _measured(table: pa.Table, names: list[str], measured: list, levels: str) -> pa.Table:
    """The columns ``names`` with what ``measure`` gave for their rows."""
    numbers = [np.concatenate([m[0][i] for m in measured]) if measured else np.zeros(0) for i in range(3)]
    cells = {n: table[n] for n in names}
    cells |= {"n_tokens": pa.array(numbers[0], pa.int64()), "n_known": pa.array(numbers[1], pa.int64()), "base_score": pa.array(numbers[2], pa.float64())}
    return pa.table(cells | {levels: pa.array([x for m in measured for x in m[1]], pa.binary())})


def _texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def look_up(docs: DataFrame, counts: Counts) -> DataFrame:
    """``docs`` (text and any other columns) with n_tokens, n_known, base_score and the levels of their tokens."""
    names = [c for c in docs.columns if c not in ("text", *RESULTS)]
    levels = spare(docs.columns, "levels")
    kept = StructType([docs.schema[n] for n in names])
    schema = StructType([*kept, StructField("n_tokens", LongType()), StructField("n_known", LongType()), StructField("base_score", DoubleType()), StructField(levels, BinaryType())])
    if counts.n_bytes <= counts.config.broadcast_bytes:
        held = docs.sparkSession.sparkContext.broadcast(counts.held())
        return materialize(_with_broadcast(docs, held, counts, names, levels, schema), "levels", compression="zstd")
    return materialize(_with_segments(docs, counts, names, levels, schema), "levels", compression="zstd")


def _with_broadcast(docs: DataFrame, held: Broadcast, counts: Counts, names: list[str], levels: str, schema: StructType) -> DataFrame:
    part_bytes, size = counts.config.part_bytes, counts.size

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            measured = [measure(some, held.value.look, size) for some in in_rounds(_texts(batch["text"]), part_bytes)]
            yield from _measured(pa.Table.from_batches([batch]), names, measured, levels).combine_chunks().to_batches()

    return docs.select(*(F.col(f"`{n}`") for n in names), "text").mapInArrow(look, schema)


def _with_segments(docs: DataFrame, counts: Counts, names: list[str], levels: str, schema: StructType) -> DataFrame:
    """Parts of the texts send their keys to the slices, and get levels and counts back.

    A scan may cut a part, and a run of its rows then sends keys of its own: ``run`` is the place of its first row.
    """
    config, slices, size = counts.config, counts.slices, counts.size
    part, place = spare(docs.columns, "part"), spare(docs.columns, "place")
    rows = docs.select(*(F.col(f"`{n}`") for n in names), "text")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (TaskContext.get().partitionId() << 32) - 1
        for batch in batches:
            if batch.num_rows:
                sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy().astype(np.int64)
                turn = (np.cumsum(sizes) - sizes) // config.part_bytes
                parts = last + np.cumsum(np.diff(turn, prepend=-1) != 0)
                last = int(parts[-1])
                yield batch.append_column(part, pa.array(parts, pa.int64())).append_column(place, pa.array(np.arange(len(sizes)), pa.int32()))

    dealt = StructType([*rows.schema, StructField(part, LongType()), StructField(place, IntegerType())])
    rows = materialize(rows.mapInArrow(deal, dealt), "parts", compression="zstd")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, places = batch[part].to_numpy(), batch[place].to_numpy()
            cuts = np.flatnonzero((np.diff(parts) != 0) | (np.diff(places) != 1)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True) if batch.num_rows else ():
                words, pairs, _ = tokens(_texts(batch["text"].slice(a, b - a)))
                found = _packed(np.unique(words), np.unique(pairs), slices)
                n = len(found)
                cells = [pa.array([parts[a]] * n, pa.int64()), pa.array([places[a]] * n, pa.int32())]
                cells += [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(cells, names=["part", "run", "slice", "words", "pairs"])

    def probe(sent: pa.Table, segment: pa.Table) -> pa.Table:
        out = {"words": [], "pairs": [], "counts": []}
        if sent.num_rows:
            start, known, counted = _start(sent["slice"][0].as_py(), slices), np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if segment.num_rows:
                known = unpack_keys(segment["words"][0].as_py(), start, False)
                counted = unpack_counts(segment["word_counts"][0].as_py(), len(known))
                bits, n_bits = np.frombuffer(segment["segment"][0].as_py(), np.uint8), segment["size"][0].as_py()
            for kind, pair in (("words", False), ("pairs", True)):
                each = [unpack_keys(x, start, pair) for x in sent[kind].to_pylist()]
                keys, at = np.unique(np.concatenate(each), return_inverse=True)
                q = levels_in(keys, bits, 0, n_bits, config.probes) if segment.num_rows else np.zeros(len(keys), dtype=np.uint8)
                n = None if pair else exact(keys, known, counted)
                for i in np.split(at, np.cumsum([len(x) for x in each])[:-1]):
                    out[kind].append(q[i].tobytes())
                    if not pair:
                        out["counts"].append(pack_counts(n[i]))
        return pa.table({c: sent[c] for c in ("part", "run", "slice")} | {c: pa.array(x, pa.binary()) for c, x in out.items()})

    keys = rows.select(part, place, "text").mapInArrow(send, "part long, run int, slice int, words binary, pairs binary")
    segments = counts.table.select("slice", "words", "word_counts", "size", "segment")
    answers = keys.groupBy("slice").cogroup(segments.groupBy("slice")).applyInArrow(probe, "part long, run int, slice int, words binary, pairs binary, counts binary")

    def put_back(mine: pa.Table, got: pa.Table) -> pa.Table:
        mine = mine.sort_by(place)
        got = got.sort_by([("run", "ascending"), ("slice", "ascending")])
        runs = got["run"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(runs)]
        firsts = np.searchsorted(mine[place].to_numpy(), runs[cuts[:-1]]) if len(runs) else []
        measured = []
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            upto = firsts[k + 1] if k + 1 < len(firsts) else mine.num_rows

            def look(words: np.ndarray, pairs: np.ndarray, a: int = a, b: int = b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                q = [np.frombuffer(b"".join(got[c].slice(a, b - a).to_pylist()), np.uint8) for c in ("words", "pairs")]
                sizes = map(len, got["words"].slice(a, b - a).to_pylist())
                return *q, np.concatenate([unpack_counts(x, n) for x, n in zip(got["counts"].slice(a, b - a).to_pylist(), sizes, strict=True)])

            measured.append(measure(_texts(mine["text"].slice(firsts[k], upto - firsts[k])), look, size))
        return _measured(mine, names, measured, levels)

    return rows.groupBy(part).cogroup(answers.groupBy("part")).applyInArrow(put_back, schema)


def steps_of(levels: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(run, level of the word before, of the pair, of the word, tokens of each text): ``run`` is how many of the
    two pairs before were known, within the text."""
    q = np.frombuffer(b"".join(map(bytes, levels)), np.uint8).astype(np.int64)
    counts = np.array([len(x) // 2 for x in levels], dtype=np.int64)
    word, pair = q[::2], q[1::2]
    last = np.cumsum(counts) - 1
    first = last + 1 - counts
    before = np.roll(word, 1)
    before[first] = word[last]  # an end stands before each text, and closes it
    known = pair > 0
    run = np.roll(known, 1).astype(np.int64) + (np.roll(known, 1) & np.roll(known, 2))
    run[first] = 0
    second = first[counts > 1] + 1
    run[second] = np.minimum(run[second], 1)
    return run, before, pair, word, counts


def shares(run: np.ndarray, before: np.ndarray, pair: np.ndarray, word: np.ndarray, size: int, base: float, left_out: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state, pair's share, word's share) of tokens from their levels; ``left_out`` is taken from each count."""
    low, high = level_ranges(base)
    state = np.minimum(11, np.floor(np.log2(np.maximum(low[before], 1))).astype(np.int64)) * 3 + run
    pair_share = np.minimum(1.0, np.maximum(low[pair] - left_out, 0) / np.maximum(high[before] - left_out, 1))
    return state, pair_share, (np.maximum(low[word] - left_out, 0) + 1) / size


def fit_mixture(found: DataFrame, counts: Counts, rounds: int = 30) -> np.ndarray:
    """The mixture of each state by expectation maximisation over all tokens of ``found``, rows of ``look_up`` for
    training texts."""
    column = found.columns[-1]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in in_rounds(batch.column(0).to_pylist(), ROUND):
                run, before, pair, word, _ = steps_of(some)
                cells, n = np.unique(((run * LEVELS + before) * LEVELS + pair) * LEVELS + word, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(n, pa.int64())], names=["cell", "n"])

    cells = found.select(column).mapInArrow(tally, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cell, n = cells["cell"].to_numpy(dtype=np.int64), cells["n"].to_numpy(dtype=float)
    state, pair_share, word_share = shares(cell // LEVELS**3, cell // LEVELS**2 % LEVELS, cell // LEVELS % LEVELS, cell % LEVELS, counts.size, counts.config.base, left_out=1.0)
    m = np.full(STATES, 0.3)
    for _ in range(rounds):
        from_pair = m[state] * pair_share
        share = from_pair / (from_pair + (1 - m[state]) * word_share)
        m = (np.bincount(state, weights=n * share, minlength=STATES) + 0.3) / (np.bincount(state, weights=n, minlength=STATES) + 1.0)
    return np.clip(m, 1e-4, 0.999)


def score_levels(found: DataFrame, counts: Counts, mixture: np.ndarray) -> DataFrame:
    """Rows of ``look_up`` with train_tokens, and ``score`` in place of the levels."""
    column, size, base = found.columns[-1], counts.size, counts.config.base

    @F.pandas_udf("double")
    def score(levels: pd.Series) -> pd.Series:
        out = [np.zeros(0)]
        for some in in_rounds(levels, ROUND):
            *steps, n = steps_of(some)
            state, pair_share, word_share = shares(*steps, size, base)
            each = np.log10(mixture[state] * pair_share + (1 - mixture[state]) * word_share)
            out.append(np.add.reduceat(each, np.cumsum(n) - n))
        return pd.Series(np.concatenate(out))

    total = F.lit(counts.n_tokens).cast("long").alias("train_tokens")
    return found.select(*(F.col(f"`{c}`") for c in found.columns[:-1]), total, score(F.col(f"`{column}`")).alias("score"))


@dataclass
class LmModel:
    """Counts and mixture of a model, to score other texts with."""

    counts: Counts
    mixture: np.ndarray


def train(texts: DataFrame, config: LmConfig = LmConfig()) -> LmModel:
    """A model of all of ``texts`` (text)."""
    counts = count(texts, config)
    return LmModel(counts, fit_mixture(look_up(texts.select("text"), counts), counts))


def score(docs: DataFrame, model: LmModel) -> DataFrame:
    """``docs`` without ``text``, with n_tokens, n_known, train_tokens, base_score and score of each whole text."""
    return score_levels(look_up(docs, model.counts), model.counts, model.mixture)


def train_and_score(docs: DataFrame, training: str, config: LmConfig = LmConfig()) -> DataFrame:
    """Scores all ``docs`` by a model of the rows whose boolean column ``training`` holds; each text is looked up
    once for both."""
    counts = count(docs.where(F.col(training)), config)
    found = look_up(docs, counts)
    return score_levels(found, counts, fit_mixture(found.where(F.col(training)), counts))
