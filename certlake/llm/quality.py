"""Quality classifier: random-indexing word vectors, pooled, and a small calibrated network.

Every text is read as a row of words, each followed by a mark of its form (case, trailing signs, a repeat of
the word before it).  Words and marks fall into a fixed number of buckets, and each bucket has a sparse random
index vector derived from its number.  A bucket's word vector is the sum of the index vectors that stood within
``window`` places of it anywhere in the corpus; these sums run over all documents.  A document is the mean of
its word vectors.  A two-layer network in numpy learns from a bounded sample of labelled rows, and a
temperature fitted on a part held back from them calibrates its probabilities.

Null and empty texts are the zero vector and get the network's answer to it.  Texts are read whole.  Labels of a
null id teach nothing; rows that repeat a labelled id teach once, by the smallest text.  Repeated rows are scored
alike.  A column named like the score is replaced.  Without labels every score is a half or nearly so.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certlake.llm.common import bounded_sample

FORM = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)


@dataclass(frozen=True)
class QualityConfig:
    """The word-vector table has ``buckets`` x ``dims`` numbers at any corpus size; ``max_train_rows`` bounds
    the labelled rows used to fit."""

    buckets: int = 8192
    dims: int = 64
    nonzero: int = 4
    window: int = 2
    hidden: int = 32
    max_train_rows: int = 8192
    rounds: int = 400
    rate: float = 0.01
    decay: float = 1e-4
    threshold: float = 0.3
    seed: int = 7


def _form(chunk: str) -> str:
    head, core, tail = FORM.match(chunk).groups()
    case = "d" if core.isdigit() else "A" if core.isupper() and len(core) > 1 else "a" if core == core.lower() else "Aa" if core[1:] == core[1:].lower() else "aA"
    return f"{'' if core else '0'}{case}|{head[:3]}|{tail[:3]}"


class Reader:
    """Turns texts into bucket numbers; remembers chunks up to a bound."""

    def __init__(self, config: QualityConfig, remember: int = 300_000):
        self.config, self.known, self.remember = config, {}, remember
        self.repeat = self.bucket("\0repeat")

    def bucket(self, word: str) -> int:
        return zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.config.buckets

    def chunk(self, chunk: str) -> int:
        code = self.bucket(FORM.match(chunk)[2].lower()) * self.config.buckets + self.bucket("\0" + _form(chunk))
        if len(self.known) >= self.remember:
            self.known.clear()
        self.known[chunk] = code
        return code

    def read(self, text: str | None) -> np.ndarray:
        """Bucket numbers: word, mark, word, mark ..."""
        known, chunk = self.known, self.chunk
        codes = np.array([known[c] if c in known else chunk(c) for c in (text or "").split()], dtype=np.int64)
        out = np.empty(2 * len(codes), dtype=np.int64)
        out[::2], out[1::2] = np.divmod(codes, self.config.buckets)
        if len(codes) > 1:
            out[3::2][codes[1:] == codes[:-1]] = self.repeat
        return out


def index_vectors(config: QualityConfig) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero cells of each bucket's index vector."""
    draw = np.random.default_rng(config.seed)
    places = np.argsort(draw.random((config.buckets, config.dims)), axis=1)[:, : config.nonzero]
    return places.astype(np.int64), draw.choice([-1.0, 1.0], (config.buckets, config.nonzero))


def _add_contexts(total: np.ndarray, tokens: np.ndarray, places: np.ndarray, signs: np.ndarray, config: QualityConfig) -> None:
    """Adds to the flat bucket x dims table what stands within the window of each token; -1 parts documents."""
    for apart in range(1, config.window + 1):
        a, b = tokens[:-apart], tokens[apart:]
        inside = (a >= 0) & (b >= 0)
        if apart > 1:
            inside &= tokens[1 : len(tokens) - apart + 1] >= 0
        a, b = a[inside], b[inside]
        for of, near in ((a, b), (b, a)):
            for k in range(config.nonzero):
                total += np.bincount(of * config.dims + places[near, k], weights=signs[near, k], minlength=len(total))


def word_vectors(docs: DataFrame, config: QualityConfig = QualityConfig()) -> np.ndarray:
    """The bucket x dims table of unit word vectors over all of ``docs``.

    Each task sums its own documents into one table; slices of the tables are added up a tree of 64 branches a
    level, so that no task gathers many of them.  The table that reaches the driver has a fixed size.
    """
    slices, branches = 64, 64
    per_slice = config.buckets * config.dims // slices
    schema = "slice int, salt int, part binary"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, (places, signs) = Reader(config), index_vectors(config)
        total, held, size = np.zeros(config.buckets * config.dims), [], 0
        for pdf in batches:
            for text in pdf["text"]:
                held += [reader.read(text), np.array([-1])]
                size += len(held[-2])
                if size > 1_000_000:
                    _add_contexts(total, np.concatenate(held), places, signs, config)
                    held, size = [], 0
        if held:
            _add_contexts(total, np.concatenate(held), places, signs, config)
        parts = total.reshape(slices, per_slice)
        full = [i for i in range(slices) if parts[i].any()]
        yield pd.DataFrame({"slice": full, "salt": TaskContext.get().partitionId() // branches, "part": [parts[i].tobytes() for i in full]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(per_slice)
        for part in pdf["part"]:
            total += np.frombuffer(part)
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "salt": pdf["salt"].iloc[:1] // branches, "part": [total.tobytes()]})

    parts = docs.select("text").mapInPandas(count, schema)
    for keys in (["slice", "salt"], ["slice", "salt"], ["slice"]):
        parts = parts.groupBy(*keys).applyInPandas(add, schema)
    table = np.zeros((slices, per_slice))
    for i, part in parts.select("slice", "part").toPandas().itertuples(index=False):
        table[i] = np.frombuffer(part)
    table = table.reshape(config.buckets, config.dims)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(norm > 0, norm, 1)).astype(np.float32)


@dataclass
class QualityModel:
    config: QualityConfig
    vectors: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float = 1.0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "reader"}

    def pool(self, text: str | None) -> np.ndarray:
        if not hasattr(self, "reader"):
            self.reader = Reader(self.config)
        return pooled(self.reader.read(text), self.vectors)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.centre) / self.spread @ w1 + b1) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def pooled(tokens: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector of the words and, beside it, of the marks."""
    out = np.zeros(2 * vectors.shape[1])
    for k in (0, 1):
        ids, times = np.unique(tokens[k::2], return_counts=True)
        if len(ids):
            out[k * vectors.shape[1] : (k + 1) * vectors.shape[1]] = times @ vectors[ids] / times.sum()
    return out


def fit(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, config: QualityConfig = QualityConfig()) -> QualityModel:
    """Adam on cross-entropy; every fifth row is held back to fit the temperature."""
    y = np.asarray(y, dtype=float)
    width = 2 * vectors.shape[1]
    x = np.asarray(x, dtype=float).reshape(-1, width)
    share = (y.sum() + 0.5) / (len(y) + 1)
    draw = np.random.default_rng(config.seed)
    layers = [draw.normal(0, width**-0.5, (width, config.hidden)), np.zeros(config.hidden), np.zeros(config.hidden), np.array(np.log(share / (1 - share)))]
    model = QualityModel(config, vectors, x.mean(0) if len(x) else np.zeros(width), (x.std(0) if len(x) else np.zeros(width)) + 1e-6, tuple(layers))
    back = np.arange(len(y)) % 5 == 4
    if len(y) < 10 or y[~back].min() == y[~back].max():
        return model
    z, t = (x[~back] - model.centre) / model.spread, y[~back]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in layers]
    for step in range(1, config.rounds + 1):
        h = np.tanh(z @ layers[0] + layers[1])
        gap = (1 / (1 + np.exp(-np.clip(h @ layers[2] + layers[3], -60, 60))) - t) / len(t)
        into = np.outer(gap, layers[2]) * (1 - h * h)
        grads = [z.T @ into + config.decay * layers[0], into.sum(0), h.T @ gap + config.decay * layers[2], gap.sum()]
        for i, (p, g) in enumerate(zip(layers, grads, strict=True)):
            m, s = moments[i]
            moments[i] = m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            layers[i] = p - config.rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    model.layers = tuple(layers)
    if back.any():
        raw, t = model.logits(x[back]), y[back]
        losses = {T: float(np.mean(np.logaddexp(0, -(2 * t - 1) * raw / T))) for T in np.geomspace(0.25, 8, 61)}
        model.temperature = min(losses, key=losses.get)
    return model


def train(docs: DataFrame, labelled: DataFrame, config: QualityConfig = QualityConfig()) -> QualityModel:
    """Word vectors over all ``docs``, then the network on a bounded sample of ``labelled`` (doc_id, quality)."""
    vectors = word_vectors(docs, config)
    held = docs.sparkSession.sparkContext.broadcast(vectors)
    sample = bounded_sample(labelled.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").dropDuplicates(["doc_id"]), "doc_id", config.max_train_rows)

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(config)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "quality": pdf["quality"], "x": [pooled(reader.read(t), held.value) for t in pdf["text"]]})

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = rows.mapInPandas(pool, "doc_id long, quality int, x array<double>").toPandas()
    got = got.sort_values("doc_id", kind="stable")
    return fit(np.array(got["x"].tolist()), got["quality"].to_numpy(), vectors, config)


def score(docs: DataFrame, model: QualityModel, column: str = "quality_score") -> DataFrame:
    """``docs`` with the model's probability of good quality for each whole text added as ``column``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(held.value.probability(np.stack([held.value.pool(t) for t in texts])))

    return docs.withColumn(column, probability(F.col("text")))
