"""BPE encoding and decoding with a published vocabulary whose words end in ``</w>``.

A text is cut at special tokens, normalised (NFC, lower case) and split into words.  Each word becomes a
contiguous array of parts with, beside it, the merge rank of every adjacent pair.  The encoder scans the ranks
for the minimum, deletes that boundary, refreshes the two neighbouring ranks, and repeats until no pair has a
rank.  Words of more than ``LONG`` parts take a heap instead of scans, with the same result.  Words seen
before are looked up in a bounded memory.

The work is per row: tasks read Arrow batches, and nothing is shuffled.  Null and empty texts have no ids and
decode to the empty text.  Very long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONG = 64  # parts from which a heap is quicker than scans
NO_RANK = 1 << 30

# Letters and numbers of Unicode 17, which the vocabulary's own splitter (Unicode 16) takes for signs.
NEWER = (
    "՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱꭬-꭭"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    "\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    "\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
# Fixed values: (first, last, distance) of capitals that are newer than Python's tables.
NEWER_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27),
)
# Contractions that are words of their own.
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"

WORDS = regex.compile(rf"{ENDINGS}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+")
WORDS_OF_ANY = regex.compile(rf"(?V1){ENDINGS}|[\p{{L}}--[{NEWER}]]+|[\p{{N}}--[{NEWER}]]|[[^\s\p{{L}}\p{{N}}]||[{NEWER}]]+")
LATIN_WORDS = re.compile(rf"{ENDINGS}|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t-\r \x85\xa0a-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+")
LOWER = {c: c + d for first, last, d in NEWER_CAPITALS for c in range(first, last + 1)} | {ord("Σ"): ord("σ")}


def byte_letters() -> list[str]:
    """The printable letter of each byte: printable Latin-1 signs stand for themselves, others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and special tokens, read from the text of a vocabulary file."""

    def __init__(self, text: str):
        data = json.loads(text)
        ids = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.first = np.array([ids[c] for c in letters])
        self.last = np.array([ids[c + "</w>"] for c in letters])
        self.ranks: dict[int, int] = {}
        made = []
        for rank, merge in enumerate(data["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[ids[a] << 20 | ids[b]] = rank
            made.append(ids[a + b])
        self.made = np.array([*made, 0])
        self.pairs = np.array(sorted(self.ranks), dtype=np.int64)
        self.rank_of = np.array([self.ranks[p] for p in self.pairs.tolist()] + [NO_RANK], dtype=np.int64)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge ranks of adjacent parts; NO_RANK where there is none."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.rank_of[at], NO_RANK)


class Encoder:
    """Encodes and decodes texts; remembers word ids, and forgets them past ``remember`` words."""

    def __init__(self, vocabulary: Vocabulary, remember: int = 500_000):
        self.v, self.known, self.remember = vocabulary, {}, remember

    def learn(self, words: list[str]) -> None:
        """Puts the ids of words, little-endian, into ``known``; short words of one length go together."""
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            data = word.encode("utf-8", "surrogatepass")
            by_length.setdefault(len(data), []).append((word, data))
        for length, group in by_length.items():
            data = np.frombuffer(b"".join(d for _, d in group), dtype=np.uint8).reshape(-1, length)
            parts = self.v.first[data]
            parts[:, -1] = self.v.last[data[:, -1]]
            if length > LONG:
                for (word, _), row in zip(group, parts.tolist(), strict=True):
                    self.known[word] = np.array(self.merge_long(row), dtype="<u4").tobytes()
            else:
                self.merge([w for w, _ in group], parts)

    def merge(self, words: list[str], parts: np.ndarray) -> None:
        """Words of equal length, a row of parts each: every round deletes one boundary in each row."""
        ranks, rows = self.v.rank(parts[:, :-1], parts[:, 1:]), np.arange(len(parts))
        while len(rows):
            every = np.arange(len(rows))
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), dtype=np.int64)
            best = ranks[every, at] if ranks.shape[1] else np.full(len(rows), NO_RANK)
            done = best == NO_RANK
            if done.any():
                size, ids = 4 * parts.shape[1], parts[done].astype("<u4").tobytes()
                for k, row in enumerate(rows[done].tolist()):
                    self.known[words[row]] = ids[k * size : (k + 1) * size]
                parts, ranks, rows, at, best = parts[~done], ranks[~done], rows[~done], at[~done], best[~done]
                every = np.arange(len(rows))
            if not len(rows):
                return
            column = np.arange(parts.shape[1] - 1)
            parts = np.where(column <= at[:, None], parts[:, :-1], parts[:, 1:])
            parts[every, at] = self.v.made[best]
            ranks = np.where(column[:-1] < at[:, None], ranks[:, :-1], ranks[:, 1:])
            left, right = at > 0, at < ranks.shape[1]
            ranks[every[left], at[left] - 1] = self.v.rank(parts[every[left], at[left] - 1], parts[every[left], at[left]])
            ranks[every[right], at[right]] = self.v.rank(parts[every[right], at[right]], parts[every[right], at[right] + 1])

    def merge_long(self, parts: list[int]) -> list[int]:
        rank, made, n = self.v.ranks.get, self.v.made, len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = int(made[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := rank(parts[x] << 20 | parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            text = unicodedata.normalize("NFC", text).translate(LOWER).lower()
            return WORDS_OF_ANY.findall(text)
        return LATIN_WORDS.findall(text.lower())

    def read(self, text: str | None) -> list[str | int]:
        """The words of a text, and the ids of special tokens between them."""
        if not text:
            return []
        if not self.v.cut or "<" not in text:
            return self.words(text)
        out: list[str | int] = []
        for piece in self.v.cut.split(text):
            if piece in self.v.special:
                out.append(self.v.special[piece])
            else:
                out += self.words(piece)
        return out

    def encode_all(self, texts: Iterable[str | None], at_once: int = 1_000_000) -> Iterator[np.ndarray]:
        """The ids of each whole text; texts of together ``at_once`` characters share a round."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text or "")
            if size > at_once:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def _encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        if len(self.known) > self.remember:
            self.known.clear()
        read = [self.read(t) for t in texts]
        new = set().union(*read).difference(self.known)
        special = {w for w in new if isinstance(w, int)}
        self.known.update({w: np.array([w], dtype="<u4").tobytes() for w in special})
        self.learn(list(new - special))
        get = self.known.__getitem__
        for words in read:
            yield np.frombuffer(b"".join(map(get, words)), dtype="<u4")

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one whole text."""
        return next(self.encode_all([text]))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; special tokens stay, and unknown ids are left out."""
        tokens = self.v.tokens
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        try:
            return " ".join(map(tokens.__getitem__, ids))
        except IndexError:
            return " ".join(tokens[i] for i in ids if i < len(tokens))


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(held) -> Encoder:
    """This worker's encoder for a broadcast vocabulary text; parsed once for each worker."""
    if held.value[0] not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[held.value[0]] = Encoder(Vocabulary(held.value[1]))
    return _ENCODERS[held.value[0]]


def hold(spark: SparkSession, vocabulary: str):
    """Broadcasts the text of a vocabulary file: its size is fixed, whatever the corpus."""
    with open(vocabulary, encoding="utf-8") as file:
        text = file.read()
    return spark.sparkContext.broadcast((hashlib.sha256(text.encode()).hexdigest(), text))


def encode_table(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``docs`` with ``ids`` array<long> for each whole ``text``."""
    held = hold(docs.sparkSession, vocabulary)

    @F.pandas_udf("array<long>")
    def ids(texts: pd.Series) -> pd.Series:
        encoder = encoder_of(held)
        return pd.Series([ids.astype(np.int64) for ids in encoder.encode_all(texts)], dtype=object)

    return docs.withColumn("ids", ids(F.col("text")))


def decode_table(rows: DataFrame, vocabulary: str) -> DataFrame:
    """``rows`` with ``decoded`` for each array of ``ids``; null for null."""
    held = hold(rows.sparkSession, vocabulary)

    @F.pandas_udf("string")
    def decoded(arrays: pd.Series) -> pd.Series:
        encoder = encoder_of(held)
        return arrays.map(lambda ids: None if ids is None else encoder.decode(np.asarray(ids)))

    return rows.withColumn("decoded", decoded(F.col("ids")))


def digest_table(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded and its ids decoded again, as digests.

    Ids and decoded texts stay in the task that made them.
    """
    held = hold(docs.sparkSession, vocabulary)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        encoder, rows = encoder_of(held), []
        for ids in encoder.encode_all(texts):
            back = encoder.decode(ids).encode("utf-8", "surrogatepass")
            rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digest("text").alias("digest")).select("doc_id", "digest.*")
