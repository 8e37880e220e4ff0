import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from certlake.llm import resampling
from certlake.llm.resampling import ResampleConfig


def plain_features(text, config):
    lowered = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, [zlib.crc32(b" ".join(words[i : i + k])) % config.buckets for k in range(1, config.grams + 1) for i in range(len(words) - k + 1)]


def plain_resample(rows, target, config):
    made = [(i, *plain_features(t, config)) for i, t in rows]
    s, t = Counter(b for _, _, f in made for b in f), Counter(b for x in target for b in plain_features(x, config)[1])
    n, m = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n + config.buckets) / ((s[b] + 1) * (m + config.buckets)))) for b in range(config.buckets)]
    out = []
    for i, words, f in made:
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"{config.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    eligible = sorted((r for r in out if r[1] >= config.min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = eligible[: config.percent * len(eligible) // 100]
    return sorted([(r[0], *r[2:], None) for r in out if r[1] < config.min_words] + [(r[0], *r[2:], k + 1 if k < len(drawn) else None) for k, r in enumerate(eligible)], key=str)


def some_texts():
    draw = random.Random(2)
    vocabulary = ["alpha", "Beta", "ÄÖ", "漢字", "x1", "it's", "w" * 70, "q" * 300, "a", "THE"]
    texts = [" ".join(draw.choice(vocabulary) for _ in range(draw.randint(0, 60))) for _ in range(150)]
    return texts + [texts[5]] * 60 + ["", None, "...", "z" * 5000, " ".join(vocabulary) * 400]


@pytest.mark.parametrize("config", [ResampleConfig(), ResampleConfig(grams=2, buckets=7, min_words=3, percent=50), ResampleConfig(buckets=100_000, task_features=50)])
def test_rows_are_those_of_brute_force(spark, config):
    rows = list(enumerate(some_texts())) + [(None, "no key but twenty words " * 8)]
    target = ["alpha beta x1 it s", None, "THE the the q", ""]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, digest string, score int").repartition(7)
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), config=config).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_resample(rows, target, config)


def test_features_do_not_depend_on_their_neighbours():
    texts = [t.encode() if t else b"" for t in some_texts()]
    config = ResampleConfig()
    together = resampling.features(texts, config)
    for k, text in enumerate(texts):
        alone = resampling.features([text], config)
        assert alone[1][0] == together[1][k] and alone[2][0] == together[2][k]
    assert np.concatenate([np.sort(resampling.features([t], config)[0]) for t in texts]).tolist() == [b for t in texts for b in sorted(plain_features(t.decode(), config)[1])]


def test_repeated_rows_ties_and_empty_tables(spark):
    words = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(1, words)] * 40 + [(2, words)] * 20, "doc_id long, text string")
    target = spark.createDataFrame([], "text string")
    got = resampling.resample(docs, target).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]
    assert len({(r.doc_id, r.score) for r in got}) == 2
    assert resampling.resample(docs.limit(0), target).collect() == []
    assert {r.doc_id for r in resampling.selected(docs.dropDuplicates(), target, config=ResampleConfig(percent=50)).collect()} < {1, 2}
