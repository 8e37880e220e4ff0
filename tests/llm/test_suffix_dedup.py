import random
from collections import Counter

import numpy as np
import pytest

from certlake.llm import suffix_dedup
from certlake.llm.suffix_dedup import RepeatConfig
from certlake.llm.suffix_groups import suffix_arrays


def test_suffix_arrays_are_those_of_sorting():
    draw = random.Random(1)
    for k in range(120):
        letters = b"ab" if k % 3 else b"abcdefgh \xff\x00"
        strings = [bytes(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(draw.randint(1, 6))]
        strings += [b"a" * 30, b"ab" * 20, b"aab" * 9 + b"a"] if k % 5 == 0 else []
        for s, got in zip(strings, suffix_arrays([np.frombuffer(s, np.uint8) for s in strings]), strict=True):
            assert got.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    assert suffix_arrays([]) == []


def plain_removal(texts, length):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        edges = [i for i in range(len(t) + 1) if (gone[i] if i < len(t) else 0) != (gone[i - 1] if i else 0)]
        out.append((bytes(b for b, x in zip(t, gone) if not x), list(zip(edges[::2], edges[1::2]))))
    return out


def planted():
    draw = random.Random(4)

    def prose(n):
        return "".join(draw.choice("abcdefghij éü漢") for _ in range(n))

    passages = [prose(n) for n in (30, 60, 61, 200, 900)]
    texts = [prose(draw.randint(0, 300)) for _ in range(30)]
    texts += [prose(draw.randint(0, 80)) + draw.choice(passages) + prose(draw.randint(0, 80)) for _ in range(60)]
    base = prose(1500)
    texts += [base[:k] + "#" + base[k + 1 :] for k in (10, 300, 700, 1400)]
    twice = prose(150)
    texts += [texts[31]] * 5 + [twice + "|" + twice, "a" * 2500, "ab" * 700, "ab" * 40, "", None, prose(20_000)]
    return texts


@pytest.mark.parametrize(
    ("length", "config"),
    [(60, {"gram": 24}), (60, {"gram": 24, "kinds": 2, "batch": 400, "task": 2000}), (60, {"gram": 60}), (200, {})],
)
def test_removed_bytes_are_those_of_brute_force(spark, length, config):
    texts = planted()
    rows = [(i, t, "clash", 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, kept int").repartition(5)
    got = {r.doc_id: r for r in suffix_dedup.remove(docs, config=RepeatConfig(length=length, **config)).collect()}
    assert len(got) == len(texts)
    for i, (kept, spans) in enumerate(plain_removal(texts, length)):
        r = got[i]
        assert bytes(r.kept) == kept and [tuple(s) for s in r.spans] == spans, i
        assert (r.n_bytes, r.n_removed, r.row) == (len((texts[i] or "").encode()), len((texts[i] or "").encode()) - len(kept), "clash")


def test_repeated_and_missing_keys_and_empty_tables(spark):
    text = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(260))
    draw = random.Random(9)
    other = "".join(draw.choice("klmnop") for _ in range(400))
    docs = spark.createDataFrame([(1, text), (1, text), (None, other), (None, None), (2, "short"), (2, "short")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.digest_table(docs).collect())
    assert got == [(0, 0, 0, 0), (0, 400, 0, 0), (1, 260, 260, 1), (1, 260, 260, 1), (2, 5, 0, 0), (2, 5, 0, 0)]
    assert suffix_dedup.digest_table(docs.limit(0)).collect() == []
