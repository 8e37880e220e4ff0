import hashlib
import random

import pytest

from certlake.llm import fim


def plain_cut(text, key):
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    text = text or ""
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return "plain", None, None, text
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return ("spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_outputs_are_those_of_plain_slicing_and_restore_the_texts(spark):
    draw = random.Random(5)
    letters = "ab <>PSM\n\t12é漢😀́ "
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(300)] + ["x" * 300_000, "a<P>b", "<M>", "", None]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "no key", "clash"), (3, texts[3], "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fim string").withColumnRenamed("fim", "output")
    done = fim.transform(docs).withColumn("restored", fim.restore(fim.F.col("output"), fim.F.col("form"))).collect()
    assert len(done) == len(rows)
    for r in done:
        form, a, m, output = plain_cut(r.text, r.doc_id)
        assert (r.form, r.prefix_chars, r.middle_chars, r.output, r.restored, r.n) == (form, a, m, output, r.text or "", len(r.text or ""))
    assert {r.form for r in done} == {"plain", "psm", "spm"}


def test_words_are_never_split(spark):
    import numpy as np

    text = "one two, three44 — vier"
    at = fim.boundaries(np.frombuffer(text.encode("utf-32-le"), "<u4"), "words").tolist()
    assert [text[a:b] for a, b in zip(at, at[1:])] == ["one", " ", "two", ",", " ", "three", "44", " ", "—", " ", "vier"]
    docs = spark.createDataFrame([(i, text) for i in range(50)], "doc_id long, text string")
    for r in fim.transform(docs, config=fim.FimConfig(units="words", rate=100)).collect():
        assert r.prefix_chars in at and r.prefix_chars + r.middle_chars in at
    with pytest.raises(ValueError, match="units"):
        fim.boundaries(np.zeros(3, dtype="<u4"), "lines")


def test_empty_tables_and_digests(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fim.digest_table(docs).collect() == []
    one = fim.digest_table(spark.createDataFrame([(7, None)], "doc_id long, text string")).first()
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(one) == (7, 0, "plain", None, None, empty, empty)
