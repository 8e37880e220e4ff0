import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from certlake.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SIGNS = "aAbéÉß sS'tTrReEvVmMlLdD12²¼ٳ_-!?<|endoftext|>\n\t\x85\xa0 中文Σσςİıǅ́e\U0001F600\x1c\x00ª\xadµ"


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Encoder(bpe.Vocabulary(file.read()))


def texts():
    draw = random.Random(5)
    fixed = ["", " ", "a" * 3000, "ab_c__d_ _!_", "<|endoftext|>", "x<|endoftext|><|startoftext|>y", "'S don'T 'llx", "ΑΣ ΑΣ", "ẞ İ", "\x1c\x1f", "abc" * 40, "word " * 20000]
    return fixed + ["".join(draw.choice(SIGNS) for _ in range(draw.randint(1, 30))) for _ in range(3000)] + ["".join(chr(draw.choice((draw.randint(1, 0x3000), draw.randint(0xE000, 0x1FFFF)))) for _ in range(12)) for _ in range(500)]


def test_ids_and_texts_are_the_librarys(encoder):
    library = Tokenizer.from_file(PATH)
    cases = texts()
    for text, ids in zip(cases, encoder.encode_all(cases), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == expected, repr(text[:60])
        assert encoder.decode(ids) == library.decode(expected, skip_special_tokens=False)


def test_forgetting_words_changes_nothing(encoder):
    small = bpe.Encoder(encoder.v, remember=10)
    cases = texts()[10:400]
    assert [i.tolist() for i in small.encode_all(cases, at_once=50)] == [i.tolist() for i in encoder.encode_all(cases)]


def test_tables_with_nulls_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (2, "Hello  World", None), (2, "Hello  World", None)], "doc_id long, text string, ids_old string")
    rows = bpe.digest_table(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 0), (1, 0), (2, 2), (2, 2)]
    back = bpe.decode_table(bpe.encode_table(docs, PATH), PATH)
    assert {r.decoded for r in back.collect()} == {"", "hello</w> world</w>"}
    assert bpe.digest_table(docs.limit(0), PATH).count() == 0


def test_packing_is_gapless_and_whole(spark, encoder):
    docs = spark.createDataFrame([(i, " ".join(["word"] * (37 * i % 700))) for i in range(120)] + [(None, None), (7, ""), (200, "steel " * 9000)], "doc_id long, text string")
    config = packing.PackingConfig(shard_rows=50)
    packed = packing.pack_documents(docs, PATH, config, with_ids=True)
    rows = packed.collect()
    assert sum(r.length for r in rows) == sum(len(encoder.encode(r.text)) + 1 for r in docs.collect())
    for sequence in packing.sequences(packed).collect():
        at = 0
        for piece in sequence.pieces:
            assert piece.offset == at
            at += piece.length
        assert at == sequence.n_tokens == len(sequence.ids) <= 2048
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 200)
    assert [x[1] for x in long] == [2048 * k for k in range(len(long))] and all(x[2] == 2048 for x in long[:-1])
    ideal = sum(r.length for r in rows) / 2048
    assert len({r.sequence_id for r in rows}) <= ideal + -(-len(rows) // 50) + 1
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_place_fills_exact_gaps_first():
    import numpy as np

    sequence, offset = packing.place(np.array([3, 7, 5, 5, 10]), 10)
    assert len(set(sequence.tolist())) == 3
    assert sequence[0] == sequence[1] and sequence[2] == sequence[3]
    assert {offset[0], offset[1]} == {0, 7}
