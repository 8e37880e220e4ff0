"""Columns of a caller's table that are named like an operator's own."""

import public_tokenizers
import pytest

from certlake.llm import bpe, cap_join, line_dedup, ngram_join, packing, quality, style_tree, topk, toxicity

NAMES = "rep copies vector filters dim block task band bands sketch members k1 k2 n host host_name drop lines kept removed shard row part place levels sequence_id offset n_lines_dropped score rank c".split()
PATH = public_tokenizers.path("word_bpe_49k.json")


def table(spark, key, value, kind):
    extra = [n for n in NAMES if n != key]
    return spark.createDataFrame([(i, v, f"http://h/{i}", "<p>some text</p>", "s", *("x",) * len(extra)) for i, v in enumerate(value)], f"{key} long, {kind}, url string, html string, source string, " + ", ".join(f"`{n}` string" for n in extra))


def test_vectors(spark):
    df = table(spark, "vec_id", [[1.0, 2.0], [2.0, 4.0], [-1.0, 0.5]] * 2, "embedding array<float>")
    assert sorted(r.n_links for r in cap_join.join(df).collect()) == [1, 1, 3, 3, 3, 3]
    assert topk.search(df).count() == 5


@pytest.mark.parametrize("same", ["doc_id", "row"])
def test_texts(spark, same):
    df = table(spark, "doc_id", ["one two three", "", None, "one two three"], "text string")
    assert [r.n_lines_dropped for r in line_dedup.drop_boilerplate(df).collect()] == [0] * 4
    assert set(NAMES) <= set(line_dedup.drop_boilerplate(df).columns)
    assert sorted(r.n_links for r in ngram_join.join(df).collect()) == [0, 0, 1, 1]
    assert len(packing.pack_documents(df, PATH).collect()) == 4
    packed = packing.pack(df.selectExpr("*", "cast(5 AS bigint) AS length")).collect()
    assert {r.shard for r in packed} == {"x"} and {r.offset for r in packed} == {0, 5, 10, 15}
    assert bpe.digest_table(df, PATH).count() == 4
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        scored = module.score(df, module.train(df, labels), "score").collect()
        assert all(0 <= r.score <= 1 and r["rank"] == "x" for r in scored)
    pages = style_tree.extract(df).collect()
    assert {(r.text, r.host, r.removed) for r in pages} == {("some text", "x", "x")}
