import corpus_pipeline
from certlake.llm.common import materialize


def test_stages_in_order_keep_the_columns(spark):
    from tests.conftest import TINY

    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, TINY), name)
        assert docs.columns == columns
        now = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(now) == len(set(now)) and set(now) <= ids and (name != "lines" or set(now) == ids)
        ids = set(now)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, TINY).collect()
    assert {r.doc_id for r in packed} == ids
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "lines", "near_copies", "packing"]


def test_stages_stand_empty_and_odd_documents(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "some words here", "en", "s", 15), (3, "some words here", "en", "s", 15)], "doc_id long, text string, lang string, source string, n_chars long")
    from tests.conftest import TINY

    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, TINY).collect()
        stage(spark, odd.limit(0), TINY).collect()


def test_copies_of_one_id_and_of_none_leave_one_row(spark):
    text = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"else{i}" for i in range(60))
    rows = [(5, text, "en"), (5, text, "en"), (5, other, "en"), (None, text + " more", "en"), (None, other, "fr"), (None, other, "fr"), (9, "quite another text", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = sorted((r.doc_id or 0, r.text[:5]) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert kept == [(5, "else0"), (5, "word0"), (9, "quite")]


def test_run_gives_every_kept_document(spark):
    from tests.conftest import TINY

    packed = corpus_pipeline.run(spark, TINY)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = packed.collect()
    ids = {r.doc_id for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id").collect()}
    assert 0 < len({r.doc_id for r in rows}) < len(ids) and {r.doc_id for r in rows} <= ids
    for sequence in {r.sequence_id for r in rows}:
        mine = sorted((r.offset, r.length) for r in rows if r.sequence_id == sequence)
        assert [o for o, _ in mine] == [sum(n for _, n in mine[:i]) for i in range(len(mine))]
