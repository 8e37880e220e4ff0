import hashlib
import json

import pytest
from pyspark.sql import functions as F

from certlake.sources import readers, writers
from certlake.streaming import jobs


def test_files_and_json(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.pdf").write_bytes(b"%PDF-1 body")
    (tmp_path / "bad.pdf").write_bytes(b"no")
    found = {r.filename: r for r in readers.discover(spark, str(tmp_path)).collect()}
    assert found["x.pdf"].document_id == hashlib.sha256(b"%PDF-1 body").hexdigest()[:16] and found["x.pdf"].size_bytes == 11
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(str(tmp_path))
    assert {r.path.rsplit("/")[-1]: r.problem for r in readers.upload_check(files).collect()} == {"x.pdf": None, "bad.pdf": "magic"}
    (tmp_path / "p").mkdir()
    for name, value in (("d1", {"grade": "S195", "extraction": {"grade": "S355"}}), ("d2", {"grade": "S195"}), ("d3", [1])):
        (tmp_path / "p" / f"{name}.json").write_text(json.dumps(value))
    docs = readers.json_files(spark, str(tmp_path / "p"))
    assert {r.doc_id: r.grade for r in readers.unwrap_prediction(docs, "value", ["grade"]).collect()} == {"d1": "S355", "d2": "S195", "d3": None}
    assert {r.doc_id for r in readers.extracted_ids(spark, str(tmp_path / "p")).collect()} == {"d1", "d2", "d3"}


def test_csv_columns_are_checked(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿doc_id,pages\nsyn001,3\n", encoding="utf-8")
    assert readers.csv_table(spark, str(tmp_path / "m.csv"), ["doc_id", "pages"]).first().doc_id == "syn001"
    with pytest.raises(ValueError, match="file_name"):
        readers.csv_table(spark, str(tmp_path / "m.csv"), ["doc_id", "file_name"])


def test_sinks_and_merges(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], None)], "doc_id long, reasons array<string>, note string")
    writers.write_csv(df, str(tmp_path / "out"), ["doc_id", "reasons", "note", "absent"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first().reasons == "a|b"
    assert "| 1 |" in writers.markdown(df.select("doc_id"), "Report")
    with pytest.raises(ValueError, match="repeated"):
        readers.merge_runs([df, df])
    assert readers.merge_runs([df, df.withColumn("doc_id", F.lit(2).cast("long")).drop("note")]).count() == 2


def test_jobs_stay_over(spark, tmp_path):
    rows = [(1, "queued", 1), (1, "succeeded", 2), (1, "processing", 3), (2, "queued", 1)]
    df = spark.createDataFrame(rows, "job_id long, status string, event_id long").withColumn("ts", F.timestamp_seconds("event_id"))
    df.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "events"))
    assert {r.job_id: (r.status, r.n_events) for r in jobs.drain(jobs.job_states(stream), "job_id").collect()} == {1: ("succeeded", 3), 2: ("queued", 1)}


def test_states_of_finished_jobs_go_after_their_time(spark, tmp_path):
    """Three triggers over one checkpoint: the watermark of later events lets the timers of finished jobs fire."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STORE)
    day, held = 86_400, []
    parts = [[(1, "queued", 1, 5), (1, "succeeded", 2, 10), (2, "queued", 3, 20)], [(1, "processing", 4, 30), (3, "queued", 5, 30 * day)], [(4, "queued", 6, 31 * day)]]
    for k, rows in enumerate(parts):
        df = spark.createDataFrame(rows, "job_id long, status string, event_id long, at long").withColumn("ts", F.timestamp_seconds("at")).drop("at")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        found = []
        states = jobs.job_states(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
        run = states.writeStream.outputMode("update").foreachBatch(lambda b, n: found.extend(b.collect())).option("checkpointLocation", str(tmp_path / "state"))
        run.trigger(availableNow=True).start().awaitTermination()
        held.append({r.key.job_id for r in spark.read.format("statestore").option("stateVarName", "job").load(str(tmp_path / "state")).collect()})
        if k == 1:
            assert {(r.job_id, r.status, r.n_events) for r in found} == {(1, "succeeded", 3), (3, "queued", 1)}
    assert held[0] == {1, 2} and held[-1] == {2, 3, 4}


def test_windowed_metrics(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "a", 2.0), (4000, "b", 1.0)], "s long, event_type string, value double").select(F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "event_type", "value")
    df.write.parquet(str(tmp_path / "m"))
    stream = jobs.windowed_metrics(jobs.event_stream(spark, str(tmp_path / "m"), df.schema))
    stream.writeStream.outputMode("complete").format("memory").queryName("metrics_test").trigger(availableNow=True).start().awaitTermination()
    assert {(r.event_type, r.n, r.cents) for r in spark.table("metrics_test").collect()} == {("a", 2, 350), ("b", 1, 100)}
