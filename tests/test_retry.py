"""The retry loop: handled events, dead letters and re-entry."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from draftlake.streaming import runs

SCHEMA = "event_id string, event_type string, batch_id string, file_id string, page_id string, artifact_uri string, attempt int, created_at timestamp, payload string"


def test_retry_stream(spark, tmp_path):
    rows = [(f"e{k}", "page.qa.requested", "b", "f", f"p{k}", f"s3://{k}", 1 + k % 6, datetime(2024, 1, 1), '{"k":1}') for k in range(40)]
    table = spark.createDataFrame(rows, SCHEMA)
    table.repartition(3).write.parquet(f"{tmp_path}/log/first")
    needs = F.col("page_id").substr(2, 9).cast("int") % 8  # attempts until it is handled; 6 and 7 are too many

    def judge(events):
        return events.withColumn("error", F.when(F.col("attempt") < needs, F.concat(F.lit("needs "), needs)))

    drains = runs.retry_stream(spark, f"{tmp_path}/log", table.schema, judge, f"{tmp_path}/done", f"{tmp_path}/dead", f"{tmp_path}/ckpt", files_per_trigger=1)
    assert 2 <= drains <= 6
    done = {r.event_id: r for r in spark.read.parquet(f"{tmp_path}/done").collect()}
    dead = {r.event_id: r for r in spark.read.parquet(f"{tmp_path}/dead").collect()}
    assert not set(done) & set(dead) and len(done) + len(dead) == 40
    assert spark.read.parquet(f"{tmp_path}/done").count() == len(done)
    for k in range(40):
        first, want = 1 + k % 6, k % 8
        if want <= max(first, 5):
            got = done[f"e{k}"]
            assert got.attempt == max(first, want) and (got.artifact_uri, got.payload) == (f"s3://{k}", '{"k":1}')
        else:
            letter = json.loads(dead[f"e{k}"].payload)
            assert dead[f"e{k}"].topic == "deadletter" and letter["original_topic"] == "page.qa.requested"
            assert letter["original_event"]["attempt"] == max(first, 5) and letter["error"] == f"needs {want}"


def test_nothing_to_retry(spark, tmp_path):
    spark.createDataFrame([("e", "x", "b", "f", "p", "u", 1, datetime(2024, 1, 1), "{}")], SCHEMA).write.parquet(f"{tmp_path}/log/first")
    schema = spark.read.parquet(f"{tmp_path}/log/first").schema
    ok = lambda events: events.withColumn("error", F.lit(None).cast("string"))
    assert runs.retry_stream(spark, f"{tmp_path}/log", schema, ok, f"{tmp_path}/done", f"{tmp_path}/dead", f"{tmp_path}/ckpt") == 1
    assert spark.read.parquet(f"{tmp_path}/dead").count() == 0
