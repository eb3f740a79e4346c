"""Streams must equal their batch twins."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from draftlake.operators import catalog
from draftlake.sources import tables
from draftlake.streaming import events as ev
from draftlake.streaming import runs

START = datetime(2024, 1, 1)
TYPES = ["page.extracted", "page.qa.requested", "page.qa.done", "page.export.done", "page.failed", "page.ocr.requested", "page.ocr.done"]


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    rows = [
        (str(i), TYPES[i * 5 % 7], f"b{i % 2}", f"f{i % 3}", None if i % 11 == 0 else f"p{i % 6}", None, 1 + i % 6, START + timedelta(seconds=7 * i), "{}")
        for i in range(300)
    ]
    df = spark.createDataFrame(
        rows,
        "event_id string, event_type string, batch_id string, file_id string, page_id string, artifact_uri string, "
        "attempt int, created_at timestamp, payload string",
    )
    path = str(tmp_path_factory.mktemp("log") / "in")
    for part in range(3):  # one file after the other, so they are read in time order
        df.where(F.floor(F.col("event_id").cast("int") / 100) == part).coalesce(1).write.mode("append").parquet(path)
    return df, path


def _stream(spark, log, fn, tmp_path, mode="append"):
    df, path = log
    stream = runs.read_table_stream(spark, path, df.schema, files_per_trigger=1)
    return runs.drain(fn(stream), str(tmp_path / "out"), str(tmp_path / "ckpt"), mode)


def test_dedupe_twin(spark, log, tmp_path):
    got = _stream(spark, log, lambda s: ev.dedupe_events(s, "2 days"), tmp_path)
    want = ev.dedupe_events(log[0])
    assert got.count() == want.count()
    key = lambda d: {(r["page_id"], r["event_type"]) for r in d.where("page_id is not null").collect()}
    assert key(got) == key(want)
    again = ev.dedupe_events(want)
    assert again.count() == want.count()


def test_rates_twin_on_closed_windows(spark, log, tmp_path):
    got = {tuple(r) for r in _stream(spark, log, ev.event_rates, tmp_path).collect()}
    want = {tuple(r) for r in ev.event_rates(log[0]).collect()}
    assert got <= want and len(want) - len(got) < 20


def test_page_state_twin(spark, log, tmp_path):
    got = _stream(spark, log, ev.page_state, tmp_path, mode="update")
    last = {r["page_id"]: r["status"] for r in got.orderBy("_epoch").collect()}
    assert last == {r["page_id"]: r["status"] for r in ev.page_state(log[0]).collect()}


def test_stateless_twins(spark, log, tmp_path):
    for i, fn in enumerate([ev.route_events, ev.fan_out, ev.retry_or_dead, lambda d: ev.progress(d, "b1")]):
        (tmp_path / str(i)).mkdir()
        assert _stream(spark, log, fn, tmp_path / str(i)).count() == fn(log[0]).count()


def test_stage_pairs_twin(spark, log, tmp_path):
    got = _stream(spark, log, lambda s: ev.stage_pairs_stream(s, "1 hour"), tmp_path)
    first = {r["event_id"]: r["d"] for r in got.groupBy("event_id").agg(F.min("done_at").alias("d")).collect()}
    want = {r["event_id"]: r["done_at"] for r in ev.stage_latency(log[0]).collect()}
    assert all(want[k] == d for k, d in first.items() if d is not None)
    assert len(first) > 30


def test_stage_latency_brute(log):
    rows = log[0].collect()
    want = {}
    for r in rows:
        for req, done in [("page.qa.requested", "page.qa.done"), ("page.ocr.requested", "page.ocr.done")]:
            if r["event_type"] == req and r["page_id"]:
                after = [q["created_at"] for q in rows if q["page_id"] == r["page_id"] and q["event_type"] == done and q["created_at"] >= r["created_at"]]
                want[r["event_id"]] = min(after, default=None)
    assert {r["event_id"]: r["done_at"] for r in ev.stage_latency(log[0], "MINUTE").collect()} == want


def test_malformed_and_valid(spark):
    raw = spark.createDataFrame(
        [('{"event_id":"1","event_type":"t","attempt":1,"created_at":"x","page_id":"p"}',), ("{}",), ("oops",), ("[1]",)], "raw string"
    )
    parsed = ev.parse_events(raw)
    assert [r["event_id"] for r in ev.accepted(parsed).collect()] == ["1"]
    reasons = {r["reason"] for r in ev.rejected(parsed).collect()}
    assert "event_id" in reasons and "malformed" in reasons
    assert ev.with_key(ev.accepted(parsed)).first()["event_key"] == "p"


def test_merge_meta_keeps_types(spark):
    row = spark.createDataFrame([('{"a":1,"b":"x"}', '{"b":2.5,"c":{"d":[1]}}'), (None, "{}")], "o string, n string")
    got = [r["m"] for r in row.select(catalog.merge_meta(F.col("o"), F.col("n")).alias("m")).collect()]
    assert got == ['{"a":1,"b":2.5,"c":{"d":[1]}}', "{}"]


def test_list_batches_limits(spark):
    df = spark.range(120).select(F.col("id").cast("string").alias("batch_id"), F.timestamp_seconds("id").alias("created_at"))
    assert catalog.list_batches(df, 0).count() == 50
    assert catalog.list_batches(df, "x").count() == 50
    assert catalog.list_batches(df, 501).count() == 50
    assert catalog.list_batches(df, 100, 110).count() == 10
    assert catalog.list_batches(df, 1).first()["batch_id"] == "119"


def test_read_cad_lists_malformed(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"schema_version":"0.1","document":{"page_id":"p","px_per_mm":10.0,"image_size_px":[1200,800]},'
        '"primitives":[{"id":"1","type":"LINE","p1":[1.0,2.0],"p2":[3.0,4.0]},{"id":"2","type":"CIRCLE","center":[5.0,6.0],"radius":7.0}],'
        '"dimensions":[{"id":"d","kind":"linear","value":3.0}]}'
    )
    (tmp_path / "b.json").write_text('{"schema_version": ')
    docs = tables.read_cad(spark, str(tmp_path))
    assert docs.count() == 1
    bad = tables.rejected_cad(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[-1], r.content.startswith('{"schema_version"')) for r in bad] == [("b.json", True)]
    prims = {r["id"]: r for r in tables.cad_primitives(docs).collect()}
    assert prims["1"]["x2"] == 3.0 and prims["2"]["x1"] == 5.0 and prims["2"]["height_px"] == 800
    assert tables.cad_dimensions(docs).first()["kind"] == "linear"
    assert tables.cad_pages(docs).first()["page_type"] == "unknown"


def test_publishing_a_run_again_replaces_it(spark, tmp_path):
    rows = [("1", "page.extracted", "p", 1), ("2", "page.failed", "p", 1)]
    log = spark.createDataFrame(rows, "event_id string, event_type string, page_id string, attempt int").withColumns(
        {c: F.lit(None).cast("string") for c in ("batch_id", "file_id", "artifact_uri", "payload")}
    ).withColumn("created_at", F.current_timestamp())
    for run in ("a", "a", "b"):
        runs.write_events(log, str(tmp_path / "log"), run=run)
    assert spark.read.text(str(tmp_path / "log")).count() == 4


def test_late_rows_are_dropped_and_early_ones_kept(spark, tmp_path):
    """A watermark that really passes: events behind it no longer count."""
    start = datetime(2024, 1, 1)
    batches = [
        [("1", "p1", 0), ("2", "p2", 1)],
        [("3", "p1", 2), ("4", "p3", 600)],  # p1 again inside the delay
        [("5", "p9", 5), ("6", "p3", 601)],  # p9 is ten minutes late
        [("7", "p4", 1200)],
    ]
    schema = "event_id string, page_id string, event_type string, created_at timestamp"
    for k, rows in enumerate(batches):
        data = [(e, p, "page.extracted", start + timedelta(seconds=s)) for e, p, s in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = runs.read_table_stream(spark, str(tmp_path / "in"), schema)
        got = runs.drain(ev.event_rates(stream, watermark="1 minute"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    # Append mode: only windows the watermark has passed are final; the late row is in none.
    found = {((r.window_start - start).total_seconds(), r.events) for r in got.collect()}
    assert found == {(0.0, 3), (600.0, 2)}
