"""Counters reported by a stream against its batch twin."""

from __future__ import annotations

from collections import Counter

from draftlake.streaming import counters, runs

SCHEMA = "event_id string, event_type string"


def test_counters_of_a_stream(spark, tmp_path):
    kinds = ["page.qa.done", "page.failed", "odd", None, "page.ocr.requested"]
    rows = [(str(k), kinds[k * k % 5]) for k in range(200)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/in")
    live = counters.TopicCounters()
    spark.streams.addListener(live)
    try:
        for run in range(2):  # a second query adds to the counters
            stream = counters.counted(runs.read_table_stream(spark, f"{tmp_path}/in", SCHEMA, 1))
            query = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c{run}").trigger(availableNow=True).start()
            query.awaitTermination()
            live.settled(query)
    finally:
        spark.streams.removeListener(live)
    want = Counter(t if t in counters.topics() else counters.OTHER for _, t in rows)
    assert live.totals() == {t: 2 * n for t, n in sorted(want.items())}
    assert len({b for _, b in live.batches}) >= 4
