"""Starting, sinking and draining streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from draftlake.streaming import events as ev
from draftlake.streaming.stateful import rocks_state


def read_events(spark: SparkSession, path: str | None = None, files_per_trigger: int = 100, **broker: str) -> DataFrame:
    """Raw event text as a stream, from JSON-line files or from broker options.

    With broker options the connector package has to be on the cluster; reading
    starts at the earliest offset, as every consumer group does.
    """
    if path is not None:
        return (
            spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(path).withColumnRenamed("value", "raw")
        )
    options = {"startingOffsets": "earliest", **broker}
    return spark.readStream.format("kafka").options(**options).load().selectExpr("CAST(value AS STRING) AS raw")


def read_table_stream(spark: SparkSession, path: str, schema: str | StructType, files_per_trigger: int = 100) -> DataFrame:
    """A folder of parquet files as a stream of rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def as_messages(events: DataFrame) -> DataFrame:
    """Key and JSON value columns of envelopes, the shape a broker sink expects."""
    keyed = ev.with_key(events)
    return keyed.select(F.col("event_key").alias("key"), F.to_json(F.struct(*events.columns)).alias("value"))


def write_events(events: DataFrame, path: str, checkpoint: str | None = None, run: str | None = None) -> StreamingQuery | None:
    """Write envelopes as JSON lines; a stream needs a checkpoint and is drained once.

    A batch is published under the name of its ``run``; publishing a run again replaces it,
    so a repeated job does not double the log.  Without a name the whole log is replaced.
    """
    lines = as_messages(events).select("value")
    if not events.isStreaming:
        lines.write.mode("overwrite").text(path if run is None else f"{path}/run={run}")
        return None
    return (
        lines.writeStream.format("text")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all available input into a parquet table and read it back.

    Update and complete mode keep every version of a row; the batch number column
    ``_epoch`` tells them apart.
    """
    spark, schema = df.sparkSession, df.schema
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).outputMode("append").start()
    else:

        def save(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/_epoch={epoch}")

        query = writer.outputMode(mode).foreachBatch(save).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(schema).parquet(path)
    return spark.read.option("basePath", path).parquet(f"{path}/_epoch=*")


def split_stream(raw: DataFrame, good: str, dead: str, checkpoint: str) -> StreamingQuery:
    """Valid events to one table and dead letters to another, exactly once per batch.

    Each micro-batch overwrites its own folder, so a repeated batch leaves no
    duplicates.
    """

    def save(batch: DataFrame, epoch: int) -> None:
        parsed = ev.parse_events(batch)
        parsed.persist()
        ev.accepted(parsed).write.mode("overwrite").parquet(f"{good}/_epoch={epoch}")
        ev.rejected(parsed).write.mode("overwrite").parquet(f"{dead}/_epoch={epoch}")
        parsed.unpersist()

    return raw.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry_stream(
    spark: SparkSession,
    log: str,
    schema: StructType,
    judge: Callable[[DataFrame], DataFrame],
    done: str,
    dead: str,
    checkpoint: str,
    max_attempts: int = ev.MAX_ATTEMPTS,
    files_per_trigger: int = 100,
) -> int:
    """Handle an event log until nothing is left to retry; returns how often it was drained.

    ``log`` holds folders of parquet envelopes.  ``judge`` adds the column ``error``, null
    where an event was handled.  Handled events go to ``done``, events out of attempts as
    dead letters to ``dead``, and the others back into the log with one more attempt, from
    where the same stream reads them again.  Each micro-batch overwrites its own folders, so
    a repeated one changes nothing; attempts are bounded, so the loop ends.
    """
    waiting = True

    def save(batch: DataFrame, epoch: int) -> None:
        nonlocal waiting
        judged = judge(batch).persist()
        failed = judged.where(F.col("error").isNotNull())
        judged.where(F.col("error").isNull()).drop("error").write.mode("overwrite").parquet(f"{done}/_epoch={epoch}")
        ev.dead_letters(failed, max_attempts).write.mode("overwrite").parquet(f"{dead}/_epoch={epoch}")
        again = ev.retried(failed, max_attempts).select(*schema.fieldNames())
        if not again.isEmpty():
            again.write.mode("overwrite").parquet(f"{log}/retry-{epoch}")
            waiting = True
        judged.unpersist()

    drains = 0
    while waiting:
        waiting, drains = False, drains + 1
        stream = read_table_stream(spark, f"{log}/*", schema, files_per_trigger)
        stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return drains


def completion_stream(
    events: DataFrame, pages: DataFrame, totals: str, checkpoint: str, on_result: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    """Batch completion after every micro-batch.

    Exported pages are deduplicated in the stream's state, so a micro-batch brings only pages
    that are new.  ``totals`` holds the exported pages per batch after each micro-batch (one
    folder per number); a step adds its new pages to the folder before it and reads no
    earlier events.  A repeated micro-batch overwrites its own folder and changes nothing.
    """
    spark = events.sparkSession
    due = ev.due_pages(pages)

    def step(fresh: DataFrame, epoch: int) -> None:
        counts = fresh.join(due, "page_id").groupBy("batch_id").agg(F.count("*").alias("exported"))
        if epoch > 0:
            counts = counts.unionByName(spark.read.parquet(f"{totals}/_epoch={epoch - 1}"))
        counts.groupBy("batch_id").agg(F.sum("exported").alias("exported")).write.mode("overwrite").parquet(f"{totals}/_epoch={epoch}")
        on_result(ev.completion(due, spark.read.parquet(f"{totals}/_epoch={epoch}")), epoch)

    fresh = ev.exported_pages(events)
    return fresh.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_moves(moves: DataFrame, legal: str, illegal: str, checkpoint: str) -> StreamingQuery:
    """Legal moves of pages to one table, illegal ones to another, exactly once per batch."""

    def save(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        batch.where("legal").drop("legal").write.mode("overwrite").parquet(f"{legal}/_epoch={epoch}")
        batch.where("NOT legal").drop("legal").write.mode("overwrite").parquet(f"{illegal}/_epoch={epoch}")
        batch.unpersist()

    with rocks_state(moves.sparkSession):
        return moves.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
