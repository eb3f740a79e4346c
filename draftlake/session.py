"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators rely on.  A join may meet one key that
# holds a large share of the rows, so AQE has to be free to split it even when
# the split costs one more exchange.
_SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings above to a session and return it."""
    for key, value in _SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


# Tables of pixels and points compress to a tenth, so a partition of the usual size fills a
# task's memory.  Exchanges start fine and are joined up to this size, whatever the table's.
_FINE_EXCHANGES = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "512",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
}


def bound_tasks(spark: SparkSession) -> SparkSession:
    """``tune`` a session and bound what a task reads of an exchange, not their number."""
    for key, value in _FINE_EXCHANGES.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the cluster.

    Only where that is unset and driver and executors are one process (``local`` or
    ``local[n]``, as in tests) a temporary folder is set; any other master is refused.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="draftlake-")
    context.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the checkpoint folder and cut its lineage.

    Used by loops and wherever a non-deterministic column (a partition number)
    must keep its value when an executor is lost.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def settle_dense(df: DataFrame) -> DataFrame:
    """``settle`` of a table of many rows: kept as compressed Arrow batches, a fraction of its size as rows.

    The table comes back without the order and the partitioning it had.
    """
    schema = df.schema

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch"])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one in b.column(0):
                yield from pa.ipc.open_stream(one.as_buffer())

    return settle(df.mapInArrow(packed, "batch binary")).mapInArrow(spelled, schema)


def spread_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over all shuffle partitions ahead of a step that multiplies them.

    The rows are still few here, and a small input would otherwise arrive in one
    partition and be multiplied by one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
