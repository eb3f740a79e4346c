"""Ordered work (ranks, running sums, next value) that survives one huge key.

A window partitioned by the key would sort the whole key in one task.  Here the
rows are range-partitioned by (key, order), so a large key spans many slices.
Each slice is processed on its own and corrected with a summary that has at most
one row per (key, slice).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlake.session import settle

SLICE = "_slice"


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int | None = None) -> DataFrame:
    """Tag rows with a slice number that grows with (keys, order).

    (keys, order) should be unique, otherwise equal rows share a slice.  The
    result is settled because range bounds come from sampling and must not move.
    """
    spark = df.sparkSession
    count = slices or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ranged = df.repartitionByRange(count, *keys, *order)
    return settle(ranged.withColumn(SLICE, F.spark_partition_id()))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    slices: int | None = None,
) -> DataFrame:
    """Add inclusive running sums per key in the given order.

    ``running(df, ["file_id"], ["path"], {"n": F.lit(1)})`` numbers rows from 1.
    """
    parts = sliced(df, keys, order, slices)
    terms = {name: f"_term_{name}" for name in sums}
    parts = parts.withColumns({terms[name]: column for name, column in sums.items()})
    totals = parts.groupBy(*keys, SLICE).agg(*[F.sum(terms[n]).alias(f"_total_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    # Only slices that continue a key started earlier need a correction.  A key
    # touches consecutive slices, so there are fewer such rows than slices.
    carried = (
        totals.withColumns({f"_carry_{n}": F.sum(f"_total_{n}").over(before) for n in sums})
        .where(F.coalesce(*[F.col(f"_carry_{n}").cast("double") for n in sums]).isNotNull())
        .select(*keys, SLICE, *[f"_carry_{n}" for n in sums])
    )
    inside = Window.partitionBy(SLICE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumns({n: F.sum(terms[n]).over(inside) for n in sums})
    joined = local.join(F.broadcast(carried), [*keys, SLICE], "left")
    return joined.withColumns({n: F.col(n) + F.coalesce(F.col(f"_carry_{n}"), F.lit(0)) for n in sums}).drop(
        SLICE, *terms.values(), *[f"_carry_{n}" for n in sums]
    )


def with_next(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    alias: str,
    slices: int | None = None,
) -> DataFrame:
    """Add the value of the following row of the same key (null at the end)."""
    parts = sliced(df, keys, order, slices)
    first = parts.groupBy(*keys, SLICE).agg(F.min_by(value, F.struct(*order)).alias("_head"))
    onward = Window.partitionBy(*keys).orderBy(SLICE)
    # One row per slice that a key continues past: fewer rows than slices.
    heads = (
        first.withColumn("_next_head", F.lead("_head").over(onward))
        .where(F.col("_next_head").isNotNull())
        .select(*keys, SLICE, "_next_head")
    )
    inside = Window.partitionBy(SLICE, *keys).orderBy(*order)
    return (
        parts.withColumn(alias, F.lead(value).over(inside))
        .join(F.broadcast(heads), [*keys, SLICE], "left")
        .withColumn(alias, F.coalesce(F.col(alias), F.col("_next_head")))
        .drop(SLICE, "_next_head")
    )


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column, count: int = 1) -> DataFrame:
    """The first ``count`` rows of every key.

    Catalyst prunes to ``count`` rows per key before the shuffle (window group
    limit), so a large key sends only a few rows from each task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= count).drop("_rank")
