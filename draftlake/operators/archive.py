"""Archive listings: limits, safety audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlake.functions import ingest

# ---------------------------------------------------------------- fixed values
MAX_FILES = 10_000
MAX_DEPTH = 8
MAX_BYTES = 20 * 1024**3
# ---------------------------------------------------------- end of fixed values

BLOCK = 4096


def running_totals(entries: DataFrame, sums: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """Running sums by ``ord`` within an archive, blocked so one archive spreads over tasks.

    ``ord`` numbers the entries of an archive, so a block holds at most ``block``
    rows.  Block totals carry the sum of everything before the block.
    """
    terms = {f"_term_{n}": c for n, c in sums.items()}
    tagged = entries.withColumns({**terms, "_block": F.floor(F.col("ord") / block)})
    totals = tagged.groupBy("archive_id", "_block").agg(*[F.sum(f"_term_{n}").alias(f"_sum_{n}") for n in sums])
    before = Window.partitionBy("archive_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "archive_id", "_block", *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_carry_{n}") for n in sums]
    )
    inside = Window.partitionBy("archive_id", "_block").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return (
        tagged.withColumns({n: F.sum(f"_term_{n}").over(inside) for n in sums})
        .join(carried, ["archive_id", "_block"])
        .withColumns({n: F.col(n) + F.col(f"_carry_{n}") for n in sums})
        .drop("_block", *terms, *[f"_carry_{n}" for n in sums])
    )


def archive_audit(
    entries: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES, max_depth: int = MAX_DEPTH
) -> DataFrame:
    """First violation of every archive, null when it may be unpacked.

    Counters start anew for each archive.  Depth is checked before any entry.
    """
    totals = running_totals(entries, {"n_files": F.lit(1).cast("long"), "n_bytes": F.col("size")})
    broken = (
        F.when(F.col("depth") > max_depth, "depth")
        .when(F.col("n_files") > max_files, "files")
        .otherwise(
            F.coalesce(
                ingest.entry_violation(F.col("name"), F.col("type")), F.when(F.col("n_bytes") > max_bytes, "bytes")
            )
        )
    )
    flagged = totals.withColumn("violation", broken)
    bad = F.col("violation").isNotNull()
    return flagged.groupBy("archive_id").agg(
        F.count("*").alias("entries"),
        F.sum("size").alias("total_bytes"),
        F.min(F.when(bad, F.struct("ord", "violation"))).alias("first"),
    ).select(
        "archive_id",
        "entries",
        "total_bytes",
        F.col("first.ord").alias("stopped_at"),
        F.col("first.violation").alias("violation"),
    )
