"""Plug point for models: a batch function over page rows with a rule fallback."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
ROLE_SCHEMAS = {
    "classify": "page_id string, page_type string, confidence double, reason string",
    "segment": "page_id string, class string, x int, y int, confidence double",
    "detect": "page_id string, block_id string, text string, kind string, x1 double, y1 double, x2 double, y2 double, confidence double",
    "review": "page_id string, ok boolean, warning string",
}
# ---------------------------------------------------------- end of fixed values

Backend = Callable[[pd.DataFrame], pd.DataFrame]


def apply_backend(
    df: DataFrame,
    load: Callable[[], Backend] | None,
    schema: str,
    fallback: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Run a model over Arrow batches, or the rules when there is none.

    ``load`` is called once per task and returns the batch function, so weights load
    once and never travel with the plan.  ``None`` selects the rule fallback.
    """
    if load is None:
        return fallback(df)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    return df.mapInPandas(run, schema)


def no_blocks(df: DataFrame) -> DataFrame:
    """Detector fallback: no text blocks."""
    return df.sparkSession.createDataFrame([], ROLE_SCHEMAS["detect"])


def classify_pages(pixels: DataFrame, load: Callable[[], Backend] | None = None) -> DataFrame:
    """Page type per page by a model or by the routing rules.

    A model receives one row per image row (``page_id, y, v array``), never a whole
    page, and may emit several opinions; the most confident one per page is kept.
    """
    from draftlake.operators.components import route_pages
    from draftlake.operators.ordered import first_per_key

    if load is None:
        return route_pages(pixels)
    rows = pixels.groupBy("page_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("_p"))
    rows = rows.select("page_id", "y", F.transform("_p", lambda p: p["v"]).alias("v"))
    opinions = apply_backend(rows, load, ROLE_SCHEMAS["classify"], lambda _: route_pages(pixels))
    return first_per_key(opinions, ["page_id"], F.desc("confidence"), F.asc("page_type"))
