"""Ordered helpers on one key that holds most of the rows."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from draftlake.operators import archive, catalog
from draftlake.operators.ordered import running, with_next


def _skewed(n: int = 3000) -> pd.DataFrame:
    rng = random.Random(1)
    keys = ["hot" if rng.random() < 0.6 else f"k{rng.randrange(40)}" for _ in range(n)]
    return pd.DataFrame({"k": keys, "o": rng.sample(range(10 * n), n), "v": [rng.randrange(100) for _ in range(n)]})


def test_running_equals_window(spark):
    pdf = _skewed()
    got = running(spark.createDataFrame(pdf), ["k"], ["o"], {"n": F.lit(1), "total": F.col("v")}, slices=7).toPandas()
    want = pdf.sort_values("o")
    want["n"] = want.groupby("k").cumcount() + 1
    want["total"] = want.groupby("k")["v"].cumsum()
    pd.testing.assert_frame_equal(
        got.sort_values("o").reset_index(drop=True)[["k", "o", "v", "n", "total"]],
        want.reset_index(drop=True)[["k", "o", "v", "n", "total"]],
        check_dtype=False,
    )


def test_next_equals_window(spark):
    pdf = _skewed()
    got = with_next(spark.createDataFrame(pdf), ["k"], ["o"], "o", "next", slices=7).toPandas().sort_values("o")
    want = pdf.sort_values("o")
    want["next"] = want.groupby("k")["o"].shift(-1)
    assert got["next"].fillna(-1).tolist() == want["next"].fillna(-1).tolist()


def test_page_index_of_one_huge_file(spark):
    paths = [f"page-{i:05d}.png" for i in range(500)]
    random.Random(2).shuffle(paths)
    got = catalog.page_index(spark.createDataFrame([("f", p) for p in paths], "file_id string, path string")).collect()
    assert {r["path"]: r["page_index"] for r in got} == {f"page-{i:05d}.png": i for i in range(500)}


def test_archive_totals_cross_blocks(spark):
    df = spark.range(1, 1001).select(F.lit("a").alias("archive_id"), F.col("id").alias("ord"), F.lit(3).cast("long").alias("size"))
    got = archive.running_totals(df, {"n": F.lit(1).cast("long"), "b": F.col("size")}, block=64).collect()
    assert all(r["n"] == r["ord"] and r["b"] == 3 * r["ord"] for r in got)
