"""Operators on page pixels.

``ink(page_id, x, y)`` lists foreground pixels; ``pixels(page_id, x, y, v)`` is a dense
gray page.  Groups are image rows, image columns or fixed tiles, never whole pages,
so one page can hold most of the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlake.functions import rules
from draftlake.operators import vector
from draftlake.operators.angles import _atan2
from draftlake.operators.distance import nearest_ink
from draftlake.operators.grouped import grouped
from draftlake.operators.pieces import PIECE, TILED, closed, opened, packed, solid_runs, unpacked
from draftlake.operators.pieces import pixels as spelled_pixels
from draftlake.session import settle, spread_rows

# ---------------------------------------------------------------- fixed values
ADAPTIVE_BLOCK = 31
ADAPTIVE_OFFSET = 10
SKEW_MAX_DEG = 10.0
SKEW_STEP_DEG = 0.2
HAUSDORFF_PERCENTILE = 0.99
FRAME_SHARE = 0.4
TEXT_BLOB = {"area": (10, 600), "side": (4, 60), "per_pixels": 50_000}
ROUTER_BLOB = {"area": (8, 800), "side": (3, 80), "per_pixels": 40_000}
GRID_MIN_RUN = 40
STROKE_THICKNESS = 2
REFERENCE_LAYER = "99_RASTER_REFERENCE"
# ---------------------------------------------------------- end of fixed values

PIXEL = ["page_id", "x", "y"]
GRAY_TILE = 256
SKEW_BLOCK = 16  # angles
FLUSH_PIXELS = 1 << 16  # of painted tiles that leave together


# ----------------------------------------------------------------- gray values
def ink_stats(pixels: DataFrame) -> DataFrame:
    """Foreground share and contrast of dense pages (ink is any non-zero value)."""
    return pixels.groupBy("page_id").agg(
        F.count("*").alias("area"),
        (F.count_if(F.col("v") > 0) / F.count("*")).alias("fg_ratio"),
        rules.clip(F.stddev_pop("v") / F.lit(rules.CONTRAST_FULL_SCALE), 0.0, 1.0).alias("contrast"),
    )


def _tiles(pixels: DataFrame, halo: int) -> DataFrame:
    """Pixels dealt to tiles of GRAY_TILE pixels and the ``halo`` around them, with the page's size.

    One exchange; a tile is of bounded size, so it may be handled as an array.
    """
    sizes = pixels.groupBy("page_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))

    def near(c: str, side: str) -> Column:
        low, high = F.floor((F.col(c) - halo) / GRAY_TILE), F.floor((F.col(c) + halo) / GRAY_TILE)
        last = F.floor((F.col(side) - 1) / GRAY_TILE)
        return F.sequence(F.greatest(low, F.lit(0)), F.least(high, last))

    sized = pixels.select(*PIXEL, "v").join(sizes, "page_id")
    return sized.withColumn("tx", F.explode(near("x", "width"))).withColumn("ty", F.explode(near("y", "height")))


def _tile_array(pdf: pd.DataFrame, halo: int, mode: str) -> tuple[int, int, np.ndarray]:
    """Origin and values of a tile with its halo; ``mode`` says how a page goes on behind its border."""
    width, height = int(pdf["width"].iloc[0]), int(pdf["height"].iloc[0])
    x0, y0 = int(pdf["tx"].iloc[0]) * GRAY_TILE, int(pdf["ty"].iloc[0]) * GRAY_TILE
    x1, y1 = min(width, x0 + GRAY_TILE), min(height, y0 + GRAY_TILE)
    left, top, right, bottom = max(0, x0 - halo), max(0, y0 - halo), min(width, x1 + halo), min(height, y1 + halo)
    cells = np.zeros((bottom - top, right - left))
    cells[pdf["y"].to_numpy() - top, pdf["x"].to_numpy() - left] = pdf["v"].to_numpy()
    pad = ((halo - (y0 - top), halo - (bottom - y1)), (halo - (x0 - left), halo - (right - x1)))
    return x0, y0, np.pad(cells, pad, mode=mode)


def noise_score(pixels: DataFrame) -> DataFrame:
    """Variance of the four-neighbour Laplacian; the border mirrors without repeating the edge."""

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, a = _tile_array(pdf, 1, "reflect")
        lap = a[1:-1, :-2] + a[1:-1, 2:] + a[:-2, 1:-1] + a[2:, 1:-1] - 4 * a[1:-1, 1:-1]
        return pd.DataFrame({"page_id": [pdf["page_id"].iloc[0]], "n": [lap.size], "s": [lap.sum()], "ss": [(lap * lap).sum()]})

    parts = _tiles(pixels, 1).groupBy("page_id", "tx", "ty").applyInPandas(sums, "page_id string, n long, s double, ss double")
    total = parts.groupBy("page_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    spread_of = F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))
    return total.select(
        "page_id", spread_of.alias("laplacian_var"), rules.clip(spread_of / F.lit(rules.NOISE_FULL_SCALE), 0.0, 1.0).alias("noise")
    )


def otsu(pixels: DataFrame) -> DataFrame:
    """Threshold with the largest between-class variance per page; ink is the rarer side.

    Works on the histogram: at most 256 rows per page after map-side counting.
    """
    hist = pixels.groupBy("page_id", "v").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("page_id").orderBy("v")
    whole = Window.partitionBy("page_id")
    mass = F.col("n") * F.col("v")
    cum = hist.select(
        "page_id",
        "v",
        F.sum("n").over(upto).alias("n0"),
        F.sum(mass).over(upto).alias("s0"),
        F.sum("n").over(whole).alias("total"),
        F.sum(mass).over(whole).alias("sum"),
    )
    n1, s1 = F.col("total") - F.col("n0"), F.col("sum") - F.col("s0")
    gap = F.col("s0") / F.col("n0") - s1 / F.nullif(n1, F.lit(0))
    between = F.coalesce(F.col("n0") * n1 * gap * gap, F.lit(0.0))
    picked = cum.withColumn("between", between).groupBy("page_id").agg(
        F.max(F.struct("between", (-F.col("v")).alias("low"), "n0", "total")).alias("best")
    )
    share_above = F.lit(1.0) - F.col("best.n0") / F.col("best.total")
    return picked.select(
        "page_id", (-F.col("best.low")).alias("threshold"), (share_above * 255 > 127).alias("inverted")
    )


def _gauss(block: int) -> list[float]:
    half = block // 2
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-half, half + 1)]
    return [w / sum(raw) for w in raw]


def _blur(a: np.ndarray, weights: list[float]) -> np.ndarray:
    """One pass of a symmetric kernel along the last axis; the result is shorter by the kernel."""
    half = len(weights) // 2
    count = a.shape[-1] - 2 * half
    total = a[..., half : half + count] * weights[half]
    for k in range(1, half + 1):
        total = total + (a[..., half - k : half - k + count] + a[..., half + k : half + k + count]) * weights[half + k]
    return total


def adaptive_threshold(pixels: DataFrame, block: int = ADAPTIVE_BLOCK, offset: int = ADAPTIVE_OFFSET) -> DataFrame:
    """Ink pixels of dense pages: darker than the local Gaussian mean minus an offset.

    White wins where the value exceeds the bound; a page that is mostly white is
    inverted, so ink is always the listed side.  Tiles are thresholded as arrays with a
    halo of half a block and kept as bitmaps until the page's side is known.
    """
    half, weights = block // 2, _gauss(block)

    def thresholded(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0, a = _tile_array(pdf, half, "edge")
        mean = _blur(np.ascontiguousarray(_blur(a, weights).T), weights).T
        own = a[half : a.shape[0] - half, half : a.shape[1] - half]
        white = own > np.rint(mean) - offset
        return pd.DataFrame(
            {"page_id": [pdf["page_id"].iloc[0]], "x0": [x0], "y0": [y0], "w": [white.shape[1]], "n": [white.size], "n_white": [int(white.sum())], "bits": [np.packbits(white).tobytes()]}
        )

    schema = "page_id string, x0 int, y0 int, w int, n long, n_white long, bits binary"
    maps = settle(_tiles(pixels, half).groupBy("page_id", "tx", "ty").applyInPandas(thresholded, schema))
    pages = maps.groupBy("page_id").agg((F.sum("n_white") / F.sum("n") * 255 > 127).alias("flip"))

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                white = np.unpackbits(np.frombuffer(row.bits, np.uint8), count=row.n).astype(bool)
                at = np.flatnonzero(white != row.flip)
                yield pd.DataFrame({"page_id": row.page_id, "x": (at % row.w + row.x0).astype(np.int32), "y": (at // row.w + row.y0).astype(np.int32)})

    return maps.join(pages, "page_id").mapInPandas(listed, "page_id string, x int, y int")


def binarize(pixels: DataFrame, method: str = "adaptive") -> DataFrame:
    if method != "otsu":
        return adaptive_threshold(pixels)
    cut = pixels.join(otsu(pixels), "page_id")
    return cut.where((F.col("v") > F.col("threshold")) != F.col("inverted")).select(*PIXEL)


# ------------------------------------------------------------------------ skew
def skew_profile(ink: DataFrame, sizes: DataFrame, max_angle: float = SKEW_MAX_DEG, step: float = SKEW_STEP_DEG) -> DataFrame:
    """Row-sum statistics of every page at every trial angle, at full resolution.

    A task turns its batches of pixels by all angles at once and counts them per row of the
    page.  The counts of a batch travel as arrays, for SKEW_BLOCK angles together, and are added
    up page by page as they arrive, so a task holds the row sums of one page and block.
    """
    count = int(round(2 * max_angle / step)) + 1
    # Pixels of a tile come together, so a batch holds few pages and a page spreads over many tasks.
    tile = ["page_id", "tx", "ty"]
    placed = ink.select(*PIXEL).join(sizes.select("page_id", "width", "height"), "page_id")
    placed = placed.withColumns({"tx": F.floor(F.col("x") / GRAY_TILE), "ty": F.floor(F.col("y") / GRAY_TILE)})
    placed = placed.repartition(*[F.col(c) for c in tile]).dropDuplicates([*tile, "x", "y"]).sortWithinPartitions(*tile).drop("tx", "ty")

    def turned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        angles = np.radians(-max_angle + np.arange(count) * step)
        for pdf in batches:
            for (page, width, height), own in pdf.groupby(["page_id", "width", "height"], sort=False):
                cx, cy, tall = width / 2.0, height / 2.0, int(height)
                dx, dy = own["x"].to_numpy(np.float64)[None, :] - cx, own["y"].to_numpy(np.float64)[None, :] - cy
                rows = []
                for block in range(0, count, SKEW_BLOCK):
                    cos, sin = (f(angles[block : block + SKEW_BLOCK])[:, None] for f in (np.cos, np.sin))
                    rx, ry = np.floor(cos * dx + sin * dy + cx + 0.5), np.floor(cos * dy - sin * dx + cy + 0.5)
                    seen = (rx >= 0) & (rx < width) & (ry >= 0) & (ry < height)
                    cell, c = _counted((np.arange(len(cos))[:, None] * tall + ry.astype(np.int64))[seen], None, len(cos) * tall)
                    if len(cell):
                        rows.append((page, block, tall, cell.astype("<i8").tobytes(), c.astype("<i8").tobytes()))
                if rows:
                    yield pd.DataFrame(rows, columns=["page_id", "block", "height", "cell", "c"])

    part = placed.mapInPandas(turned, "page_id string, block int, height int, cell binary, c binary")
    key = ["page_id", "block", "height"]
    part = part.repartition(*[F.col(c) for c in key]).sortWithinPartitions(*key)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, held, load, out = None, [], 0, []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            cell, c = (np.concatenate(v) for v in zip(*held, strict=True))
            return _counted(cell, c, SKEW_BLOCK * name[2])

        def close() -> None:
            cell, c = merged()
            sums, squares = np.zeros(SKEW_BLOCK, np.int64), np.zeros(SKEW_BLOCK, np.int64)
            np.add.at(sums, cell // name[2], c)
            np.add.at(squares, cell // name[2], c * c)
            # A row of the result is an angle with pixels on the page.
            out.extend((name[0], name[1] + i, name[2], int(sums[i]), int(squares[i])) for i in np.flatnonzero(sums))

        def given() -> pd.DataFrame:
            return pd.DataFrame(out, columns=["page_id", "i", "height", "s", "ss"])

        for pdf in batches:
            for page, block, tall, cell, c in pdf.itertuples(index=False):
                if (page, block, tall) != name:
                    if held:
                        close()
                    name, held, load = (page, block, tall), [], 0
                held.append((np.frombuffer(cell, "<i8"), np.frombuffer(c, "<i8")))
                load += len(held[-1][0])
                if load > 1 << 20 and len(held) > 1:
                    held = [merged()]
                    load = 0
            if len(out) >= 4096:
                yield given()
                out = []
        if held:
            close()
        if out:
            yield given()

    sums = part.mapInPandas(summed, "page_id string, i int, height int, s long, ss long")
    # Integer form of the variance over all rows, empty ones included.
    return sums.select("page_id", "i", (F.col("ss") * F.col("height") - F.col("s") * F.col("s")).alias("score"))


def _counted(cell: np.ndarray, c: np.ndarray | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order and how often they occur, or the sums of ``c`` there."""
    if len(cell) * 8 > size:
        whole = np.zeros(size, np.int64)
        if c is None:
            whole = np.bincount(cell, minlength=size)
        else:
            np.add.at(whole, cell, c)
        found = np.flatnonzero(whole)
        return found, whole[found]
    # Few pixels of a tall page.
    found, at = np.unique(cell, return_inverse=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, at, 1 if c is None else c)
    return found, sums


def estimate_skew(ink: DataFrame, sizes: DataFrame, max_angle: float = SKEW_MAX_DEG, step: float = SKEW_STEP_DEG) -> DataFrame:
    """Angle whose rotation gives the most uneven row sums; the first of equals."""
    best = skew_profile(ink, sizes, max_angle, step).groupBy("page_id").agg(
        F.max(F.struct("score", (-F.col("i")).alias("first"))).alias("b")
    )
    found = best.select("page_id", F.round(F.lit(-max_angle) - F.col("b.first") * F.lit(step), 6).alias("angle"))
    return sizes.select("page_id").join(found, "page_id", "left").withColumn("angle", F.coalesce("angle", F.lit(0.0)) + F.lit(0.0))


# ---------------------------------------------------------- runs and morphology
def runs(ink: DataFrame, axis: str = "x") -> DataFrame:
    """Maximal runs of ink along rows (axis x) or columns (axis y)."""
    line = "y" if axis == "x" else "x"
    order = Window.partitionBy("page_id", line).orderBy(axis)
    island = F.col(axis) - F.row_number().over(order)
    return (
        ink.withColumn("_island", island)
        .groupBy("page_id", line, "_island")
        .agg(F.min(axis).alias(f"{axis}0"), F.max(axis).alias(f"{axis}1"))
        .drop("_island")
        .withColumn("length", F.col(f"{axis}1") - F.col(f"{axis}0") + 1)
    )


def open_runs(ink: DataFrame, axis: str, min_len: Column | int) -> DataFrame:
    """Opening with a bar of ``min_len``: the pixels of runs at least that long."""
    line = "y" if axis == "x" else "x"
    long = runs(ink, axis).where(F.col("length") >= min_len)
    return long.select(
        "page_id", line, F.explode(F.sequence(f"{axis}0", f"{axis}1")).alias(axis)
    ).select(*PIXEL)


def erode_runs(ink: DataFrame, axis: str, bar: int) -> DataFrame:
    """Erosion with a bar of ``bar`` pixels anchored at its middle."""
    line = "y" if axis == "x" else "x"
    lead = bar // 2
    long = solid_runs(ink, axis).where(F.col("length") >= bar)
    kept = F.sequence(F.col(f"{axis}0") + lead, F.col(f"{axis}1") - (bar - 1 - lead))
    return long.select("page_id", line, F.explode(kept).alias(axis)).select(*PIXEL)


def run_edges(rows: DataFrame, bucket: int = 64) -> DataFrame:
    """Touching runs on consecutive rows (eight-neighbour contact).

    Runs are filed under the ``bucket``-pixel stretches they cover, so a crowded row
    is compared piecewise; a pair counts in the first stretch both share.
    """
    stretch = lambda c: F.floor(c / F.lit(bucket))
    a = rows.select(
        "page_id", F.col("y").alias("ay"), F.col("x0").alias("ax0"), F.col("x1").alias("ax1"), (F.col("y") + 1).alias("_y")
    ).withColumn("a_first", stretch(F.col("ax0") - 1))
    a = a.withColumn("_s", F.explode(F.sequence("a_first", stretch(F.col("ax1") + 1))))
    b = rows.select("page_id", F.col("y").alias("_y"), F.col("x0").alias("bx0"), F.col("x1").alias("bx1")).withColumn(
        "b_first", stretch(F.col("bx0"))
    )
    b = b.withColumn("_s", F.explode(F.sequence("b_first", stretch(F.col("bx1")))))
    touching = (F.col("ax0") <= F.col("bx1") + 1) & (F.col("bx0") <= F.col("ax1") + 1)
    once = F.col("_s") == F.greatest("a_first", "b_first")
    return a.join(b, ["page_id", "_y", "_s"]).where(touching & once).select(
        "page_id", "ay", "ax0", "ax1", F.col("_y").alias("by"), "bx0", "bx1"
    )


def dilate(ink: DataFrame, width: int, height: int) -> DataFrame:
    """Dilation with a rectangle anchored at its middle.

    A small rectangle repeats each pixel and removes copies in one exchange.  A large
    one works on runs: a run grows by the bar, and only then becomes pixels.
    """
    if width * height <= 9:
        steps = [
            F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
            for dx in range(width // 2 - width + 1, width // 2 + 1)
            for dy in range(height // 2 - height + 1, height // 2 + 1)
        ]
        wide = ink.select("page_id", "x", "y", F.explode(F.array(*steps)).alias("s"))
        return wide.select(
            "page_id", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y")
        ).distinct()

    def grow(df: DataFrame, axis: str, bar: int) -> DataFrame:
        line = "y" if axis == "x" else "x"
        before, after = bar - 1 - bar // 2, bar // 2
        wide = runs(df, axis)
        span = F.sequence(F.col(f"{axis}0") - before, F.col(f"{axis}1") + after)
        return wide.select("page_id", line, F.explode(span).alias(axis)).select(*PIXEL).distinct()

    grown = grow(ink, "x", width) if width > 1 else ink
    return grow(grown, "y", height) if height > 1 else grown


def mask_union(*masks: DataFrame) -> DataFrame:
    whole = masks[0].select(*PIXEL)
    for m in masks[1:]:
        whole = whole.unionByName(m.select(*PIXEL))
    return whole.distinct()


def mask_subtract(ink: DataFrame, *masks: DataFrame) -> DataFrame:
    """Pixels of ``ink`` in none of the masks."""
    left = ink.select(*PIXEL)
    for m in masks:
        left = left.join(m.select(*PIXEL), PIXEL, "left_anti")
    return left


def mask_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels of ``a`` that are in ``b``; both travel as pieces of tiles."""
    kinds = [F.col(f.name).cast(f.dataType).alias(f.name) for f in a.select(*PIXEL).schema]
    placed = F.col("page_id").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()
    sides = [packed(side.where(placed)).withColumn("own", F.lit(k == 0)) for k, side in enumerate((a, b))]
    met = grouped(sides[0].unionByName(sides[1]), ["page_id", "tx", "ty"], _shared, PIECE, flush=1024, dense=True)
    return unpacked(met).select(*kinds)


def _shared(rows: dict[str, np.ndarray]) -> dict:
    """A tile's pixels of the own pieces that the others have as well."""
    own = rows["own"].astype(bool)
    if own.all() or not own.any():
        return {}
    mine, theirs = (np.concatenate([opened(v) for v in rows["codes"][side]]) for side in (own, ~own))
    held = np.sort(mine[np.isin(mine, theirs)])
    if not len(held):
        return {}
    return {**{c: rows[c][:1] for c in ("page_id", "tx", "ty")}, "n": np.array([len(held)]), "codes": np.array([closed(held)], object)}


def mask_bbox(mask: DataFrame, *extra: str) -> DataFrame:
    return mask.groupBy("page_id", *extra).agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("pixels")
    )


def neighbours(ink: DataFrame) -> DataFrame:
    """Count of ink pixels around each ink pixel; 1 is an end, 3 or more a junction.

    Pixels are dealt to tiles, those at a tile's edge to the tiles next to it as well, and
    counted there as arrays.  A repeated pixel counts as often as it stands there.
    """
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    tiles = lambda c: F.sequence(F.floor((F.col(c) - 1) / GRAY_TILE), F.floor((F.col(c) + 1) / GRAY_TILE))
    none = F.array(F.lit(None).cast("long"))
    dealt = ink.select("page_id", "x", "y").withColumn("tx", F.explode(F.when(placed, tiles("x")).otherwise(none)))
    dealt = dealt.withColumn("ty", F.explode(F.when(placed, tiles("y")).otherwise(none)))
    counted = grouped(dealt, ["page_id", "tx", "ty"], _votes, "page_id string, x int, y int, neighbours long")
    return counted.select(
        *PIXEL,
        "neighbours",
        F.when(F.col("neighbours") == 1, "end").when(F.col("neighbours") >= 3, "junction").alias("role"),
    )


def _votes(own: dict[str, np.ndarray]) -> dict:
    """The distinct pixels of a tile and how many stand around each."""
    x, y, tx, ty = (own[c].astype(np.float64) for c in ("x", "y", "tx", "ty"))
    if np.isnan(tx[0]):  # pixels without x or y: a missing number is equal to itself and its neighbours
        votes = pd.DataFrame([(a + dx, b + dy, dx == dy == 0) for a, b in zip(x, y, strict=True) for dx in (-1, 0, 1) for dy in (-1, 0, 1)], columns=["x", "y", "own"])
        sums = votes.groupby(["x", "y"], dropna=False)["own"].agg(["sum", "count"]).reset_index()
        sums = sums[sums["sum"] > 0]
        return {"page_id": own["page_id"][0], "x": sums["x"].to_numpy(), "y": sums["y"].to_numpy(), "neighbours": (sums["count"] - sums["sum"]).to_numpy()}
    # One column and row more on each side, so that no neighbour falls into another row.
    left, top, wide = int(tx[0]) * GRAY_TILE - 2, int(ty[0]) * GRAY_TILE - 2, GRAY_TILE + 4
    x, y = x.astype(np.int64) - left, y.astype(np.int64) - top
    held = np.bincount(y * wide + x, minlength=wide * wide)
    inside = (x >= 2) & (x < wide - 2) & (y >= 2) & (y < wide - 2)
    code = np.unique(y[inside] * wide + x[inside])
    steps = [dy * wide + dx for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]
    around = sum(held[code + s] for s in steps) if len(code) else np.zeros(0, np.int64)
    return {"page_id": own["page_id"][0], "x": code % wide + left, "y": code // wide + top, "neighbours": around}


# --------------------------------------------------------------------- compare
def raster_iou(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlap of two rasters per page; two empty rasters overlap fully."""
    tagged = a.select(*PIXEL, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        b.select(*PIXEL, F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    cells = tagged.groupBy(*PIXEL).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return cells.groupBy("page_id").agg(
        F.sum(F.col("a") * F.col("b")).alias("intersection"), F.count("*").alias("union")
    ).withColumn("iou", F.when(F.col("union") == 0, 1.0).otherwise(F.col("intersection") / F.col("union")))


def _directed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distances of both directions: page, direction, distance, number of pixels."""
    both = nearest_ink(a, b).withColumn("dir", F.lit(0)).unionByName(nearest_ink(b, a).withColumn("dir", F.lit(1)))
    return settle(both.groupBy("page_id", "dir", "dist").agg(F.count("*").alias("n")))


def distances(a: DataFrame, b: DataFrame, percentile: float = HAUSDORFF_PERCENTILE) -> DataFrame:
    """Chamfer and robust Hausdorff distance per page (infinite when one side is empty).

    Equal distances are counted first; the percentile then weighs them.
    """
    sides = _directed(a, b).groupBy("page_id", "dir").agg(
        (F.sum(F.col("dist") * F.col("n")) / F.sum("n")).alias("mean"),
        F.percentile("dist", percentile, F.col("n")).alias("p"),
    )
    both = sides.groupBy("page_id").agg(
        F.count("mean").alias("directions"), F.avg("mean").alias("chamfer"), F.max("p").alias("hausdorff")
    )
    whole = F.col("directions") == 2
    endless = F.lit(float("inf"))
    return both.select(
        "page_id",
        F.when(whole, F.col("chamfer")).otherwise(endless).alias("chamfer"),
        F.when(whole, F.col("hausdorff")).otherwise(endless).alias("hausdorff"),
    )


def deviation_map(a: DataFrame, b: DataFrame, percentile: float = HAUSDORFF_PERCENTILE) -> DataFrame:
    """Heat value 0-255 of every pixel of ``a``: its distance relative to the 99th percentile."""
    near = nearest_ink(a, b)
    scale = (
        near.groupBy("page_id", "dist").agg(F.count("*").alias("n")).groupBy("page_id").agg(F.percentile("dist", percentile, F.col("n")).alias("p"))
    )
    share = rules.clip(F.col("dist") / F.greatest(F.lit(1.0), F.col("p")), 0.0, 1.0)
    return near.join(scale, "page_id").select(*PIXEL, "dist", F.floor(share * 255).cast("int").alias("heat"))


# ------------------------------------------------------------------- rasterise
def rasterise(primitives: DataFrame, polylines: DataFrame | None, sizes: DataFrame, thickness: int = STROKE_THICKNESS) -> DataFrame:
    """Ink of lines, circles, arcs and polylines; ``sizes``: page_id, width, height.

    Shapes, not pixels, are exchanged: each is filed under the tiles of the page it can
    touch, and a task paints one tile after the other.  Only the part of a shape inside the
    tile is sampled, so a stray coordinate cannot blow up the number of samples.  A painted
    tile leaves its task as an array of pixels, which become rows behind it.  The
    reference layer is not drawn.
    """
    shown = F.coalesce(F.col("layer"), F.lit("")) != REFERENCE_LAYER
    whole = lambda c: F.bround(c, 0)
    frame = F.struct(F.col("width").cast("long").alias("w"), F.col("height").cast("long").alias("h"))
    known = sizes.where(F.col("width").isNotNull() & F.col("height").isNotNull())
    pages = known.groupBy("page_id").agg(F.max("width").alias("width"), F.max("height").alias("height_px"), F.collect_list(frame).alias("frames"))
    drawn = primitives.where(shown).drop("height").join(pages, "page_id")
    page = ["page_id", "width", "height_px", "frames"]
    lines = drawn.where(F.col("type") == "LINE").select(*page, *[whole(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in vector.ENDS])
    if polylines is not None:
        edges = vector.polyline_edges(polylines.where(shown)).join(pages, "page_id")
        lines = lines.unionByName(edges.select(*page, *[whole(F.col(c)).alias(c) for c in vector.ENDS]))
    rounds = drawn.where(F.col("type").isin("CIRCLE", "ARC"))
    shapes = _filed_lines(lines, thickness + 1).unionByName(_filed_rounds(rounds, thickness + 1))
    dealt = spread_rows(shapes, "page_id", "tx", "ty").sortWithinPartitions("page_id", "tx", "ty")
    return spelled_pixels(dealt.mapInArrow(_painter(thickness), TILED))


def _tiles_between(low: Column, high: Column, size: Column) -> Column:
    """Tiles of a side that [low, high] meets; it has to meet the page."""
    first, last = F.greatest(low, F.lit(0.0)), F.least(high, size - F.lit(1.0))
    return F.explode(F.sequence(F.floor(first / GRAY_TILE), F.floor(last / GRAY_TILE)))


def _filed_lines(lines: DataFrame, margin: int) -> DataFrame:
    """Lines once per tile they can touch: by rows of tiles, then by their reach in such a row."""
    x1, y1, x2, y2 = (F.col(c) for c in vector.ENDS)
    dx, dy = x2 - x1, y2 - y1
    low, high = F.least(y1, y2) - margin, F.greatest(y1, y2) + margin
    rows = lines.where((high >= 0) & (low <= F.col("height_px") - 1)).withColumn("ty", _tiles_between(low, high, F.col("height_px")))
    up = (F.col("ty") * GRAY_TILE - margin - y1) / F.nullif(dy, F.lit(0.0))
    down = ((F.col("ty") + 1) * GRAY_TILE + margin - y1) / F.nullif(dy, F.lit(0.0))
    share = lambda t, flat: F.when(dy == 0, flat).otherwise(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)))
    a, b = x1 + share(F.least(up, down), 0.0) * dx, x1 + share(F.greatest(up, down), 1.0) * dx
    left, right = F.least(a, b) - margin, F.greatest(a, b) + margin
    near = rows.where((right >= 0) & (left <= F.col("width") - 1)).withColumn("tx", _tiles_between(left, right, F.col("width")))
    return near.select("page_id", "tx", "ty", "frames", F.lit(False).alias("round"), *[F.col(c).alias(n) for c, n in zip(vector.ENDS, "abcd", strict=True)], F.lit(0.0).alias("e"))


def _filed_rounds(rounds: DataFrame, margin: int) -> DataFrame:
    """Circles and arcs once per tile of their box: centre, radius, first angle, sweep."""
    start = F.when(F.col("type") == "ARC", F.coalesce(F.col("start_angle_deg"), F.lit(0.0))).otherwise(0.0)
    end = F.when(F.col("type") == "ARC", F.coalesce(F.col("end_angle_deg"), F.lit(360.0))).otherwise(360.0)
    turn = F.lit(360.0)
    shape = rounds.select(
        "page_id",
        "width",
        "height_px",
        "frames",
        F.bround("x1", 0).alias("a"),
        F.bround("y1", 0).alias("b"),
        F.bround(F.coalesce(F.col("radius"), F.lit(0.0)), 0).alias("c"),
        start.alias("d"),
        F.when(F.abs(end - start) >= 360, turn).otherwise(F.pmod(end - start, turn)).alias("e"),
    ).where(F.col("c") > 0)
    box = lambda c: (F.col(c) - F.col("c") - margin, F.col(c) + F.col("c") + margin)
    for c, size, name in (("b", "height_px", "ty"), ("a", "width", "tx")):
        low, high = box(c)
        shape = shape.where((high >= 0) & (low <= F.col(size) - 1)).withColumn(name, _tiles_between(low, high, F.col(size)))
    return shape.select("page_id", "tx", "ty", "frames", F.lit(True).alias("round"), *"abcde")


def _spelled(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of all whole numbers from ``first`` to ``last`` of each owner."""
    many = np.maximum(last - first + 1, 0).astype(np.int64)
    owner = np.repeat(np.arange(len(many)), many)
    return owner, np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + first[owner]


def _line_pixels(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples at pixel steps of lines (x1, y1, x2, y2) close to the box from ``low`` to ``high``."""
    start, step = a[:, :2], a[:, 2:4] - a[:, :2]
    n = np.maximum(np.abs(step).max(axis=1), 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.stack([(low - 1 - start) / step, (high + 1 - start) / step])
    flat = step == 0
    apart = (flat & ((start < low - 1) | (start > high + 1))).any(axis=1)
    t0 = np.where(flat, 0.0, t.min(axis=0)).max(axis=1).clip(0.0)
    t1 = np.where(flat, 1.0, t.max(axis=0)).min(axis=1).clip(None, 1.0)
    first = np.maximum(np.floor(t0 * n) - 1, 0)
    last = np.where(apart | (t0 > t1), first - 1, np.minimum(np.ceil(t1 * n) + 1, n))
    many = np.maximum(last - first + 1, 0).astype(np.int64)
    k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - first.astype(np.int64), many)
    t = k / np.repeat(n, many)
    return tuple(np.rint(np.repeat(start[:, c], many) + t * np.repeat(step[:, c], many)) for c in (0, 1))


def _on_arc(dy: np.ndarray, dx: np.ndarray, start: np.ndarray, sweep: np.ndarray) -> np.ndarray:
    """Whether points lie on arcs; angles close to an end are taken as the JVM computes them."""

    def turned(angle: np.ndarray, start: np.ndarray) -> np.ndarray:
        t = np.fmod(np.degrees(angle) - start, 360.0)
        return np.where(t < 0, np.fmod(t + 360.0, 360.0), t)

    on = np.ones(len(dy), bool)
    arc = np.flatnonzero(sweep < 360.0)
    dy, dx, start, sweep = dy[arc], dx[arc], start[arc], sweep[arc]
    t = np.degrees(np.arctan2(dy, dx)) - np.fmod(start, 360.0)
    t = t + 360.0 * (t < 0) + 360.0 * (t < -360.0) - 360.0 * (t >= 360.0)
    on[arc] = t <= sweep
    k = np.flatnonzero((np.abs(t - sweep) < 1e-6) | (t < 1e-6) | (t > 360.0 - 1e-6) | (np.abs(start) > 1e6))
    on[arc[k]] = turned(_atan2(dy[k], dx[k]), start[k]) <= sweep[k]
    return on


def _round_pixels(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of arcs (centre, radius, first angle, sweep) once per column and per row of the box on either half."""
    found = []
    for axis in (0, 1):
        c, r = a[:, axis], a[:, 2]
        owner, p = _spelled(np.maximum(np.ceil(c - r), low[axis]).astype(np.int64), np.minimum(np.floor(c + r), high[axis]).astype(np.int64))
        own = a[owner]
        off = p - own[:, axis]
        far = np.sqrt(own[:, 2] * own[:, 2] - off * off)
        for half in (-1.0, 1.0):
            q = own[:, 1 - axis] + half * far
            x, y = (p.astype(np.float64), q) if axis == 0 else (q, p.astype(np.float64))
            dx, dy = x - own[:, 0] + 0.0, y - own[:, 1] + 0.0
            on = _on_arc(dy, dx, own[:, 3], own[:, 4])
            found.append((np.rint(x[on]), np.rint(y[on])))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _painter(thickness: int):
    """Shapes sorted by tile -> the tile's pixels; a task holds the canvas of one tile."""
    after, before = thickness // 2, thickness - 1 - thickness // 2
    side = GRAY_TILE + thickness - 1
    fields = pa.schema([("page_id", pa.string()), ("tx", pa.int32()), ("ty", pa.int32()), ("codes", pa.list_(pa.int32()))])

    def paint(canvas: np.ndarray, shapes: np.ndarray, is_round: np.ndarray, low: np.ndarray) -> None:
        high = low + side - 1
        for pixels, own in ((_line_pixels, shapes[~is_round]), (_round_pixels, shapes[is_round])):
            for at in range(0, len(own), 2048):
                # A number below the box is a very large one without a sign.
                x, y = ((v - o).astype(np.int64).view(np.uint64) for v, o in zip(pixels(own[at : at + 2048], low, high), low, strict=True))
                inside = (x < side) & (y < side)
                canvas.ravel()[(y * np.uint64(side) + x)[inside].view(np.int64)] = True

    def done(tile: tuple, canvas: np.ndarray, frames: list[dict], held: list[tuple]) -> None:
        page, tx, ty = tile
        down = np.logical_or.reduce([canvas[k : k + GRAY_TILE] for k in range(thickness)])
        ink = np.logical_or.reduce([down[:, k : k + GRAY_TILE] for k in range(thickness)])
        for f in frames:
            w, h = max(f["w"] - tx * GRAY_TILE, 0), max(f["h"] - ty * GRAY_TILE, 0)
            own = ink
            if w < GRAY_TILE or h < GRAY_TILE:
                own = ink.copy()
                own[h:], own[:, w:] = False, False
            held.append((page, tx, ty, np.flatnonzero(own).astype(np.int32)))

    def given(held: list[tuple]) -> pa.RecordBatch:
        page, tx, ty, codes = zip(*held, strict=True)
        stops = np.r_[0, np.cumsum([len(c) for c in codes])]
        listed = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(np.concatenate(codes), pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(page, pa.string()), pa.array(tx, pa.int32()), pa.array(ty, pa.int32()), listed], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, canvas, frames, held = None, None, None, []
        for b in batches:
            if not b.num_rows:
                continue
            pages, tx, ty = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy()
            shapes = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(5, 10)], axis=1)
            is_round = b.column(4).to_numpy(zero_copy_only=False)
            usable = np.isfinite(shapes).all(axis=1)
            same = pc.equal(pages.slice(1), pages.slice(0, len(pages) - 1)).to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.flatnonzero(~same | (tx[1:] != tx[:-1]) | (ty[1:] != ty[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                key = (pages[int(i)].as_py(), int(tx[i]), int(ty[i]))
                if key != tile:
                    if tile is not None:
                        done(tile, canvas, frames, held)
                    if sum(len(h[3]) for h in held) > FLUSH_PIXELS:
                        yield given(held)
                        held = []
                    tile, canvas, frames = key, np.zeros((side, side), bool), b.column(3)[int(i)].as_py()
                on = usable[i:j]
                paint(canvas, shapes[i:j][on], is_round[i:j][on], np.array([key[1] * GRAY_TILE - after, key[2] * GRAY_TILE - after], np.float64))
        if tile is not None:
            done(tile, canvas, frames, held)
        if held:
            yield given(held)

    return run


# ---------------------------------------------------------- component summaries
def text_density(components: DataFrame, sizes: DataFrame, blob: dict = TEXT_BLOB) -> DataFrame:
    """Small blobs per page area, capped at 1; ``components`` has area, x0, y0, x1, y1."""
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    small = F.col("area").between(*blob["area"]) & w.between(*blob["side"]) & h.between(*blob["side"])
    counts = components.groupBy("page_id").agg(F.count_if(small).alias("blobs"))
    cells = F.greatest(F.lit(1.0), F.col("width") * F.col("height") / F.lit(float(blob["per_pixels"])))
    return (
        sizes.select("page_id", "width", "height")
        .join(counts, "page_id", "left")
        .select(
            "page_id",
            F.coalesce("blobs", F.lit(0)).alias("blobs"),
            F.least(F.lit(1.0), F.coalesce("blobs", F.lit(0)) / cells).alias("density"),
        )
    )


def detect_frame(components: DataFrame, sizes: DataFrame, share: float = FRAME_SHARE) -> DataFrame:
    """Bounding box of the largest component covering enough of the page, else the page."""
    boxed = components.join(sizes.select("page_id", "width", "height"), "page_id")
    box = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)
    big = boxed.withColumn("box", box).where(F.col("box") >= F.lit(share) * F.col("width") * F.col("height"))
    best = big.groupBy("page_id").agg(
        F.max(F.struct("box", (-F.col("comp")).alias("first"), "x0", "y0", "x1", "y1")).alias("b")
    )
    found = F.col("b").isNotNull()
    return (
        sizes.select("page_id", "width", "height")
        .join(best, "page_id", "left")
        .select(
            "page_id",
            F.when(found, F.col("b.x0")).otherwise(0).alias("x1"),
            F.when(found, F.col("b.y0")).otherwise(0).alias("y1"),
            F.when(found, F.col("b.x1") + 1).otherwise(F.col("width")).alias("x2"),
            F.when(found, F.col("b.y1") + 1).otherwise(F.col("height")).alias("y2"),
            found.alias("found"),
            F.when(found, -F.col("b.first")).alias("comp"),
        )
    )
