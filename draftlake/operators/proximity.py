"""Neighbours of every position on a page, crowded places included.

Positions are filed in squares a little wider than the tolerance, so neighbours lie in the 3 x 3
squares about a position, and travel once in blocks of 32 x 32 squares with a rim of one; a
task looks all positions of its blocks up at once, as arrays.

Around squares that hold too many positions, they are filed in quadtree cells that are refined until each holds a bounded number of
them.  Two cells are compared by their boxes first: cells too far apart are dropped, a cell
that lies in reach as a whole and cannot hold the closest position adds its count, and only
the others meet position by position, as arrays inside a task.  No pair of positions is
ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.operators.grid import offsets, spread
from draftlake.operators.vector import ENDPOINT_TOLERANCE_PX
from draftlake.session import settle

# ---------------------------------------------------------------- fixed values
LEAF = 256  # positions of a cell
TOP = 32  # sides of a cell at the first level, in tolerances
LEVELS = 24  # halvings of a cell's side; what is still crowded then is dealt by hash
SQUARE = 1.0001  # side of a square, in tolerances; above 1, so rounding moves no neighbour two squares away
BLOCK = 5  # a block's side in squares, as a power of two
MEETINGS = 1 << 21  # candidates measured together
# ---------------------------------------------------------- end of fixed values

SPOT = ["page_id", "x", "y"]
CELL = ["page_id", "level", "cx", "cy", "part"]
BLOCKS = ["page_id", "hx", "hy"]


def leaves(spots: DataFrame, tol: float, limit: int = LEAF, levels: int = LEVELS) -> DataFrame:
    """``spots`` with the quadtree cell of each: level, cx, cy, part; cells hold ``limit`` spots or so.

    Only spots of crowded cells go on to the next level, so a page without crowds takes one round.
    """
    open_spots, out, level = spots, None, 0
    while True:
        side = TOP * tol / 2**level
        filed = open_spots.withColumns({"level": F.lit(level), "cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side), "part": F.lit(0)})
        key = ["page_id", "cx", "cy"]
        crowded = settle(filed.groupBy(*key).agg(F.count("*").alias("held")).where(F.col("held") > limit))
        if crowded.isEmpty():
            return filed if out is None else out.unionByName(filed)
        if level == levels:
            many = F.coalesce(F.ceil(F.col("held") / limit), F.lit(1))
            dealt = filed.join(crowded, key, "left").withColumn("part", F.pmod(F.xxhash64("x", "y"), many).cast("int")).drop("held")
            return dealt if out is None else out.unionByName(dealt)
        calm = filed.join(crowded, key, "left_anti").select(*filed.columns)
        out = calm if out is None else out.unionByName(calm)
        open_spots = settle(filed.join(crowded, key, "left_semi").select(*spots.columns))
        level += 1


def _boxes(filed: DataFrame, tol: float) -> DataFrame:
    """One row per cell: its box, its positions as arrays, and the cell of the first level it lies in."""
    cells = filed.groupBy(*CELL).agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.collect_list(F.struct("x", "y")).alias("held")
    )
    home = lambda c: F.floor(F.col(c) / (TOP * tol))
    return settle(cells.withColumns({"id": F.concat_ws(":", *[c for c in CELL if c != "page_id"], "page_id"), "hx": home("x0"), "hy": home("y0")}))


def _met(v: dict[str, np.ndarray], tol: float) -> pd.DataFrame:
    """Neighbours of the positions marked ``mine`` among all of their block; blocks are stretches of the arrays."""
    change = np.zeros(len(v["x"]), np.int64)
    for c in BLOCKS:
        change[1:] |= v[c][1:] != v[c][:-1]
    side = (1 << BLOCK) + 4
    row, column = (v[f] - (v[h] << BLOCK) + 1 for f, h in (("fy", "hy"), ("fx", "hx")))
    key = (np.cumsum(change) * side + row) * side + column
    order = np.lexsort((v["y"], v["x"], key))
    key, x, y = key[order], v["x"][order], v["y"][order]
    own = np.flatnonzero(v["mine"][order])
    # A position's squares are three stretches of the order, one per row of squares.
    low = np.stack([np.searchsorted(key, key[own] + side * d - 1, "left") for d in (-1, 0, 1)], 1)
    size = np.stack([np.searchsorted(key, key[own] + side * d + 1, "right") for d in (-1, 0, 1)], 1) - low
    near, best = np.zeros(len(own), np.int64), np.full((3, len(own)), np.nan)
    ends, at = np.cumsum(size.sum(axis=1)), 0
    while at < len(own):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + MEETINGS, "right")))
        count = size[at:stop].ravel()
        a = np.repeat(np.repeat(np.arange(at, stop), 3), count)
        b = np.arange(len(a)) + np.repeat(low[at:stop].ravel() - (np.cumsum(count) - count), count)
        dx, dy = x[b] - x[own[a]], y[b] - y[own[a]]
        d2 = dx * dx + dy * dy
        kept = np.flatnonzero((d2 <= tol * tol) & ((dx != 0) | (dy != 0)))
        a, b, d2 = a[kept], b[kept], d2[kept]
        near[at:stop] = np.bincount(a - at, minlength=stop - at)
        closest = np.lexsort((y[b], x[b], d2, a))
        closest = closest[np.flatnonzero(np.r_[True, a[closest][1:] != a[closest][:-1]][: len(a)])]
        best[:, a[closest]] = x[b[closest]], y[b[closest]], d2[closest]
        at = stop
    return pd.DataFrame(
        {"page_id": v["page_id"][order][own], "x": x[own], "y": y[own], "n": v["n"][order][own], "neighbours": near, "near_x": best[0], "near_y": best[1], "d2": best[2]}
    )


def _calm_spots(filed: DataFrame, tol: float) -> DataFrame:
    """``near_spots`` of the positions marked ``own`` among ``filed``, whose squares hold few positions."""
    about = lambda c: F.array_distinct(F.array(*[F.shiftright(F.col(c) + d, BLOCK) for d in (-1, 0, 1)]))
    rows = filed.where(F.col("page_id").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    rows = rows.withColumn("hx", F.explode(about("fx"))).withColumn("hy", F.explode(about("fy")))
    home = (F.col("hx") == F.shiftright("fx", BLOCK)) & (F.col("hy") == F.shiftright("fy", BLOCK))
    rows = rows.withColumn("mine", F.col("own") & home).drop("own")
    columns = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict[str, np.ndarray]] = []  # pieces of the block that may go on
        for pdf in batches:
            if not len(pdf):
                continue
            v = {c: pdf[c].to_numpy() for c in columns}
            # Whole blocks end where the batch's last one begins.
            last = len(pdf) - 1
            same = np.logical_and.reduce([v[c] == v[c][last] for c in BLOCKS])
            cut = int(np.argmax(same))
            goes_on = cut == 0 and (not held or all(held[-1][c][-1] == v[c][0] for c in BLOCKS))
            if not goes_on:
                held.append({c: w[:cut] for c, w in v.items()})
                yield _met({c: np.concatenate([h[c] for h in held]) for c in columns}, tol)
                held = []
            held.append({c: w[cut:] for c, w in v.items()})
        if held:
            yield _met({c: np.concatenate([h[c] for h in held]) for c in columns}, tol)

    dealt = rows.repartition(*[F.col(c) for c in BLOCKS]).sortWithinPartitions(*BLOCKS)
    found = dealt.mapInPandas(run, "page_id string, x double, y double, n long, neighbours long, near_x double, near_y double, d2 double")
    return found.withColumn("dist", F.sqrt("d2")).drop("d2")


def near_spots(points: DataFrame, tol: float = ENDPOINT_TOLERANCE_PX, limit: int = LEAF, levels: int = LEVELS) -> DataFrame:
    """Every distinct position: page_id, x, y, n, neighbours, near_x, near_y, dist.

    ``n`` counts the points there, ``neighbours`` the other positions at most ``tol`` away and
    the rest is the closest of them (the smallest by x and y of equals; null if there is none).
    Positions without page, x or y are left out.
    """
    spots = settle(points.groupBy(*SPOT).agg(F.count("*").alias("n")))
    place = lambda c: F.floor(F.col(c) / F.lit(float(SQUARE * tol)))
    filed = spots.withColumns({"fx": place("x"), "fy": place("y")})
    square = ["page_id", "fx", "fy"]
    crowds = settle(filed.groupBy(*square).agg(F.count("*").alias("held")).where(F.col("held") > limit).drop("held"))
    if crowds.isEmpty():
        return _calm_spots(filed.withColumn("own", F.lit(True)), tol)
    # Positions next to a crowd may see it; what they can see lies two squares away from one at most.
    beside, around = (settle(spread(crowds, "fx", "fy", reach).distinct()) for reach in (1, 2))
    calm = filed.join(crowds, square, "left_anti").join(beside.withColumn("seen", F.lit(True)), square, "left")
    calm = calm.withColumn("own", F.col("seen").isNull()).drop("seen")
    crowded = _crowded_spots(filed.join(around, square, "left_semi").select(*spots.columns), tol, limit, levels)
    crowded = crowded.join(filed.join(beside, square, "left_semi").select(*SPOT), SPOT, "left_semi")
    return _calm_spots(calm, tol).unionByName(crowded)


def _crowded_spots(spots: DataFrame, tol: float, limit: int, levels: int) -> DataFrame:
    """``near_spots`` of counted positions, however many lie together."""
    spots = settle(spots)
    cells = _boxes(leaves(spots.select(*SPOT), tol, limit, levels), tol)
    box = ["x0", "x1", "y0", "y1"]
    plain = cells.select("page_id", "id", "hx", "hy", *box, F.size("held").alias("size"))
    one = plain.select("page_id", *[F.col(c).alias(f"a_{c}") for c in plain.columns[1:]], F.explode(offsets(1)).alias("s"))
    one = one.withColumns({"hx": F.col("a_hx") + F.col("s.dx"), "hy": F.col("a_hy") + F.col("s.dy")}).drop("s", "a_hx", "a_hy")
    other = plain.select("page_id", "hx", "hy", F.col("id").alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in [*box, "size"]])
    met = one.join(other, ["page_id", "hx", "hy"])
    apart = lambda c: F.greatest(F.lit(0.0), F.col(f"b_{c}0") - F.col(f"a_{c}1"), F.col(f"a_{c}0") - F.col(f"b_{c}1"))
    reach = lambda c: F.greatest(F.col(f"b_{c}1") - F.col(f"a_{c}0"), F.col(f"a_{c}1") - F.col(f"b_{c}0"))
    square = lambda a, b: a * a + b * b
    wide = square(F.col("a_x1") - F.col("a_x0"), F.col("a_y1") - F.col("a_y0"))
    near, far = square(apart("x"), apart("y")), square(reach("x"), reach("y"))
    # A cell of several positions has a closer one of its own than any beyond its diagonal.
    whole = (far <= tol * tol) & (near > wide) & (F.col("a_size") > 1)
    met = settle(met.where(near <= tol * tol).select("a_id", "b_id", "b_size", whole.alias("whole")))
    added = met.where("whole").groupBy("a_id").agg(F.sum("b_size").alias("more"))
    side = lambda k: cells.select(F.col("id").alias(f"{k}_id"), F.col("held.x").alias(f"{k}x"), F.col("held.y").alias(f"{k}y"), *(["page_id"] if k == "a" else []))
    pairs = met.where("NOT whole").select("a_id", "b_id").join(side("b"), "b_id").join(side("a"), "a_id")
    count = int(spots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(count, "a_id").sortWithinPartitions("a_id").select("a_id", "ax", "ay", "bx", "by", "page_id")

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, held = None, None

        def rows() -> pd.DataFrame:
            page, x, y, near, best, bx, by = held
            none = np.isinf(best)
            return pd.DataFrame(
                {"page_id": page, "x": x, "y": y, "near": near, "near_x": np.where(none, np.nan, bx), "near_y": np.where(none, np.nan, by), "d2": np.where(none, np.nan, best)}
            )

        for pdf in batches:
            for own, ax, ay, bx, by, page in pdf.itertuples(index=False):
                if own != name:
                    if held is not None:
                        yield rows()
                    name, held = own, [page, ax, ay, np.zeros(len(ax), np.int64), *(np.full(len(ax), np.inf) for _ in range(3))]
                order = np.lexsort((by, bx))
                bx, by = bx[order], by[order]
                dx, dy = bx[None, :] - ax[:, None], by[None, :] - ay[:, None]
                d2 = dx * dx + dy * dy
                self = (dx == 0) & (dy == 0)
                held[3] += ((d2 <= tol * tol) & ~self).sum(axis=1)
                d2[self | (d2 > tol * tol)] = np.inf
                at = d2.argmin(axis=1)
                found = d2[np.arange(len(ax)), at]
                better = (found < held[4]) | ((found == held[4]) & np.isfinite(found) & ((bx[at] < held[5]) | ((bx[at] == held[5]) & (by[at] < held[6]))))
                for k, v in ((4, found), (5, bx[at]), (6, by[at])):
                    held[k] = np.where(better, v, held[k])
        if held is not None:
            yield rows()

    found = pairs.mapInPandas(measured, "page_id string, x double, y double, near long, near_x double, near_y double, d2 double")
    extra = cells.join(added, F.col("id") == F.col("a_id")).select("page_id", F.inline("held"), "more")
    null = F.lit(None).cast("double")
    return (
        spots.join(found, SPOT)
        .join(extra, SPOT, "left")
        .select(
            *SPOT,
            "n",
            (F.col("near") + F.coalesce("more", F.lit(0))).alias("neighbours"),
            F.nanvl("near_x", null).alias("near_x"),
            F.nanvl("near_y", null).alias("near_y"),
            F.sqrt(F.nanvl("d2", null)).alias("dist"),
        )
    )
