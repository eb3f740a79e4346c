"""Mixing sources to target weights by pivotal dependent rounding.

Every document has a fractional number of copies, its source's target divided by the
source's size.  The whole part is taken as it is.  The fractions are rounded in pairs: mass
moves between two documents, at random and without bias, until one of them is whole, and
the other goes on to the next pair.  Mass is counted in words, so each step keeps the
source's word total; only the last document of a source is rounded on its own.

Pairs are made inside (source, leaf) groups, where a leaf is a range of a hash of doc_id.
Each group leaves one fractional document at most, and those are combined up a tree of
FAN leaves to a node until one is left per source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import Scratch, by_batch, utf8, word_count
from draftlake.operators.ordered import running

# ---------------------------------------------------------------- fixed values
WEIGHTS = (3, 1, 2)  # by rank of the source name, repeating
SHARE = 1.5  # of all sizes
MOST = 2  # times a document's size
SEED = 20_261
LEAF_ROWS = 256
FAN = 64
FEW_SOURCES = 100_000  # rows of the source table up to which it is broadcast
# ---------------------------------------------------------- end of fixed values

UNIT = "source string, leaf long, rank long, key string, doc_id long, size long, source_size long, target double, base long, part double"


def sizes(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", key: str | None = None) -> DataFrame:
    """(key, doc_id, source, size): size counts the words of the whole text, null has none."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {n: b[n] for n in ("key", "doc_id", "source")} | {"size": [word_count(t) for t in b["text"]]}

    own = (F.lit(None) if key is None else F.col(key)).cast("string").alias("key")
    rows = docs.select(own, F.col(id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), utf8(text).alias("text"))
    return by_batch(rows, run, "key string, doc_id long, source string, size long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) by filling up to the cap.

    Targets are in proportion to the weights, but ``most`` times a source's size at most;
    what is cut there is shared among the others until none is above.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    keyed = totals.select("*", F.lit(0).alias("all"), F.col("source").isNull().cast("int").alias("last"), F.coalesce("source", F.lit("")).alias("name"))
    ranked = running(keyed, ["all"], ["last", "name"], {"place": F.lit(1)})
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked.select("source", "source_size", "n_docs", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")).alias("weight"))
    weighed = Scratch(sized.sparkSession).keep("weighed", weighed)
    cap = F.col("source_size") * F.lit(float(most))
    whole = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, level, full = share * (whole[0] or 0), share * (whole[0] or 0) / (whole[1] or 1), -1
    while True:
        over = cap <= F.lit(level) * F.col("weight")
        row = weighed.agg(
            F.count(F.when(over, 1)), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))
        ).first()
        if row[0] == full or not row[2]:
            break
        full, level = row[0], (budget - (row[1] or 0.0)) / row[2]
    return weighed.select("source", "source_size", "n_docs", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


def _chance(a: int, b: int) -> float:
    """Reproducible uniform number for a pair of documents."""
    return xxhash.xxh64_intdigest(f"{a},{b}", SEED) / 2.0**64


def transfer(p: float, w: int, q: float, v: int, chance: float) -> tuple[float, float]:
    """Move mass between two fractions of weights w and v until one is 0 or 1.

    ``w * p + v * q`` stays and so do the expected values of both.
    """
    up, down = min(w * (1 - p), v * q), min(w * p, v * (1 - q))
    if chance * (up + down) < down:
        # The first gains: it becomes whole or the second becomes empty.
        return (1.0, q - w * (1 - p) / v) if w * (1 - p) <= v * q else (p + v * q / w, 0.0)
    return (0.0, q + w * p / v) if w * p <= v * (1 - q) else (p - v * (1 - q) / w, 1.0)


def _whole(x: float) -> bool:
    return x <= 1e-12 or x >= 1 - 1e-12


def _round_groups(batches: Iterator[dict]) -> Iterator[dict]:
    """Rows sorted by (source, leaf, rank): all come out, one per group still fractional."""
    names = [f.split()[0] for f in UNIT.split(", ")]
    place = {n: k for k, n in enumerate(names)}
    part, size, rank = place["part"], place["size"], place["rank"]
    group, held = None, None
    for b in batches:
        out = []
        columns = [b[n].tolist() if isinstance(b[n], np.ndarray) else b[n] for n in names]
        for row in map(list, zip(*columns, strict=True)):
            if (row[0], row[1]) != group:
                if held is not None:
                    out.append(held)
                group, held = (row[0], row[1]), None
            if _whole(row[part]):
                out.append(row)
            elif held is None:
                held = row
            else:
                p, q = transfer(held[part], held[size], row[part], row[size], _chance(held[rank], row[rank]))
                held[part], row[part] = p, q
                for r in (held, row):
                    if _whole(r[part]):
                        out.append(r)
                held = next((r for r in (held, row) if not _whole(r[part])), None)
        if out:
            yield {n: [r[k] for r in out] for n, k in place.items()}
    if held is not None:
        yield {n: [held[k]] for n, k in place.items()}


def mix(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    leaf_rows: int = LEAF_ROWS,
    fan: int = FAN,
    key: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: key, doc_id, source, size, source_size, target, copies, taken.

    ``copies`` (0 to ``most``) is how often the mix takes the document, ``taken`` its words.
    A source's taken words differ from its target by less than its largest document.  The
    choice depends on the rows only, not on how they are partitioned.  Null texts and texts
    without words have size 0 and are not taken; a null source is a source of its own and
    ranks last; repeated rows are rounded one by one; rows without id are treated alike.
    ``key`` names a column that tells rows apart better than the id; it then leads the
    random choice and comes back with each row.
    An empty table gives an empty result; extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    sized = scratch.keep("sizes", sizes(docs, id, text, source, key))
    targets = scratch.keep("targets", source_targets(sized, weights, share, most))
    facts = targets.agg(F.count("*"), F.sum("n_docs")).first()
    leaves = 1 << max(0, math.ceil(math.log2(max(1, (facts[1] or 0) / leaf_rows))))
    side = F.broadcast(targets) if facts[0] <= FEW_SOURCES else targets
    per_source = sized.join(side, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    copies = F.least(F.lit(float(most)), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    # Near-whole numbers of copies (a target at the cap) have no fraction to round.
    base = F.floor(copies + F.lit(1e-9))
    part = F.when(F.col("size") > 0, F.greatest(F.lit(0.0), copies - base)).otherwise(F.lit(0.0))
    rank = F.xxhash64("doc_id" if key is None else "key", F.lit(SEED))
    units = per_source.select(
        "source",
        F.shiftrightunsigned(rank, 32).cast("long").alias("leaf"),
        rank.alias("rank"),
        "key",
        "doc_id",
        "size",
        "source_size",
        "target",
        base.cast("long").alias("base"),
        part.cast("double").alias("part"),
    ).withColumn("leaf", F.floor(F.col("leaf") * F.lit(leaves) / F.lit(1 << 32)).cast("long"))
    level, settled = 0, []
    open_part = (F.col("part") > 1e-12) & (F.col("part") < 1 - 1e-12)
    while True:
        # Without a number, so that the few rows of the upper levels come to few tasks and files.
        dealt = units.repartition("source", "leaf").sortWithinPartitions("source", "leaf", "rank", "doc_id", "size")
        done = scratch.keep(f"level-{level}", by_batch(dealt, _round_groups, UNIT))
        if leaves == 1:
            break
        settled.append(done.where(~open_part))
        leaves = math.ceil(leaves / fan)
        units = done.where(open_part).withColumn("leaf", F.floor(F.col("leaf") / fan).cast("long"))
        level += 1
    # One fractional document per source at most is left; it is rounded alone.
    alone = F.pmod(F.xxhash64("rank", F.lit(SEED + 1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = done.withColumn("part", F.when(open_part, (alone < F.col("part")).cast("double")).otherwise(F.col("part")))
    for s in settled:
        out = out.unionByName(s)
    copies = (F.col("base") + F.round("part").cast("long")).alias("copies")
    return out.select("key", "doc_id", "source", "size", "source_size", "target", copies, (copies * F.col("size")).alias("taken"))
