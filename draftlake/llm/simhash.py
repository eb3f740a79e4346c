"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at distance 2r or less have a common variant within r flips of
both.  Each distinct fingerprint therefore emits its ball of radius r, the exchange is
keyed on the variants, and fingerprints that meet on a variant are linked.

The ball of radius 2 has 2081 variants.  They are emitted in two steps that give the same
set: the exchange carries the 137 prefixes (16 bits) of the ball with the fingerprint, and
the task that owns a prefix writes out the variants below it, blocked so that memory stays
bounded.  Prefixes that hold very many fingerprints are keyed on 8 further bits first.
All fingerprints that share a variant are within 2r of each other by the triangle
inequality, so linking them to the smallest of them loses no link and lists no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import Scratch, by_batch, partitions, utf8
from draftlake.llm.graph import components, forest

# ---------------------------------------------------------------- fixed values
SEED = 42
WIDTH = 4  # words in a shingle
DISTANCE = 4  # differing bits of linked fingerprints
PREFIX = 16
SUB = 8
HOT_PREFIX = 50_000  # fingerprints under one prefix from which 8 more bits enter the key
BLOCK = 2_000_000  # variants after which a task compares what it has
SPLIT = 4  # blocks from which one comparison is dealt by further bits
# ---------------------------------------------------------- end of fixed values


def _bits(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set, lowest bit first."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(part, axis=0, dtype=np.uint32)
    return ones


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """64-bit SimHash of the text's word shingles, as a signed long; no words: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        value = hashed(joined, SEED)
        return value - (value >> 63 << 64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    hashes = np.array([hashed(joined[a:b], SEED) for a, b in spans], np.dtype("<u8"))
    over = _bits(hashes) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, fp) for every row; null and empty texts have fingerprint 0."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b["doc_id"], "fp": [fingerprint(t, width) for t in b["text"]]}

    return by_batch(docs.select(F.col(id).cast("long").alias("doc_id"), utf8(text).alias("text")), run, "doc_id long, fp long")


@lru_cache(maxsize=256)
def flips(bits: int, most: int) -> np.ndarray:
    """Every mask of ``bits`` bits with at most ``most`` bits set, fewest first."""
    out, layer = [np.zeros(1, np.uint64)], [0]
    for _ in range(most):
        layer = [m | 1 << k for m in layer for k in range(m.bit_length(), bits)]
        out.append(np.array(layer, np.uint64))
    return np.concatenate(out)


def _met(variants: np.ndarray, owners: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, root) for the components that owners sharing a variant form in this block."""
    ranked = np.sort(variants)
    shared = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(shared):
        return shared, shared
    at = np.minimum(np.searchsorted(shared, variants), len(shared) - 1)
    hit = shared[at] == variants
    at, who = at[hit], owners[hit]
    order = np.lexsort((who, at))
    at, who = at[order], who[order]
    first = np.maximum.accumulate(np.where(np.r_[True, at[1:] != at[:-1]], np.arange(len(at)), 0))
    a, b = who, who[first]
    apart = (a != b) & (np.bitwise_count(a ^ b) <= distance)
    pair = np.unique(np.stack([a[apart], b[apart]]), axis=1)
    return forest(pair[0], pair[1]) if pair.shape[1] else (pair[0], pair[1])


def collide(
    owner: np.ndarray, base: np.ndarray, budget: np.ndarray, low: int, distance: int, block: int = BLOCK
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among the variants of ``base`` that flip up to ``budget`` of the ``low`` lowest bits.

    Where that is more than SPLIT blocks, the variants are dealt by their next eight bits.
    """
    masks = {b: flips(low, b) for b in np.unique(budget).tolist()}
    if sum(int((budget == b).sum()) * len(m) for b, m in masks.items()) > SPLIT * block and low >= SUB and len(owner) > 1:
        upper = np.uint64(low - SUB)
        byte = (base >> upper) & np.uint64(255)
        clear = base & ~(np.uint64(255) << upper)
        for value in range(256):
            left = budget - np.bitwise_count(byte ^ np.uint64(value)).astype(np.int64)
            on = left >= 0
            if on.sum() > 1:
                yield from collide(owner[on], clear[on] | np.uint64(value) << upper, left[on], low - SUB, distance, block)
        return
    parts = [(base[on, None] ^ m, np.repeat(owner[on], len(m))) for b, m in masks.items() if (on := budget == b).any()]
    if parts:
        a, b = _met(np.concatenate([p.ravel() for p, _ in parts]), np.concatenate([o for _, o in parts]), distance)
        if len(a):
            yield a, b


def _links_of(radius: int, distance: int, block: int):
    """Batches sorted by (prefix, sub) -> links between fingerprints."""
    weight = {b: len(flips(64 - PREFIX, b)) for b in range(radius + 1)}

    def flush(prefix: np.ndarray, sub: np.ndarray, fp: np.ndarray) -> Iterator[dict]:
        for hot in (False, True):
            on = (sub >= 0) == hot
            if on.sum() < 2:
                continue
            p, s, f = prefix[on].astype(np.uint64), sub[on], fp[on]
            key, low = p << np.uint64(64 - PREFIX), 64 - PREFIX
            if hot:
                low -= SUB
                key |= s.astype(np.uint64) << np.uint64(low)
            tail = np.uint64((1 << low) - 1)
            left = radius - np.bitwise_count((f ^ key) & ~tail).astype(np.int64)
            for a, b in collide(f, key | f & tail, left, low, distance, block):
                yield {"a": a.view(np.int64), "b": b.view(np.int64)}

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held, load, full = [], 0, block
        for b in batches:
            new = (np.asarray(b["prefix"], np.int64), np.asarray(b["sub"], np.int64), np.asarray(b["fp"], np.int64).view(np.uint64))
            held.append(new)
            near = np.bitwise_count((new[2] >> np.uint64(64 - PREFIX)) ^ new[0].astype(np.uint64))
            load += sum(int((near == radius - k).sum()) * w for k, w in weight.items())
            if load < full:
                continue
            prefix, sub, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            open_key = np.flatnonzero((prefix == prefix[-1]) & (sub == sub[-1]))[0]
            if open_key:
                yield from flush(prefix[:open_key], sub[:open_key], fp[:open_key])
                held, load, full = [(prefix[open_key:], sub[open_key:], fp[open_key:])], 0, block
            else:
                full *= 2
        if held:
            yield from flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def links(
    scratch: Scratch, distinct: DataFrame, distance: int = DISTANCE, hot_prefix: int = HOT_PREFIX, block: int = BLOCK
) -> DataFrame:
    """(a, b) pairs of fingerprints that span the components of all links within ``distance``.

    ``distinct`` has each fingerprint once (column ``fp``); ``distance`` must be even.
    """
    radius = distance // 2
    spark = distinct.sparkSession
    prefix = F.shiftrightunsigned("fp", 64 - PREFIX)
    masks = F.array(*[F.lit(int(m)).cast("long") for m in flips(PREFIX, radius)])
    balls = distinct.select("fp", F.explode(F.transform(masks, lambda m: prefix.bitwiseXOR(m))).alias("prefix"))
    # At most 2**16 prefixes exist, which bounds what comes to the driver.
    crowded = distinct.groupBy(prefix.alias("prefix")).count().where(F.col("count") > hot_prefix)
    hot = [r[0] for r in crowded.select("prefix").collect()]
    keyed = balls.withColumn("sub", F.lit(-1).cast("long"))
    if hot:
        few = F.broadcast(spark.createDataFrame([(p, True) for p in hot], "prefix long, hot boolean"))
        byte = F.shiftrightunsigned("fp", 64 - PREFIX - SUB).bitwiseAND(255)
        spent = F.bit_count(F.col("prefix").bitwiseXOR(prefix))
        sub_masks = F.array(*[F.lit(int(m)).cast("long") for m in flips(SUB, radius)])
        fitting = F.filter(sub_masks, lambda m: F.bit_count(m) + spent <= radius)
        subs = F.when(F.col("hot"), F.transform(fitting, lambda m: byte.bitwiseXOR(m))).otherwise(F.array(F.lit(-1).cast("long")))
        keyed = balls.join(few, "prefix", "left").select("fp", "prefix", F.explode(subs).alias("sub"))
    dealt = keyed.repartition(partitions(spark), "prefix", "sub").sortWithinPartitions("prefix", "sub")
    return by_batch(dealt, _links_of(radius, distance, block), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    distance: int = DISTANCE,
    hot_prefix: int = HOT_PREFIX,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over fingerprints that differ in ``distance``
    bits or fewer, its own included.  Null and empty texts have fingerprint zero and link
    like any other.  Repeated rows stay as they are.  A row without id keeps its row; it
    never names a component, and one whose fingerprint no row with an id has gets null.
    Extra columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.keep("prints", fingerprints(docs, id, text))
    first = scratch.keep("first", prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = scratch.keep("found", links(scratch, first.select("fp"), distance, hot_prefix, block).distinct())
    # Label by fingerprint, then take the smallest id of each component.
    labels = components(scratch, found)
    rooted = first.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.select("fp", "first", F.coalesce("label", "fp").alias("root"))
    lowest = rooted.join(labels.select(F.col("label").alias("root")).distinct(), "root", "left_semi")
    lowest = lowest.groupBy("root").agg(F.min("first").alias("lowest"))
    classes = rooted.join(lowest, "root", "left").select("fp", F.coalesce("lowest", "first").alias("component_id"))
    classes = scratch.keep("classes", classes)
    scratch.drop("found", "first")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(classes, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")
