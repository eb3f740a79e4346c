"""Exact duplicates by composable polynomial fingerprints.

A text is cut into chunks.  Chunks are hashed on their own (two polynomials over 31-bit
primes) and combined by length-shifted arithmetic, ``H(xy) = H(x) * B**len(y) + H(y)``,
so a huge document is hashed by many tasks.  Rows with equal fingerprint and length are
then compared chunk by chunk with the row that would stay; what differs is grouped anew
until every group is proven equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import SPACE, Scratch, by_batch, partitions

# ---------------------------------------------------------------- fixed values
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1299709001)
CHUNK = 1 << 16  # bytes that are hashed or compared at a time
HUGE = 1 << 20  # bytes from which a document's chunks are dealt to several tasks
BLOCK = 256
SALT_ROWS = 512  # copies that share one copy of the row they are compared with
# ---------------------------------------------------------- end of fixed values


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"{SPACE}+", " ")


class Polynomial:
    """Fingerprints of byte strings modulo two primes; ``bits`` < 31 weakens them for tests."""

    def __init__(self, bits: int = 31) -> None:
        self.primes = PRIMES if bits >= 31 else ((1 << bits) - 1, (1 << bits) - 1)
        powers = [[pow(b, BLOCK - 1 - k, p) for k in range(BLOCK)] for b, p in zip(BASES, self.primes, strict=True)]
        self.within = np.array(powers, np.float64).T  # exact: 256 * 255 * 2**31 < 2**53
        self.step = [pow(b, BLOCK, p) for b, p in zip(BASES, self.primes, strict=True)]
        self.blocks = [self._powers(s, p, CHUNK // BLOCK) for s, p in zip(self.step, self.primes, strict=True)]

    @staticmethod
    def _powers(step: int, prime: int, count: int) -> np.ndarray:
        return np.array([pow(step, count - 1 - k, prime) for k in range(count)], np.uint64)

    def chunk(self, data: bytes) -> list[int]:
        """Hash of at most CHUNK bytes."""
        pad = -len(data) % BLOCK  # zeros ahead of the text do not change the value
        cells = np.frombuffer(b"\0" * pad + data, np.uint8).reshape(-1, BLOCK).astype(np.float64) @ self.within
        out = []
        for k, p in enumerate(self.primes):
            rows = cells[:, k].astype(np.uint64) % np.uint64(p)
            out.append(int((rows * self.blocks[k][len(self.blocks[k]) - len(rows) :] % np.uint64(p)).sum()) % p)
        return out

    def shift(self, value: list[int], length: int) -> list[int]:
        """``value`` as it counts ahead of ``length`` further bytes."""
        return [v * pow(b, length, p) % p for v, b, p in zip(value, BASES, self.primes, strict=True)]

    def whole(self, data: bytes) -> list[int]:
        value = [0, 0]
        for at in range(0, len(data), CHUNK):
            part = data[at : at + CHUNK]
            value = [(x + y) % p for x, y, p in zip(self.shift(value, len(part)), self.chunk(part), self.primes, strict=True)]
        return value


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", bits: int = 31, huge: int = HUGE) -> DataFrame:
    """(doc_id, n_bytes, f1, f2, text_sha256) of every row's normalised text."""
    long_text = F.coalesce(F.octet_length(F.col(text)), F.lit(0)) > huge

    def clean(rows: DataFrame) -> DataFrame:
        norm = rows.select(F.col(id).cast("long").alias("doc_id"), normalised(text).cast("binary").alias("norm"))
        size = F.octet_length("norm").cast("long")
        return norm.select("doc_id", "norm", F.sha2("norm", 256).alias("text_sha256"), size.alias("n_bytes"))

    def in_place(batches: Iterator[dict]) -> Iterator[dict]:
        poly = Polynomial(bits)
        for b in batches:
            values = [poly.whole(t) for t in b["norm"]]
            yield b | {"f1": [v[0] for v in values], "f2": [v[1] for v in values]}

    def shifted(batches: Iterator[dict]) -> Iterator[dict]:
        poly = Polynomial(bits)
        for b in batches:
            values = [poly.shift(poly.chunk(t), int(after)) for t, after in zip(b["part"], b["after"], strict=True)]
            yield b | {"f1": [v[0] for v in values], "f2": [v[1] for v in values]}

    columns = "doc_id long, n_bytes long, f1 long, f2 long, text_sha256 string"
    small = by_batch(clean(docs.where(~long_text)), in_place, columns)
    # Chunks of a huge text go to many tasks; their shifted values simply add up.
    large = clean(docs.where(long_text)).withColumn("row", F.monotonically_increasing_id())
    number = F.explode(F.sequence(F.lit(0), ((F.col("n_bytes") - 1) / CHUNK).cast("int"))).alias("no")
    about = ["row", "doc_id", "n_bytes", "text_sha256"]
    cut = large.select(*about, "norm", number).select(
        *about,
        "no",
        F.substring("norm", F.col("no") * CHUNK + 1, F.lit(CHUNK)).alias("part"),
        F.greatest(F.lit(0), F.col("n_bytes") - (F.col("no") + 1) * CHUNK).alias("after"),
    )
    spread = cut.repartition(partitions(docs.sparkSession), "row", "no").drop("no")
    parts = by_batch(spread, shifted, f"row long, {columns}").groupBy("row")
    whole = parts.agg(
        *[F.first(c).alias(c) for c in about[1:]],
        *[(F.sum(f"f{k + 1}") % F.lit(p).cast("long")).alias(f"f{k + 1}") for k, p in enumerate(Polynomial(bits).primes)],
    )
    return small.unionByName(whole.drop("row"))


def _unequal(docs: DataFrame, pairs: DataFrame, id: str, text: str) -> DataFrame:
    """Of (doc_id, keep_id, size, key...), the rows whose texts differ in some chunk.

    Chunks meet on (keep_id, salt, chunk number).  A row that very many rows are compared
    with is sent once for every SALT_ROWS of them, so no key gathers a large group.
    """
    clean = docs.select(F.col(id).cast("long").alias("doc_id"), normalised(text).cast("binary").alias("norm"))
    count = F.ceil((F.octet_length("norm") + 1) / CHUNK).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda k: F.struct(k.alias("no"), F.substring(F.col("norm"), k * CHUNK + 1, F.lit(CHUNK)).alias("part")),
    )
    salts = F.ceil(F.col("size") / SALT_ROWS).cast("long")
    asked = pairs.where(F.col("doc_id") != F.col("keep_id"))
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts)).select("doc_id", "keep_id", "salt", *KEY)
    stay = pairs.where(F.col("doc_id") == F.col("keep_id")).select(
        "doc_id", F.col("keep_id"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), *KEY
    )
    wanted = asked.withColumn("role", F.lit(1)).unionByName(stay.withColumn("role", F.lit(0)))
    # The rows asked for grow with the table, so this join is a merge join at every size.
    parts = (
        clean.join(wanted.hint("merge"), "doc_id")
        .where(F.octet_length("norm") == F.col("n_bytes"))
        .select("doc_id", "keep_id", "salt", "role", *KEY, F.explode(pieces).alias("piece"))
        .select("doc_id", "keep_id", "salt", "role", *KEY, F.col("piece.no").alias("no"), F.col("piece.part").alias("part"))
    )
    meet = ["keep_id", "salt", "no", *KEY]
    # An id that stands on several rows offers each of its texts once.
    left = parts.where("role = 1").select("doc_id", *meet, "part")
    right = parts.where("role = 0").select(*meet, F.col("part").alias("stays")).distinct()
    same = left.join(right, meet, "left").groupBy("doc_id", "keep_id", *KEY, "no")
    same = same.agg(F.max(F.coalesce(F.col("part") == F.col("stays"), F.lit(False))).alias("same"))
    return same.where(~F.col("same")).select("doc_id", "keep_id", *KEY).distinct()


KEY = ["f1", "f2", "n_bytes"]


def exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", bits: int = 31, huge: int = HUGE) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal after runs of spaces and control spaces become one space; null counts
    as empty.  The smallest id of equal texts stays.  group_size counts rows, repeated ones
    included; a row that repeats the kept id and text is marked kept too.  Rows without id
    are counted, never chosen, and ``kept`` is null for them; where only such rows share a
    text keep_id is null.  Ids that stand on several rows with different texts are grouped
    row by row.  Extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.keep("prints", fingerprints(docs, id, text, bits, huge))
    groups = prints.groupBy(*KEY).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("size"))
    groups = scratch.keep("groups", groups)
    several = groups.where((F.col("size") > 1) & F.col("keep_id").isNotNull())
    open_pairs = prints.where(F.col("doc_id").isNotNull()).select("doc_id", *KEY).distinct().join(several, KEY)
    open_pairs = scratch.keep("pairs-0", open_pairs)
    moved, turn = [], 0
    while True:
        differ = scratch.keep(f"differ-{turn}", _unequal(docs, open_pairs, id, text))
        if differ.isEmpty():
            break
        # Same fingerprint, other text: choose the smallest of those that differ and go on.
        chosen = differ.groupBy("keep_id", *KEY).agg(F.min("doc_id").alias("next"), F.count("*").alias("size"))
        again = differ.join(chosen, ["keep_id", *KEY]).drop("keep_id").withColumnRenamed("next", "keep_id")
        open_pairs = scratch.keep(f"pairs-{turn + 1}", again)
        moved.append(open_pairs.select("doc_id", *KEY, F.col("keep_id").alias("moved_to"), F.lit(turn).alias("turn")))
        turn += 1
    if not moved:
        out = prints.join(groups.withColumnRenamed("size", "group_size"), KEY)
    else:
        final = moved[0]
        for m in moved[1:]:
            final = final.unionByName(m)
        final = final.groupBy("doc_id", *KEY).agg(F.max_by("moved_to", "turn").alias("moved_to"))
        out = prints.join(groups.drop("size"), KEY).join(final, ["doc_id", *KEY], "left")
        out = scratch.keep("placed", out.withColumn("keep_id", F.coalesce("moved_to", "keep_id")))
        sizes = out.groupBy("keep_id", *KEY).agg(F.count("*").alias("group_size"))
        out = out.join(sizes, (out["keep_id"].eqNullSafe(sizes["keep_id"])) & (out["f1"] == sizes["f1"]) & (out["f2"] == sizes["f2"]) & (out["n_bytes"] == sizes["n_bytes"])).select(
            out["doc_id"], out["keep_id"], "group_size", "text_sha256"
        )
    kept = F.col("doc_id") == F.col("keep_id")
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
