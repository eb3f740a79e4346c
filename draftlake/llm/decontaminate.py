"""Benchmark decontamination by spaced seeds.

A mask selects some positions of a window of words and ignores the others, so a seed still
matches when a word at an ignored position was substituted.  Both tables are hashed in
tasks, equal seeds are joined, and around each hit the document is laid over the item and
the overlap is verified word by word, substitutions allowed.  Texts are known by their
digest, so copies are searched once.

Two filters of a fixed size (one bit per hash prefix) go to every task: seeds of the
benchmark, so that other seeds of documents are never rows, and blocks of words that a
candidate needs.  Both only save rows; the joins behind them decide.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import Scratch, by_batch, keep_rows, utf8

# ---------------------------------------------------------------- fixed values
# Every stretch of ten equal words or more with 80 % equal has one of these seeds.
MASKS = ("111111", "11101011", "11100100011", "1101000111")
# Items of few words: all words up to four, then equal words in a row.
SHORT = {n: "1" * n for n in range(1, 5)} | {5: "11"} | dict.fromkeys(range(6, 13), "111")
MIN_MATCH = 10  # equal words of an overlap; shorter items: SHARE of their words
SHARE = 0.8  # equal words among those of an overlap
MISMATCH = 4  # equal words that make up for another one at that share
FILTER_BITS = 26  # a filter is 8 MB whatever the tables hold
CHUNK_BITS = 16
BLOCK = 256  # words of a document compared at a time
SALTS = 16  # parts of a seed that very many documents share
PUNCTUATION = b".,;:!?\"'()[]"
CACHE = 500_000
HASH_SEED = 42  # of the engine's own xxhash64
# ---------------------------------------------------------- end of fixed values


class WordHash(dict):
    """64-bit hashes of words without case (A-Z) and outer punctuation; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.lower().strip(PUNCTUATION) or word)
        return value

    def of(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the selected words at every place where the mask fits."""
    places = len(words) - len(mask) + 1
    if places <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(places, xxhash.xxh64_intdigest(mask), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out += words[k : k + places] * np.uint64(xxhash.xxh64_intdigest(f"{mask}{k}") | 1)
    out ^= out >> np.uint64(29)
    return out * np.uint64(0x9E3779B97F4A7C15)


def masks_of(n: int) -> tuple[str, ...]:
    """Masks of an item of ``n`` words."""
    return () if n == 0 else (SHORT[n],) if n in SHORT else MASKS


def least_equal(n: int) -> int:
    """Equal words that an overlap with an item of ``n`` words needs."""
    return min(MIN_MATCH, math.ceil(SHARE * n))


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, length, equal words) of the stretch with most equal words, SHARE of it or more.

    An equal word counts 1 and another one -4, so a stretch qualifies if its sum is not
    negative.  For every start the last end that qualifies follows from the largest sum
    behind it.
    """
    if not equal.any():
        return 0, 0, 0
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -MISMATCH))])
    behind = np.maximum.accumulate(total[::-1])  # largest sum from the k-th last place on
    ends = len(total) - 1 - np.searchsorted(behind, total, "left")
    count = np.concatenate([[0], np.cumsum(equal)])
    start = int(np.argmax(count[ends] - count))
    own = np.flatnonzero(equal[start : ends[start]]) + start
    return int(own[0]), int(own[-1] - own[0] + 1), len(own)


# ---------------------------------------------------------------- filters of a fixed size
def _filter(hashes: DataFrame) -> Callable[[], np.ndarray]:
    """Bits of the hash prefixes in column ``h``, packed in tasks and shared with all tasks."""
    low = (1 << CHUNK_BITS) - 1
    slot = hashes.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).alias("slot")).distinct()
    chunks = slot.groupBy(F.shiftright("slot", CHUNK_BITS).alias("chunk")).agg(
        F.collect_list(F.col("slot").bitwiseAND(F.lit(low))).alias("slots")
    )

    def pack(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out = []
            for slots in b["slots"]:
                bits = np.zeros(1 << CHUNK_BITS, np.uint8)
                bits[slots] = 1
                out.append(np.packbits(bits, bitorder="little").tobytes())
            yield {"chunk": b["chunk"], "bits": out}

    table = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    width = 1 << (CHUNK_BITS - 3)
    for chunk, bits in by_batch(chunks, pack, "chunk long, bits binary").collect():
        table[chunk * width : (chunk + 1) * width] = np.frombuffer(bits, np.uint8)
    shared = hashes.sparkSession.sparkContext.broadcast(table)
    return lambda: shared.value


def _has(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - FILTER_BITS)
    return (table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


# ---------------------------------------------------------------- seeds and their join
def _keyed(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.md5(utf8(text)).alias("key"), utf8(text).alias("text")).where(F.col("text").isNotNull())


def _item_seeds(items: DataFrame) -> DataFrame:
    """Words and seeds of distinct item texts: item_key, words, mask, and arrays of seeds."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        hashed = WordHash()
        for b in batches:
            for key, text in zip(b["key"], b["text"], strict=True):
                words = hashed.of(text)
                for k, mask in enumerate(masks_of(len(words))):
                    own = words.view(np.int64) if k == 0 else None  # once per item
                    yield {"item_key": [key], "words": [own], "mask": [mask], "seeds": [seeds(words, mask).view(np.int64)]}

    return by_batch(items, run, "item_key string, words array<long>, mask string, seeds array<long>")


def _document_seeds(texts: DataFrame, masks: list[str], known: Callable[[], np.ndarray]) -> DataFrame:
    """key, seed, place of the seeds that the filter lets through."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        hashed, table = WordHash(), known()
        for b in batches:
            parts = [hashed.of(t) for t in b["text"]]
            starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            words, keys = np.concatenate(parts), np.array(b["key"], object)
            for mask in masks:
                own = seeds(words, mask)
                at = np.flatnonzero(_has(table, own))
                doc = np.searchsorted(starts, at, "right") - 1
                inside = at + len(mask) <= starts[doc + 1]
                at, doc = at[inside], doc[inside]
                if len(at):
                    yield {"key": keys[doc], "seed": own[at].view(np.int64), "place": at - starts[doc]}

    return by_batch(texts, run, "key string, seed long, place long")


def _block_hash(key: str, block: int) -> int:
    return xxhash.xxh64_intdigest(f"{key}/{block}".encode(), seed=HASH_SEED)


def _document_blocks(texts: DataFrame, needed: Callable[[], np.ndarray]) -> DataFrame:
    """key, block, words of the blocks that the filter lets through."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        hashed, table = WordHash(), needed()
        for b in batches:
            for key, text in zip(b["key"], b["text"], strict=True):
                most = (len(text) + 1) // 2 // BLOCK + 1
                spots = np.fromiter((_block_hash(key, k) for k in range(most)), np.uint64, most)
                blocks = np.flatnonzero(_has(table, spots))
                if not len(blocks):
                    continue
                words = hashed.of(text).view(np.int64)
                blocks = blocks[blocks * BLOCK < len(words)]
                if len(blocks):
                    cut = [words[k * BLOCK : (k + 1) * BLOCK] for k in blocks.tolist()]
                    yield {"key": [key] * len(blocks), "block": blocks, "words": cut}

    return by_batch(texts, run, "key string, block long, words array<long>")


def _verified(docs: DataFrame, benchmark: DataFrame, text: str, item_text: str) -> DataFrame:
    """key, item_key, doc_word, item_word, n_words, n_equal of distinct texts, as a written table."""
    scratch = Scratch(docs.sparkSession)
    own = scratch.keep("items", _item_seeds(_keyed(benchmark, item_text).dropDuplicates(["key"])))
    masks = sorted(r[0] for r in own.select("mask").distinct().collect())  # a dozen at most
    items = own.where(F.col("words").isNotNull()).select("item_key", "words")
    of_items = own.select("item_key", F.posexplode("seeds").alias("item_place", "seed"))
    known = _filter(of_items.select(F.col("seed").alias("h")))
    texts = _keyed(docs, text)

    hits = _document_seeds(texts, masks, known).distinct()
    hits = hits.withColumn("salt", F.pmod(F.xxhash64("key", "place"), F.lit(SALTS)))
    of_items = of_items.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = hits.join(of_items, ["seed", "salt"]).select("key", "item_key", (F.col("place") - F.col("item_place")).alias("diagonal"))

    # What lies over the words of one block of the document.
    laid = met.distinct().join(items, "item_key").withColumn("n_item", F.size("words").cast("long"))
    first, last = F.greatest("diagonal", F.lit(0)), F.col("diagonal") + F.col("n_item") - 1
    laid = laid.withColumn("block", F.explode(F.sequence(F.floor(first / BLOCK), F.floor(last / BLOCK))))
    laid = laid.withColumn("start", F.greatest(F.lit(0), F.col("block") * BLOCK - F.col("diagonal")))
    laid = laid.withColumn("skip", F.col("start") + F.col("diagonal") - F.col("block") * BLOCK)
    part = F.slice("words", (F.col("start") + 1).cast("int"), F.least(F.col("n_item") - F.col("start"), BLOCK - F.col("skip")).cast("int"))
    need = scratch.keep("need", laid.select("key", "block", "item_key", "diagonal", "n_item", "start", "skip", part.alias("part")))
    spot = F.xxhash64(F.concat("key", F.lit("/"), F.col("block").cast("string")))
    blocks = _document_blocks(texts, _filter(need.select(spot.alias("h")))).dropDuplicates(["key", "block"])

    other = F.slice("words", (F.col("skip") + 1).cast("int"), F.size("part"))
    equal = F.zip_with("part", other, lambda a, b: F.coalesce(a == b, F.lit(False)))
    rows = need.join(blocks, ["key", "block"]).withColumn("equal", equal)
    lines = rows.groupBy("key", "item_key", "diagonal", "n_item").agg(
        F.min("start").alias("start"), F.array_sort(F.collect_list(F.struct("start", "equal"))).alias("parts")
    )
    lines = lines.withColumn("equal", F.flatten(F.col("parts.equal"))).drop("parts")

    def verify(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out = []
            for k, line in enumerate(b["equal"]):
                start, length, many = best_stretch(np.array(line, bool))
                if many >= least_equal(b["n_item"][k]):
                    at = int(b["start"][k]) + start
                    out.append((b["key"][k], b["item_key"][k], int(b["diagonal"][k]) + at, at, length, many))
            if out:
                names = ("key", "item_key", "doc_word", "item_word", "n_words", "n_equal")
                yield dict(zip(names, map(list, zip(*out, strict=True)), strict=True))

    found = by_batch(lines, verify, "key string, item_key string, doc_word long, item_word long, n_words long, n_equal long")
    found = scratch.keep("found", found)
    scratch.drop("items", "need")
    return found


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Verified overlaps: doc_id, item_id, doc_word, item_word, n_words, n_equal.

    An overlap is a stretch of an item laid over a document, words in the same order, where
    80 % of the words or more are equal and the equal words are at least ten (of items with
    few words, 80 % of them).  Words are compared without case and outer punctuation.  Null
    and empty texts overlap nothing; repeated rows of either table are reported for each;
    null ids pass through; an empty table gives an empty result; extra columns are ignored.
    """
    found = _verified(docs, benchmark, text, item_text)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.md5(utf8(text)).alias("key"))
    items = benchmark.select(F.col(item).cast("long").alias("item_id"), F.md5(utf8(item_text)).alias("item_key"))
    named = found.join(items, "item_key")
    return rows.join(named, "key").select("doc_id", "item_id", "doc_word", "item_word", "n_words", "n_equal")


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per leaked (doc_id, item_id): n_overlaps and the most equal words of one."""
    found = overlaps(docs, benchmark, **options)
    return found.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_overlaps"), F.max("n_equal").alias("n_equal"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap no item, all columns unchanged.

    Rows whose text the filter does not know are kept without an exchange; only the others
    meet the digests of leaked texts.
    """
    leaked = _verified(docs, benchmark, text, item_text).select(F.col("key").alias("_leaked_key")).distinct()
    known = _filter(leaked.select(F.xxhash64("_leaked_key").alias("h")))

    def test(wanted: bool) -> Callable[[], Callable[[dict], list]]:
        def of_task() -> Callable[[dict], list]:
            table = known()

            def chosen(b: dict) -> list:
                keys = (hashlib.md5(t or b"").hexdigest().encode() for t in b[text])
                spots = np.fromiter((xxhash.xxh64_intdigest(k, seed=HASH_SEED) for k in keys), np.uint64, len(b[text]))
                return (_has(table, spots) == wanted).tolist()

            return chosen

        return of_task

    doubtful = keep_rows(docs, test(True), text)
    kept = doubtful.join(leaked, F.md5(doubtful[text].cast("binary")) == leaked["_leaked_key"], "left_anti")
    return keep_rows(docs, test(False), text).union(kept)
