"""Substring deduplication by paragraph MinHash banding.

Paragraphs are lines of MIN_WORDS words or more, and shorter lines joined until the next
long or blank one.  Equal paragraphs are counted first, so copies never multiply.  The distinct ones are banded; bands are tuned so that a pair at the
threshold is missed with a probability of at most MISS.  In every bucket the paragraph with
most copies is compared with all others by exact Jaccard similarity of five-word shingles.
Buckets whose members are not in one component by then are compared pair by pair inside
tasks, in blocks of bounded size, so no link is lost and no list of pairs is written.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.llm import simhash
from draftlake.llm.common import Scratch, by_batch, partitions, utf8
from draftlake.llm.graph import components, forest

# ---------------------------------------------------------------- fixed values
MIN_WORDS = 20
WIDTH = 5
THRESHOLD = 0.8
ROWS = 3  # minima in a band
MISS = 0.001
BLOCK = 256  # paragraphs of a bucket in one block
CACHE = 500_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
# ---------------------------------------------------------- end of fixed values


def bands(threshold: float = THRESHOLD, rows: int = ROWS, miss: float = MISS) -> int:
    """Fewest bands that keep a pair at the threshold with probability 1 - miss."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def _constants(count: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(k), 7) | 1 for k in range(count)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * MULTIPLIER
    return x ^ (x >> np.uint64(32))


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hashes of the word shingles of one paragraph, or of all of it if it is shorter."""
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for k, c in enumerate(_constants(width)):
        out += words[k : k + len(out)] * c
    return _mixed(out)


class Paragraphs:
    """Cuts texts into paragraphs and hashes them."""

    def __init__(self, min_words: int) -> None:
        self.min_words, self.words = min_words, Words()

    def cut(self, text: bytes | None) -> Iterator[tuple[int, int, list[bytes]]]:
        """(number of the first line, first word, words) of each paragraph."""
        at, joined, start = 0, [], (0, 0)
        for n, line in enumerate((text or b"").lower().split(b"\n")):
            words = line.split()
            if joined and not 0 < len(words) < self.min_words:
                yield *start, joined
                joined = []
            if len(words) >= self.min_words:
                yield n, at, words
            elif words:
                start = start if joined else (n, at)
                joined.extend(words)
            at += len(words)
        if joined:
            yield *start, joined

    def of(self, text: bytes | None, hashed: np.ndarray | None = None) -> Iterator[tuple[int, bytes, np.ndarray, int, int]]:
        """(number, digest, shingles, first word, words) of each paragraph that is long enough.

        ``hashed`` gives the hashes of all words of the text, if they are known.
        """
        for n, at, words in self.cut(text):
            if len(words) >= self.min_words:
                own = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words)) if hashed is None else hashed[at : at + len(words)]
                yield n, xxhash.xxh3_128_digest(b" ".join(words)), shingles(own), at, len(words)


class Whole(Paragraphs):
    """Takes a text as one paragraph, whatever its length; the digest is the text's MD5."""

    def __init__(self) -> None:
        super().__init__(0)

    def of(self, text: bytes | None) -> Iterator[tuple[int, bytes, np.ndarray, int, int]]:
        words = (text or b"").lower().split()
        hashed = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        yield 0, hashlib.md5(text or b"").digest(), shingles(hashed), 0, len(words)


def cutter(min_words: int | None) -> Paragraphs:
    return Whole() if min_words is None else Paragraphs(min_words)


def band_keys(sets: list[np.ndarray], count: int, rows: int = ROWS) -> np.ndarray:
    """(paragraphs, count) 64-bit bucket keys."""
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    multipliers = _constants(count * rows)
    keys = np.empty((len(sets), count), np.uint64)
    for band in range(count):
        key = np.full(len(sets), band + 1, np.uint64)
        for m in multipliers[band * rows : (band + 1) * rows]:
            scattered = flat * m
            scattered ^= scattered >> np.uint64(31)
            key = _mixed(key * MULTIPLIER + np.minimum.reduceat(scattered, starts))
        keys[:, band] = key
    return keys


def marked(docs: DataFrame, id: str, text: str, min_words: int | None, count: int) -> DataFrame:
    """(doc_id, paragraph, first_word, n_words, digest, keys) of every paragraph that is long enough.

    Whole texts (``min_words`` None) have their SimHash fingerprint with them (fp).
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        cut = cutter(min_words)
        for b in batches:
            found = [(d, *p) for d, t in zip(b["doc_id"], b["text"], strict=True) for p in cut.of(t)]
            if found:
                ids, numbers, digests, sets, at, size = map(list, zip(*found, strict=True))
                keys = band_keys(sets, count).view(np.int64)
                out = {"doc_id": ids, "paragraph": numbers, "first_word": at, "n_words": size, "digest": digests, "keys": list(keys)}
                yield out | {"fp": [simhash.fingerprint(t) for t in b["text"]]} if min_words is None else out

    source = docs.select(F.col(id).cast("long").alias("doc_id"), utf8(text).alias("text"))
    schema = "doc_id long, paragraph int, first_word int, n_words int, digest binary, keys array<long>"
    return by_batch(source, run, schema + ", fp long" * (min_words is None))


def shingle_sets(docs: DataFrame, wanted: DataFrame, id: str, text: str, min_words: int | None) -> DataFrame:
    """(pid, shingles) of the paragraphs ``wanted`` (pid, doc_id, digest) by a pass over their documents."""
    # Grouped by document: as many entries as the document has paragraphs at most.
    per_doc = wanted.groupBy("doc_id").agg(F.collect_list("digest").alias("digests"), F.collect_list("pid").alias("pids"))
    source = docs.select(F.col(id).cast("long").alias("doc_id"), utf8(text).alias("text"))
    # What is wanted grows with the table, so this join is a merge join at every size.
    source = source.join(per_doc.hint("merge"), "doc_id")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        cut = cutter(min_words)
        for b in batches:
            pids, sets = [], []
            for t, digests, own in zip(b["text"], b["digests"], b["pids"], strict=True):
                ask = dict(zip(digests, own, strict=True))
                for _, digest, s, *_ in cut.of(t):
                    if (pid := ask.pop(digest, None)) is not None:
                        pids.append(pid)
                        sets.append(np.unique(s).tobytes())
            yield {"pid": pids, "shingles": sets}

    return by_batch(source, run, "pid long, shingles binary")


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of (a, b) those whose shingle sets are similar enough."""
    left = sets.select(F.col("pid").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("pid").alias("b"), F.col("shingles").alias("y"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            near = np.array([jaccard(x, y) >= threshold for x, y in zip(b["x"], b["y"], strict=True)], bool)
            yield {"a": b["a"][near], "b": b["b"][near]}

    return by_batch(pairs.join(left, "a").join(right, "b"), run, "a long, b long")


def _similar_pairs(sets: list[bytes], threshold: float, room: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a bounded list of sets with at least the threshold's similarity."""
    k = len(sets)
    sizes = np.array([len(s) // 8 for s in sets], np.int64)
    values = np.concatenate([np.frombuffer(s, np.uint64) for s in sets])
    owner = np.repeat(np.arange(k), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    many = np.diff(np.r_[first, len(values)])
    first, many = first[many > 1], many[many > 1]
    common, at = np.zeros(k * k, np.int64), 0
    cost = np.cumsum(many * many)
    while at < len(many):
        stop = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + room)))
        f, m = first[at:stop], many[at:stop]
        row = np.repeat(f, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        reps = np.repeat(m, m)
        left = np.repeat(owner[row], reps)
        begin = np.repeat(np.repeat(f, m), reps)
        right = owner[begin + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)]
        common += np.bincount(left * k + right, minlength=k * k)
        at = stop
    common = common.reshape(k, k)
    near = np.triu(common >= threshold * (sizes[:, None] + sizes[None, :] - common), 1)
    return np.nonzero(near)


def rest_of_buckets(members: DataFrame, sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links inside buckets, found by comparing all blocks of a bucket inside tasks.

    ``members`` has (key, pid, size): buckets that still hold several components.
    """
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("pid"), blocks).cast("int")
    meet = F.explode(F.sequence(F.lit(0), blocks - 1))
    dealt = members.select("key", "pid", own.alias("own"), meet.alias("other"))
    dealt = dealt.select("key", "pid", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = dealt.join(sets, "pid").repartition(partitions(members.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def linked(pids: list[int], own: list[bytes]) -> Iterator[dict]:
        u, v = _similar_pairs(own, threshold)
        if len(u):
            ids = np.array(pids, np.int64)
            a, b = forest(ids[u], ids[v])
            yield {"a": a, "b": b}

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        group, pids, own = None, [], []
        for b in batches:
            for key, i, j, pid, s in zip(b["key"], b["i"], b["j"], b["pid"], b["shingles"], strict=True):
                if (key, i, j) != group:
                    if len(pids) > 1:
                        yield from linked(pids, own)
                    group, pids, own = (key, i, j), [], []
                pids.append(pid)
                own.append(s)
        if len(pids) > 1:
            yield from linked(pids, own)

    return by_batch(dealt, run, "a long, b long")


def alike(scratch: Scratch, distinct: DataFrame) -> DataFrame:
    """(a, b): texts whose SimHash fingerprints are equal or linked by the ball search, ahead of their verification."""
    first = scratch.keep("prints", distinct.groupBy("fp").agg(F.min("pid").alias("head")))
    same = distinct.join(first, "fp").where(F.col("pid") != F.col("head")).select(F.col("head").alias("a"), F.col("pid").alias("b"))
    found = simhash.links(scratch, first.select("fp")).distinct().withColumnsRenamed({"a": "u", "b": "v"})
    end = lambda fp, pid: first.select(F.col("fp").alias(fp), F.col("head").alias(pid))
    linked = found.join(end("u", "p"), "u").join(end("v", "q"), "v")
    return same.unionByName(linked.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")))


def _labelled(
    scratch: Scratch, docs: DataFrame, id: str, text: str, min_words: int | None, threshold: float, block: int, marks: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Marks of all paragraphs (unless given), and (digest, place, copies, label) of the distinct ones."""
    named = docs.where(F.col(id).isNotNull())
    if marks is None:
        marks = scratch.keep("marks", marked(named, id, text, min_words, bands(threshold)))
    hashed = ["fp"] if "fp" in marks.columns else []
    distinct = marks.groupBy("digest").agg(
        F.min(F.struct("doc_id", "paragraph")).alias("place"), F.count("*").alias("copies"), F.first("keys").alias("keys"), *[F.first(c).alias(c) for c in hashed]
    )
    # Numbers fall with the copies (in powers of two), so the smallest of a bucket has most.
    rarity = F.lit(63) - F.floor(F.log2("copies")).cast("int")
    number = F.shiftleft(rarity.cast("long"), 57).bitwiseOR(F.monotonically_increasing_id())
    distinct = scratch.keep("distinct", distinct.withColumn("pid", number))
    entries = distinct.select("pid", F.explode("keys").alias("key"))
    # The paragraph with most copies speaks for a bucket; minima combine ahead of the exchange.
    heads = entries.groupBy("key").agg(F.min("pid").alias("head"), F.count("*").alias("size"))
    shared = heads.where(F.col("size") > 1)
    members = scratch.keep("members", entries.join(shared, "key").select("key", "pid", "head", "size"))
    asked = members.select("pid")
    if hashed:
        near = scratch.keep("alike", alike(scratch, distinct.select("pid", "fp")))
        asked = asked.unionByName(near.select(F.explode(F.array("a", "b")).alias("pid")))
    wanted = distinct.join(asked.distinct(), "pid").select("pid", "place.doc_id", "digest")
    sets = shingle_sets(named, wanted, id, text, min_words).groupBy("pid").agg(F.first("shingles").alias("shingles"))
    sets = scratch.keep("sets", sets)
    pairs = members.where(F.col("pid") != F.col("head")).select(F.col("head").alias("a"), F.col("pid").alias("b"))
    pairs = (pairs.unionByName(near) if hashed else pairs).distinct()
    links = scratch.keep("links-star", verified(pairs, sets, threshold))
    labels = components(scratch, links, "star").withColumnRenamed("node", "pid")
    placed = members.join(labels, "pid", "left").withColumn("label", F.coalesce("label", "pid"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("size").alias("size"))
    # Buckets of two were compared as a whole.
    mixed = mixed.where((F.col("low") < F.col("high")) & (F.col("size") > 2)).select("key")
    rest = members.join(mixed, "key").select("key", "pid", "size")
    more = scratch.keep("links-rest", rest_of_buckets(rest, sets, threshold, block))
    if not more.isEmpty():
        labels = components(scratch, links.unionByName(more), "all").withColumnRenamed("node", "pid")
    rooted = distinct.select("pid", "digest", "place", "copies").join(labels, "pid", "left")
    rooted = rooted.withColumn("label", F.coalesce("label", "pid"))
    return marks, rooted


def repeated_paragraphs(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    min_words: int = MIN_WORDS,
    threshold: float = THRESHOLD,
    block: int = BLOCK,
    marks: DataFrame | None = None,
) -> DataFrame:
    """Paragraphs that occur again: doc_id, paragraph, cluster_doc, cluster_paragraph, n_members, removed, first_word, n_words.

    Two paragraphs are linked if the Jaccard similarity of their five-word shingles is
    ``threshold`` or more, without case (A-Z); clusters are the components.  The first
    member by (doc_id, number of the line) stays and names the cluster, the others are
    marked removed.  Lines of fewer than ``min_words`` words are joined until the next long or
    blank line; what stays shorter, null and empty texts have no paragraphs.  ``first_word``
    and ``n_words`` give the place in the document.  A paragraph repeated in one document counts, and so do repeated rows; rows
    without id are left out, as they cannot name a place.  Extra columns are ignored; an
    empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    marks, rooted = _labelled(scratch, docs, id, text, min_words, threshold, block, marks)
    place = F.struct("doc_id", "paragraph")
    clusters = rooted.groupBy("label").agg(F.min("place").alias("first"), F.sum("copies").alias("n_members"))
    classes = rooted.join(clusters.where(F.col("n_members") > 1), "label").select("digest", "first", "n_members")
    classes = scratch.keep("classes", classes)
    scratch.drop("members", "sets", "distinct")
    return marks.select("doc_id", "paragraph", "first_word", "n_words", "digest").join(classes, "digest").select(
        "doc_id",
        "paragraph",
        F.col("first.doc_id").alias("cluster_doc"),
        F.col("first.paragraph").alias("cluster_paragraph"),
        "n_members",
        (place != F.col("first")).alias("removed"),
        "first_word",
        "n_words",
    )


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(doc_id, digest) of the text that stays of every group of near-duplicate texts.

    Two texts are linked if the Jaccard similarity of their five-word shingles is
    ``threshold`` or more, without case (A-Z); of a component the smallest (id, MD5) stays.
    Candidates are the links of the SimHash ball search and the members of a MinHash band.
    Null texts are empty ones, and texts of fewer than five words are one shingle.  Rows
    without id are left out.
    """
    scratch = Scratch(docs.sparkSession)
    marks, rooted = _labelled(scratch, docs, id, text, None, threshold, block)
    placed = marks.select("doc_id", "digest").join(rooted.select("digest", "label"), "digest")
    first = placed.groupBy("label").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    first = scratch.keep("first", first.select("first.doc_id", "first.digest"))
    scratch.drop("members", "sets", "distinct", "marks")
    return first


def without_repeats(docs: DataFrame, repeated: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) without the removed words, by position; lines that lose all their words go."""
    place = F.struct(F.col("first_word").cast("long").alias("at"), F.col("n_words").cast("long").alias("n"))
    gone = repeated.where("removed").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(place).alias("_gone"))
    gone = gone.select("_id", F.flatten(F.transform("_gone", lambda p: F.array(p["at"], p["n"]))).alias("gone"))
    joined = docs.join(gone, F.col(id) == F.col("_id"), "left").select(F.col(id).alias("doc_id"), utf8(text).alias("text"), "gone")

    def left(body: bytes, spans: list[int]) -> bytes:
        lost = {k for at, n in zip(spans[::2], spans[1::2], strict=True) for k in range(at, at + n)}
        at, out = 0, []
        for line in body.split(b"\n"):
            words = line.split()
            stay = [w for k, w in enumerate(words, at) if k not in lost]
            at += len(words)
            if len(stay) == len(words):
                out.append(line)
            elif stay:
                out.append(b" ".join(stay))
        return b"\n".join(out)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            texts = [t if t is None or not g else left(t, g) for t, g in zip(b["text"], b["gone"], strict=True)]
            yield {"doc_id": b["doc_id"], "text": texts}

    return by_batch(joined, run, "doc_id long, text binary").withColumn("text", F.col("text").cast("string"))
