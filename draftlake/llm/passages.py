"""Repeated passages of WINDOW words or more, wherever they stand in a text.

Line breaks do not matter here: a text is its sequence of words.  Each window of WINDOW
words is represented by the smallest hash among its grams of GRAM words, so equal windows
have the same one and only about two grams in 27 words travel.  Grams that occur once rule
their windows out; what is left is compared by hashes of whole windows.  No pair of texts
is listed: the first place of a window stays and the others refer to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import Scratch, by_batch, partitions, utf8
from draftlake.llm.paragraphs import MIN_WORDS, Paragraphs, Words, _mixed, band_keys, bands, repeated_paragraphs

# ---------------------------------------------------------------- fixed values
WINDOW = 50  # words of the shortest passage
GRAM = 25
ROOM = 200_000  # words whose shingles and grams a task holds
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
# ---------------------------------------------------------- end of fixed values


def rolling(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of every run of ``width`` words."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    up = np.full(len(words), base, np.uint64)
    up[0] = 1
    down = np.full(len(words), pow(base, -1, 1 << 64), np.uint64)
    down[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(up))])
    return _mixed((sums[width:] - sums[:-width]) * np.cumprod(down)[: len(words) - width + 1])


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Smallest or largest value of every run of ``width``."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[:-step], values[step:])
        done += step
    return values


class Cutter:
    """Hashes of the words, grams and windows of texts."""

    def __init__(self) -> None:
        self.words = Words()

    def of(self, text: bytes | None) -> np.ndarray:
        found = (text or b"").lower().split()
        return np.fromiter(map(self.words.__getitem__, found), np.uint64, len(found))

    def grams(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of the grams that represent some window of hashed words."""
        if len(words) < WINDOW:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        own, span = rolling(words, GRAM, BASES[0]), WINDOW - GRAM + 1
        least, edge = sliding(own, span, np.minimum), np.zeros(span - 1, np.uint64)
        at = np.flatnonzero(own == sliding(np.concatenate([edge, least, edge]), span, np.maximum))
        return own[at], at

    def windows(self, text: bytes | None, wanted: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, gram, first word, line) of windows with a wanted gram and no word that is gone."""
        words = self.of(text)
        if len(words) < WINDOW:
            return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
        least = sliding(rolling(words, GRAM, BASES[0]), WINDOW - GRAM + 1, np.minimum)
        at = np.flatnonzero(np.isin(least, wanted))
        out = cover(gone, len(words))
        before = np.concatenate([[0], np.cumsum(out)])
        at = at[before[at + WINDOW] == before[at]]
        ends = np.cumsum([len(line.split()) for line in text.split(b"\n")])
        return rolling(words, WINDOW, BASES[1])[at], least[at], at, np.searchsorted(ends, at, "right")


def cover(spans: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` words lie in one of the spans (first word, words)."""
    steps = np.zeros(size + 1, np.int64)
    spans = np.asarray(spans, np.int64).reshape(-1, 2)
    np.add.at(steps, np.minimum(spans[:, 0], size), 1)
    np.add.at(steps, np.minimum(spans.sum(axis=1), size), -1)
    return np.cumsum(steps[:-1]) > 0


def spans_of(rows: DataFrame) -> DataFrame:
    """(doc_id, gone): the removed spans of each document; as many entries as it has paragraphs."""
    gone = rows.where("removed").select("doc_id", F.array(F.col("first_word").cast("long"), F.col("n_words").cast("long")).alias("span"))
    return gone.groupBy("doc_id").agg(F.flatten(F.collect_list("span")).alias("gone"))


def _grams(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        cut = Cutter()
        for b in batches:
            found = [cut.grams(cut.of(t)) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "grams": [g.view(np.int64) for g, _ in found], "at": [a for _, a in found]}

    return by_batch(docs, run, "doc_id long, grams array<long>, at array<int>").where(F.size("grams") > 0)


def _read_once(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Marks of paragraphs and, in rows without a paragraph, grams of whole texts, by one reading of the words."""
    count = bands()

    def columns(marks: list[tuple], held: list[tuple]) -> dict:
        keys = list(band_keys([m[3] for m in marks], count).view(np.int64)) if marks else []
        blank, more = [None] * len(held), [None] * len(marks)
        return {
            "doc_id": [m[0] for m in marks] + [h[0] for h in held],
            "paragraph": [m[1] for m in marks] + blank,
            "first_word": [m[4] for m in marks] + blank,
            "n_words": [m[5] for m in marks] + blank,
            "digest": [m[2] for m in marks] + blank,
            "keys": keys + blank,
            "grams": more + [h[1] for h in held],
            "at": more + [h[2] for h in held],
        }

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        cut, paragraphs = Cutter(), Paragraphs(min_words)
        for b in batches:
            marks, held, load = [], [], 0
            for d, t in zip(b["doc_id"], b["text"], strict=True):
                words = cut.of(t)
                marks += [(d, *p) for p in paragraphs.of(t, words)]
                own, at = cut.grams(words)
                if len(own):
                    held.append((d, own.view(np.int64), at))
                load += len(words)
                if load >= ROOM:
                    yield columns(marks, held)
                    marks, held, load = [], [], 0
            yield columns(marks, held)

    schema = "doc_id long, paragraph int, first_word int, n_words int, digest binary, keys array<long>, grams array<long>, at array<int>"
    return by_batch(docs, run, schema)


def _standing(grams: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, gram, n) of the grams outside the removed spans, n places each."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            ids, kept, places = [], [], []
            for d, g, at, gone in zip(b["doc_id"], b["grams"], b["at"], b["gone"], strict=True):
                g, at = np.array(g, np.int64), np.array(at, np.int64)
                before = np.concatenate([[0], np.cumsum(cover(gone or [], int(at[-1]) + GRAM))])
                own, n = np.unique(g[before[at + GRAM] == before[at]], return_counts=True)
                ids.append(np.full(len(own), d, np.int64))
                kept.append(own)
                places.append(n)
            yield {"doc_id": np.concatenate(ids), "gram": np.concatenate(kept), "n": np.concatenate(places)}

    return by_batch(grams.join(spans, "doc_id", "left"), run, "doc_id long, gram long, n long")


def _windows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(hash, gram, doc_id, at, line) of the windows that may occur again."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        cut = Cutter()
        for b in batches:
            for d, t, w, gone in zip(b["doc_id"], b["text"], b["wanted"], b["gone"], strict=True):
                key, gram, at, line = cut.windows(t, np.array(w, np.int64).view(np.uint64), gone or [])
                yield {"hash": key.view(np.int64), "gram": gram.view(np.int64), "doc_id": np.full(len(at), d, np.int64), "at": at, "line": line}

    # What is wanted grows with the table, so this join is a merge join at every size.
    return by_batch(docs.join(wanted.hint("merge"), "doc_id"), run, "hash long, gram long, doc_id long, at int, line int")


def _stretches(places: list[tuple]) -> Iterator[tuple]:
    """Passages of one document from its windows (at, line, first doc, at, line, count), sorted."""
    size = places[-1][0] + WINDOW
    runs: list[list] = []
    for at, line, doc, first, first_line, count, moved in places:
        last = runs[-1] if runs else None
        if last and last[1] >= at - 1 and last[3] == doc and last[7] == moved and last[4] + at - last[0] == first:
            last[1], last[6] = at, max(last[6], count)
        else:
            runs.append([at, at, line, doc, first, first_line, count, moved])
    stay = cover(np.array([[r[0], r[1] - r[0] + WINDOW] for r in runs if not r[7]], np.int64), size)
    for low, high, line, doc, _, first_line, count, moved in runs:
        # Words of a window that stays are not taken out by another that overlaps it.
        free = np.flatnonzero(~stay[low : high + WINDOW]) if moved else np.arange(high + WINDOW - low)
        for part in np.split(free, np.flatnonzero(np.diff(free) > 1) + 1):
            if len(part):
                yield line, doc, first_line, count, moved, low + int(part[0]), len(part)


def _merged(found: DataFrame) -> DataFrame:
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        names = ("paragraph", "cluster_doc", "cluster_paragraph", "n_members", "removed", "first_word", "n_words")

        def written(doc: int, places: list[tuple]) -> Iterator[dict]:
            rows = list(zip(*_stretches(places), strict=True))
            if rows:
                yield {"doc_id": [doc] * len(rows[0])} | dict(zip(names, map(list, rows), strict=True))

        owner, held = None, []
        for b in batches:
            columns = (b[n] for n in ("doc_id", "at", "line", "first_doc", "first_at", "first_line", "count"))
            for d, at, line, doc, first, first_line, count in zip(*map(list, columns), strict=True):
                if d != owner:
                    if held:
                        yield from written(owner, held)
                    owner, held = d, []
                held.append((int(at), int(line), int(doc), int(first), int(first_line), int(count), (d, at) != (doc, first)))
        if held:
            yield from written(owner, held)

    dealt = found.repartition(partitions(found.sparkSession), "doc_id").sortWithinPartitions("doc_id", "at")
    schema = "doc_id long, paragraph int, cluster_doc long, cluster_paragraph int, n_members long, removed boolean, first_word int, n_words int"
    return by_batch(dealt, run, schema)


def _source(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("doc_id"), utf8(text).alias("text"))


def repeated_runs(docs: DataFrame, rows: DataFrame, id: str = "doc_id", text: str = "text", grams: DataFrame | None = None) -> DataFrame:
    """Passages that occur again in what the removal of ``rows`` leaves, with the columns of ``rows``.

    Every run of WINDOW equal words or more that stands at two places is found, without case
    (A-Z) and whatever the line breaks; the place with the smallest (doc_id, first word)
    stays.  ``paragraph`` is the line in which the run begins.  A place is listed once for
    all rows of one id.
    """
    scratch = Scratch(docs.sparkSession)
    source = _source(docs, id, text)
    spans = scratch.keep("spans", spans_of(rows))
    standing = scratch.keep("standing", _standing(_grams(source) if grams is None else grams, spans))
    again = standing.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > 1).select("gram")
    wanted = standing.join(again, "gram").groupBy("doc_id").agg(F.collect_set("gram").alias("wanted"))
    windows = scratch.keep("windows", _windows(source, wanted.join(spans, "doc_id", "left")))
    key = ["hash", "gram"]
    first = windows.groupBy(*key).agg(F.min(F.struct("doc_id", "at", "line")).alias("first"), F.count("*").alias("count"))
    found = windows.join(first.where(F.col("count") > 1), key).select(
        "doc_id",
        "at",
        "line",
        F.col("first.doc_id").alias("first_doc"),
        F.col("first.at").alias("first_at"),
        F.col("first.line").alias("first_line"),
        "count",
    )
    out = scratch.keep("runs", _merged(found))
    scratch.drop("standing", "windows", "spans")
    return out


def repeated_passages(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Repeated paragraphs, and repeated runs of words in what their removal leaves."""
    scratch = Scratch(docs.sparkSession)
    read = scratch.keep("read", _read_once(_source(docs, id, text)))
    marks = read.where(F.col("paragraph").isNotNull()).drop("grams", "at")
    rows = scratch.keep("paragraphs", repeated_paragraphs(docs, id, text, marks=marks))
    grams = read.where(F.col("paragraph").isNull()).select("doc_id", "grams", "at")
    return rows.unionByName(repeated_runs(docs, rows, id, text, grams))
