"""Filter interaction audit by contraction of contingency tensors.

Five filters give every document five bits.  Documents are counted per part and bit pattern,
so a part is a tensor of shape 2x2x2x2x2, whatever its number of documents.  Each question
of the audit selects pass, fail or all along every axis, which is one contraction; all
orders and steps of a part are contracted at once.

Equal texts are found through their SHA-256.  Copies are counted before anything is
exchanged by their text, so a text that a third of all rows repeat travels as a few rows.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import by_batch, utf8

# ---------------------------------------------------------------- fixed values
FILTERS = "ABCDE"
MIN_WORDS = 50  # A
DISTINCT = 65  # B, per cent of the words
CAPITALS = 5  # C, per cent of the code points
SYMBOLS = re.compile(rb"[#$%&*|]")  # D
# ---------------------------------------------------------- end of fixed values

CAPITAL = bytes(range(ord("A"), ord("Z") + 1))
LATER = bytes(range(0x80, 0xC0))  # bytes of a code point behind its first
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
MEASURES = ("n", "good", "toxic")


def text_bits(text: bytes) -> int:
    """Filters A to D that a text fails; A is bit 0."""
    words = text.split()
    points = len(text.translate(None, LATER))
    capitals = len(text) - len(text.translate(None, CAPITAL))
    failed = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < DISTINCT * len(words),
        100 * capitals > CAPITALS * points,
        SYMBOLS.search(text) is not None,
    )
    return sum(bit << k for k, bit in enumerate(failed))


def marked(docs: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, digest, bits) of every row, from its whole text."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            texts = [t or b"" for t in b["text"]]
            yield {
                "doc_id": b["doc_id"],
                "part": b["part"],
                "digest": [hashlib.sha256(t).digest() for t in texts],
                "bits": [text_bits(t) for t in texts],
            }

    named = F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part")
    source = docs.select(F.col(id).cast("long").alias("doc_id"), named, utf8(text).alias("text"))
    return by_batch(source, run, "doc_id long, part string, digest binary, bits int")


def cells(marks: DataFrame, labels: DataFrame, id: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, bits, e, n, good, toxic): documents of each part by failed filters A to D and E.

    A document is good or toxic if any label of its id says so.
    """
    says = labels.groupBy(F.col(id).cast("long").alias("_id")).agg(
        F.max(F.coalesce((F.col(quality) == 1).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col(toxic) == 1).cast("int"), F.lit(0))).alias("toxic"),
    )
    told = marks.join(says, F.col("doc_id") == F.col("_id"), "left")
    told = told.select("doc_id", "part", "digest", "bits", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "toxic")])
    kind = ["digest", "part", "bits", "good", "toxic"]
    # Rows of one id and kind first, then the kinds of a text: its first id and how many rows that has.
    per_id = told.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    named = F.col("doc_id").isNotNull()
    kinds = per_id.groupBy(*kind).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(named, F.col("n")).otherwise(0)).alias("named"),
        F.min(F.when(named, F.struct("doc_id", "n"))).alias("first"),
    )
    least = kinds.groupBy(F.col("digest").alias("_digest")).agg(F.min("first.doc_id").alias("least"))
    known = kinds.join(least, F.col("digest") == F.col("_digest"))
    # Of the rows with an id only those of the text's smallest id pass E; rows without one pass.
    passed = F.col("n") - F.col("named") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    counted = known.select("part", "bits", "good", "toxic", passed.alias("passed"), (F.col("n") - passed).alias("failed"))
    sides = F.explode(F.array(*[F.struct(F.lit(e).alias("e"), F.col(c).alias("n")) for e, c in enumerate(("passed", "failed"))])).alias("side")
    return (
        counted.select("part", "bits", "good", "toxic", sides)
        .where(F.col("side.n") > 0)
        .groupBy("part", "bits", F.col("side.e").alias("e"))
        .agg(
            F.sum("side.n").alias("n"),
            F.sum(F.col("side.n") * F.col("good")).alias("good"),
            F.sum(F.col("side.n") * F.col("toxic")).alias("toxic"),
        )
    )


class Questions:
    """Selectors of every order and step: one row of pairs (pass, fail) per axis."""

    def __init__(self, filters: str = FILTERS) -> None:
        self.orders = ["".join(o) for o in itertools.permutations(filters)]
        self.steps = [(order, k, filters.index(f)) for order in self.orders for k, f in enumerate(order)]
        self.axis = np.array([axis for *_, axis in self.steps])
        kept, removed, failing, alone = [], [], [], []
        for order, k, axis in self.steps:
            before = {filters.index(f) for f in order[:k]}
            kept.append([PASS if a in before or a == axis else ALL for a in range(len(filters))])
            removed.append([PASS if a in before else FAIL if a == axis else ALL for a in range(len(filters))])
            failing.append([FAIL if a == axis else ALL for a in range(len(filters))])
            alone.append([FAIL if a == axis else PASS for a in range(len(filters))])
        self.kept, self.removed, self.failing, self.alone = (np.array(s, np.int64) for s in (kept, removed, failing, alone))

    @staticmethod
    def contracted(tensor: np.ndarray, select: np.ndarray) -> np.ndarray:
        """(steps, measures): ``tensor`` (measures, 2, 2, 2, 2, 2) by one selector row per step."""
        return np.einsum("mabcde,sa,sb,sc,sd,se->sm", tensor, *(select[:, k] for k in range(select.shape[1])), optimize="greedy")

    def answered(self, tensor: np.ndarray) -> dict[str, list]:
        removed = self.contracted(tensor, self.removed)
        every = np.zeros(len(FILTERS), np.int64)
        np.add.at(every, self.axis, removed[:, 0])
        return {
            "filter_order": [order for order, *_ in self.steps],
            "step": [k + 1 for _, k, _ in self.steps],
            "kept": self.contracted(tensor, self.kept)[:, 0],
            "removed": removed[:, 0],
            "redundant": self.contracted(tensor, self.failing)[:, 0] - removed[:, 0],
            "unique_fails": self.contracted(tensor, self.alone)[:, 0],
            "good_lost": removed[:, 1],
            "toxic_lost": removed[:, 2],
            "shapley": every[self.axis],
        }


COLUMNS = "kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """What each filter does at each step of every order, per part of the table.

    One row per part, filter_order and step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley.  Filters fail a text with under 50 words (A), with fewer
    than 65 % distinct words (B), with over 5 % capitals A-Z (C), with one of ``#$%&*|`` (D),
    and one that a row of a smaller id has too (E), in any part.  A null text is empty and a
    null part is the empty string.  Rows that repeat an id and its text are documents of
    their own and do not fail E by each other; rows without id neither fail E nor make
    others fail, and have no labels.  Labels that repeat an id count once.  Extra columns
    are ignored; an empty table gives an empty result.
    """
    counted = cells(marked(docs, id, text, part), labels, id)
    # At most 32 cells of a part.
    parts = counted.groupBy("part").agg(F.collect_list(F.array(F.col("bits").cast("long"), F.col("e").cast("long"), *MEASURES)).alias("cells"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        ask = Questions()
        for b in batches:
            for name, held in zip(b["part"], b["cells"], strict=True):
                tensor = np.zeros((len(MEASURES), *(2,) * len(FILTERS)), np.int64)
                for bits, e, *values in held:
                    at = tuple(bits >> k & 1 for k in range(len(FILTERS) - 1)) + (e,)
                    tensor[(slice(None), *at)] += np.array(values, np.int64)
                yield {"part": [name] * len(ask.steps)} | ask.answered(tensor)

    return by_batch(parts, run, f"part string, filter_order string, step int, {COLUMNS}")
