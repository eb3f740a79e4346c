"""Line deduplication: explode, hash, count documents per hash, drop, reassemble."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import Scratch, by_batch, utf8

# ---------------------------------------------------------------- fixed values
MIN_CHARS = 10  # code points of a line key that can be dropped
# ---------------------------------------------------------- end of fixed values


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit hash of a normalised line; None for lines that are too short to drop.

    The line is stripped of spaces and control spaces at both ends and A-Z are lowered.
    """
    key = line.strip(b" \t\n\x0b\x0c\r").lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, line): one row per document and distinct key."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            ids, keys = [], []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                own = {line_key(x, min_chars) for x in (t or b"").split(b"\n")}
                own.discard(None)
                ids.extend([i] * len(own))
                keys.extend(own)
            yield {"doc_id": ids, "line": keys}

    source = docs.select(F.col(id).cast("long").alias("doc_id"), utf8(text).alias("text"))
    return by_batch(source, run, "doc_id long, line binary")


def drop_repeated_lines(
    docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, text (what stays).

    A key of ``min_chars`` code points or more that occurs in two documents loses its
    lines everywhere but in the smallest id that holds it; there every occurrence stays.
    Null and empty texts are one empty line.  Rows without id are not counted as holders
    and lose no line.  Rows that repeat an id are one holder.  Extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    known = F.col("doc_id").isNotNull()
    lines = scratch.keep("lines", line_hashes(docs, id, text, min_chars).where(known))
    # Combined ahead of the exchange: a line that every document has is a row per task.
    shared = lines.groupBy("line").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("last"))
    shared = shared.where(F.col("holder") < F.col("last"))
    lost = lines.join(shared.select("line", "holder"), "line").where(F.col("doc_id") > F.col("holder"))
    # A document's own distinct lines: as long as the document at most.
    lost = lost.groupBy("doc_id").agg(F.collect_set("line").alias("lost"))
    source = docs.select(F.col(id).cast("long").alias("doc_id"), utf8(text).alias("text"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            total, gone, kept = [], [], []
            for t, lost_keys in zip(b["text"], b["lost"], strict=True):
                parts = (t or b"").split(b"\n")
                drop = set(lost_keys or ())
                stay = [x for x in parts if line_key(x, min_chars) not in drop] if drop else parts
                total.append(len(parts))
                gone.append(len(parts) - len(stay))
                kept.append(b"\n".join(stay))
            yield {"doc_id": b["doc_id"], "n_lines": total, "n_dropped": gone, "text": kept}

    joined = source.join(lost, "doc_id", "left")
    out = by_batch(joined, run, "doc_id long, n_lines long, n_dropped long, text binary")
    return out.withColumn("text", F.col("text").cast("string"))


def digest(kept: DataFrame) -> DataFrame:
    """The contract's columns: the kept text as a SHA-256."""
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def sha256_hex(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()
