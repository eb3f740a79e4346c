"""Token ids in bit-plane files.

Ids are cut into blocks of fixed size; a block is transposed into planes (byte k of every
id, or bit k of every id), each plane is compressed with zstandard, and a chunk index says
where the planes of every block lie.  A segment is one such file: header, document table,
chunk index, planes.  Segments are rows of a written table, so tasks that are run again and
stores that only Spark reaches need no special care; each can be read on its own.

Documents are range-partitioned by id and tokenised in order inside the partition, so text
is exchanged once and ids never.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.llm.common import by_batch, partitions, utf8

# ---------------------------------------------------------------- fixed values
MAGIC = b"BPL1"
HEADER = struct.Struct("<4sBxxxIIQI")  # magic, planes, documents, block ids, ids, table bytes
ENTRY = struct.Struct("<QII")  # offset, bytes, ids
BLOCK_IDS = 1 << 14
SEGMENT_IDS = 1 << 18
END_ID = 1
CACHE = 400_000
LEVEL = 3
# What a vocabulary has to do with a text ahead of its model for the short way through it.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = "<|"  # how its special tokens begin
# ---------------------------------------------------------- end of fixed values

PLAIN = re.compile(r"[a-zß-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+|[0-9]")
OTHER = re.compile(r"[^a-zß-öø-ÿ!-&(-/:-@\[-`{-~0-9 \t\n\v\f\r]")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Pieces(dict):
    """Ids of a run of letters, a run of punctuation or a digit; bounded, in two generations."""

    def __init__(self, model) -> None:
        super().__init__()
        self.model, self.letters, self.older = model, _byte_letters(), {}

    def __missing__(self, part: str) -> bytes:
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        value = self.older.get(part)
        if value is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            value = _bytes([t.id for t in self.model.tokenize(shown)])
        self[part] = value
        return value


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit integers.

    If the vocabulary lowers case, drops white space and cuts letters, digits and
    punctuation apart, texts of Latin letters, digits and plain punctuation go to its model
    piece by piece, and each distinct piece once.  Lines with anything else, and all texts
    of other vocabularies, are encoded by the full tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.pieces = Pieces(self.whole.model)
        rules = json.loads(self.whole.to_str())
        cuts = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        levels = [{k: c.get(k) for k in ("type", "add_prefix_space", "use_regex")} for c in cuts[1:]]
        self.short = (
            rules.get("normalizer") == NORMALIZER
            and (cuts[0].get("pattern"), cuts[0].get("behavior"), cuts[0].get("invert")) == ({"Regex": SPLIT}, "Removed", True)
            and levels == [{"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]
            and all(t["content"].startswith(SPECIAL) for t in rules.get("added_tokens", []))
        )

    def encode(self, text: str) -> bytes:
        return _bytes(self.whole.encode(text, add_special_tokens=False).ids)

    def text(self, text: bytes | None) -> bytes:
        own = (text or b"").decode("utf-8", "replace")
        if not self.short:
            return self.encode(own)
        low = own.lower()
        if SPECIAL in low:
            return self.encode(own)
        if OTHER.search(low) is None:
            return b"".join(map(self.pieces.__getitem__, PLAIN.findall(low)))
        # No piece crosses a line's end.
        lines = own.split("\n")
        if len(lines) == 1:
            return self.encode(own)
        return b"".join([self.encode(x) if OTHER.search(y := x.lower()) else b"".join(map(self.pieces.__getitem__, PLAIN.findall(y))) for x in lines])


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """Kept by a Python worker over its tasks, with the pieces it has met."""
    return WordIds(path)


def planes_of(ids: np.ndarray, bits: bool) -> list[bytes]:
    cells = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if not bits:
        return [cells[:, k].tobytes() for k in range(4)]
    flat = np.unpackbits(cells, axis=1, bitorder="little")
    return [np.packbits(flat[:, k]).tobytes() for k in range(32)]


def ids_of(planes: list[bytes], count: int, bits: bool) -> np.ndarray:
    if not bits:
        cells = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        flat = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=count) for p in planes], axis=1)
        cells = np.packbits(flat, axis=1, bitorder="little")
    return np.ascontiguousarray(cells).view("<u4").reshape(-1)


def pack_segment(doc_ids: list, counts: list[int], ids: bytes, bits: bool = False, block: int = BLOCK_IDS) -> bytes:
    """One segment: whole documents, their ids one after the other."""
    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    values = np.frombuffer(ids, "<u4")
    number = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    table = squeeze(number + np.array(counts, "<i8").tobytes() + bytes(d is None for d in doc_ids))
    entries, body, offset = [], [], 0
    for at in range(0, len(values), block):
        count = min(block, len(values) - at)
        for plane in planes_of(values[at : at + count], bits):
            body.append(squeeze(plane))
            entries.append(ENTRY.pack(offset, len(body[-1]), count))
            offset += len(body[-1])
    head = HEADER.pack(MAGIC, 32 if bits else 4, len(doc_ids), block, len(values), len(table))
    return b"".join([head, table, *entries, *body])


class Segment:
    """Reads a segment; ``block(k)`` unpacks one block alone by the chunk index."""

    def __init__(self, data: bytes) -> None:
        magic, self.planes, self.n_docs, self.size, self.n_ids, table = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        self.data, at = data, HEADER.size
        raw = self._plain(at, table)
        self.doc_ids = np.frombuffer(raw, "<i8", self.n_docs)
        self.counts = np.frombuffer(raw, "<i8", self.n_docs, 8 * self.n_docs)
        self.missing = np.frombuffer(raw, np.uint8, self.n_docs, 16 * self.n_docs).astype(bool)
        self.blocks = -(-self.n_ids // self.size)
        self.index = at + table
        self.body = self.index + ENTRY.size * self.planes * self.blocks

    def _plain(self, at: int, size: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.data[at : at + size])

    def block(self, k: int) -> np.ndarray:
        entries = [ENTRY.unpack_from(self.data, self.index + ENTRY.size * (k * self.planes + p)) for p in range(self.planes)]
        planes = [self._plain(self.body + offset, size) for offset, size, _ in entries]
        return ids_of(planes, entries[0][2], self.planes == 32)

    def ids(self) -> np.ndarray:
        return np.concatenate([*(self.block(k) for k in range(self.blocks)), np.zeros(0, "<u4")])


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    id: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    bits: bool = False,
    block: int = BLOCK_IDS,
    segment: int = SEGMENT_IDS,
) -> None:
    """Write the ids of every row of ``docs`` to ``path`` in ascending order of id.

    Null and empty texts consist of the end id alone.  Rows without id come first; rows that
    repeat an id follow each other in the order of their texts.  A segment holds whole
    documents and is closed once it has ``segment`` ids.  Extra columns are ignored.
    """
    source = docs.select(F.col(id).cast("long").alias("doc_id"), utf8(text).alias("text"))
    ordered = source.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        words, part = word_ids(vocabulary), TaskContext.get().partitionId()
        number, before = 0, 0
        names, counts, held, load = [], [], [], 0

        def closed() -> dict:
            data = pack_segment(names, counts, b"".join(held), bits, block)
            return {"part": [part], "segment": [number], "ids_before": [before], "n_ids": [load], "data": [data]}

        for b in batches:
            ids = b["doc_id"].tolist() if isinstance(b["doc_id"], np.ndarray) else b["doc_id"]
            for d, t in zip(ids, b["text"], strict=True):
                own = words.text(t) + end
                names.append(d)
                counts.append(len(own) // 4)
                held.append(own)
                load += len(own) // 4
                if load >= segment:
                    yield closed()
                    number, before = number + 1, before + load
                    names, counts, held, load = [], [], [], 0
        if names:
            yield closed()

    rows = by_batch(ordered, run, "part int, segment int, ids_before long, n_ids long, data binary")
    rows.write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32, ids.

    ``start`` counts the ids of all documents before it, ``ids`` are their little-endian
    32-bit integers; ``with_ids=False`` leaves that column out once it is checked.
    """
    schema = "part int, segment int, ids_before long, n_ids long, data binary"
    rows = spark.read.schema(schema).parquet(path)
    # One row per range partition of the writer, so its number is bounded by that setting.
    totals = {r[0]: r[1] for r in rows.groupBy("part").agg(F.sum("n_ids")).collect()}
    base, at = {}, 0
    for part in sorted(totals):
        base[part], at = at, at + totals[part]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for part, ahead, data in zip(b["part"], b["ids_before"], b["data"], strict=True):
                s = Segment(data)
                raw, stops = s.ids().tobytes(), np.cumsum(s.counts)
                starts = stops - s.counts
                own = [raw[4 * x : 4 * y] for x, y in zip(starts.tolist(), stops.tolist(), strict=True)]
                yield {
                    "doc_id": [None if m else d for d, m in zip(s.doc_ids.tolist(), s.missing.tolist(), strict=True)],
                    "start": starts + base[int(part)] + int(ahead),
                    "n_tokens": s.counts.astype(np.int64),
                    "ids_crc32": [zlib.crc32(x) for x in own],
                    "ids": own if with_ids else [],
                }

    columns = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return by_batch(rows, run, f"{columns}, ids binary" if with_ids else columns)
