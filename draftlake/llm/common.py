"""Shared pieces of the training-data operators: scratch tables, Arrow batches, words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftlake.session import shared_dir, tune

# ---------------------------------------------------------------- fixed values
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
SCAN = 1 << 20  # bytes of a text looked at together
# ---------------------------------------------------------- end of fixed values


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators.

    One row may be a whole document, so a batch for Python is limited in rows and in bytes.
    """
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "32m")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Written tables of one run in the folder that all executors share.

    A written table cuts the lineage and survives lost executors.  ``drop`` deletes a
    table once its successor is written, so loops hold at most two rounds.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = prepare(spark)
        self.root = f"{shared_dir(spark).rstrip('/')}/draftlake-{uuid.uuid4().hex}"

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def utf8(column: str = "text") -> Column:
    """A text column as UTF-8 bytes; Python then gets ``bytes`` without decoding."""
    return F.col(column).cast("binary")


IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_count(text: bytes | None) -> int:
    """How many words a text in UTF-8 has; none of them is made, null has none."""
    text, count, before = text or b"", 0, True
    for at in range(0, len(text), SCAN):
        space = IS_SPACE[np.frombuffer(text, np.uint8, min(SCAN, len(text) - at), at)]
        count += int(np.count_nonzero(space[:-1] > space[1:])) + int(before and not space[0])
        before = bool(space[-1])
    return count


def arrow_type(kind: T.DataType) -> pa.DataType:
    simple = {
        T.LongType: pa.int64(),
        T.IntegerType: pa.int32(),
        T.ShortType: pa.int16(),
        T.DoubleType: pa.float64(),
        T.BooleanType: pa.bool_(),
        T.StringType: pa.string(),
        T.BinaryType: pa.binary(),
    }
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    return simple[type(kind)]


def by_batch(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """Run ``fn`` over a partition's batches, each a dict of Python lists or numpy arrays.

    ``fn`` yields dicts of columns named as in ``schema``.
    """
    kinds = T._parse_datatype_string(schema)
    fields = [(f.name, arrow_type(f.dataType)) for f in kinds.fields]
    wanted = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def plain() -> Iterator[dict]:
            for b in batches:
                if b.num_rows:
                    yield {n: _plain(b.column(i)) for i, n in enumerate(b.schema.names)}

        for out in fn(plain()):
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in fields], schema=wanted)

    return df.mapInArrow(run, kinds)


def _plain(column: pa.Array):
    if column.null_count == 0 and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        return column.to_numpy(zero_copy_only=False)
    return column.to_pylist()


def keep_rows(df: DataFrame, wanted: Callable[[], Callable[[dict], list]], *columns: str) -> DataFrame:
    """Rows of ``df`` that a test in Python keeps; all columns pass through untouched.

    ``wanted()`` is called once per task and gives a function from a batch (only the named
    columns, texts as bytes) to one boolean per row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = wanted()
        for b in batches:
            if b.num_rows:
                own = {}
                for n in columns:
                    c = b.column(b.schema.get_field_index(n))
                    own[n] = _plain(c.cast(pa.binary()) if pa.types.is_string(c.type) else c)
                yield b.filter(pa.array(test(own), pa.bool_()))

    return df.mapInArrow(run, df.schema)
