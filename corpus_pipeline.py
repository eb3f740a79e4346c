"""Documents to token files: language, near-duplicates, leaks, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet in the shared folder and reads it again as the next stage's ``docs``.  All stages but
the last return the columns of ``docs``, whatever further ones there are.  Null texts are
empty ones; rows without id are no near-duplicates of anything and take part in all other
stages; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.llm import decontaminate, langid, mixing, paragraphs, token_planes
from draftlake.llm.common import Scratch, keep_rows, prepare, table
from draftlake.llm.registry import vocabulary

MIN_SCORE = 1.2  # times an even guess; below that mean probability a document's language counts as unknown


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    return [next(n for k in range(len(taken) + 1) if (n := "_" * k + name) not in taken) for name in names]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: a letter in the text and a clear enough prediction.

    Null and empty texts go.  Equal texts are judged alike.  Where nothing could be learned
    every text with a letter stays, and so it does where there is one language only.
    """
    prepare(spark)
    model = langid.fit(docs)
    packed, least = model.packed(), MIN_SCORE / len(model.languages) if len(model.languages) > 1 else 0.0

    def test() -> Callable[[dict], list]:
        net = langid.Network.unpacked(packed)
        reader = langid.Reader(net) if net.languages else None

        def clear(b: dict) -> list:
            texts = [t if t and langid.LETTER.search(t.decode("utf-8", "replace")) else b"" for t in b["text"]]
            if reader is None:
                return [bool(t) for t in texts]
            best = reader.documents(texts).max(axis=1)
            return [bool(t) and p >= least for t, p in zip(texts, best.tolist(), strict=True)]

        return clear

    return keep_rows(docs, test, "text")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates, the smallest by id and then by MD5 of the text.

    Other texts under the same id are documents of their own.  Near-duplicates have five-word
    shingles of Jaccard similarity 0.8 or more.  Candidates come from op6's ball search over
    SimHash fingerprints and, as those within four bits are few of them, from MinHash bands.
    """
    prepare(spark)
    id, digest, row = unused(docs, "id", "digest", "row")
    first = paragraphs.one_of_each(docs).select(F.col("doc_id").alias(id), F.hex("digest").alias(digest))
    own = F.upper(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    named = docs.join(first.hint("merge"), (F.col("doc_id") == F.col(id)) & (own == F.col(digest)))
    # Rows of one id and text are copies; the smallest by all columns stays.
    kept = named.groupBy(id, digest).agg(F.min(F.struct(*docs.columns)).alias(row)).select(f"{row}.*")
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no item of the benchmark.

    Null and empty texts overlap nothing and stay; every row is judged by its own text, so
    repeated ids need no care.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mixture takes it; repeated rows are copies.

    Rows are told apart by all their columns: another text or source under the same id is
    a document of its own, and equal rows share what the mixture takes of them.  Texts
    without words, null ones included, are not taken.
    """
    prepare(spark)
    key, rows, times, copy = unused(docs, "key", "rows", "times", "copy")
    # The text enters by its digest, so only short columns are written out.
    body = F.md5(F.col("text").cast("binary")).alias("text")
    told = F.to_json(F.struct(*[body if c == "text" else F.col(f"`{c}`") for c in docs.columns]), {"ignoreNullFields": "false"})
    keyed = docs.withColumn(key, F.sha2(told, 256))
    taken = mixing.mix(keyed, key=key).groupBy(F.col("key").alias(key)).agg(F.count("*").alias(rows), F.sum("copies").alias(times))
    joined = keyed.join(taken.where(F.col(times) > 0).hint("merge"), key)
    # Equal rows come as one that is repeated as often as all of them are taken.
    once = joined.where(F.col(rows) == 1).unionByName(joined.where(F.col(rows) > 1).dropDuplicates([key]))
    return once.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(times).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' documents, read back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts are their end id alone; repeated rows follow each other.
    """
    path = f"{Scratch(spark).root}/tokens"
    token_planes.write_tokens(docs, path, vocabulary())
    return token_planes.read_tokens(spark, path, with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", no_benchmark),
    ("mixture", mixture),
    ("tokens", token_files),
]

# A trained network, SimHash and a tokenizer cannot be written in SQL; tests compare the
# stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; the last one's rows."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(name, docs)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
