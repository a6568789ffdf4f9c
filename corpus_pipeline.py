"""Five filters and rewrites over ``documents``, each stage written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cutgrove.llm import bpe, decontaminate, near_dups, pii, quality
from cutgrove.llm.common import small_batches, table
from cutgrove.session import drop_path, scratch


def stored(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Written as Parquet to the shared folder and read again.

    Texts that go through Python do so here, in small batches: an executor holds two of them for each task outside its heap.
    """
    path = scratch(spark, "pipeline")
    with small_batches(spark):
        docs.write.parquet(path)
    return spark.read.schema(docs.schema).parquet(path)


def forget(spark: SparkSession, docs: DataFrame) -> None:
    """Drop the folder of a stored table; other tables stay."""
    for folder in {f.rpartition("/")[0] for f in docs.inputFiles()}:
        if folder.rpartition("/")[2].startswith("pipeline-"):
            drop_path(spark, folder)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return stored(spark, quality.keep_good(docs, model))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stored(spark, decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark")))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stored(spark, pii.redact_pii(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return stored(spark, bpe.bpe_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [("quality classifier", keep_good), ("MinHash near-dedup", drop_near_copies), ("benchmark decontamination", drop_benchmark), ("personal data", redact), ("byte-level BPE", encode)]
#: Stages hold trained models and BPE, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row. Every stage's rows are stored, so none computes the ones before it again; a stage's table goes
    once the next one is stored, and the last one's stays, as the result is read from it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        done = stage(spark, docs, sf_dir)
        if stage is drop_near_copies:
            done = stored(spark, done)
        forget(spark, docs)
        docs = done
    return docs
