"""A training-corpus pipeline: toxic documents go, one of each group of near copies
stays, repeated passages go, sources are mixed to target weights, and the rest is
encoded. Each stage reads what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terralens.llm import bpe, mixing, simhash, substring, toxicity
from terralens.llm.common import drop_scratch, scratch, scratch_made

#: Words of a passage that may not repeat.
MIN_WORDS = 35
#: Share of the tokens that the mix keeps.
SHARE = 0.9


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.trained(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, 5, 0.8)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.remove_duplicate_passages(docs, "text", MIN_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(docs, mixing.source_domain("source"), SHARE, mixing.WEIGHTS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_digests(docs, bpe.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("substring", cut_passages),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The first stage learns a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again. What
    a stage needed on its way, and what its predecessor wrote, goes once it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = scratch_made()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            drop_scratch(spark, since, (path,))
    return docs
