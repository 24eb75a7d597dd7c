"""A training corpus from documents, stage by stage; each stage's rows are written before the next reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repograph.llm import decontam, minhash, mixing, sharding, toxicity
from repograph.llm.common import documents, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is under the threshold; the model is fit on the labelled rows of docs."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, documents(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of least doc_id."""
    return minhash.without_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.without_leaks(docs, documents(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows as came, each source at its target share: some documents go, some come more than once."""
    return mixing.mix_documents(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's rows with shard and position, every shard a sample of the mixture."""
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: Trained models and hash-drawn rounding are not SQL; tests/llm/test_edges.py has the comparison of run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
