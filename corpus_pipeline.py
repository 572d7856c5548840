"""A corpus pipeline: five operators in a row, each over all that the one before kept.

Documents that score as toxic go, one document of each near-duplicate component stays, documents
that hold benchmark items go, sources are mixed to their targets (rows are repeated or left out),
and the rest is put into shards. Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all
but the last return the columns of the documents.

Nulls and edge cases, by stage: documents without text or words have no toxic word, are copies of
nothing, hold no item, are taken once by the mix and have a shard; those without a ``doc_id`` are
scored and searched like others, copies of nothing, and share one shard; of equal rows one stays;
rows that share a ``doc_id`` but not their text, or another column, are rows of their own; very long
texts are read whole; ties are broken by ``doc_id`` and hashes of whole rows; an empty table passes
every stage and stays empty; columns with any other names are kept, but for shard, slot and
grown_shard, which the last stage replaces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vitaeflow.llm import decontamination, mixing, near_duplicates, sharding, toxicity
from vitaeflow.llm.common import read, remove, shared_dir


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.without_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded_rows(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Scoring, signatures and balancing can't be written in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, with what each returns written to the shared folder. What the last
    but one wrote stays there, as the result reads it; the rest is removed as soon as it isn't needed."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)  # nothing reads it any more
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
