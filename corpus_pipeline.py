"""A corpus pipeline of five stages over `documents`; each takes and returns its columns but the last, which mixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noisegrid.llm import decontaminate, mixing, pii, simhash, toxicity
from noisegrid.llm._common import table, write_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't take for toxic. Null and empty texts are scored like any other and repeated
    rows alike; without labels all stay, and an empty table stays empty."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id. Texts without words are copies of each
    other, as are repeated rows; documents without an id go where their group has one."""
    return simhash.deduplicate(docs)


def drop_leaking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts stay, as do repeated rows; without a benchmark
    all stay."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and what discloses it replaced. Null texts stay null; repeated rows change alike."""
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their repeats: (doc_id, source, size, source_size, target, position, taken).
    Texts without words are never taken; rows that repeat an id queue one by one; an empty table gives no rows."""
    return mixing.mix(docs).where(F.col("taken") > 0).select("doc_id", "source", "size", "source_size", "target", "position", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaking),
    ("pii", sanitise),
    ("mixing", mix_sources),
]

#: Learned weights, fingerprints and components have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
