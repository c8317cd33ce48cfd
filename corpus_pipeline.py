"""The corpus pipeline: five stages, each an operator of lociweave.llm, from raw documents to a weighted mix.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns
to the shared folder as Parquet, and the next stage reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lociweave.llm.common import materialise, table
from lociweave.llm.decontamination import keep_uncontaminated
from lociweave.llm.exact_dedup import drop_exact_copies
from lociweave.llm.language import keep_identified
from lociweave.llm.mixing import mix_documents
from lociweave.llm.simhash import drop_near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to documents; an empty table passes through all of them."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{i}")
    return docs


#: Language ID and SimHash similarity have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None
