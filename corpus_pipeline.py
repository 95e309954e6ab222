"""From raw documents to a training mixture: five filtering stages, each written and read again.

1. quality rules: documents that fail the policy go;
2. toxicity: documents at or above their language's threshold go;
3. near-duplicates: texts that share 0.8 or more of their five-word shingles are linked, one document of each component stays;
4. decontamination: documents in which a benchmark passage occurs go;
5. mixing: documents are sampled to the target mixture.

Every stage works on all rows its predecessor kept and returns them with the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontamination, mixing, near_dedup, quality_rules, toxicity
from quarry.llm.common import save, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep(docs, percent=80)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.keep(docs)


STAGES = [
    ("quality_rules", quality),
    ("toxicity", toxic),
    ("near_dedup", near_duplicates),
    ("decontamination", contaminated),
    ("mixing", mixed),
]

#: The trained classifier has no SQL form; tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs
