"""A corpus pipeline: each stage works on all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents. Between stages the documents are written as Parquet to the shared folder and read again.
Every stage tells rows apart by doc_id and text: rows that repeat a doc_id with other texts are documents of their own, exact
copies are near-duplicates whatever their ids, and a null doc_id comes behind all others in the choice of who stays. Null
and empty texts fail the quality rules. Further columns, of whatever name, are kept up to the last stage. An empty table
gives an empty one. Texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm import bpe, decontaminate, pii, quality, simhash
from docflow.llm.common import drop_written, table, write_read, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.keep_good(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one document stays, the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kinds; n_chars follows."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    return bpe.digests(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]

#: SQL has neither XXH64, the tagger nor the merges of the last stages; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = write_read(stage(spark, docs, sf_dir), name)
        drop_written(spark, before, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
