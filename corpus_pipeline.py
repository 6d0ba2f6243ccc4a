"""Corpus preparation: quality rules, near-dedup, decontamination, pseudonyms, packing.

Each stage reads what its predecessor kept, from Parquet in the shared folder, and its decisions take effect in what it
returns. All stages but the last return the columns of ``documents``, further columns included, whatever their names; the
last returns the packed pieces. An empty table goes through all stages empty. Repeated rows are treated alike. Texts are
processed whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontam, packing, pii, quality, simhash
from graphloom.llm.common import read_table, stage_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the latest quality policy keeps. Null and empty texts have no word and go; null ids stay."""
    return quality.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of texts whose five-word shingles are 0.8 alike or more.

    Candidates come from SimHash balls (measured recall of pairs at 0.8 to 0.85: 0.99, see the README), every link is
    exact. Null and blank texts are copies of each other; rows of a null id stay.
    """
    return simhash.keep_first(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, also in an edited form. Null and empty texts hold none; null ids stay."""
    return decontam.drop_leaking(docs, read_table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms in the place of personal data; ``n_chars`` follows the text. Null texts stay null."""
    done = pii.pseudonymise(docs)
    return done.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in done.columns else done


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences. A null or empty text is one piece of the end id."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Tokens, Feistel rounds and alignments have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
