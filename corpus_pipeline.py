"""From raw documents to packed sequences, one stage after the other.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Each result is written as Parquet and read again
as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shipgauge.llm.exact_dup import drop_exact_duplicates
from shipgauge.llm.frames import materialize
from shipgauge.llm.language import keep_known_languages
from shipgauge.llm.mixing import domain_labels, mix
from shipgauge.llm.near_dup import drop_near_duplicates
from shipgauge.llm.packing import pack
from shipgauge.llm.queries import DOMAIN_TARGETS, WORD_BPE, table
from shipgauge.session import tune


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; the others go."""
    return keep_known_languages(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    tune(spark)
    return drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    tune(spark)
    return drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, so that expected tokens meet the targets."""
    return mix(docs, domain_labels(table(spark, sf_dir, "labels")), DOMAIN_TARGETS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return pack(docs, WORD_BPE)


STAGES = [
    ("language ID", languages),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("mixing", mixture),
    ("packing", packing),
]

# No SQL: byte context trees, alignments and the fit have none. Tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
