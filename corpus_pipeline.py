"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing, packing, each stage over all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import free_shuffles, materialize, only_last_stays, read_table
from millrace.llm.exact_dedup import dedup_documents
from millrace.llm.minhash import near_dedup_documents
from millrace.llm.mixing import mix_documents
from millrace.llm.packing import pack
from millrace.llm.quality import quality_filter


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the divergence from every language reference reject go.

    Null, empty and short texts fail the base rules. Each document is judged by
    itself, so ties and repeated rows are treated alike; columns are those given.
    """
    return quality_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays, a null id counting as the smallest and a null text as empty.

    Of rows equal in id and text one stays. Columns are those given.
    """
    return dedup_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the row with the least id stays, a null id counting as the largest.

    Texts without words are linked with nothing and stay. Columns are those given.
    """
    return near_dedup_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows stay as often as their source's target takes them: not at all, once or twice.

    A null source is a source of its own, a null text has size 0; rows equal in id
    and text are taken alike. Columns are those given.
    """
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents with their sequences and offsets.

    Null and empty texts are the end token alone; texts above the capacity are cut.
    Null ids are kept. An empty table gives no rows, here as in every stage.
    """
    return pack(docs)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("mixing sources to target weights", mix),
    ("best-fit packing", packing),
]

#: SQL has neither the tokenizer nor the packing search; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with only_last_stays(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{i}")
        free_shuffles(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
