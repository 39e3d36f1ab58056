"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, packing.

Each stage takes all documents its predecessor kept and returns the columns of documents; the last returns the packed
pieces. Between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import common, decontaminate, packing, personal_data, quality, tokens
from siltstone.llm import near_duplicates as near


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a certified cutoff go, so null and empty texts do.

    Each row is judged by itself, so repeated rows stay or go together; labels count once a document. A very long text is arrays of
    its words within a row; an empty table gives no rows, and without labels the base rules alone decide.
    """
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.quality(docs, labels, docs.columns).filter("kept").select("_kept.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts stays; null, empty and blank texts all stay.

    Texts that share an id, or have none, are judged by themselves; of rows equal in id and text one stays, the same on any
    partitioning. A very long text is whole in a task; an empty table gives no rows; other columns are kept, whatever their names.
    """
    return near.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold a benchmark item go; null and empty texts stay, and so do other texts of the same id.

    Repeated rows go or stay together. A very long text is arrays of its words within a row; an empty table on either side
    takes nothing away.
    """
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark")).select(*docs.columns)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become their kind in angle brackets; every row stays, null and empty texts as they are.

    Repeated rows are masked alike. A very long text is scanned and masked in time that grows with its length; an empty table gives
    no rows.
    """
    return personal_data.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences.

    Null and empty texts are pieces of their end id alone; repeated rows are packed each; only texts of over 4096 tokens are cut, a
    very long one into many pieces of one task; an empty table gives no rows.
    """
    return packing.packed(docs, tokens.vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal),
    ("packing", pack),
]
#: SQL can't express the tokens of the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.stage(stage(spark, docs, sf_dir), name)
        if k > 1:
            scratch.drop(STAGES[k - 1][0])
    return docs
