"""The corpus pipeline: what its stages keep of the documents, packed into sequences at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hushframe.llm import exact_dedup, jaccard, packing, pii, quality
from hushframe.llm.common import table, written
from hushframe.session import ship


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go. Those without characters, also with a null text, stay, and all
    where no document is trusted; rows that repeat go or stay together; an empty table stays empty."""
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts, a null one being empty, the row with the largest doc_id stays, and of rows that repeat
    both one; a row without doc_id stays if none of its text has one. An empty table stays empty."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of documents that links connect, the one with the smallest doc_id stays (null last); those
    without words link with nothing and stay. An empty table stays empty."""
    return jaccard.drop_near_copies(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data: each span is replaced by its kind; null and empty texts stay as they are, and so all rows."""
    return pii.mask_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of all that is left into sequences; a null text is one end token. An empty table gives no piece."""
    return packing.pack(docs)


# All stages read texts of any length whole, and keep columns of any other name as they are; the last returns pieces.
STAGES = [("quality classifier", good), ("exact dedup", exact), ("n-gram Jaccard join", near), ("personal data", private), ("best-fit packing", pack)]
#: A trained classifier and a tokenizer are beyond SQL; tests/llm/test_others.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other; what each keeps is written as Parquet to the shared folder and read again."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
