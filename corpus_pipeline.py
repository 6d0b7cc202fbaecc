"""From raw documents to packed sequences: quality rules, language ID, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before
it kept, and is written as Parquet and read again before the next one runs. All
but the last return the columns of their input, extra ones included.

Edge cases: rows with a null or empty text fail the base rules and go; null ids,
languages and sources are carried through, and a null language is not learned
from; of repeated rows and near-duplicates one row stays per group, the smallest
id, nulls last, then the smallest digest of the text, while different texts under
one id both stay; texts of any length are taken whole; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from swathline.llm import langid, packing, quality_rules, simhash
from swathline.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the others lose the lines that fail and the corpus's boilerplate."""
    return quality_rules.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that is found with confidence go. Learned from what the stage before kept."""
    return langid.keep_known(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays."""
    return simhash.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("pack", pack)]

#: SQL expresses neither the language model nor the token ids; tests/llm compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
