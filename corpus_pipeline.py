"""From raw documents to packed training sequences, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir), works on every row of ``docs`` and returns a
DataFrame. All but the last return the columns of ``docs``, those beyond ``documents`` too, whatever their names; the last
returns the placed pieces. Texts are taken whole, however long: very long ones are tokenized, packed and compared in parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import exact_dedup, jaccard_join, language, packing, private_data
from quern.llm.common import saved, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go: those far from every learned language, and texts without a letter
    (null and empty ones, too). Repeated rows are judged alike; without a row nothing is learned and nothing stays."""
    return language.accepted(docs, language.train(docs, ~language.held_out(F.col("doc_id"))))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest, then the one with the smallest id stays; of rows that are equal in these, too, any one.
    Null and empty texts are one group. An empty table stays empty."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; of several with that id the one with the
    smallest digest. Texts without words and rows without an id stay. An empty table stays empty."""
    return jaccard_join.one_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind, and ``n_chars`` counts the new text. Null texts stay null."""
    return private_data.without_private_data(docs, length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its place in the training sequences; a null or empty text is one token. Ids may be null or
    repeat. An empty table gives no piece."""
    return packing.packed(packing.tokenized(docs))


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("private_data", redact),
    ("packing", pack),
]

#: The language model and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
