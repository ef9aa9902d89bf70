"""Documents to packed training sequences: the stages, in order.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns
of documents, whatever those are called; the last returns the packed pieces. Labels are those of the
same folder. In every stage null texts count as empty ones, texts of any length are read whole, an
empty table gives an empty one, and rows that are equal in id and text are judged alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusframe.llm import compression_quality, exact_dedup, jaccard_join, packing, toxic_crf
from corpusframe.llm.common import materialize, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxic spans score under the threshold stay. Empty texts have no spans and stay;
    without toxic labels all stay."""
    return toxic_crf.drop_toxic(docs, table(spark, sf_dir, "labels"), ~toxic_crf.held_out())


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good stay. Empty texts have the score of no
    difference; without labels of both classes every score is 0.5, under the threshold."""
    return compression_quality.keep_quality(docs, table(spark, sf_dir, "labels"), ~compression_quality.held_out())


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest id stays, one row of it; a null id is smaller than any other. Empty
    texts equal each other."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the smallest id stays. Documents without words are like
    no other and stay, as do rows without an id."""
    return jaccard_join.drop_near_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, placed in sequences of 2048 ids; ties of length go by id and piece.
    An empty text is a piece of one id."""
    return packing.pack_documents(docs, *packing.gpt_parts())


STAGES = [
    ("toxicity", toxicity),
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs


#: Fitted classifiers and token ids are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None
