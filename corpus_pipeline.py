"""From raw documents to packed training sequences: toxicity, near-duplicates, personal data, mixture, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; its result is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents, and further ones of docs, as they are.
Every stage takes nulls in any column, empty and very long texts, repeated rows and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import mixing, packing, pii, shingles, toxicity
from threadloom.llm.common import written


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score reaches their language's threshold.

    Of the labelled documents that aren't held out, all count: four fifths train, all of the others set the thresholds.

    A null or empty text has the score of a text without words; a null language is one by itself; equal rows go or stay
    together, and so do rows with equal texts and languages; without labels none goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.cleaned(docs, toxicity.train(docs, labels))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id, null last; of equal rows one.

    Null, empty and blank texts have no shingles and all stay; a text of any length is one set.
    """
    return shingles.deduplicated(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind, in every row; null stays null and empty empty, and equal rows stay equal."""
    return pii.masked(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, a cut one to its first words.

    Null, empty and blank texts have no words and aren't taken; a null source is one by itself; of equal rows each is taken
    on its own; a very long text is served in packets like all others.
    """
    return mixing.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed; an empty or null text is its end token alone, a very long one many pieces."""
    return packing.packed(packing.token_pieces(docs, packing.public_path()))


STAGES = [
    ("toxicity", clean),
    ("n-gram Jaccard join", distinct),
    ("PII", private),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", sequences),
]

#: A trained classifier decides in the first stage, so SQL can't give these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
