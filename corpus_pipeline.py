"""A pipeline of five stages over ``documents``; each calls one operator of fernmark.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of their input. Decisions are taken and carried out row by row: rows that
share an id, or have none, are told apart by id and text.

In every stage very long texts are read whole, an empty table gives an empty
result, and other columns are kept (by the last stage ignored), whatever their
names and types, maps included. Ties go to the lowest id, then to the lowest row.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernmark.llm import decontam, mixing, ngram_join, token_output, toxicity
from fernmark.llm._common import made, release, shared_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a toxicity score of one half or more.

    Null and empty texts have no evidence and stay; repeated rows get the same
    score; without labels of both kinds nothing is rejected.
    """
    model = toxicity.fit_on_labels(docs, table(spark, sf_dir, "labels"))
    return docs.where(~toxicity.is_toxic(spark, model)(F.col("text")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.75 the one with the lowest id stays; of repeated rows, one.

    Null and empty texts link with nothing and stay, repeated ones too.
    """
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a window of a benchmark item. Null and empty texts hold none and stay."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: none to three times.

    Null and empty texts count no words: they cost nothing and are taken as their
    place in the queue says; a null source is a source of its own, the last.
    """
    return mixing.take(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and what they hold of each document, repeated ones each; null and empty texts are an end id."""
    return token_output.token_output(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("tokens", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. The tables that a stage made on its way are deleted once its output is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        begun, path = made(), shared_path(spark, f"stage-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.option("compression", "zstd").parquet(path)
        release(spark, begun)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs


#: The classifier's and the tokenizer's stages have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None
