"""A corpus pipeline of five stages over ``documents``: quality, near duplicates, personal data, mixing, tokens.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept, and but for the last returns the
columns of ``docs``; its result is written as Parquet in the shared folder and read again. Extra columns travel along
to the last stage. Empty tables give empty results; nulls are treated as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm import bpe, mixing, ngram_join, pii, quality
from lorespark.llm.scratch import Workspace


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote rejects go."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more, the one with the least id stays."""
    return ngram_join.one_of_each_class(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows the new text."""
    clean = pii.redact_pii(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources approach their target sizes."""
    return mixing.mixed(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of the mixture with its number of tokens and the digests of its ids and of the decoded ids."""
    return bpe.op10(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: SQL can't express these stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the table ``documents`` in ``sf_dir``."""
    docs, work, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "pipeline"), []
    for name, stage in STAGES[:-1]:
        docs = work.write(stage(spark, docs, sf_dir), name)
        work.drop(*before)
        before = [name]
    return STAGES[-1][1](spark, docs, sf_dir)
