"""From raw documents to token ids: five stages, each an operator of tallyspark.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe, jaccard_join, mixing, substring_dedup, toxicity
from tallyspark.llm.queries import RANKS
from tallyspark.llm.shared import discard, scratch, table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is 0.5 or more. Null and empty texts and null ids stay, repeated rows fare alike."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of similar documents.

    Null and empty texts are like nothing; of rows with one id the first by their columns stays; rows with a null id all stay.
    """
    return jaccard_join.one_of_each(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that an earlier document has; other text stays as it is.

    A null text becomes an empty one. Every row stays, those with null or repeated ids too.
    """
    out = substring_dedup.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources weigh 5, 2, 1.

    A null source is a source. A text without words is taken as often as its whole part says. Rows alike in id, text and source count together.
    """
    return mixing.repeated_documents(docs)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes they decode to. Null and empty texts have none; every row stays."""
    where = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return bpe.digests(bpe.encode(docs, *where), *where)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("substring_dedup", substring_dedup_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: The toxicity stage learns a model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the table documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch() as tables:
            docs = written(stage(spark, docs, sf_dir))
            tables.remove(docs)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
