"""The corpus pipeline: documents through five operators of ``tunnelscope.llm``.

A stage gets all that its predecessor kept, written as Parquet and read again. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunnelscope.llm import jaccard, language, lexicon, mixture, repeats
from tunnelscope.session import cut

TOKENIZER = "byte_bpe_50k.json"
# Near duplicates: word n-grams and similarity in percent.
SHINGLE_WORDS, SIMILARITY = 5, 80
# Bytes that make a repeated passage: about forty words of these tables.
PASSAGE_BYTES = 240
# Bytes of an Arrow batch. A task and its worker hold several at once, in both directions.
ARROW_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """Texts differ in length by orders of magnitude, so batches are bounded by bytes and not by rows alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those far from every language; a missing label is filled with the prediction."""
    bounded(spark)
    out = language.learn_and_identify(docs).filter(~F.col("rejected"))
    return out.select(*[F.coalesce("lang", "lang_pred").alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near duplicates."""
    bounded(spark)
    return jaccard.one_of_each(docs, SHINGLE_WORDS, SIMILARITY, 100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that occur again anywhere out of the texts."""
    bounded(spark)
    return repeats.without_repeats(docs, PASSAGE_BYTES)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes of each source what its weight asks for; a document taken twice is two rows."""
    bounded(spark)
    return mixture.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of each text (little-endian unsigned 32-bit integers) and their number."""
    bounded(spark)
    with open(public_tokenizers.path(TOKENIZER)) as f:
        spec = f.read()
    tokens = lexicon.encode_documents(docs, spec)
    return tokens.withColumn("n_tokens", F.floor(F.octet_length("token_ids") / 4).cast("bigint"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing),
    ("encoding", encoding),
]
# Several stages cannot be put in SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
