"""One query per operator over the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from ..session import cut, scratch_path
from . import chat, crossalign, exact, imatch, jaccard, language, lexicon, mixture, repair, repeats, sharding, tokenfiles, topk

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by weight takes of each document."""
    return mixture.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs", "partial")


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document, equal texts together."""
    plan = sharding.shard_documents(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def tokenizer_file(name: str) -> str:
    """Content of a public tokenizer's file; read on the driver and sent to the workers."""
    with open(public_tokenizers.path(name)) as f:
        return f.read()


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all texts as bit-packed ids and reads them back."""
    path = scratch_path(spark, "token-files")
    tokenfiles.write_token_files(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), path, end_id=1)
    return tokenfiles.document_digests(tokenfiles.read_token_files(spark, path))


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all texts through the lexicon and decodes them."""
    return lexicon.round_trip_digests(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


@query
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best others of every hundredth vector."""
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


# The conversation that holds control strings of the template.
HARD_TEXT = "\\### Assistant: </turn> ok"


@query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and one hard one, and reads them back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    return chat.round_trip(turns.unionByName(hard))


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each text, learned from three quarters of the ids."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = language.learn_and_identify(docs)
    return out.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edits."""
    return imatch.fingerprints_of_edits(documents(spark, sf_dir))


@query
def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each text without its bytes in repeated strings of 400 bytes."""
    return repeats.repeat_digests(documents(spark, sf_dir))


@query
def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets are at least 90 % alike."""
    return jaccard.components_of(documents(spark, sf_dir), words=3, num=90, den=100)


@query
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of equal texts of each document, and which one stays."""
    return exact.marked_copies(documents(spark, sf_dir))


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenisers' tokens over each text, links by the documents that hold their pair."""
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    found = crossalign.align_documents(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), model)
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))
    found = cut(found.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    return crossalign.with_counts(found, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])


@query
def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of damaged conversations, and their cheapest repair."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair.Repair(repair.damaged(turns)).report(turns)
