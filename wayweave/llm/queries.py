"""The registered query of each corpus operator, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bagminhash, byteconv, chat, edit_embedding, feistel, hash_tree, licences, mixing, paragraphs, text, winnow
from .frames import table


def op7_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = winnow.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return report.select("doc_id", "n_words", "n_hit", "n_items",
                         F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op1_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.fingerprints_and_classes(table(spark, sf_dir, "documents"))


def op2_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.assign(table(spark, sf_dir, "documents"))


def op4_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.duplicate_classes(table(spark, sf_dir, "documents"))


def op5_byte_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    text.small_batches(spark)
    guess = byteconv.predict("text", byteconv.fit(documents))
    return documents.select("doc_id", byteconv.held_out().alias("held_out"), guess.alias("guess")).select(
        "doc_id", "held_out", F.col("guess.lang").alias("lang_pred"), F.col("guess.score").alias("score"))


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel.pseudonyms(table(spark, sf_dir, "documents"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op8_temperature_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated(table(spark, sf_dir, "documents")).drop("version")


def op10_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_turns(chat.probe(table(spark, sf_dir, "conversations"))))


QUERIES = {f.__name__: f for f in (
    op1_edit_embedding, op2_weighted_hash_tree, op3_feistel_pseudonyms, op4_bagminhash, op5_byte_convolution, op6_licence_scan,
    op7_winnowing_decontamination, op8_temperature_mixture, op9_repeated_passages, op10_chat_round_trip,
)}
