"""The corpus pipeline: language, near duplicates, contamination, mixture, shards.

All stages but the last return rows of their input with its columns, extra ones
and such as bear an operator's own names included; an empty table gives an empty one. Very long texts
count whole. Equal rows are treated alike until the second stage keeps one of them.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from wayweave.llm import bagminhash, byteconv, hash_tree, mixing, winnow
from wayweave.llm.frames import settled, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go, null texts and such without a letter among them; null doc_ids stay."""
    return byteconv.known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the least doc_id, null last; on a tie the least hash of the text."""
    return bagminhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go; texts without words, and all if there is no benchmark item, stay."""
    return winnow.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight says; a null source is one of its own, texts without tokens go."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row; rows of one doc_id, or of none, share a shard."""
    return hash_tree.assign(docs)


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards),
]

#: A trained network and signatures decide the first two stages, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written and read back for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(spark, partial(stage, spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
