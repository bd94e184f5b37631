"""Lineage cuts for iterative plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window, functions as F


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in reliable storage (spark.checkpoint.dir; a temporary folder only in local mode where that is unset)."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="wayweave-"))
    return df.checkpoint()


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Broadcast df if a count proves that it has at most `rows` rows; else leave the join to a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def ranked(df: DataFrame, *order: str, name: str = "nth") -> DataFrame:
    """df with its rows' numbers 1, 2, ... in the given order, without sorting all rows in one task.

    Rows are dealt by ranges; only the ranges' counts are added up in one place.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    counts = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__range", before.alias("__start"))  # one row for each range
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__at", within).join(F.broadcast(starts), "__range").withColumn(name, (F.col("__start") + F.col("__at")).cast("long")).drop("__range", "__at", "__start")
