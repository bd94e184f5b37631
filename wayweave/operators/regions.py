"""Recursive split of the map into regions, and what belongs to each."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def side(split: str) -> str:
    """1 or 2: the side of an edge; one that crosses follows its farther end, the first on a tie."""
    far = f"if(abs(x1 - {split}) >= abs(x2 - {split}), if(x1 > x2, 2, 1), if(x2 > x1, 2, 1))"
    return f"case when x1 <= {split} and x2 <= {split} then 1 when x1 > {split} and x2 > {split} then 2 else {far} end"


def partition(edges: DataFrame, depth: int) -> DataFrame:
    """edges with region_id: the path of sides, then the depth (10 for depth 0).

    Every part is halved at the middle of its own x extent; the bounds of a level
    are at most 2^depth rows.
    """
    parts = edges.withColumn("part", F.lit(0).cast("long"))
    for _ in range(depth):
        mid = parts.groupBy("part").agg(((F.min(F.least("x1", "x2")) + F.max(F.greatest("x1", "x2"))) / 2).alias("split"))
        parts = parts.join(F.broadcast(mid), "part").withColumn("part", F.col("part") * 10 + F.expr(side("split"))).drop("split")
    return parts.withColumn("region_id", (F.col("part") * 10 + depth).cast("int") if depth else F.lit(10)).drop("part")


def edge_region(parted: DataFrame) -> DataFrame:
    return parted.select("edge_id", "region_id")


def regional(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows of a region's edges with their region_id."""
    return rows.join(regions, "edge_id")


def borders(connections: DataFrame, regions: DataFrame) -> DataFrame:
    """Connections that lead into another region: region_a, region_b, edge_id, succ_id."""
    a, b = regions.withColumnRenamed("region_id", "region_a"), regions.select(F.col("edge_id").alias("succ_id"), F.col("region_id").alias("region_b"))
    return connections.join(a, "edge_id").join(b, "succ_id").where("region_a <> region_b").select("region_a", "region_b", "edge_id", "succ_id")
