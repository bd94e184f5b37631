"""The road network: geometry, weights, numbering and connectivity of directed edges."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..plans.store import ranked

#: Edge numbers that are never given out, and the number before the first one.
RESERVED = (1, 112, 122, 212, 222)
FIRST = 2
SCALE = 100_000_000


def number_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """Adds edge_id: 3, 4, ... in the given order; a reserved number is passed over once."""
    numbered = ranked(edges, *order, name="edge_id").withColumn("edge_id", F.col("edge_id") + FIRST)
    for taken in sorted(r for r in RESERVED if r > FIRST):
        numbered = numbered.withColumn("edge_id", F.when(F.col("edge_id") >= taken, F.col("edge_id") + 1).otherwise(F.col("edge_id")))
    return numbered


def midpoints(edges: DataFrame) -> DataFrame:
    return edges.select("edge_id", ((F.col("x1") + F.col("x2")) / 2).alias("mid_x"), ((F.col("y1") + F.col("y2")) / 2).alias("mid_y"))


def bounds(edges: DataFrame) -> dict[str, float]:
    """Extent of all end points (one row, read by the driver)."""
    return edges.agg(F.min(F.least("x1", "x2")).alias("min_x"), F.max(F.greatest("x1", "x2")).alias("max_x"),
                     F.min(F.least("y1", "y2")).alias("min_y"), F.max(F.greatest("y1", "y2")).alias("max_y")).first().asDict()


def edge_weights(edges: DataFrame) -> DataFrame:
    """Ring weight: 3 within 20 % of the extent from the centre on both axes, 2 within 40 %, 1 within 60 %, else 0."""
    b = bounds(edges)
    if b["min_x"] is None:
        return edges.select("edge_id", F.lit(0).alias("weight"))

    def away(axis: str):
        lo, hi = b[f"min_{axis}"], b[f"max_{axis}"]
        return F.try_divide(F.abs(F.col(f"mid_{axis}") - F.lit((hi + lo) / 2)), F.lit(float(hi - lo)))

    far = F.greatest(away("x"), away("y"))
    return midpoints(edges).select("edge_id", F.when(far <= 0.2, 3).when(far <= 0.4, 2).when(far <= 0.6, 1).otherwise(0).alias("weight"))


def rotate_nodes(nodes: DataFrame, degrees: float = -5.0) -> DataFrame:
    """Nodes (node_id, x, y) turned about the origin."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return nodes.select("node_id", (F.col("x") * c - F.col("y") * s).alias("x"), (F.col("x") * s + F.col("y") * c).alias("y"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return (edges.select(F.col("src").alias("node_id"), F.col("x1").alias("x"), F.col("y1").alias("y"))
            .union(edges.select("dst", "x2", "y2")).distinct())


def scaled(nodes: DataFrame) -> DataFrame:
    """Coordinates as integers, times 10^8, cut towards 0."""
    return nodes.select("node_id", (F.col("x") * SCALE).cast("long").alias("x"), (F.col("y") * SCALE).cast("long").alias("y"))


def connections(edges: DataFrame, compat_skip_first_edge: bool = False) -> DataFrame:
    """Edges and those that start where they end: edge_id, succ_id."""
    nxt = edges.select(F.col("edge_id").alias("succ_id"), F.col("src").alias("at"))
    if compat_skip_first_edge:
        first = edges.agg(F.min("edge_id")).first()[0]
        nxt = nxt.where(F.col("succ_id") != F.lit(first))
    return edges.select("edge_id", F.col("dst").alias("at")).join(nxt, "at").select("edge_id", "succ_id")


def central_edges(edges: DataFrame, share: float = 0.08) -> DataFrame:
    """The share of edges (at least one) nearest to the mean end point: edge_id, distance; ties by edge_id."""
    n = edges.count()
    mean = edges.agg(F.avg((F.col("x1") + F.col("x2")) / 2).alias("x"), F.avg((F.col("y1") + F.col("y2")) / 2).alias("y")).first()
    if not n:
        return edges.select("edge_id", F.lit(0.0).alias("distance"))
    d = F.pow(F.pow(F.col("mid_x") - F.lit(mean.x), 2) + F.pow(F.col("mid_y") - F.lit(mean.y), 2), F.lit(0.45))
    return midpoints(edges).select("edge_id", d.alias("distance")).orderBy("distance", "edge_id").limit(max(1, int(share * n)))
