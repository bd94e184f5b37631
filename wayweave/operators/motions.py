"""Trajectories: lookup, inversion, and a seeded simulator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.store import cut, ranked
from .network import central_edges, connections


def motions_from_nodes(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge sequences from node sequences (obj_id, pos, node_id): parallel edges count as the one of the greatest id."""
    pair = edges.groupBy("src", "dst").agg(F.max("edge_id").alias("edge_id"))
    after = steps.select("obj_id", (F.col("pos") - 1).alias("pos"), F.col("node_id").alias("dst"))
    return steps.withColumnRenamed("node_id", "src").join(after, ["obj_id", "pos"]).join(pair, ["src", "dst"]).select("obj_id", "pos", "edge_id")


def invert(motions: DataFrame) -> DataFrame:
    """Distinct objects of every edge."""
    return motions.select("edge_id", "obj_id").distinct()


def sightings_by_edge(sightings: DataFrame) -> DataFrame:
    return sightings.groupBy("edge_id").agg(F.countDistinct("obj_id").alias("n_objects"))


def simulate(spark: SparkSession, edges: DataFrame, objects: int, length: int, seed: int = 1, central_share: float = 0.08, central_start: float = 0.8) -> DataFrame:
    """Walks of at most `length` edges: obj_id, pos, edge_id.

    The first int(central_start * objects) objects start on a central edge, the
    others anywhere. A walk heads away from the side it starts on (from the middle:
    left), takes an unvisited successor that heads that way if there is one, else
    any unvisited one, never the way back, and stops at a dead end. Choices are
    hashes of seed, object, step and edge.
    """
    draw = lambda *c: F.xxhash64(F.lit(seed), *c)
    every = ranked(edges.select("edge_id"), "edge_id")
    mid = ranked(central_edges(edges, central_share).select("edge_id"), "edge_id")
    n_every, n_mid = edges.count(), mid.count()
    draws = spark.range(objects).select(F.col("id").alias("obj_id"), (F.col("id") < int(central_start * objects)).alias("central"), draw(F.col("id"), F.lit(0)).alias("h"))
    picks = draws.select("obj_id", "central", (F.pmod("h", F.when(F.col("central"), F.lit(n_mid)).otherwise(F.lit(n_every)).cast("long")) + 1).alias("nth"))
    walk = picks.where("central").join(mid, "nth").select("obj_id", "edge_id").union(picks.where("not central").join(every, "nth").select("obj_id", "edge_id"))
    ext = edges.agg(((F.min(F.least("x1", "x2")) + F.max(F.greatest("x1", "x2"))) / 2).alias("m")).first().m
    shape = edges.select(F.col("edge_id").alias("e"), "src", "dst", "x1", "x2")
    now = walk.join(shape, walk.edge_id == shape.e).select(
        "obj_id", F.lit(1).alias("pos"), "edge_id", "src", "dst", F.when(F.col("x1") < ext, 1).otherwise(-1).alias("way"), F.array("src", "dst").alias("seen"))
    now = cut(now)
    found = now.select("obj_id", "pos", "edge_id")
    nxt = connections(edges).join(shape, F.col("succ_id") == F.col("e")).select("edge_id", "succ_id", F.col("src").alias("s"), F.col("dst").alias("d"), (F.col("x2") - F.col("x1")).alias("dx"))
    for pos in range(2, length + 1):
        go = now.join(nxt, "edge_id").where("d <> src and not array_contains(seen, d)")
        rank = F.struct(F.when(F.col("dx") * F.col("way") > 0, 0).otherwise(1).alias("off"), draw(F.col("obj_id"), F.lit(pos), F.col("succ_id")).alias("h"),
                        F.col("succ_id").alias("edge_id"), F.col("s").alias("src"), F.col("d").alias("dst"), "way", F.concat("seen", F.array("d")).alias("seen"))
        now = cut(go.groupBy("obj_id").agg(F.min(rank).alias("r")).select("obj_id", F.lit(pos).alias("pos"), "r.edge_id", "r.src", "r.dst", "r.way", "r.seen"))
        if now.isEmpty():
            break
        found = found.unionByName(now.select("obj_id", "pos", "edge_id"))
    return found
