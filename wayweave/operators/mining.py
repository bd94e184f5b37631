"""Level-wise mining of connected edge chains that a share of a region's objects travels, exactly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..plans.store import cut, small


@dataclass(frozen=True)
class Mined:
    """paths: region_id, level, path, support, n_objects, ratio; occurrences: region_id, path, obj_id."""

    paths: DataFrame
    occurrences: DataFrame


def check_threshold(threshold: float) -> None:
    if not 0.01 < threshold <= 1:
        raise ValueError("the threshold must lie between 0.01 and 1")


def region_objects(sightings: DataFrame, regions: DataFrame) -> DataFrame:
    """region_id, n_objects, n_edges (with an object), objects_per_edge."""
    own = sightings.join(regions, "edge_id")
    return own.groupBy("region_id").agg(F.countDistinct("obj_id").alias("n_objects"), F.countDistinct("edge_id").alias("n_edges")).withColumn(
        "objects_per_edge", F.col("n_objects") / F.col("n_edges"))


def hot_edges(sightings: DataFrame, regions: DataFrame, threshold: float) -> DataFrame:
    """Edges whose objects are at least the threshold of the region's: region_id, edge_id, support, n_objects, ratio."""
    check_threshold(threshold)
    own = sightings.join(regions, "edge_id").select("region_id", "edge_id", "obj_id").distinct()
    total = own.groupBy("region_id").agg(F.countDistinct("obj_id").alias("n_objects"))
    count = own.groupBy("region_id", "edge_id").agg(F.count("*").alias("support"))
    out = count.join(total, "region_id").withColumn("ratio", F.col("support") / F.col("n_objects"))
    return out.where(F.col("ratio") >= threshold)


def mine(sightings: DataFrame, regions: DataFrame, connections: DataFrame, threshold: float, max_level: int = 100) -> Mined:
    """All chains, level by level, until none is left or max_level.

    Support is kept as rows (path, obj_id), so that a level is two equi-joins and
    a count, whatever the number of objects; paths are broadcast up to a counted number; a chain may not return to one of
    its edges, except to stay on a self-loop.
    """
    own = cut(sightings.join(regions, "edge_id").select("region_id", "edge_id", "obj_id").distinct())
    total = cut(own.groupBy("region_id").agg(F.countDistinct("obj_id").alias("n_objects")))
    hot = cut(hot_edges(own.select("edge_id", "obj_id"), regions, threshold))
    marks = own.join(small(hot.select("region_id", "edge_id")), ["region_id", "edge_id"], "left_semi")
    occ = cut(marks.select("region_id", F.array("edge_id").alias("path"), "obj_id"))
    level = hot.select("region_id", F.lit(1).alias("level"), F.array("edge_id").alias("path"), "support", "n_objects", "ratio")
    paths, occurrences = level, occ
    follow = connections.select(F.col("edge_id").alias("tail"), F.col("succ_id").alias("succ"))
    warm = hot.select("region_id", F.col("edge_id").alias("succ"))
    seen = marks.select("region_id", F.col("edge_id").alias("succ"), "obj_id")
    for n in range(2, max_level + 1):
        grown = level.select("region_id", "path", F.element_at("path", -1).alias("tail")).join(follow, "tail").join(warm, ["region_id", "succ"])
        grown = grown.where("succ = tail or not array_contains(path, succ)").select("region_id", "path", "succ")
        if n > 2:  # support falls with length: a chain can't hold unless its end of the same length does
            ends = level.select("region_id", F.col("path").alias("end"))
            grown = grown.withColumn("end", F.concat(F.expr("slice(path, 2, size(path) - 1)"), F.array("succ"))).join(small(ends), ["region_id", "end"], "left_semi").drop("end")
        grown = cut(grown)
        new = occ.join(small(grown), ["region_id", "path"]).join(seen, ["region_id", "succ", "obj_id"])
        new = cut(new.select("region_id", F.concat("path", F.array("succ")).alias("path"), "obj_id"))
        level = cut(
            new.groupBy("region_id", "path").agg(F.count("*").alias("support")).join(total, "region_id")
            .withColumn("ratio", F.col("support") / F.col("n_objects")).where(F.col("ratio") >= threshold)
            .select("region_id", F.lit(n).alias("level"), "path", "support", "n_objects", "ratio"))
        if level.isEmpty():
            break
        occ = new.join(small(level.select("region_id", "path")), ["region_id", "path"], "left_semi")
        paths, occurrences = paths.unionByName(level), occurrences.unionByName(occ)
    return Mined(paths, occurrences)


def maximal(paths: DataFrame) -> DataFrame:
    """Paths that are neither the start nor the end of a path one longer."""
    longer = paths.where("level >= 2")
    parts = longer.select("region_id", F.slice("path", 1, F.size("path") - 1).alias("path")).union(
        longer.select("region_id", F.expr("slice(path, 2, size(path) - 1)"))).distinct()
    return paths.join(parts, ["region_id", "path"], "left_anti")


def ready_regions(hot: DataFrame) -> DataFrame:
    """Regions with a hot edge."""
    return hot.select("region_id").distinct()
