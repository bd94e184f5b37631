"""Bytes of the messages that regions and the coordinator would exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.measures import BYTES_PER_INTEGER, cost
from ..plans.reports import gather_bytes
from .mining import Mined, maximal
from .stitching import Stitched


def first_level(sightings: DataFrame, regions: DataFrame) -> DataFrame:
    """region_id, integers, n_bytes, cost of what a region's edges send to it: an edge's id and its objects."""
    total = sightings.join(regions, "edge_id").groupBy("region_id").agg((F.countDistinct("edge_id") + F.countDistinct("edge_id", "obj_id")).alias("integers"))
    n_bytes = F.col("integers") * BYTES_PER_INTEGER
    return total.select("region_id", "integers", n_bytes.alias("n_bytes"), cost(n_bytes).alias("cost"))


def gathered(per_region: DataFrame, ready: DataFrame) -> DataFrame:
    """n_regions, integers, n_bytes, in total, of the regions that have a path: what the coordinator asks of them alone."""
    own = per_region.join(ready.select("region_id").distinct(), "region_id", "left_semi")
    return own.agg(F.count("*").alias("n_regions"), F.coalesce(F.sum("integers"), F.lit(0)).alias("integers"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"))


def sketch_first_level(sketches: DataFrame, regions: DataFrame) -> DataFrame:
    """region_id, integers, n_bytes, cost of the signatures that a region sends: an edge's id, its count and its values."""
    total = sketches.join(regions, "edge_id").groupBy("region_id").agg(F.sum(2 + F.size("sig")).alias("integers"))
    n_bytes = F.col("integers") * BYTES_PER_INTEGER
    return total.select("region_id", "integers", n_bytes.alias("n_bytes"), cost(n_bytes).alias("cost"))


def _listed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """JSON length of the list of a group's objects, without gathering it."""
    return rows.groupBy(*keys).agg((F.sum(F.octet_length(F.col("obj_id").cast("string"))) + 2 * (F.count("*") - 1) + 2).alias("n"))


def message_bytes(mined: Mined, stitched: Stitched, sightings: DataFrame, regions: DataFrame) -> DataFrame:
    """message, n_messages, n_bytes.

    paths: the levels of every ready region; objects: a ready region's objects as
    the text of a set; path_objects: the objects of p1 for every candidate; edge_objects:
    the objects of every edge of p2 that is looked at (all that pass and the first that fails).
    """
    best = maximal(mined.paths).select("region_id", "level", "path")
    singles = mined.paths.where("level = 1")
    paths = gather_bytes(best.unionByName(singles.select("region_id", F.lit(0).alias("level"), "path"))).withColumnRenamed("n_bytes", "n")
    own = sightings.join(regions, "edge_id").join(singles.select("region_id").distinct(), "region_id", "left_semi").select("region_id", "obj_id").distinct()
    objects = _listed(own, ["region_id"]).withColumn("n", F.col("n") + 2)
    p1 = _listed(mined.occurrences, ["region_id", "path"]).select(F.col("region_id").alias("region_a"), F.col("path").alias("p1"), "n")
    asked = stitched.candidates.join(p1, ["region_a", "p1"])
    passed = stitched.spans.select("region_a", "p1", "region_b", "p2", "n_edges")
    looked = stitched.candidates.join(passed, ["region_a", "p1", "region_b", "p2"], "left").select(
        F.explode(F.expr("slice(p2, 1, least(size(p2), coalesce(n_edges, 0) + 1))")).alias("edge_id"))
    edges = looked.join(_listed(sightings.select("edge_id", "obj_id").distinct(), ["edge_id"]), "edge_id")
    total = lambda df, name: df.agg(F.count("*").alias("n_messages"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_bytes")).select(F.lit(name).alias("message"), "n_messages", "n_bytes")
    return total(paths, "paths").union(total(objects, "objects")).union(total(asked, "path_objects")).union(total(edges, "edge_objects"))
