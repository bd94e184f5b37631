"""The registered queries of the engine, over networks derived from the generic tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.measures import bracketed, pair_code
from ..operators import costs, mining, motions, network, regions as rg, sketches as sk, stitching
from ..sources import fixtures as fx
from ..streaming import live
from . import reports, sweep
from .store import cut

HOT, PATHS, PAIRS, LEVELS = 0.50, 0.10, 0.25, 4
K, SEED = 32, 1
SWEEP = [0.10, 0.15, 0.25, 0.30]
OBJECTS = [10, 50]
TARGETS = [16.0, 8.0]
STREET = 0.06


def _path(c: str = "path"):
    return F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",").alias(c)


def _regions(spark: SparkSession, depth: int) -> DataFrame:
    return rg.edge_region(rg.partition(fx.grid_edges(spark), depth))


def _mined(spark: SparkSession, d: str, depth: int = 0, threshold: float = PATHS, levels: int = LEVELS) -> mining.Mined:
    edges = fx.grid_edges(spark)
    return mining.mine(fx.grid_sightings(spark, d), _regions(spark, depth), network.connections(edges), threshold, levels)


def hot_edges(spark, d):
    out = mining.hot_edges(fx.grid_sightings(spark, d), _regions(spark, 0), HOT)
    return out.select("edge_id", "support", "n_objects", "ratio")


def lane_hot_edges(spark, d):
    lanes = fx.lane_edges(spark, d)
    out = mining.hot_edges(fx.lane_sightings(spark, d), lanes.select("edge_id", F.lit(10).alias("region_id")), 0.6)
    return out.select("edge_id", "support", "n_objects", "ratio")


def lane_connections(spark, d):
    return network.connections(fx.lane_edges(spark, d))


def lane_paths(spark, d):
    lanes = fx.lane_edges(spark, d)
    found = mining.mine(fx.lane_sightings(spark, d), lanes.select("edge_id", F.lit(10).alias("region_id")), network.connections(lanes), 0.45, 3)
    return found.paths.select("level", _path(), "support", "ratio")


def connections(spark, d):
    return network.connections(fx.grid_edges(spark))


def edge_weights(spark, d):
    return network.edge_weights(fx.grid_edges(spark))


def edge_midpoints(spark, d):
    return network.midpoints(fx.grid_edges(spark))


def rotate_nodes(spark, d):
    out = network.rotate_nodes(network.nodes_of(fx.grid_edges(spark)))
    return out.select("node_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def central_topk(spark, d):
    return network.central_edges(fx.grid_edges(spark)).select("edge_id", F.round("distance", 6).alias("distance"))


def grid_motions(spark, d):
    return fx.grid_motions(spark, d)


def sightings_by_edge(spark, d):
    return motions.sightings_by_edge(motions.invert(fx.grid_motions(spark, d)))


def partition_d0(spark, d):
    return _regions(spark, 0)


def partition_d1(spark, d):
    return _regions(spark, 1)


def partition_d2(spark, d):
    return _regions(spark, 2)


def regional_connections(spark, d):
    return rg.regional(network.connections(fx.grid_edges(spark)), _regions(spark, 1)).select("region_id", "edge_id", "succ_id")


def borders(spark, d):
    return rg.borders(network.connections(fx.grid_edges(spark)), _regions(spark, 2))


def region_objects(spark, d):
    return mining.region_objects(fx.grid_sightings(spark, d), _regions(spark, 2))


def pairs(spark, d):
    return _mined(spark, d, 0, PAIRS, 2).paths.where("level = 2").select(_path(), "support", "ratio")


def triples(spark, d):
    return _mined(spark, d, 0, PATHS, 3).paths.where("level = 3").select(_path(), "support", "ratio")


def paths_all(spark, d):
    return _mined(spark, d).paths.select("level", _path(), "support", "ratio")


def paths_maximal(spark, d):
    return mining.maximal(_mined(spark, d).paths).select("level", _path(), "support")


def paths_by_level(spark, d):
    return _mined(spark, d).paths.groupBy("level").agg(F.count("*").alias("n_paths"))


def region_paths(spark, d):
    return _mined(spark, d, 1).paths.select("region_id", "level", _path(), "support", "ratio")


def region_ready(spark, d):
    return mining.ready_regions(mining.hot_edges(fx.grid_sightings(spark, d), _regions(spark, 2), HOT))


def distinct_path_edges(spark, d):
    return _mined(spark, d).paths.where("level >= 2").select(F.explode("path").alias("edge_id")).distinct()


def _stitched(spark, d) -> stitching.Stitched:
    regions = _regions(spark, 1)
    links, seen = network.connections(fx.grid_edges(spark)), fx.grid_sightings(spark, d)
    return stitching.stitch(_mined(spark, d, 1), seen, regions, rg.borders(links, regions), PATHS)


def region_common_objects(spark, d):
    return stitching.common_objects(fx.grid_sightings(spark, d), _regions(spark, 1))


def span_candidates(spark, d):
    return _stitched(spark, d).candidates.select("region_a", _path("p1"), "region_b", _path("p2"))


def span_paths(spark, d):
    return _stitched(spark, d).spans.select("region_a", "region_b", _path("p1"), _path("p2"), "kind", "n_objects", "ratio", _path("path"))


def span_paths_sketch(spark, d):
    found = sweep.run(fx.grid_edges(spark), fx.grid_sightings(spark, d), sweep.RunConfig(PATHS, 1, 2, K, SEED)).stitched.spans
    return found.select("region_a", "region_b", _path("p1"), _path("p2"), "kind", "n_objects", "ratio", _path("path"))


def object_sweep(spark, d):
    return sweep.object_sweep(fx.grid_edges(spark), fx.grid_sightings(spark, d), [0.15, 0.30], OBJECTS, 0, 1)


def level_reached(spark, d):
    return _mined(spark, d, 1).paths.groupBy("region_id").agg(F.max("level").alias("greatest_level"))


def sketch_first_level_bytes(spark, d):
    return costs.sketch_first_level(_sketches(spark, d), _regions(spark, 2))


def numbered_edges(spark, d):
    return network.number_edges(fx.grid_edges(spark).select(F.col("edge_id").alias("old_id"), "src", "dst"), ["src", "dst", "old_id"]).select("old_id", "edge_id")


def scaled_nodes(spark, d):
    return network.scaled(network.nodes_of(fx.grid_edges(spark)))


def connections_skipping_first(spark, d):
    return network.connections(fx.grid_edges(spark), compat_skip_first_edge=True)


def span_remainders(spark, d):
    return _stitched(spark, d).remainders.select("region_a", "region_b", _path("p1"), _path("p2"), _path("path"))


def absorbed_paths(spark, d):
    return _stitched(spark, d).absorbed.select("region_b", _path("p2"))


def path_catalog_counts(spark, d):
    return stitching.catalog(_stitched(spark, d)).groupBy("kind").agg(F.count("*").alias("n_entries"))


def span_counts(spark, d):
    spans = _stitched(spark, d).spans
    return spans.groupBy("kind").agg(F.count("*").alias("n_spans"), F.countDistinct("region_a", "region_b", "path").alias("n_distinct_spans"))


def _sketches(spark, d) -> DataFrame:
    return sk.minhash(fx.grid_sightings(spark, d), K, SEED)


def minhash_signatures(spark, d):
    return _sketches(spark, d).select("edge_id", "n_raw", _path("sig"))


def cohen_by_region(spark, d):
    return sk.cohen(_sketches(spark, d).join(_regions(spark, 2), "edge_id"), ["region_id"], K)


def union_signature(spark, d):
    return sk.union_signature(_sketches(spark, d).join(_regions(spark, 1), "edge_id"), ["region_id"])


def hot_edges_sketch(spark, d):
    return sk.hot_edges_sketch(_sketches(spark, d), _regions(spark, 0), K, HOT).select("edge_id", "n_raw", "estimate", "ratio")


def pairs_sketch(spark, d):
    found = sk.mine_sketch(_sketches(spark, d), _regions(spark, 0), network.connections(fx.grid_edges(spark)), K, PAIRS, 2)
    return found.where("level = 2").select(_path(), "ratio")


def hot_edges_override(spark, d):
    seen, regions = fx.grid_sightings(spark, d), _regions(spark, 0)
    return sk.hot_edges_sketch(_sketches(spark, d), regions, K, HOT, mining.hot_edges(seen, regions, HOT)).select("edge_id", "n_raw")


def sketch_accuracy(spark, d):
    links, regions = network.connections(fx.grid_edges(spark)), _regions(spark, 0)
    return sweep.sketch_accuracy(_mined(spark, d, 0, PAIRS, 2).paths, sk.mine_sketch(_sketches(spark, d), regions, links, K, PAIRS, 2))


def first_level_bytes(spark, d):
    return costs.first_level(fx.grid_sightings(spark, d), _regions(spark, 2))


def gathered_first_level(spark, d):
    seen, regions = fx.grid_sightings(spark, d), _regions(spark, 2)
    return costs.gathered(costs.first_level(seen, regions), mining.hot_edges(seen, regions, HOT))


def gathered_sketch_level(spark, d):
    regions, sketches = _regions(spark, 2), _sketches(spark, d)
    return costs.gathered(costs.sketch_first_level(sketches, regions), sk.hot_edges_sketch(sketches, regions, K, HOT))


def _gathered_paths(paths: DataFrame) -> DataFrame:
    paths = paths.select("region_id", "level", "path")
    return mining.maximal(paths).unionByName(paths.where("level = 1").withColumn("level", F.lit(0)))


def gather_bytes(spark, d):
    return reports.gather_bytes(_gathered_paths(_mined(spark, d, 1).paths))


def message_bytes(spark, d):
    regions, seen = _regions(spark, 1), fx.grid_sightings(spark, d)
    mined = _mined(spark, d, 1)
    joined = stitching.stitch(mined, seen, regions, rg.borders(network.connections(fx.grid_edges(spark)), regions), PATHS)
    return costs.message_bytes(mined, joined, seen, regions)


def compression_ratio(spark, d):
    return sk.compression(fx.grid_sightings(spark, d), K, SEED)


def permutation_search(spark, d):
    seen = fx.grid_sightings(spark, d)
    return spark.createDataFrame(sk.signature_lengths(seen, [256.0, 128.0, 64.0, 32.0, 16.0, 8.0, 4.0, 2.0], SEED), "target double, k long, ratio double")


def _heads(spark, d, depth: int) -> DataFrame:
    seen, regions = fx.grid_sightings(spark, d), _regions(spark, depth)
    return mining.region_objects(seen, regions).join(costs.first_level(seen, regions), "region_id")


def path_log_lines(spark, d):
    return reports.path_lines(mining.maximal(_mined(spark, d, 1).paths), _heads(spark, d, 1), PATHS, 100)


def path_log_rows(spark, d):
    rows = reports.path_rows(mining.maximal(_mined(spark, d, 1).paths), _heads(spark, d, 1), PATHS, 100)
    return rows.select("n_objects", "threshold", "edges", "k", "compress", "region_id", _path())


def single_log_lines(spark, d):
    return reports.path_lines(_mined(spark, d, 2, HOT, 1).paths, _heads(spark, d, 2), HOT, 100)


def pair_log_lines(spark, d):
    return reports.path_lines(_mined(spark, d, 1, PATHS, 2).paths.where("level = 2"), _heads(spark, d, 1), PATHS, 100)


def longer_log_lines(spark, d):
    return reports.path_lines(mining.maximal(_mined(spark, d, 1).paths).where("level >= 2"), _heads(spark, d, 1), PATHS, 100)


def cost_log_lines(spark, d):
    return reports.path_lines(mining.maximal(_mined(spark, d, 1).paths), _heads(spark, d, 1), PATHS, 100, with_costs=True)


def info_log_lines(spark, d):
    return reports.info_lines(_heads(spark, d, 2), HOT, 100)


def seed_log_line(spark, d):
    n = fx.grid_sightings(spark, d).select("obj_id").distinct().count()
    return reports.span_lines(_stitched(spark, d).spans, [n, PATHS, 100, -1, -1], SEED)


def _cost_head(spark, d) -> list:
    """N, bytes gathered, first-level bytes, threshold, edges, k, compress of the run at depth 1."""
    seen, regions = fx.grid_sightings(spark, d), _regions(spark, 1)
    mined = _mined(spark, d, 1)
    sent = reports.gather_bytes(_gathered_paths(mined.paths)).agg(F.sum("n_bytes")).first()[0] or 0
    first = costs.gathered(costs.first_level(seen, regions), mined.paths).first().n_bytes
    return [seen.select("obj_id").distinct().count(), sent, first, PATHS, 100, -1, -1]


def span_cost_line(spark, d):
    return reports.span_lines(_stitched(spark, d).spans, _cost_head(spark, d))


def edge_cost_line(spark, d):
    return reports.edge_lines(mining.maximal(_mined(spark, d, 1).paths), _cost_head(spark, d))


def result_report(spark, d):
    return reports.result_report(stitching.catalog(_stitched(spark, d)), PATHS)


def target_sweep(spark, d):
    return sweep.sweep(fx.grid_edges(spark), fx.grid_sightings(spark, d), [PAIRS, HOT], TARGETS, 0, 2, 64, SEED)


def _street_regions(spark, d) -> DataFrame:
    return rg.edge_region(rg.partition(fx.street_edges(spark, d), 2))


def street_edges(spark, d):
    return fx.street_edges(spark, d)


def street_connections(spark, d):
    return network.connections(fx.street_edges(spark, d))


def street_weights(spark, d):
    return network.edge_weights(fx.street_edges(spark, d))


def street_regions(spark, d):
    return _street_regions(spark, d)


def street_borders(spark, d):
    return rg.borders(network.connections(fx.street_edges(spark, d)), _street_regions(spark, d))


def street_hot_edges(spark, d):
    return mining.hot_edges(fx.street_sightings(spark, d), _street_regions(spark, d), STREET).select("region_id", "edge_id", "support", "n_objects", "ratio")


def street_pairs(spark, d):
    edges = fx.street_edges(spark, d)
    found = mining.mine(fx.street_sightings(spark, d), _street_regions(spark, d), network.connections(edges), STREET, 2).paths
    return found.select("region_id", "level", _path(), "support", "ratio")


def pair_codes(spark, d):
    found = _mined(spark, d, 0, PAIRS, 2).paths.where("level = 2")
    return found.select(_path(), pair_code(F.col("path")[0], F.col("path")[1]).alias("code"))


def pair_report(spark, d):
    found = cut(_mined(spark, d, 0, PAIRS, 2).paths.where("level = 2"))
    two = found.select(F.explode(F.array(F.lit(0.25), F.lit(0.28))).alias("threshold"), "path", "ratio").where("ratio >= threshold")
    pairs = two.select("threshold", F.lit(-1).alias("k"), bracketed("path").alias("pair"))
    top = spark.createDataFrame([(1, 0.25, -1, "first"), (2, 0.25, -1, "last"), (3, 0.28, -1, "only"), (4, 0.99, -1, "none")], "line_no long, threshold double, k int, head string")
    return reports.pair_report(top, pairs)


def threshold_sweep(spark, d):
    return sweep.threshold_sweep(fx.grid_edges(spark), fx.grid_sightings(spark, d), SWEEP, 1, 3)


def simulated_motions(spark, d):
    return motions.simulate(spark, fx.grid_edges(spark), 200, 8)


def live_edge_counts(spark, d):
    return live.edge_counts(live.passages(fx.read(spark, d, "events"))).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "edge_id", "n_objects")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    hot_edges, lane_hot_edges, lane_connections, lane_paths, connections, edge_weights, edge_midpoints, rotate_nodes, central_topk, grid_motions,
    sightings_by_edge, partition_d0, partition_d1, partition_d2, regional_connections, borders, region_objects, pairs, triples, paths_all, paths_maximal,
    paths_by_level, region_paths, region_ready, distinct_path_edges, region_common_objects, span_candidates, span_paths, span_paths_sketch, span_remainders, absorbed_paths,
    path_catalog_counts, span_counts, minhash_signatures, cohen_by_region, union_signature, hot_edges_sketch, pairs_sketch, hot_edges_override, sketch_accuracy,
    first_level_bytes, gathered_first_level, gathered_sketch_level, gather_bytes, message_bytes, compression_ratio, permutation_search, path_log_lines, path_log_rows, single_log_lines,
    pair_log_lines, longer_log_lines, cost_log_lines, info_log_lines, seed_log_line, span_cost_line, edge_cost_line, result_report, pair_codes, pair_report, threshold_sweep,
    target_sweep, object_sweep, level_reached, sketch_first_level_bytes, numbered_edges, scaled_nodes, connections_skipping_first,
    street_edges, street_connections, street_weights, street_regions, street_borders, street_hot_edges, street_pairs,
    simulated_motions, live_edge_counts,
)}
