"""Joining paths across region borders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..plans.store import cut, small
from .mining import Mined, maximal

_KEY = ["region_a", "p1", "region_b", "p2"]


@dataclass(frozen=True)
class Stitched:
    """candidates, prefixes (count and ratio of every prefix), spans, remainders, absorbed, local."""

    candidates: DataFrame
    spans: DataFrame
    remainders: DataFrame
    absorbed: DataFrame
    local: DataFrame


def common_objects(sightings: DataFrame, regions: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """region_a, region_b, n_common for ordered pairs of regions that share objects (of the given pairs, if any)."""
    own = sightings.join(regions, "edge_id").select("region_id", "obj_id").distinct()
    first, other = own.withColumnRenamed("region_id", "region_a"), own.select(F.col("region_id").alias("region_b"), "obj_id")
    if pairs is not None:
        met = first.join(small(pairs.select("region_a", "region_b").distinct()), "region_a").join(other, ["region_b", "obj_id"])
    else:
        met = first.join(other, "obj_id")
    return met.where("region_a <> region_b").groupBy("region_a", "region_b").agg(F.count("*").alias("n_common"))


def candidates(best: DataFrame, border: DataFrame) -> DataFrame:
    """Pairs of maximal paths whose ends meet at a border."""
    a = best.select(F.col("region_id").alias("region_a"), F.col("path").alias("p1"), F.element_at("path", -1).alias("edge_id"))
    b = best.select(F.col("region_id").alias("region_b"), F.col("path").alias("p2"), F.element_at("path", 1).alias("succ_id"))
    return a.join(border, ["region_a", "edge_id"]).join(b, ["region_b", "succ_id"]).select(*_KEY).distinct()


def stitch(mined: Mined, sightings: DataFrame, regions: DataFrame, border: DataFrame, threshold: float) -> Stitched:
    """For every candidate the longest prefix of p2 that keeps the threshold of the two regions' common objects.

    An object's reach into p2 is the number of leading edges it was seen on; the
    objects of a prefix are those that reach it, so counts fall with length and the
    longest passing prefix is the greatest passing length.
    """
    best = cut(maximal(mined.paths).where("level >= 1"))
    pairs = cut(candidates(best, border))
    n_common = common_objects(sightings, regions, border)
    objs = mined.occurrences.select(F.col("region_id").alias("region_a"), F.col("path").alias("p1"), "obj_id")
    steps = pairs.select(*_KEY, F.posexplode("p2").alias("at", "edge_id"))
    seen = objs.join(small(steps), ["region_a", "p1"]).join(sightings.distinct(), ["edge_id", "obj_id"])
    reach = seen.groupBy(*_KEY, "obj_id").agg(F.sort_array(F.collect_set("at")).alias("at")).withColumn(
        "reach", F.expr("size(filter(transform(at, (x, i) -> x = i), ok -> ok))")).where("reach > 0")
    held = reach.select(*_KEY, F.explode(F.sequence(F.lit(1), F.col("reach"))).alias("n")).groupBy(*_KEY, "n").agg(F.count("*").alias("n_objects"))
    passed = held.join(n_common, ["region_a", "region_b"]).withColumn("ratio", F.try_divide("n_objects", "n_common")).where(F.col("ratio") >= threshold)
    longest = passed.groupBy(*_KEY).agg(F.max(F.struct("n", "n_objects", "ratio")).alias("m")).select(*_KEY, "m.*")
    return _assembled(best, pairs, longest)


def stitch_sketch(paths: DataFrame, sketches: DataFrame, border: DataFrame, k: int, threshold: float) -> Stitched:
    """The same on signatures: of p1's surviving values (k at most) those that also survive p2's edges, as a share of k.

    A candidate's signatures are at most its edges times k values.
    """
    best = cut(maximal(paths).where("level >= 1"))
    pairs = cut(candidates(best, border))
    steps = pairs.select(*_KEY, F.posexplode(F.concat("p1", "p2")).alias("at", "edge_id")).join(small(sketches.select("edge_id", "sig")), "edge_id", "left")
    listed = steps.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("sig", F.array().cast("array<bigint>")).alias("sig")))).alias("s")).select(*_KEY, F.col("s.sig").alias("sigs"))
    keep = "filter(a, v -> array_contains(x, v))"
    start = f"aggregate(slice(sigs, 2, size(p1) - 1), sigs[0], (a, x) -> {keep})"
    after = f"transform(sequence(1, size(p2)), n -> size(aggregate(slice(sigs, size(p1) + 1, n), start, (a, x) -> {keep})))"
    left = listed.withColumn("start", F.expr(start)).withColumn("left", F.expr(after))
    held = left.withColumn("n", F.expr(f"size(filter(left, c -> c / {float(k)!r}D >= {threshold!r}D))")).where("n > 0")  # what survives only falls
    longest = held.selectExpr(*_KEY, "n", "cast(left[n - 1] as bigint) as n_objects", f"left[n - 1] / {float(k)!r}D as ratio")
    return _assembled(best, pairs, longest)


def _assembled(best: DataFrame, pairs: DataFrame, longest: DataFrame) -> Stitched:
    """All results of the longest passing prefixes (n edges of p2)."""
    spans = cut(longest.select(
        *_KEY, F.col("n").alias("n_edges"), "n_objects", "ratio", F.concat("p1", F.expr("slice(p2, 1, n)")).alias("path"),
        F.when(F.col("n") == F.size("p2"), "span_full").otherwise("span_partial").alias("kind")))
    remainders = spans.where("kind = 'span_partial'").select(*_KEY, F.expr("filter(p2, x -> not array_contains(slice(p2, 1, n_edges), x))").alias("path"))
    absorbed = spans.select("region_b", "p2").distinct()
    by_region = best.groupBy("region_id").agg(F.count("*").alias("own"))
    every = by_region.agg(F.sum("own")).first()[0] or 0
    met = pairs.groupBy("region_a", "p1").agg(F.count("*").alias("met"))
    local = (best.select(F.col("region_id").alias("region_a"), F.col("path").alias("p1")).join(by_region.withColumnRenamed("region_id", "region_a"), "region_a")
             .join(met, ["region_a", "p1"], "left").where(F.coalesce("met", F.lit(0)) < F.lit(every) - F.col("own")).select("region_a", "p1"))
    return Stitched(pairs, spans, remainders, absorbed, local)


def catalog(s: Stitched) -> DataFrame:
    """All entries of the coordinator's catalog: region_a, region_b, path, kind."""
    none = F.lit(None).cast("int")
    rows = [
        s.spans.select("region_a", "region_b", "path", "kind"),
        s.remainders.select("region_a", "region_b", "path", F.lit("remainder").alias("kind")),
        s.absorbed.select(F.col("region_b").alias("region_a"), none.alias("region_b"), F.col("p2").alias("path"), F.lit("absorbed").alias("kind")),
        s.local.select("region_a", none.alias("region_b"), F.col("p1").alias("path"), F.lit("local").alias("kind")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.distinct()
