"""Road networks and sightings derived from the generic tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Node steps of the four edges that leave a node of the 5 x 5 torus.
TORUS_STEPS = (1, 24, 5, 20)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid_edges(spark: SparkSession) -> DataFrame:
    """A 5 x 5 torus of 100 directed edges: edge_id, src, dst, x1, y1, x2, y2."""
    steps = F.array(*[F.lit(s) for s in TORUS_STEPS])
    nodes = spark.range(100).select(
        F.col("id").alias("edge_id"), (F.col("id") % 25).alias("src"),
        ((F.col("id") % 25 + F.element_at(steps, (F.floor(F.col("id") / 25) + 1).cast("int"))) % 25).alias("dst"))
    x, y = (lambda c: F.col(c) % 5 * 100), (lambda c: F.floor(F.col(c) / 5) * 100)
    return nodes.select("edge_id", "src", "dst", x("src").alias("x1"), y("src").alias("y1"), x("dst").alias("x2"), y("dst").alias("y2"))


def grid_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a passage: obj_id, edge_id, ts, event_id."""
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("obj_id"), F.get_json_object("props", "$.k").cast("long").alias("edge_id"), "ts", "event_id")


def grid_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_passages(spark, sf_dir).select("edge_id", "obj_id").distinct()


def grid_motions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each object's edges in order of time: obj_id, pos, edge_id."""
    order = Window.partitionBy("obj_id").orderBy("ts", "event_id")
    return grid_passages(spark, sf_dir).select("obj_id", F.row_number().over(order).alias("pos"), "edge_id")


def lane_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes from supplier region to customer region, self-loops included: edge_id, src, dst."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: k.cast("long"))
    src = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("src"))
    return src.select("src", F.explode(keys).alias("dst")).select((5 * F.col("src") + F.col("dst") + 3).alias("edge_id"), "src", "dst")


def lane_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts were shipped on which lane."""
    nation = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("r"))
    customers = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r").alias("cr"))
    suppliers = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r").alias("sr"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    joined = (lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
              .join(customers, F.col("o_custkey") == F.col("c_custkey")))
    return joined.select((5 * F.col("sr") + F.col("cr") + 3).alias("edge_id"), F.col("l_partkey").alias("obj_id")).distinct()


def street_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lattice with a node for each part and edges to its right and upper neighbours, so that it grows with the tables: edge_id, src, dst, x1, y1, x2, y2."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"))
    side = math.isqrt(max(parts.count() - 1, 0)) + 1
    column, row = F.col("src") % side, F.floor(F.col("src") / side)
    ends = parts.select("src", column.alias("c"), row.alias("r"), F.explode(F.array(
        F.struct((column + 1).alias("c2"), row.alias("r2"), F.lit(0).alias("up"), (F.col("src") + 1).alias("dst")),
        F.struct(column.alias("c2"), (row + 1).alias("r2"), F.lit(1).alias("up"), (F.col("src") + side).alias("dst")))).alias("e")).select("src", "c", "r", "e.*")
    inside = ends.where(F.col("c2") < side).join(parts.select(F.col("src").alias("dst")), "dst", "left_semi")
    return inside.select((2 * F.col("src") + F.col("up") + 3).alias("edge_id"), "src", "dst", (F.col("c") * 100).alias("x1"), (F.col("r") * 100).alias("y1"),
                         (F.col("c2") * 100).alias("x2"), (F.col("r2") * 100).alias("y2"))


def street_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers on the streets that leave the parts they shipped."""
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("obj_id")).distinct()
    return lines.join(street_edges(spark, sf_dir).select("edge_id", "src"), F.col("l_partkey") == F.col("src")).select("edge_id", "obj_id")
