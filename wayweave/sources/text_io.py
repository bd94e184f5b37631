"""Text files of the data model: fixed and ragged comma-separated lines without headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.measures import bracketed
from ..plans.store import ranked

EDGES = "edge_id long, src long, dst long, x1 long, y1 long, x2 long, y2 long, weight int"


def read_edges(spark: SparkSession, path: str, weights: bool = True) -> DataFrame:
    return spark.read.schema(EDGES if weights else EDGES.removesuffix(", weight int")).csv(path)


def write_edges(edges: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").csv(path)


def write_region_maps(parted: DataFrame, path: str) -> None:
    """The edges of each region (edge_id ... y2, without weights) in a folder of its own, region_id=..."""
    columns = [c.split()[0] for c in EDGES.split(", ")][:-1]
    parted.select(*columns, "region_id").write.mode("overwrite").partitionBy("region_id").csv(path)


def _write_lines(lines: DataFrame, path: str, regions: DataFrame | None) -> None:
    """Lines (value, and the key edge_id where regions are given): one folder, or one for each region."""
    if regions is None:
        lines.select("value").write.mode("overwrite").text(path)
    else:
        lines.join(regions, "edge_id").select("value", "region_id").write.mode("overwrite").partitionBy("region_id").text(path)


def _ragged(spark: SparkSession, path: str) -> DataFrame:
    numbers = F.transform(F.split(F.trim("value"), ","), lambda x: x.try_cast("long"))
    return spark.read.text(path).where("trim(value) <> ''").select(numbers.alias("v"))


def read_ragged(spark: SparkSession, path: str, key: str, item: str, position: str | None = None, keep_empty: bool = True) -> DataFrame:
    """key, item rows (and 1-based position) of lines key,item,item,...; a bare key stays with a null item if keep_empty."""
    rest = F.expr("slice(v, 2, greatest(size(v) - 1, 0))")
    rows = _ragged(spark, path).select(F.col("v")[0].alias(key), (F.posexplode_outer if keep_empty else F.posexplode)(rest).alias("__pos", item))
    return rows.select(key, (F.col("__pos") + 1).alias(position), item) if position else rows.select(key, item)


def write_ragged(rows: DataFrame, path: str, key: str, item: str, position: str | None = None, regions: DataFrame | None = None) -> None:
    """Lines key,item,... in order of position (or of item); null items are left out. With regions (edge_id, region_id) and key edge_id, a folder for each region."""
    order = F.struct(F.col(position or item).alias("o"), F.col(item).alias("i"))
    listed = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col(item).isNotNull(), order))).alias("s"))
    text = F.concat_ws(",", F.col(key).cast("string"), F.transform(F.col("s.i"), lambda x: x.cast("string")))
    _write_lines(listed.select(key, text.alias("value")), path, regions)


def write_borders(border: DataFrame, path: str) -> None:
    """Lines edge,succ,... of the connections between each ordered pair of regions, in folders region_a=.../region_b=..."""
    listed = border.groupBy("region_a", "region_b", "edge_id").agg(F.sort_array(F.collect_set("succ_id")).alias("s"))
    text = F.concat_ws(",", F.col("edge_id").cast("string"), F.transform("s", lambda x: x.cast("string")))
    listed.select(text.alias("value"), "region_a", "region_b").write.mode("overwrite").partitionBy("region_a", "region_b").text(path)


def read_borders(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).select("region_a", "region_b", F.transform(F.split("value", ","), lambda x: x.try_cast("long")).alias("v"))
    return rows.select("region_a", "region_b", F.col("v")[0].alias("edge_id"), F.explode(F.expr("slice(v, 2, greatest(size(v) - 1, 0))")).alias("succ_id"))


def read_connections(spark: SparkSession, path: str) -> DataFrame:
    return read_ragged(spark, path, "edge_id", "succ_id")


def read_sightings(spark: SparkSession, path: str) -> DataFrame:
    return read_ragged(spark, path, "edge_id", "obj_id", keep_empty=False).distinct()


def read_motions(spark: SparkSession, path: str) -> DataFrame:
    return read_ragged(spark, path, "obj_id", "edge_id", position="pos", keep_empty=False)


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return _ragged(spark, path).selectExpr("v[0] as edge_id", "v[1] as n_raw", "slice(v, 3, greatest(size(v) - 2, 0)) as sig")


def write_sketches(sketches: DataFrame, path: str, regions: DataFrame | None = None) -> None:
    text = F.concat_ws(",", F.col("edge_id").cast("string"), F.col("n_raw").cast("string"), F.transform("sig", lambda x: x.cast("string")))
    _write_lines(sketches.select("edge_id", text.alias("value")), path, regions)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1, in order of file and place), value of the lines that aren't blank, without quotation marks."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
                                        F.monotonically_increasing_id().alias("__row"), F.regexp_replace("value", '"', "").alias("value"))
    return ranked(rows.where("trim(value) <> ''"), "__file", "__block", "__row", name="line_no").select("line_no", "value")


def read_top_log(spark: SparkSession, path: str) -> DataFrame:
    """line_no, threshold, k, head (the first eight fields) of the coordinator's cost log."""
    v = F.split("value", ",")
    return numbered_lines(spark, path).select("line_no", v[3].cast("double").alias("threshold"), v[5].cast("int").alias("k"), F.array_join(F.slice(v, 1, 8), ",").alias("head"))


def read_pair_log(spark: SparkSession, path: str) -> DataFrame:
    """threshold, k, pair of a log of pairs; a run without pairs keeps its row, with [0]."""
    found = read_path_log(spark, path, keep_empty=True)
    return found.select("threshold", F.col("k").cast("int").alias("k"), F.coalesce(bracketed("path"), F.lit("[0]")).alias("pair"))


def read_costs_log(spark: SparkSession, path: str) -> DataFrame:
    """line_no, n_bytes, cost, n_objects, threshold, edges, k, compress, region_id of a path log with costs."""
    v = F.split("value", ",")
    names = [("n_bytes", "long"), ("cost", "double"), ("n_objects", "long"), ("threshold", "double"), ("edges", "long"), ("k", "int"), ("compress", "int"), ("region_id", "int")]
    return numbered_lines(spark, path).select("line_no", *[v[i].cast(t).alias(n) for i, (n, t) in enumerate(names)])


def read_path_log(spark: SparkSession, path: str, keep_empty: bool = False) -> DataFrame:
    """n_objects, threshold, edges, k, compress, region_id, path rows of a path log ([0]: no path, or a null one if keep_empty)."""
    head = F.split(F.regexp_extract("value", r"^([^\[]*)", 1), ",")
    paths = F.regexp_extract_all("value", F.lit(r"\[([^\]]*)\]"), 1)
    rows = spark.read.text(path).select(F.regexp_replace("value", '"', "").alias("value")).select(
        head[0].cast("long").alias("n_objects"), head[1].cast("double").alias("threshold"), head[2].cast("long").alias("edges"),
        head[3].cast("long").alias("k"), head[4].cast("long").alias("compress"), head[5].cast("int").alias("region_id"), F.explode_outer(paths).alias("p"))
    path = F.when(F.col("p") != "0", F.transform(F.split("p", ","), lambda x: F.trim(x).try_cast("long")))
    out = rows.withColumn("path", path).drop("p")
    return out if keep_empty else out.where("path is not null")
