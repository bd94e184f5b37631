"""Run logs and reports: path lines, pair report, replay of signature lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.measures import bracketed, cost_text, list_json_length, pair_codes


def path_rows(paths: DataFrame, heads: DataFrame, threshold: float, n_edges: int, k: int = -1, compress: int = -1) -> DataFrame:
    """One row per path with its run's columns, and one with a null path per region without: n_objects, threshold, edges, k, compress, region_id, path.

    heads: region_id, n_objects of every region of the run. This form has no long rows, whatever the number of paths.
    """
    both = heads.select("region_id", "n_objects").join(paths.select("region_id", "path"), "region_id", "left")
    return both.select("n_objects", F.lit(threshold).alias("threshold"), F.lit(n_edges).alias("edges"), F.lit(k).alias("k"), F.lit(compress).alias("compress"), "region_id", "path")


def path_lines(paths: DataFrame, heads: DataFrame, threshold: float, n_edges: int, k: int = -1, compress: int = -1, with_costs: bool = False) -> DataFrame:
    """One log line per region of heads: N,threshold,edges,k,compress,region,[path],... ([0] without paths); heads' n_bytes and their cost go in front if with_costs.

    heads: region_id, n_objects (and n_bytes). The text format puts all paths of a region on one line; path_rows doesn't.
    """
    listed = paths.groupBy("region_id").agg(F.array_join(F.sort_array(F.collect_list(bracketed("path"))), ",").alias("paths"))
    text = lambda c: F.col(c).cast("string")
    line = F.concat_ws(",", *([text("n_bytes"), cost_text("n_bytes")] if with_costs else []), text("n_objects"), F.lit(repr(threshold)), F.lit(str(n_edges)),
                       F.lit(str(k)), F.lit(str(compress)), text("region_id"), F.coalesce("paths", F.lit("[0]")))
    return heads.join(listed, "region_id", "left").select("region_id", line.alias("line"))


def info_lines(heads: DataFrame, threshold: float, n_edges: int) -> DataFrame:
    """One line per region of heads (region_id, n_objects): edges, objects, objects to an edge, threshold."""
    ratio = (F.col("n_objects") / F.lit(n_edges)) if n_edges else F.lit(0)
    return heads.select("region_id", F.concat(F.lit(f"4_1. {n_edges},"), F.concat_ws(",", F.col("n_objects").cast("string"), ratio.cast("string"), F.lit(repr(threshold)))).alias("line"))


def span_lines(paths: DataFrame, head: list, seed: int | None = None) -> DataFrame:
    """One line of a run: head values, 0 for the coordinator, then its distinct paths; behind "seed;" if given one."""
    listed = paths.select("path").distinct().agg(F.sort_array(F.collect_list(bracketed("path"))).alias("paths"))
    start = ("" if seed is None else f"{seed};") + ",".join(str(h) for h in [*head, 0])
    return listed.select(F.array_join(F.concat(F.array(F.lit(start)), F.col("paths")), ",").alias("line"))


def edge_lines(paths: DataFrame, head: list) -> DataFrame:
    """The same with the run's distinct edges in one bracket, of which a network has a bounded number."""
    edges = paths.select(F.explode("path").alias("edge_id")).distinct().agg(F.sort_array(F.collect_list("edge_id")).alias("edges"))
    return edges.select(F.concat(F.lit(",".join(str(h) for h in [*head, 0]) + ","), bracketed("edges")).alias("line"))


def result_report(catalog: DataFrame, threshold: float, compress: int = -1, seconds: float = 0.0) -> DataFrame:
    """line_no, line of the coordinator's report: totals, then each pair of regions with its paths.

    Local paths and remainders belong to a region and itself; absorbed paths count in the total, but aren't listed unless
    they are an entry of another kind as well.
    """
    own = F.col("kind").isin("local", "remainder", "absorbed")
    home = F.when(F.col("kind") == "remainder", F.col("region_b")).otherwise(F.col("region_a"))
    rows = catalog.select(F.when(own, home).otherwise(F.col("region_a")).alias("a"), F.when(own, home).otherwise(F.col("region_b")).alias("b"), "path", "kind")
    totals = rows.agg(F.countDistinct(F.when(~own, F.struct("a", "b", "path"))).alias("spans"), F.countDistinct("a", "b", "path").alias("paths"))
    top = totals.select(F.posexplode(F.array(
        F.lit("TOP LEADER"), F.concat(F.lit("Total number of Span-HoMoPaths: "), F.col("spans").cast("string")),
        F.concat(F.lit("Total number of HoMoPaths : "), F.col("paths").cast("string")), F.lit("HoMoPaths Span Regions : "),
        F.lit(f"Exec Time : {seconds}"), F.lit(f"Threshold: {threshold} , Compress:{compress}"))).alias("line_no", "line"))
    texts = rows.where("kind <> 'absorbed'").select("a", "b", F.concat(F.lit("["), F.array_join(F.transform("path", lambda x: x.cast("string")), ", "), F.lit("],")).alias("t")).distinct()
    listed = texts.groupBy("a", "b").agg(F.array_join(F.sort_array(F.collect_list("t")), "").alias("t"))
    body = listed.select("a", "b", F.concat(F.lit("    "), F.col("b").cast("string"), F.lit(": "), F.col("t")).alias("line"))
    body = body.unionByName(listed.select("a").distinct().select("a", F.lit(None).cast("int").alias("b"), F.col("a").cast("string").alias("line")))
    order = Window.orderBy("a", F.col("b").asc_nulls_first())  # a row for each pair of regions
    return top.select("line_no", "line").unionByName(body.select((F.row_number().over(order) + 5).alias("line_no"), "line"))


def gather_bytes(paths_with_level_0: DataFrame) -> DataFrame:
    """region_id, n_bytes: size of the JSON object of levels and their lists of paths."""
    one = paths_with_level_0.select("region_id", "level", list_json_length("path").alias("n"))
    level = one.groupBy("region_id", "level").agg((F.sum("n") + 2 * (F.count("*") - 1) + 2 + F.octet_length(F.first("level").cast("string")) + 4).alias("n"))
    return level.groupBy("region_id").agg((F.sum("n") + 2 * (F.count("*") - 1) + 2).alias("n_bytes"))


def last_rows(log: DataFrame) -> DataFrame:
    """Of rows (line_no, threshold, k, ...) the last one for each (threshold, k)."""
    nth = F.row_number().over(Window.partitionBy("threshold", "k").orderBy(F.desc("line_no")))
    return log.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def pair_report(top: DataFrame, pairs: DataFrame) -> DataFrame:
    """top rows (line_no, threshold, k, head) with the codes of the pairs (threshold, k, pair) of the same run: threshold, k, head, codes."""
    listed = pairs.where("pair <> '[0]'").groupBy("threshold", "k").agg(F.sort_array(F.collect_list("pair")).alias("pairs"))
    text = F.concat(F.lit("["), F.array_join(pair_codes("pairs"), ","), F.lit("]"))
    return last_rows(top).join(listed, ["threshold", "k"], "left").select("threshold", "k", "head", F.coalesce(F.when(F.col("pairs").isNotNull(), text), F.lit("")).alias("codes"))


def replayed_lengths(costs_log: DataFrame) -> DataFrame:
    """compress, k of the first run of sketch rows behind the raw rows, of rows (line_no, k, compress); raw rows have -1 and -1.

    A log is one run's file, a row for each region and target: its order is a single sequence.
    """
    order = Window.orderBy("line_no")
    raw = (F.col("k") == -1) & (F.col("compress") == -1)
    marked = costs_log.withColumn("raw", raw.cast("int"))
    begins = F.when((F.col("raw") == 1) & (F.coalesce(F.lag("raw").over(order), F.lit(0)) == 0), 1).otherwise(0)
    block = F.sum(begins).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("block", block).where("block = 1 and raw = 0").groupBy("compress").agg(F.min_by("k", "line_no").alias("k"))


def folder_settings(folders: DataFrame) -> DataFrame:
    """folder, edges, objects, threshold, length and map out of names like 181_edges_10000_objects_60_percent_15_length_map16."""
    take = lambda p: F.regexp_extract("folder", p, 1).try_cast("long")
    return folders.select("folder", take(r"(\d+)_edges").alias("edges"), take(r"(\d+)_objects").alias("objects"), take(r"(\d+)_percent").alias("threshold"),
                          take(r"(\d+)_length").alias("length"), take(r"map_?(\d+)").alias("map"))
