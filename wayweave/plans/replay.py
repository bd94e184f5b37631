"""Past runs: their folders, and the same thresholds and signature lengths once more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import motions
from ..sources import text_io
from . import reports, sweep

#: File names of a run's folder.
EDGES, MOTIONS, COSTS = "1_combined_nodes_edges.txt", "3_Motions.txt", "Current_Experiment_Compare_RAW_HASh_NEW_formatted_paths_all_with_costs.txt"


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def archive(spark: SparkSession, files: list[str], folder: str) -> list[str]:
    """Moves those of the files (or folders) that exist into the folder, made anew if need be; the names moved. A name taken there is an error."""
    target, fs = _path(spark, folder)
    fs.mkdirs(target)
    moved = []
    for name in files:
        path, own = _path(spark, name)
        if not own.exists(path):
            continue
        goal, _ = _path(spark, f"{folder}/{path.getName()}")
        if fs.exists(goal) or not own.rename(path, goal):
            raise FileExistsError(f"{path.getName()} can't be moved to {folder}")
        moved.append(path.getName())
    return moved


def settings(spark: SparkSession, folder: str) -> dict[str, int | None]:
    """edges, objects, threshold (percent), length and map out of the folder's name."""
    name = folder.rstrip("/").rsplit("/", 1)[-1]
    return reports.folder_settings(spark.createDataFrame([(name,)], "folder string")).drop("folder").first().asDict()


def replay(spark: SparkSession, folder: str, threshold: float | None = None, depth: int = 2, max_level: int = 100, seed: int = 1) -> DataFrame:
    """The runs of a folder again, on its network and motions, as sweep.sweep gives them.

    The threshold is the name's unless given; targets and lengths are those of its log with costs; without a log there is only the exact run.
    """
    if threshold is None:
        percent = settings(spark, folder)["threshold"]
        if percent is None:
            raise ValueError(f"no threshold in the name of {folder}")
        threshold = percent / 100
    edges = text_io.read_edges(spark, f"{folder}/{EDGES}")
    seen = motions.invert(text_io.read_motions(spark, f"{folder}/{MOTIONS}"))
    log, fs = _path(spark, f"{folder}/{COSTS}")
    lengths = []
    if fs.exists(log):  # one row for each target
        found = reports.replayed_lengths(text_io.read_costs_log(spark, f"{folder}/{COSTS}")).orderBy("compress").collect()
        lengths = [(float(r.compress), r.k) for r in found]
    return sweep.lengths_sweep(edges, seen, [threshold], lengths, depth, max_level, seed)
