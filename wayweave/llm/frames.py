"""Spark plumbing shared by the corpus operators: tables, lineage cuts, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: Bytes (by count and by the lengths of texts and arrays) up to which a side of a join is broadcast,
#: and up to which it is if the other side is all texts or as large.
BROADCAST_BYTES, BESIDE_TEXTS = 8_000_000, 64_000_000
#: Edges that a single task may put together.
FEW_EDGES = 10_000
_ROOTS: dict[str, str] = {}
_SCRATCH: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables under spark.checkpoint.dir; a temporary one only in local mode, where it is shared by nature."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="wayweave-")
        _ROOTS[app] = f"{base.rstrip('/')}/tables-{app}"
        atexit.register(_delete, spark, _ROOTS[app])
    return _ROOTS[app]


def _delete(spark: SparkSession, root: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    path = jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _write(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{_shared_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stashed_at = path
    return back


def stash(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Cuts the lineage in storage that outlives an executor, and leaves no
    partitioning claim behind, so that a later join can split a hot key. Tables
    go by `discard`, at the end of the `scratch` they were made in, or with the application.
    """
    back = _write(df)
    if _SCRATCH:
        _SCRATCH[-1].append(back._stashed_at)
    return back


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing lazy reads any more."""
    for df in tables:
        if hasattr(df, "_stashed_at"):
            _delete(df.sparkSession, df._stashed_at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stashed inside go when the block ends."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            _delete(spark, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The written rows of make(), without the tables that it stashed on the way."""
    with scratch(spark):
        return _write(make())


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _extra(column: Column, kind: DataType) -> Column | None:
    """Bytes of a value beyond its eight."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.octet_length(column)
    if isinstance(kind, ArrayType):
        own = F.size(column) * 8
        inner = _extra(F.lit(None).cast(kind.elementType), kind.elementType)
        return own if inner is None else own + F.aggregate(column, F.lit(0), lambda a, x: a + F.coalesce(_extra(x, kind.elementType), F.lit(0)))
    if isinstance(kind, StructType):
        parts = [p for p in (_extra(column.getField(f.name), f.dataType) for f in kind) if p is not None]
        return sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(8 * len(kind)))
    return None


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast df if its counted bytes are at most `limit`; else leave the join to a shuffle."""
    parts = [p for p in (_extra(F.col(f"`{f.name}`"), f.dataType) for f in df.schema) if p is not None]
    each = sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(24 + 8 * len(df.columns)))
    return F.broadcast(df) if (df.agg(F.sum(each.cast("long"))).first()[0] or 0) <= limit else df


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, root) for the vertices of all edges (a, b), by union and find."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    ids = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())], names=["id", "up"])


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW_EDGES) -> DataFrame:
    """Connected components of an undirected graph over longs: rows (id, root) for every id in an edge, root the least id.

    Each round every vertex follows the neighbour (or itself) of the lowest
    keyed hash and the graph is contracted along those arrows; a round shrinks
    the vertices by a constant factor on average, paths and stars included. A
    hub's neighbours are only folded to a minimum, never gathered. Once no more than
    `few` edges are left, one task joins them.
    """
    spark = edges.sparkSession
    live = stash(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct())
    steps: list[DataFrame] = []
    turn = 0
    while (left := live.count()) > few:
        turn += 1
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), c.alias("v"))
        step = stash(
            both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m"))
            .select(F.col("a").alias("id"), F.least(F.col("m"), rank(F.col("a"))).getField("v").alias("up"))
        )
        steps.append(step)
        to = lambda c: step.select(F.col("id").alias(c), F.col("up").alias(f"{c}_up"))
        last, live = live, stash(
            live.join(to("a"), "a").join(to("b"), "b")
            .where("a_up <> b_up")
            .select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct()
        )
        discard(last)
    if left:
        steps.append(stash(live.coalesce(1).mapInArrow(_joined, "id long, up long")))
    if not steps:
        return spark.createDataFrame([], "id long, root long")
    found = steps[0]
    for step in steps[1:]:
        found = found.join(step.select(F.col("id").alias("up"), F.col("up").alias("next")), "up", "left").select(
            "id", F.coalesce("next", "up").alias("up"))
    found = stash(found)
    least = stash(found.groupBy("up").agg(F.min(F.least("id", "up")).alias("root")))
    discard(live, *steps)
    return found.join(least, "up").select("id", "root")
