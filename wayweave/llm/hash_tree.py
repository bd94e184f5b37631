"""Sharding by a hierarchical weighted hash tree of regions, racks and shards, in SQL expressions.

Shard s sits in region s // 16, rack (s // 4) mod 4 of it and place s mod 4 of
that. A key descends by weighted hash draws: every child of a node draws
-ln(u) / weight, u from the MD5 digest of the key and the node, and the least draw
wins. Regions, racks and places have weights of their own (a rack's and a region's are by
default the sums of what they can hold), so the shares follow the weights, and
changed weights move keys only between the children of nodes whose children's weights
changed: within a rack if only its places change, within a region if only its racks do.

A place that has no shard yet keeps its weight. A draw that ends there doesn't
count: the region draws again, later (its draws add up, as arrivals of a Poisson
process), and the region whose counting draw comes first takes the key. So a new
shard, also the first one of a new region, takes keys only into itself. After TURNS draws a
region is passed over (with one shard of 16 present, 1 key in 10^14).

The law is `key`: doc_id and the shards' weights decide, nothing else. A null
doc_id is one key. Rows of one doc_id share a shard. Slots number the rows of a
shard from 0 without gaps: equal rows are counted first and spread again, the others
ordered within hashed pieces of about PIECE_ROWS rows, so that no task sorts a whole shard
or a hot key. A null text has no bytes and crc32 0; very long texts are only measured. Extra
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from .frames import small, stash

RACKS, PLACES = 4, 4
REGION = RACKS * PLACES
SHARDS = 40
TURNS = 512
PIECE_ROWS = 1000
#: Equal rows that one task spreads at once.
SPREAD_ROWS = 10_000


@dataclass(frozen=True)
class Tree:
    """Weights of places (shards, then those to come), of racks and of regions; the first `shards` places have a shard."""

    shards: int
    places: tuple[float, ...]
    racks: tuple[float, ...]
    regions: tuple[float, ...]

    @staticmethod
    def of(weights: list[float], racks: list[float] | None = None, regions: list[float] | None = None) -> Tree:
        """A tree of shards of these weights; places without a shard weigh 1."""
        if not weights or min(weights) < 0 or not any(weights):
            raise ValueError("weights must not be negative, and not all be 0")
        places = [*map(float, weights), *[1.0] * (-len(weights) % REGION)]
        racks = racks or [sum(places[i:i + PLACES]) for i in range(0, len(places), PLACES)]
        regions = regions or [sum(racks[i:i + RACKS]) for i in range(0, len(racks), RACKS)]
        if (len(racks), len(regions)) != (len(places) // PLACES, len(places) // REGION):
            raise ValueError("one weight for every rack and region")
        return Tree(len(weights), tuple(places), tuple(racks), tuple(regions))


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _wait(digest: str, nth: int) -> str:
    """-ln(u), of the nth 8 hex digits of a digest."""
    return f"(-ln((cast(conv(substr({digest}, {8 * nth + 1}, 8), 16, 10) as double) + 0.5D) / 4294967296D))"


def _inverse(weight: float) -> str:
    return f"{1 / weight!r}D" if weight > 0 else "double('Infinity')"


def _least(digest: str, inverses: list[str]) -> str:
    """The child of the least draw (the first one on a tie)."""
    draws = ", ".join(f"named_struct('d', {_wait(digest, c)} * {w}, 'c', {c})" for c, w in enumerate(inverses))
    return f"array_min(array({draws})).c"


def _draw(tree: Tree, region: int, key: str, turn: str, before: str) -> str:
    """Struct (t, s): time of a region's draw and the shard it ends at, -1 if none is there."""
    racks = [_inverse(w) for w in tree.racks[region * RACKS:(region + 1) * RACKS]]
    own = [tree.places[region * REGION + r * PLACES:region * REGION + (r + 1) * PLACES] for r in range(RACKS)]
    places = [f"array({', '.join(_inverse(p[c]) for p in own)})[rk]" for c in range(PLACES)]
    shard = f"{region * REGION} + rk * {PLACES} + pl"
    end = f"named_struct('t', {before} + {_wait('h', 0)} * {_inverse(tree.regions[region])}, 's', if({shard} < {tree.shards}, {shard}, -1))"
    end = _let(f"md5(concat({key}, '|{region}.', rk, '|', {turn}))", "f", _let(_least("f", places), "pl", end))
    end = _let(f"md5(concat({key}, '|racks {region}|', {turn}))", "g", _let(_least("g", racks), "rk", end))
    return _let(f"md5(concat({key}, '|{region}|', {turn}))", "h", end)


def shard_sql(key: str, tree: Tree) -> str:
    """SQL for the shard of a key (a string column)."""
    firsts = []
    for region in range(len(tree.regions)):
        if tree.shards >= (region + 1) * REGION:
            firsts.append(_draw(tree, region, key, "0", "0D"))
        else:
            step = _draw(tree, region, key, "i", "a.t")
            firsts.append(f"aggregate(sequence(0, {TURNS - 1}), named_struct('t', 0D, 's', -1), (a, i) -> if(a.s >= 0, a, {step}))")
    return f"coalesce(array_min(filter(array({', '.join(firsts)}), x -> x.s >= 0)).s, 0)"


def key_sql(doc_id: str = "doc_id") -> str:
    return f"coalesce(cast(cast({doc_id} as bigint) as string), 'null')"


def assign(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    raw = F.col("text").cast("binary")
    rows = documents.select(F.col("doc_id").cast("long"), (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"), F.coalesce(F.crc32(raw), F.lit(0).cast("long")).alias("text_crc32"))
    own = ["doc_id", "size", "text_crc32"]
    now, grown = (shard_sql("k", Tree.of([1.0] * n)) for n in (shards, shards + 1))
    placed = stash(rows.groupBy(*own).agg(F.count("*").alias("n")).withColumn("k", F.expr(key_sql()))
                   .selectExpr(*own, "n", "k", f"{now} as shard", f"{grown} as grown_shard"))
    pieces = max(1, (placed.agg(F.sum("n")).first()[0] or 0) // (shards * PIECE_ROWS))
    split = placed.withColumn("piece", F.expr(f"cast(conv(substr(md5(k), 1, 8), 16, 10) as bigint) % {pieces}")).drop("k")
    upto = lambda *by: F.sum("n").over(Window.partitionBy("shard", *by).orderBy(*(["piece"] if not by else own)).rowsBetween(Window.unboundedPreceding, -1))
    sizes = split.groupBy("shard", "piece").agg(F.sum("n").alias("n"))
    starts = stash(sizes.select("shard", "piece", F.coalesce(upto(), F.lit(0)).alias("start")))
    counted = split.withColumn("before", F.coalesce(upto("piece"), F.lit(0))).join(small(starts), ["shard", "piece"])
    counted = counted.select(*own, "shard", "grown_shard", "n", (F.col("start") + F.col("before")).alias("first"))
    once = counted.where("n = 1").withColumn("slot", F.col("first"))
    parts = counted.where("n > 1").withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 1) div {SPREAD_ROWS})"))).repartition(F.xxhash64(*own, "part"))
    more = parts.withColumn("slot", F.explode(F.expr(f"sequence(first + part * {SPREAD_ROWS}, first + least(n, (part + 1) * {SPREAD_ROWS}) - 1)"))).drop("part")
    return once.unionByName(more).select(*own, F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard")
