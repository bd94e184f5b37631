"""Classes of alike texts from bands and sketches, whatever the signature.

Leaders first: in each bucket of a band every member is verified against two
leaders, the least and the greatest id, so that a bucket of n costs 2n pairs, and
fewer where the same leaders come up in many buckets. Connected components of these links are classes, except that members
the leaders failed could still be linked to each other or to other members.
That rest is settled exactly: items that share a bucket across classes form
groups, and in each group all items outside its largest class are compared with
the whole group, block against block. Nothing is capped; only sketches that rule
a pair out (by MARGIN_SIGMAS standard deviations) spare it the exact comparison,
and only items of which a pair is not ruled out have their texts sent.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import BESIDE_TEXTS, components, discard, small, stash

MARGIN_SIGMAS = 4.5
QUERY_BLOCK, GROUP_BLOCK = 64, 256


@dataclass(frozen=True)
class Likeness:
    """How two texts are compared: a bag made of each, and a test of two bags (given the threshold).

    sketch is the length of the items' sketches (0: they have none), many a test of
    one bag against several, prepared once, if there is a faster one than their pairs'.
    """

    threshold: float
    sketch: int
    bag: Callable[[Any], Any]
    alike: Callable[[Any, Any, float], bool]
    many: Callable[[list, float], Callable[[Any], np.ndarray]] | None = None

    def least_equal(self) -> float:
        """Equal sketch bytes below which a pair is ruled out."""
        t = self.threshold
        return self.sketch * t - MARGIN_SIGMAS * (self.sketch * t * (1 - t)) ** 0.5


class _Bags:
    """Bags of recently used texts, bounded by their total length."""

    def __init__(self, how: Likeness, limit: int = 4_000_000):
        self.how, self.limit, self.held, self.kept = how, limit, 0, OrderedDict()

    def __call__(self, key: int, text: str | bytes):
        at = (key, hash(text))
        if at not in self.kept:
            self.kept[at] = (self.how.bag(text), len(text))
            self.held += len(text)
            while self.held > self.limit and len(self.kept) > 2:
                self.held -= self.kept.popitem(last=False)[1][1]
        return self.kept[at][0]


def _sketches(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)


def true_pairs(pairs: DataFrame, items: DataFrame, texts_of: Callable[[DataFrame], DataFrame], how: Likeness) -> DataFrame:
    """Of candidate pairs (a, b), those that are alike."""

    def likely(batches):
        for batch in batches:
            same = (_sketches(batch.column("sa"), how.sketch) == _sketches(batch.column("sb"), how.sketch)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(same >= how.least_equal()))

    def verified(batches):
        bags = _Bags(how)
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")), strict=True)
            ok = [how.alike(bags(a, s), bags(b, t), how.threshold) for a, b, s, t in rows]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    near = pairs
    if how.sketch:
        sa, sb = (items.select(F.col("id").alias(c), F.col("sketch").alias(f"s{c}")) for c in "ab")
        near = stash(pairs.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb").mapInArrow(likely, "a long, b long"))
    own = stash(texts_of(near.select(F.col("a").alias("id")).union(near.select("b")).distinct()))
    ta, tb = (own.select(F.col("id").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    return near.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(verified, "a long, b long")


_BLOCK = ["grp", "q", "g"]
_OWN = "grp long, q long, g long, asks boolean, id long, root long, minor boolean"


def _settle(rest: DataFrame, items: DataFrame, texts_of: Callable[[DataFrame], DataFrame], how: Likeness) -> DataFrame:
    """Links between items of one group and different roots, from rows (grp, id, root).

    If there are sketches they alone are dealt to the blocks first; texts follow only for what they don't rule out.
    """
    by_root = rest.groupBy("grp", "root").agg(F.count("*").alias("n"))
    groups = stash(by_root.groupBy("grp").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"))
                   .select("grp", F.col("top.root").alias("top"), F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("top.n")) / QUERY_BLOCK)).cast("long").alias("nq"),
                           F.greatest(F.lit(1), F.ceil(F.col("n") / GROUP_BLOCK)).cast("long").alias("ng")))
    extra = "sketch" if how.sketch else "text"
    own = items.select("id", "sketch") if how.sketch else stash(texts_of(rest.select("id")))
    sized = rest.join(own, "id").join(small(groups), "grp")
    same = ["id", "root", (F.col("root") != F.col("top")).alias("minor"), extra]
    query = sized.where("root <> top").select(
        "grp", F.pmod(F.xxhash64("id"), F.col("nq")).alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("ng") - 1)).alias("g"), F.lit(True).alias("asks"), *same)
    whole = sized.select(
        "grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)).alias("q"), F.pmod(F.xxhash64("id"), F.col("ng")).alias("g"), F.lit(False).alias("asks"), *same)
    blocks = query.unionByName(whole)

    def maybe(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        """Rows that ask, and the rows of other roots that aren't ruled out by their sketches."""
        asks = np.array(table.column("asks"))
        ids, roots, minor = (np.array(table.column(c)) for c in ("id", "root", "minor"))
        sk = _sketches(table.column("sketch"), how.sketch) if how.sketch else None
        them = np.flatnonzero(~asks)
        for x in np.flatnonzero(asks):
            # a pair of two minor items meets in both roles; it is looked at once
            ok = them[(roots[them] != roots[x]) & ~(minor[them] & (ids[them] < ids[x]))]
            if sk is not None:
                ok = ok[(sk[ok] == sk[x]).sum(axis=1) >= how.least_equal()]
            if len(ok):
                yield x, ok

    def likely(table: pa.Table) -> pa.Table:
        need = np.zeros(table.num_rows, bool)
        for x, ok in maybe(table):
            need[x] = need[ok] = True
        return table.filter(pa.array(need))

    def verified(table: pa.Table) -> pa.Table:
        """Links enough to join what the block's links join."""
        ids, roots, texts = np.array(table.column("id")), np.array(table.column("root")), table.column("text")
        bags, up, found = _Bags(how, 20_000_000), {}, []
        bag = lambda i: bags(int(ids[i]), texts[int(i)].as_py())
        every = how.many([how.bag(t) for t in texts.to_pylist()], how.threshold) if how.many else None

        def find(r: int) -> int:
            while up.setdefault(r, r) != r:
                up[r] = r = up[up[r]]
            return r

        for x, ok in maybe(table):
            if every:
                ok = ok[every(bag(x))[ok]]
            for y in ok:
                a, b = find(int(roots[x])), find(int(roots[y]))
                if a != b and (every or how.alike(bag(x), bag(y), how.threshold)):
                    up[a] = b
                    found.append((int(ids[x]), int(ids[y])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    if how.sketch:
        near = stash(blocks.groupBy(*_BLOCK).applyInArrow(likely, f"{_OWN}, sketch binary"))
        blocks = near.join(stash(texts_of(near.select("id"))), "id")
    return blocks.groupBy(*_BLOCK).applyInArrow(verified, "a long, b long")


def classes(items: DataFrame, texts_of: Callable[[DataFrame], DataFrame], how: Likeness, by_bucket: bool = False) -> DataFrame:
    """Rows (id, root) for every item with a link; items are rows (id, bands, sketch if there are any; without one also repeated), texts_of gives rows (id, text) for ids.

    by_bucket: what leaders leave apart is compared bucket by bucket; else in the components of
    shared buckets, which looks at a pair once but needs bands that unlike items rarely share.
    """
    banded = items.select("id", F.explode("bands").alias("key"))
    buckets = stash(banded.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi"))
    members = stash(banded.join(small(buckets, BESIDE_TEXTS), "key").distinct())
    led = members.select(F.least("lo", "id").alias("a"), F.greatest("lo", "id").alias("b"))
    led = led.union(members.select(F.least("hi", "id").alias("a"), F.greatest("hi", "id").alias("b")))
    links = stash(true_pairs(stash(led.where("a < b").distinct()), items, texts_of, how))
    roots = stash(components(links))

    placed = stash(members.select("key", "id").join(small(roots), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")))
    # leaders have seen all pairs of up to three members
    split = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("id").alias("first"), F.count("*").alias("n"))
    split = split.where("r0 < r1 and n > 3").select("key", "first")
    rest = stash(placed.join(small(stash(split)), "key").select("key", "first", "id", "root"))
    discard(buckets, members, placed)
    if rest.isEmpty():
        return roots
    if by_bucket:
        grouped = rest.select(F.col("key").alias("grp"), "id", "root")
    else:
        groups = components(rest.select(F.col("first").alias("a"), F.col("id").alias("b")).distinct())
        grouped = rest.select("id", "root").distinct().join(groups.select("id", F.col("root").alias("grp")), "id").select("grp", "id", "root")
    more = stash(_settle(stash(grouped), items, texts_of, how))
    return roots if more.isEmpty() else components(links.unionByName(more))
