"""Near-duplicate classes by BagMinHash over multisets of five-word shingles.

Signature. A shingle of multiplicity w owns Poisson processes on the weight
levels [0,1), [1,2), [2,4), [4,8), ... up to w, each of a rate in proportion to
its length. Points come in order of time from the shingle's hash alone; a
point of a level that only partly lies below w counts if its place in the
level does. Each point falls to one of M components, which keeps its earliest
time. Two components are equal with probability sum(min w) / sum(max w), the
weighted Jaccard similarity. Processes stop once they are later than every
component of their document, so the work is about M log M points and one point
for each shingle, whatever the weights.

Classes. Equal texts are folded first. Signatures are cut into BANDS bands of
ROWS components, and banding.classes verifies and clusters what shares a band by
the exact overlap of whole texts' multisets.

A pair at the threshold shares no band with probability (1 - 0.8^6)^40 < 6e-6.

Null and empty texts are equal texts (one class). Texts without words are
in a class only with equal texts. Texts of one to four words have a single
shingle. Classes belong to texts: a doc_id on rows of several texts takes the
least class of those, but does not join them. A null doc_id comes after all others, so a
class is named null only if no row of it has an id. Very long texts are signed whole, cut into words in pieces.
Of repeated rows one stays; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import text as tx
from .banding import Likeness, classes
from .frames import BESIDE_TEXTS, small, stash

THRESHOLD = 0.8
BANDS, ROWS = 40, 6
M = BANDS * ROWS
#: Arrays of points handled at once.
POINTS = 1 << 20
NO_ID = 2**63 - 1
_U = np.uint64


def _points(seed: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Waiting time at rate 1, place in the level, and component of the index-th point of each process."""
    h = tx.mix(seed + index.astype(_U) * _U(0x9E3779B97F4A7C15))
    wait = -np.log(((h >> _U(24)).astype(np.float64) + 0.5) * 2.0**-40)
    g = tx.mix(h ^ _U(0xD1B54A32D192ED03))
    place = (g >> _U(32)).astype(np.float64) * 2.0**-32
    return wait, place, ((g & _U(0xFFFFFFFF)) % _U(M)).astype(np.int64)


def signatures(values: np.ndarray, rows: np.ndarray, weights: np.ndarray, n_rows: int) -> np.ndarray:
    """Earliest times, n_rows x M; rows without elements stay infinite."""
    times = np.full((n_rows, M), np.inf)
    if not len(values):
        return times
    seeds, owner, size, share, start = [], [], [], [], 0
    low, high = 0, 1
    while True:  # level [low, high)
        at = np.flatnonzero(weights > low)
        if not len(at):
            break
        seeds.append(tx.mix(values[at] + _U(start * 0x632BE59BD9B4E019 % 2**64)))
        owner.append(rows[at])
        size.append(np.full(len(at), float(high - low)))
        share.append(np.minimum(weights[at] - low, high - low) / (high - low))
        low, high, start = high, 2 * high, start + 1
    seed, owner, size, share = (np.concatenate(x) for x in (seeds, owner, size, share))
    now, done, step = np.zeros(len(seed)), 0, 1
    while len(seed):
        step = max(1, min(2 * step if done > 1 else 1, POINTS // len(seed), 64))
        keep = np.empty(len(seed), bool)
        latest = times.max(axis=1)
        for lo in range(0, len(seed), POINTS // step):
            part = slice(lo, lo + POINTS // step)
            wait, place, comp = _points(seed[part, None], np.arange(done, done + step)[None, :])
            wait /= size[part, None] * M
            wait[:, 0] += now[part]
            t = np.add.accumulate(wait, axis=1)
            now[part] = t[:, -1]
            ok = (place < share[part, None]) & (t < latest[owner[part], None])
            flat = (owner[part, None] * M + comp)[ok]
            np.minimum.at(times.reshape(-1), flat, t[ok])
            keep[part] = True
        done += step
        keep &= now < times.max(axis=1)[owner]
        seed, owner, size, share, now = (x[keep] for x in (seed, owner, size, share, now))
    return times


def _sign(batches):
    for batch in batches:
        data, at = tx.utf8(batch.column("text"))
        h = batch.column("h1").to_numpy(zero_copy_only=False)
        _, one, back = np.unique(h, return_index=True, return_inverse=True)
        bands: list = [None] * len(one)
        sketch: list = [None] * len(one)
        sub = np.zeros(len(one) + 1, np.int64)
        np.cumsum(at[one + 1] - at[one], out=sub[1:])
        for lo, hi in tx.blocks(sub):
            picked = np.concatenate([data[at[i]:at[i + 1]] for i in one[lo:hi]]) if hi > lo else data[:0]
            words, rows = tx.words(picked, sub[lo:hi + 1] - sub[lo])
            sig = signatures(*tx.multiset(*tx.shingles(words, rows, hi - lo)), hi - lo)
            full = np.isfinite(sig[:, 0])
            bits = tx.mix(sig.view(_U))
            for i in np.flatnonzero(full):
                sketch[lo + i] = (bits[i] & _U(255)).astype(np.uint8).tobytes()
            grouped = bits.reshape(hi - lo, BANDS, ROWS)
            key = np.arange(BANDS, dtype=_U)[None, :] * _U(0x9E3779B97F4A7C15)
            for j in range(ROWS):
                key = tx.mix(key ^ grouped[:, :, j])
            for i in np.flatnonzero(full):
                bands[lo + i] = key[i].view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("h1"), batch.column("h2"),
             pa.array([bands[i] for i in back], pa.list_(pa.int64())), pa.array([sketch[i] for i in back], pa.binary())],
            names=["id", "h1", "h2", "bands", "sketch"])


def overlap(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact weighted Jaccard similarity of two multisets given as sorted values and counts."""
    if len(one[0]) > len(two[0]):
        one, two = two, one
    j = np.minimum(np.searchsorted(two[0], one[0]), len(two[0]) - 1) if len(two[0]) else np.zeros(0, np.int64)
    i = np.flatnonzero(two[0][j] == one[0])
    j = j[i]
    shared = int(np.minimum(one[1][i], two[1][j]).sum())
    return shared / max(1, int(one[1].sum() + two[1].sum()) - shared)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words, rows = tx.words(data, np.array([0, len(data)])) if len(data) else (np.zeros(0, _U), np.zeros(0, np.int64))
    return np.unique(tx.shingles(words, rows, 1)[0], return_counts=True)


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _text_classes(documents: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows (id, h1, h2) of all documents, and rows (h1, h2, class_id, keep) of their texts.

    class_id is the least doc_id of the class, keep the (id, h1, h2) that stands for it.
    """
    tx.small_batches(documents.sparkSession)
    texts = documents.select(_key().alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = texts.select("id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    signed = stash(hashed.mapInArrow(_sign, "id long, h1 long, h2 long, bands array<long>, sketch binary"))

    copies = stash(signed.groupBy("h1", "h2").agg(F.min("id").alias("rep")))
    reps = signed.join(copies.select(F.col("rep").alias("id"), "h1", "h2"), ["id", "h1", "h2"], "left_semi")
    reps = stash(reps.where("sketch is not null").dropDuplicates(["h1", "h2"]))
    how = Likeness(threshold, M, bag, lambda a, b, t: overlap(a, b) >= t)
    by_text = hashed.select(F.col("h1").alias("id"), "text")
    roots = classes(reps.select(F.col("h1").alias("id"), "bands", "sketch"),
                    lambda ids: by_text.join(small(stash(ids.distinct()), BESIDE_TEXTS), "id", "left_semi").distinct(), how)

    named = stash(copies.join(roots, F.col("h1") == F.col("id"), "left").select("h1", "h2", "rep", F.coalesce("root", "h1").alias("root")))
    least = stash(named.groupBy("root").agg(F.min(F.struct(F.col("rep").alias("id"), "h1", "h2")).alias("keep")))
    return signed.select("id", "h1", "h2"), stash(named.join(least, "root").select("h1", "h2", F.col("keep.id").alias("class_id"), "keep"))


def duplicate_classes(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class)."""
    rows, named = _text_classes(documents, threshold)
    out = rows.join(named, ["h1", "h2"]).groupBy("id").agg(F.min("class_id").alias("root"))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(known("id").alias("doc_id"), known("root").alias("class_id"))


def one_of_each(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents (all their columns) that stand for their class: one row each."""
    rows, named = _text_classes(documents, threshold)
    seen = stash(rows.groupBy("id", "h1", "h2").count().join(named, ["h1", "h2"])
                 .select("id", "h1", "h2", (F.struct("id", "h1", "h2") != F.col("keep")).alias("gone"), (F.col("count") > 1).alias("twice")))
    text = F.coalesce("text", F.lit(""))

    def of(some: DataFrame) -> tuple[DataFrame, Column]:
        some = small(stash(some.select(*(F.col(c).alias(f"__{c}") for c in ("id", "h1", "h2")))), BESIDE_TEXTS)
        return some, (_key() == some["__id"]) & (F.xxhash64(text) == some["__h1"]) & (F.xxhash64(F.lit(1), text) == some["__h2"])

    kept = documents.join(*of(seen.where("gone")), "left_anti")
    twice = seen.where("twice and not gone")
    if twice.isEmpty():
        return kept
    again = of(twice)
    one = kept.join(*again, "left_semi").withColumn("__text", text).dropDuplicates(["doc_id", "__text"]).drop("__text")
    return kept.join(*again, "left_anti").unionByName(one)
