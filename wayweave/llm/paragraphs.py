"""Repeated passages: paragraph MinHash banding, and a winnowed pass for passages inside longer paragraphs.

Paragraphs are lines of at least MIN_WORDS words. Their sets of five-word
shingles (as 32-bit hashes) get MinHash signatures; bands are tuned for high recall at the
threshold (`tune`). Paragraphs that share a band are verified by exact Jaccard
similarity of these sets and clustered by connected components. Every
paragraph of a class that occurs in two or more documents is repeated; it is kept
in the least of these documents (at its first place there) and removed everywhere else.

A passage that sits inside different paragraphs leaves them too unlike for
that. So runs of LENGTH words that occur in two or more documents are found
too, exactly: a word is repeated if such a run covers it, and removed if one of
these runs occurs in a document of a lesser id. What covers a removed word so has
a copy in a lesser document, and that copy's word is kept or has one in a still
lesser document: no word is removed everywhere, and no run is kept twice.

Every run has an anchor, the place of the least hash of K words in it (the last
one on a tie), which equal runs share; an anchor's runs start one after the other. Anchors
whose hash occurs in one document only are dropped. Of the others, those with all
words of all their runs alike are one variant, of which only the least document's is looked
at run by run, and that only if the hash has other variants.

Words are numbered from 0 in each text; `without_repeats` cuts the reported
words out of the texts. Nulls and texts without words have no paragraphs. Rows of one doc_id count as
one document, told apart by `version`, a hash of the text; rows of null doc_id count as
one document, the least. Repeated rows are reported once. Of ties, the first place is
kept. Very long texts are handled whole, and in pieces where words are cut. Extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from . import text as tx
from .banding import Likeness, classes
from .frames import BESIDE_TEXTS, discard, small, stash

THRESHOLD, RECALL = 0.8, 0.999
MIN_WORDS = 20
HASHES = 30
K, WINDOW = 20, 31
LENGTH = K + WINDOW - 1
NO_ID = -(2**63)
_U = np.uint64


def tune(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows of which a pair at the threshold still shares a band with probability `recall`."""
    rows = [r for r in range(1, hashes + 1) if 1 - (1 - threshold**r) ** (hashes // r) >= recall]
    r = max(rows, default=1)
    return hashes // r, r


BANDS, ROWS = tune()
_rng = np.random.default_rng(99)
_MULT = _rng.integers(0, 2**63, HASHES, dtype=np.int64).astype(_U) * _U(2) + _U(1)


def _lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all lines (a line feed ends one), and the row of each line."""
    ends = np.union1d(np.flatnonzero(data == 10) + 1, at[1:])
    cuts = np.unique(np.concatenate([at[:1], ends]))
    return cuts, np.searchsorted(at, cuts[:-1], "right") - 1


def minhash(values: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Least hashes, n_rows x HASHES, of shingles grouped by row (rows without any: the greatest value)."""
    out = np.full((n_rows, HASHES), 2**64 - 1, _U)
    order = np.argsort(rows, kind="stable")
    values, rows = values[order], rows[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    if len(first):
        for j in range(HASHES):
            h = values * _MULT[j]
            out[rows[first], j] = np.minimum.reduceat(h ^ (h >> _U(29)), first)
    return out


def shingle_sets(values: np.ndarray, rows: np.ndarray, n_rows: int) -> list[bytes]:
    """The distinct shingles of every row, as 32-bit hashes in order."""
    both = np.unique((rows.astype(_U) << _U(32)) | (values >> _U(32)))
    cuts = np.searchsorted(both >> _U(32), np.arange(n_rows + 1).astype(_U))
    low = both.astype(np.uint32)
    return [low[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


def bands(sets: str) -> Column:
    """Band keys of the MinHash signatures of a column of shingle sets."""

    @arrow_udf("array<long>")
    def run(found: pa.Array) -> pa.Array:
        size = np.array([len(x) for x in found.to_pylist()], np.int64) // 4
        values = tx.mix(np.frombuffer(b"".join(found.to_pylist()), np.uint32).astype(_U) + _U(1))
        key = bands_of(minhash(values, np.repeat(np.arange(len(size)), size), len(size))).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * BANDS), pa.array(key.ravel()))

    return run(F.col(sets))


def bands_of(sig: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=_U)[None, :] * _U(0x9E3779B97F4A7C15) + _U(1)
    for j in range(ROWS):
        key = tx.mix(key ^ sig[:, j:BANDS * ROWS:ROWS])
    return key


def _exact(words: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """One hash for each row's whole sequence of words."""
    begin = np.searchsorted(rows, np.arange(n))
    mixed = tx.mix(words + (np.arange(len(words)) - begin[rows]).astype(_U) * _U(0xD6E8FEB86659FD93))
    total = np.r_[_U(0), np.cumsum(mixed, dtype=_U)]
    end = np.searchsorted(rows, np.arange(n), "right")
    return tx.mix(total[end] - total[begin] + (end - begin).astype(_U))


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the (last) least value in every window of w."""
    n = len(h) - w + 1
    best, at, have = h.copy(), np.arange(len(h)), 1
    while have < w:
        by = min(have, w - have)
        m = len(best) - by
        later = best[by:] <= best[:m]
        best, at = np.where(later, best[by:], best[:m]), np.where(later, at[by:], at[:m])
        have += by
    return at[:n]


def grams(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of K words."""
    m = max(len(words) - K + 1, 0)
    h = np.zeros(m, _U)
    for j in range(K):
        h += words[j:j + m] * _U(pow(0x9E3779B97F4A7C15, j + 1, 2**64) | 1)
    return tx.mix(h)


def anchors(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first and last start of its runs, hash of K words) of all anchors; places and starts index words."""
    none = np.zeros(0, np.int64)
    if len(words) < LENGTH:
        return none, none, none, np.zeros(0, _U)
    h = grams(words)
    at = _window_min(h, WINDOW)
    starts = np.flatnonzero(rows[:len(at)] == rows[LENGTH - 1:])
    if not len(starts):
        return none, none, none, np.zeros(0, _U)
    at = at[starts]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (rows[starts[1:]] != rows[starts[:-1]])])
    last = np.r_[new[1:], len(starts)] - 1
    return at[new], starts[new], starts[last], h[at[new]]


def surroundings(words: np.ndarray, places: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of all words of the runs that start from lo to hi, by their distance from the anchor's place."""
    h = np.zeros(len(places), _U)
    for j in range(-WINDOW + 1, LENGTH):
        at = places + j
        ok = (at >= lo) & (at < hi + LENGTH)
        h[ok] += words[at[ok]] * _U(pow(0xD6E8FEB86659FD93, j + WINDOW, 2**64) | 1)
    return tx.mix(tx.mix(h + (places - lo).astype(_U)) + (hi - places).astype(_U))


def runs(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the runs of LENGTH words at starts."""
    h = np.zeros(len(starts), _U)
    for j in range(LENGTH):
        h += words[starts + j] * _U(pow(0xA24BAED4963EE407, j + 1, 2**64) | 1)
    return tx.mix(h)


_PIECES = "doc_id long, version long, kind string, start long, n_words long, hash long, shingles binary, lo long, hi long, around long"


def _batch(ids, versions, kind, start, n_words, hashes, shingles=None, lo=None, hi=None, around=None):
    none = lambda x, t: pa.array(x, t) if x is not None else pa.nulls(len(ids), t)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(versions, pa.int64()), pa.array([kind] * len(ids), pa.string()), pa.array(start, pa.int64()), none(n_words, pa.int64()),
         pa.array(hashes.view(np.int64)), none(shingles, pa.binary()), none(lo, pa.int64()), none(hi, pa.int64()), none(around, pa.int64())],
        names=[f.split()[0] for f in _PIECES.split(", ")])


def _cut(batches):
    for batch in batches:
        data, at = tx.utf8(batch.column("text"))
        ids, versions = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "version"))
        for lo, hi in tx.blocks(at):
            raw, off = data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
            if not len(raw):
                continue
            words, rows, begin, _ = tx.words_at(raw, off)
            cuts, owner = _lines(raw, off)
            line = np.searchsorted(cuts, begin, "right") - 1
            n_words = np.bincount(line, minlength=len(owner))
            long = np.flatnonzero(n_words >= MIN_WORDS)
            new = np.full(len(owner), -1)
            new[long] = np.arange(len(long))
            keep = new[line] >= 0
            hashes = _exact(words[keep], new[line[keep]], len(long))
            _, one = np.unique(hashes, return_index=True)
            fresh = np.full(len(long), -1)
            fresh[one] = np.arange(len(one))
            pick = keep.copy()
            pick[keep] = fresh[new[line[keep]]] >= 0
            sets, bags = shingle_sets(*tx.shingles(words[pick], fresh[new[line[pick]]], len(one)), len(one)), [None] * len(long)
            for i, own in zip(one, sets, strict=True):
                bags[i] = own
            doc, first = owner[long], np.searchsorted(rows, np.arange(hi - lo))
            yield _batch(ids[lo + doc], versions[lo + doc], "paragraph", np.searchsorted(line, long) - first[doc], n_words[long], hashes, bags)
            places, a, b, prints = anchors(words, rows)
            doc = rows[a]
            yield _batch(ids[lo + doc], versions[lo + doc], "passage", places - first[doc], None, prints, lo=a - first[doc], hi=b - first[doc],
                         around=surroundings(words, places, a, b).view(np.int64))


_GRAMS = "hash long, around long, doc_id long, several boolean, bit int, run long"
#: An anchor's place, the starts of its runs and whether several documents have it, in one number.
_PACKED = "place * 2048 + (place - lo) * 64 + (place - hi) * 2 + if(doc_id < last, 1, 0)"


def _run_by_run(batches):
    """All runs of texts at the anchors `spots` (three numbers each: _PACKED, hash, around)."""
    for batch in batches:
        data, at = tx.utf8(batch.column("text"))
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        spots, ends = batch.column("spots").flatten().to_numpy().reshape(-1, 3), np.cumsum([0, *batch.column("spots").value_lengths().to_pylist()]) // 3
        for lo, hi in tx.blocks(at):
            words, rows = tx.words(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
            packed, prints, around = spots[ends[lo]:ends[hi]].T
            doc = np.repeat(np.arange(hi - lo), np.diff(ends[lo:hi + 1]))
            place, before, after = packed // 2048, packed // 64 % 32, packed // 2 % 32
            n = before - after + 1
            own = np.repeat(np.arange(len(n)), n)
            back = before[own] - (np.arange(len(own)) - (np.cumsum(n) - n)[own])
            first = np.searchsorted(rows, np.arange(hi - lo))
            found = runs(words, place[own] - back + first[doc[own]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(prints[own]), pa.array(around[own]), pa.array(ids[lo + doc[own]], pa.int64()), pa.array(packed[own] % 2 == 1),
                 pa.array(back.astype(np.int32)), pa.array(found.view(np.int64))], names=[x.split()[0] for x in _GRAMS.split(", ")])


def _spans(batches):
    """Runs of words that are kept or removed, from the starts of repeated runs as bits below their anchors' places."""
    for batch in batches:
        marks = batch.column("marks")
        ids, versions = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "version"))
        sizes, flat = marks.value_lengths().to_numpy(), marks.flatten()
        place, seen, gone = (flat.field(c).to_numpy() for c in ("place", "seen", "gone"))
        if not len(place):
            continue
        first = np.cumsum(sizes) - sizes
        low = np.minimum.reduceat(place, first) - WINDOW
        room = np.maximum.reduceat(place, first) - low + LENGTH + 1
        shift = np.cumsum(room) - room - low  # a word's number and its text's shift make its place among the words of all texts
        at = place + np.repeat(shift, sizes)
        covered = []
        for bits in (seen, gone):
            step = np.zeros(int(room.sum()) + 1, np.int32)
            for o in range(WINDOW):
                start = at[(bits >> o) & 1 == 1] - o
                np.add.at(step, start, 1)
                np.add.at(step, start + LENGTH, -1)
            covered.append(np.cumsum(step) > 0)
        state = covered[0].astype(np.int8) + covered[1]
        edge = np.flatnonzero(np.diff(state, prepend=0, append=0))
        a, b = edge[:-1], edge[1:]
        a, b = a[state[a] > 0], b[state[a] > 0]
        doc = np.searchsorted(np.cumsum(room), a, "right")
        yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(versions[doc]), pa.array(a - shift[doc]), pa.array(b - a), pa.array(state[a] == 2)],
                                         names=["doc_id", "version", "start", "n_words", "removed"])


def bag(shingles: bytes) -> np.ndarray:
    return np.frombuffer(shingles, np.uint32)


def alike(one: np.ndarray, two: np.ndarray, threshold: float) -> bool:
    if min(len(one), len(two)) < threshold * max(len(one), len(two)):
        return False
    shared = int(np.isin(one, two, assume_unique=True).sum())
    return shared >= threshold * (len(one) + len(two) - shared)


def alike_many(sets: list[np.ndarray], threshold: float):
    """`alike` of one set and all of several."""
    size = np.array([len(x) for x in sets])
    owner, values = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)

    def run(one: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(one, values), len(one) - 1)
        shared = np.bincount(owner, one[at] == values, minlength=len(sets))
        return shared >= threshold * (len(one) + size - shared)

    return run


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("version"), F.coalesce("text", F.lit("")).alias("text"))


def repeated(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Repeated passages: doc_id, version, kind, start (number of the first word), n_words, first_doc, first_start, removed.

    kind `paragraph`: lines, each with the place of the one line that its class (component) keeps;
    kind `passage`: longest runs of words that are all kept or all removed.
    """
    tx.small_batches(documents.sparkSession)
    docs = _keyed(documents)
    pieces = stash(docs.mapInArrow(_cut, _PIECES))
    lines, prints = pieces.where("kind = 'paragraph'"), pieces.where("kind = 'passage'").select(
        "doc_id", "version", F.col("start").alias("place"), "lo", "hi", "hash", "around")

    place = F.struct("doc_id", "start", "version")
    nodes = stash(lines.groupBy(F.col("hash").alias("id")).agg(F.min(place).alias("at"), F.max("doc_id").alias("last")).select("id", "at.doc_id", "at.start", "at.version", "last"))
    sets = lines.where("shingles is not null").select(F.col("hash").alias("id"), F.col("shingles").alias("text"))

    def sets_of(ids: DataFrame) -> DataFrame:
        return sets.join(small(stash(ids.distinct()), BESIDE_TEXTS), "id", "left_semi").dropDuplicates(["id"])

    roots = stash(classes(sets.select("id", bands("text").alias("bands")), sets_of, Likeness(threshold, 0, bag, alike, alike_many)))
    named = stash(nodes.join(roots, "id", "left").select("id", "doc_id", "start", "version", "last", F.coalesce("root", "id").alias("class_id")))
    by_class = stash(named.groupBy("class_id").agg(F.min(F.struct("doc_id", "start", "version")).alias("first"), F.max("last").alias("last")).where("first.doc_id < last").select("class_id", "first"))
    hit = stash(named.select("id", "class_id").join(small(by_class), "class_id"))
    discard(nodes, roots, named, by_class)
    whole = lines.join(small(hit, BESIDE_TEXTS), F.col("hash") == F.col("id")).select(
        "doc_id", "version", "kind", "start", "n_words", F.col("first.doc_id").alias("first_doc"), F.col("first.start").alias("first_start"), (F.struct("doc_id", "start", "version") != F.col("first")).alias("removed")).distinct()
    none = F.lit(None).cast("long")
    inner = _passages(docs, prints).select("doc_id", "version", F.lit("passage").alias("kind"), "start", "n_words", none.alias("first_doc"), none.alias("first_start"), "removed")
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return whole.unionByName(inner).select(real("doc_id"), "version", "kind", "start", "n_words", real("first_doc"), "first_start", "removed")


def _bits(low: Column, high: Column) -> Column:
    """The bits from low to high."""
    one = lambda n: F.expr("shiftleft(1L, cast({} as int))".format(n))
    return one(f"({high}) + 1") - one(low)


def _passages(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """doc_id, version, start, n_words, removed of the words that repeated runs cover, from rows (doc_id, version, place, lo, hi, hash, around).

    Runs of one anchor are bits, counted from its place backwards.
    """
    common = prints.groupBy("hash").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("hash")
    hits = stash(prints.join(small(stash(common), BESIDE_TEXTS), "hash", "left_semi"))
    spot = F.struct("doc_id", "version", "place", "lo", "hi")
    variants = stash(hits.groupBy("hash", "around").agg(F.min(spot).alias("at"), F.max("doc_id").alias("last")).select("hash", "around", "at.*", "last"))
    crowded = variants.groupBy("hash").count().where("count > 1").select("hash")
    spots = stash(variants.join(small(stash(crowded)), "hash", "left_semi").groupBy("doc_id", "version").agg(
        F.flatten(F.collect_list(F.array(F.expr(_PACKED), "hash", "around"))).alias("spots")))  # a text's own anchors
    few = docs.join(small(spots.select("doc_id", "version"), BESIDE_TEXTS), ["doc_id", "version"], "left_semi")
    texts = few.join(small(spots, BESIDE_TEXTS), ["doc_id", "version"]).select("doc_id", "text", "spots")
    grams = stash(texts.mapInArrow(_run_by_run, _GRAMS))
    held = stash(grams.groupBy("hash", "run").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("end"), F.bool_or("several").alias("several")).where("several or keeper < end").select("hash", "run", "keeper"))
    bit = F.expr("shiftleft(1L, bit)")
    marked = grams.join(small(held), ["hash", "run"]).groupBy("hash", "around").agg(
        F.bit_or(bit).alias("seen"), F.bit_or(F.when(F.col("keeper") < F.col("doc_id"), bit).otherwise(0)).alias("gone"))
    every = _bits("place - hi", "place - lo")
    known = stash(variants.join(marked, ["hash", "around"], "left").select("hash", "around", F.col("doc_id").alias("least"), F.when(F.col("doc_id") < F.col("last"), every).otherwise(F.coalesce("seen", F.lit(0))).alias("seen"),
                                                                           F.coalesce("gone", F.lit(0)).alias("gone")).where("seen <> 0"))
    discard(grams, held, spots)
    later = F.col("doc_id") > F.col("least")
    marks = hits.join(small(known), ["hash", "around"]).select("doc_id", "version", F.struct("place", "seen", F.when(later, every).otherwise(F.col("gone")).alias("gone")).alias("mark"))
    listed = marks.groupBy("doc_id", "version").agg(F.collect_set("mark").alias("marks"))  # a text's own anchors, each once
    return listed.mapInArrow(_spans, "doc_id long, version long, start long, n_words long, removed boolean")


def without_repeats(documents: DataFrame, report: DataFrame) -> DataFrame:
    """documents (all their columns) with the words that `report` (of `repeated`) removes cut out of their texts, and what lies between two such words."""
    gone = report.where("removed").groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("__doc"), F.col("version").alias("__version")).agg(
        F.collect_set(F.struct("start", "n_words")).alias("__gone"))  # a text's own spans
    key = (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col("__doc")) & (F.xxhash64("text") == F.col("__version"))

    def cut(batches):
        for batch in batches:
            kept, spans = [], batch.column("__gone")
            for i, text in enumerate(batch.column("text")):
                if not spans[i].is_valid:
                    kept.append(text.as_py())
                    continue
                raw = np.frombuffer(text.as_py().encode(), np.uint8)
                _, _, begin, end = tx.words_at(raw, np.array([0, len(raw)]))
                out, last = [], 0
                for a, n in sorted((s["start"], s["n_words"]) for s in spans[i].as_py()):
                    out.append(raw[last:max(last, begin[a])].tobytes())
                    last = max(last, end[a + n - 1])
                kept.append(b"".join([*out, raw[last:].tobytes()]).decode("utf-8", "replace"))
            names = [n for n in batch.schema.names if n != "__gone"]
            yield pa.RecordBatch.from_arrays([pa.array(kept, batch.schema.field("text").type) if n == "text" else batch.column(n) for n in names], names=names)

    return documents.join(small(stash(gone), BESIDE_TEXTS), key, "left").drop("__doc", "__version").mapInArrow(cut, documents.schema)
